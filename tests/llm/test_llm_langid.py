import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqsieve.llm import langid

SF = "/root/testdata/sf0.001"


def model_of(texts):
    def counted(text):
        return np.unique(langid._grams(np.frombuffer(b" " * langid.ORDER + text, np.uint8)), return_counts=True)

    return langid.Model.of({lang: counted(text) for lang, text in texts.items()})


MODEL = model_of({"one": b"the cat sat on the mat and the dog sat on the log", "two": "le chat était là où était le chien".encode()})


@pytest.mark.parametrize("context", [b"the", b"at ", b"xth", b"xxe", b"zzz", "é".encode() + b"t"])
@pytest.mark.parametrize("tree", [0, 1])
def test_code_lengths_are_those_of_a_distribution(context, tree):
    grams = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint32)
    assert np.exp2(-MODEL.trees[tree].bits(grams)).sum() == pytest.approx(1)


def test_blocks_add_up_to_single_bytes(monkeypatch):
    texts = [b"the cat", b"", b"dog sat " * 40, b"q", "où était ".encode() * 9]
    padded = [b"   " + t for t in texts]
    want = [[sum(tree.bits(np.array([int.from_bytes(p[i : i + 4], "big")], np.uint32))[0] for i in range(len(t))) for tree in MODEL.trees] for t, p in zip(texts, padded)]
    for block in (16, 100, 1 << 20):
        monkeypatch.setattr(langid, "BLOCK", block)
        assert np.allclose(MODEL.text_bits(texts), want, rtol=1e-5)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_held_out_accuracy_and_labels_unseen(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [(r.lang, got[r.doc_id].lang_pred) for r in docs.collect() if got[r.doc_id].held_out]
    assert held and sum(a == b for a, b in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    wrong = docs.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    again = {r.doc_id: r for r in langid.identify(wrong).collect()}
    assert again == got


def test_edges(table):
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "123 ... !!", "en", "s"), (None, "the cat sat", "en", None), (5, "le chien", None, "s"), (6, "LE CHIEN était", "fr", "s"), (6, "LE CHIEN était", "fr", "s"), (8, "the dog " * 40_000, "en", "s")]
    got = langid.identify(table(rows, clashing=True)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert {by_id[i].lang_pred for i in (1, 2, 3)} == {"und"} and by_id[1].score == 0
    assert by_id[8].lang_pred in ("en", "fr")
    assert langid.identify(table([])).collect() == []
    untaught = langid.identify(table([(1, "words", None, "s")])).collect()
    assert [(r.lang_pred, r.score) for r in untaught] == [("und", 0.0)]


def test_every_labelled_language_is_learned(table):
    """Few very long texts, many languages, and rows that share a null id."""
    long = [(i, f"{word} " * 4_000, word, "s") for word in ("alpha", "beta", "gamma", "delta") for i in range(3)]
    assert langid.learn(table(long), sample_chars=100).languages == ["alpha", "beta", "delta", "gamma"]
    many = [(None, f"some words of {i}", f"l{i:04}", "s") for i in range(1100)]
    assert len(langid.learn(table(many)).languages) == 1100
    same = [(None, f"text {chr(97 + i % 26)}{chr(97 + i // 26)}" * 20, "en", "s") for i in range(300)]
    tree = langid.learn(table(same), sample_chars=1_000).trees[0]
    assert 500 < tree.contexts[0][1].sum() < 5_000
