import random

import pytest

import corpus_pipeline as P
from seqsieve.llm import bpe, mixing
from seqsieve.llm.common import written


@pytest.fixture(scope="module")
def corpus(table):
    rng = random.Random(8)
    en = "the and of that with there where this from have been were which when their said each about"
    de = "der die und nicht eine auch sich mit dem für über können wird haben sein nach bei einer"
    make = lambda words, n: " ".join(rng.choice(words.split()) for _ in range(n))
    rows = [(i, make(en, 60), "en", f"s{i % 3}") for i in range(60)] + [(100 + i, make(de, 60), "de", "s0") for i in range(40)]
    near = make(en, 100).split()
    for i in range(8):
        copy = list(near)
        copy[i * 7] = "other"
        rows.append((200 + i, " ".join(copy), "en", "s1"))
    rows += [(300, rows[0][1], "en", "s2"), (301, f"{make(en, 60)} write to jane@mail.org or 10.0.0.1", "en", "s2")]
    rows += [(400, None, "en", "s1"), (401, "", "en", "s1"), (402, "12 34 !!", "en", None)]
    return rows


def test_stages(spark, table, corpus):
    docs = table(corpus)
    stages = dict(P.STAGES)
    assert list(stages) == ["language_id", "ngram_jaccard", "personal_data", "mix_sources", "byte_bpe"]
    seen = {}
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, ""))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    ids = {r[0] for r in corpus}
    assert set(seen["language_id"]) == ids - {400, 401, 402}
    # near copies: pairwise similar ones are joined, the smallest id stays
    assert set(seen["ngram_jaccard"]) == set(seen["language_id"]) - set(range(201, 208)) - {300}
    private = seen["personal_data"]
    assert set(private) == set(seen["ngram_jaccard"])
    # no other document has write, to or or: each discloses the addresses
    assert private[301] == seen["ngram_jaccard"][301].replace("write to jane@mail.org or 10.0.0.1", "  [email]  [ip]")
    assert all(private[i] == t for i, t in seen["ngram_jaccard"].items() if i != 301)
    copies = {r.doc_id: r.copies for r in mixing.mix_report(written(stages["personal_data"](spark, written(stages["ngram_jaccard"](spark, written(stages["language_id"](spark, table(corpus), "")), "")), ""))).collect()}
    assert docs.groupBy("doc_id").count().count() == sum(c > 0 for c in copies.values())
    assert {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()} == {k: v for k, v in copies.items() if v}
    last = stages["byte_bpe"](spark, docs, "").collect()
    codec = bpe.Codec(open(P.public_tokenizers.path(P.RANKS), "rb").read(), P.public_tokenizers.PATTERN)
    assert len(last) == sum(copies.values())
    assert all(r.n_tokens == len(codec.encode(private[r.doc_id])) for r in last)


def test_run_and_empty(spark, table, corpus, tmp_path):
    table(corpus, clashing=True).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert P.run(spark, f"{tmp_path}/a").count() > 50
    table([]).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert P.run(spark, f"{tmp_path}/b").collect() == []
