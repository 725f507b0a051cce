"""Batches of literals read a text once; profiles travel as bytes."""

import random

import numpy as np
import pyarrow as pa

import seqsieve as S
from seqsieve.functions import literals
from seqsieve.functions.literals import literal_spans
from seqsieve.operators import batches, profiles
from seqsieve.operators import search as X


def rows():
    draw = random.Random(11)
    texts = ["", "AAAAAAA", "ACACACA", *("".join(draw.choices("ACDE", k=draw.randrange(50))) for _ in range(60))]
    return [(f"b{i % 9}", f"r{i}", text) for i, text in enumerate(texts)] + [("b1", "none", None), ("b1", "none", None)]


def found(df):
    return sorted((r.bin, r.name, r.motif_id, r.match, r.start, r.end) for r in df.collect())


def test_literals_of_a_table(spark, monkeypatch):
    index = S.build_index(spark.createDataFrame(rows(), "bin string, name string, seq string"), k=3)
    literals = ["AAA", "ACA", "ACAC", "ACDE", "DEAC", "EEE", "AAAA", "CDED"]
    other = {"o1": "AC[DE]A", "o2": "A"}
    table = [*((w, w) for w in literals), ("twin", "ACA"), *other.items()]
    want = found(S.search_many(index, dict(table)))
    monkeypatch.setattr(batches, "LITERALS", 4)  # several groups
    motifs = spark.createDataFrame(table, "id string, motif string")
    assert found(S.search_many(index, motifs)) == want
    # every pair of text and literal was a row that was searched again
    plan = S.search_many(index, motifs.where("length(motif) > 2 AND id NOT LIKE 'o%'"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "contains" not in plan.lower()


def test_literal_spans(spark):
    texts = spark.createDataFrame([("AAAAA",), ("ÄACA",), (None,), ("",)], "seq string")
    got = texts.select(literal_spans(["AA", "ACA", "A"])("seq").alias("s")).collect()
    assert [sorted(map(tuple, r.s)) for r in got] == [
        [(0, 0, 2), (0, 2, 4), (2, 0, 1), (2, 1, 2), (2, 2, 3), (2, 3, 4), (2, 4, 5)], [(1, 1, 4), (2, 1, 2), (2, 3, 4)], [], []
    ]


def test_literals_against_plain_search(spark, monkeypatch):
    """Literals that overlap themselves, long ones and several tables, in texts of any characters."""
    draw = random.Random(12)
    words = sorted({"".join(draw.choices("ABÄ", k=draw.randrange(1, 9))) for _ in range(60)})
    texts = [None, "", *("".join(draw.choices("ABÄ\U0001f600", k=draw.randrange(50))) for _ in range(40))]
    want = []
    for t, text in enumerate(texts):
        for word in words:
            at = (text or "").find(word)
            while at >= 0:
                want.append((t, word, at, at + len(word)))
                at = text.find(word, at + len(word))
    for cells, depth in ((1 << 24, 32), (40, 32), (1 << 24, 3)):
        monkeypatch.setattr(literals, "CELLS", cells)
        monkeypatch.setattr(literals, "DEPTH", depth)
        counts, *columns = literals.LiteralFinder(words).spans(pa.array(texts, pa.string()))
        got = zip(np.repeat(np.arange(len(texts)), counts).tolist(), *(c.tolist() for c in columns), strict=True)
        assert sorted((t, words[n], s, e) for t, n, s, e in got) == sorted(want)


def lookup_index(spark, layout="exact"):
    draw = random.Random(13)
    rows = [(f"b{i:03d}", f"r{i}", "".join(draw.choices("ACDEF", k=draw.choice([2, 5, 9, 30])))) for i in range(150)]
    return S.build_index(spark.createDataFrame(rows, "bin string, name string, seq string"), k=3, layout=layout), rows


def test_masks_of_groups(spark):
    """The lookup made a row for every motif, key and block; a group is looked up further only where it has no bin yet."""
    index, rows = lookup_index(spark)
    words = {g: ["ACD", "CDEF", "FFEDA", "ACDAC"][g:] for g in range(4)}
    motifs = spark.createDataFrame([(w, w) for own in words.values() for w in own], "id string, motif string")
    table = batches.prepared(index, motifs, False, False, True)
    groups = spark.createDataFrame([(g, w) for g, own in words.items() for w in own], "g int, motif_id string")
    got = batches.group_masks(index, groups.join(table, "motif_id"), "g").join(index.bins, "block").where("(mask & shiftleft(1L, lane)) != 0")
    kmers = lambda w: {w[i : i + 3] for i in range(len(w) - 2)}
    want = {(g, b) for g, own in words.items() for b, _, t in rows for w in own if kmers(w) <= kmers(t)}
    assert {(r.g, r.bin) for r in got.collect()} == want


def test_literals_are_prepared_as_patterns_are(spark):
    index, _ = lookup_index(spark)
    words = ["AC", "ACD", "ACDACD", "ACX", "aCD", "CDEFA"]
    table = spark.createDataFrame([(w, w) for w in words], "id string, motif string")
    frame = batches.prepared(index, table, False, False, True)
    assert frame.inputFiles() and frame.count() == len(words)
    for row in frame.collect():
        motif = X.prepare(row.pattern, row.motif_id)
        graph = X.motif_graph(motif, index.shape(False), "aa")
        keys = [] if graph.needs_no_key() else [set(a) for a in graph.required_sets(100)]
        names = {n: key[1:] for key, n in graph.keys.items()}
        assert [row.regex, row.literal, row.walk, row.testable] == [motif.regex, motif.literal, motif.walk, motif.testable]
        assert row.unfiltered == graph.needs_no_key()
        assert [(k.part, k.needed, k.key_no, k.kmer) for k in row["keys"]] == [(p, len(a), n, names[n]) for p, a in enumerate(keys) for n in sorted(a)]


def test_profiles_travel_as_bytes(spark):
    cells = spark.createDataFrame([("p", i, c, 1.0) for i in range(50) for c in "ACDEFGHIKLMNPQRSTVWY"], "profile_id string, position int, residue string, weight double")
    least = spark.createDataFrame([("p", 50.0)], "profile_id string, threshold double")
    planned = profiles._planned(cells, least, 4)
    assert dict(planned.dtypes)["cells"] == "binary"  # were 1,000 objects for every text
    assert len(planned.first().cells) == 50 * 20 * 16
