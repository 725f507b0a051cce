"""Clustered records, batches as tables and the automaton of literals."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import seqsieve as S
from seqsieve.functions.literals import held_numbers
from seqsieve.operators import batches, candidates
from seqsieve.operators import index as I
from test_search import frame, rows


def scanned_rows(df):
    """Rows that the file scans of an executed query handed on."""
    found = []

    def walk(plan):
        if plan.nodeName().startswith("Scan parquet"):
            found.append(plan.metrics().apply("numOutputRows").value())
        for child in [*([plan.executedPlan()] if "AdaptiveSparkPlan" in plan.nodeName() else []), *to_list(plan.children())]:
            walk(child)
        if "QueryStage" in plan.nodeName():
            walk(plan.plan())

    def to_list(seq):
        return [seq.apply(i) for i in range(seq.size())]

    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return sum(found)


@pytest.fixture(scope="module")
def many_bins(spark):
    rng = random.Random(2)
    data = [(f"bin{i:05d}", f"r{i}", "".join(rng.choice("ACDEFGHIKLMN") for _ in range(400))) for i in range(3000)]
    return data, S.build_index(spark.createDataFrame(data, "bin string, name string, seq string"), k=5)


def test_only_pages_of_candidate_bins_are_read(many_bins):
    data, index = many_bins
    word = data[1234][2][100:108]
    found = S.search(index, word)
    want = sorted((b, n, word, s.index(word), s.index(word) + 8) for b, n, s in data if word in s)
    assert sorted((r.bin, r.name, r.match, r.start, r.end) for r in found.collect()) == want
    assert 0 < scanned_rows(S.search(index, word)) < len(data) / 3
    plan = found._jdf.queryExecution().explainString(index.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [" in plan and "bin_id" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert "Exchange" not in plan and "Join" not in plan


def test_pruning_reaches_shards(spark, monkeypatch, many_bins):
    monkeypatch.setattr(I, "SHARD_RESIDUES", 100_000)
    data, _ = many_bins
    index = S.build_index(spark.createDataFrame(data, "bin string, name string, seq string"), k=5)
    assert index.meta["shards"] > 5
    word = data[77][2][10:18]
    assert rows(S.search(index, word).select("bin")) == rows(S.scan(index.records, word).select("bin"))
    files = {r[0] for r in index.of_bins(np.array([5])).select(F.input_file_name()).distinct().collect()}
    assert len(files) <= 2


def test_a_large_bin_is_cut_and_found(spark):
    data = [("big", f"r{i}", "ACDEFGHIK" * 20) for i in range(400)] + [("small", "s", "LMNPQRSTVWY")]
    index = S.build_index(frame(spark, data).repartition(4), k=3)
    assert S.search(index, "HIKACD").count() == 400 * 19 and S.search(index, "QRSTV").count() == 1


@pytest.mark.parametrize("seed", range(20))
def test_spans_cover_and_are_few(seed):
    rng = np.random.default_rng(seed)
    numbers = np.unique(rng.integers(0, 500, rng.integers(1, 200)))
    for limit in (1, 3, 50, 1000):
        spans = I.spans_of(numbers, limit)
        assert len(spans) <= limit and all(a <= b for a, b in spans)
        inside = [n for a, b in spans for n in range(a, b + 1)]
        assert set(numbers.tolist()) <= set(inside) and len(inside) == len(set(inside))
    assert sum(b - a + 1 for a, b in I.spans_of(numbers, 1000)) == len(numbers)


def test_settled_and_distributed_lookups_agree(many_bins, monkeypatch):
    data, index = many_bins
    motifs = {"one": data[5][2][:6], "two": f"({data[9][2][:5]}|{data[8][2][:6]})", "three": "A[CD]E.FG", "none": "QQQQQQ", "all": "AC"}
    settled = rows(S.candidate_bins_many(index, motifs))
    monkeypatch.setattr(candidates, "FETCHED_MASKS", 0)
    assert rows(S.candidate_bins_many(index, motifs)) == settled


def test_held_numbers(spark):
    rng = random.Random(3)
    literals = ["", "A", "AB", "ABA", "BAB", "AB", "ü"] + ["".join(rng.choice("ABC") for _ in range(4)) for _ in range(30)]
    texts = ["", "AB", "ABABA", "xüx", None] + ["".join(rng.choice("ABC") for _ in range(50)) for _ in range(20)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = [sorted(r[0]) for r in df.select(held_numbers(literals)("t")).collect()]
    assert got == [[n for n, a in enumerate(literals) if t is not None and a in t] for t in texts]
    assert df.select(held_numbers(["", ""])("t")).first()[0] == [0, 1]


@pytest.mark.parametrize("options", [{}, {"layout": "bloom"}, {"dgram_gaps": (1, 3)}], ids=str)
def test_table_of_motifs_of_all_kinds(spark, options, monkeypatch):
    rng = random.Random(5)
    data = [(f"b{i % 130}", f"r{i}", "".join(rng.choice("ACDEK") for _ in range(60))) for i in range(400)]
    index = S.build_index(frame(spark, data), k=3, **options)
    motifs = {"word": "ACDE", "loop": "(A|CA)+CD", "rich": "A[CDEK]{2}[ACDEK]{3}KD", "short": "K", "gap": "ACD.{2}KED", "start": "^AC", "absent": "WWW"}
    table = [*motifs.items(), ("word", "ACDE"), ("word", "EDCA")]
    want = sorted(rows(S.search_many(index, motifs)) + [("word", *r) for r in rows(S.search(index, "EDCA"))], key=repr)
    df = spark.createDataFrame(table, "id string, motif string")
    columns = ["motif_id", *S.search(index, "EDCA").columns]
    by_name = lambda found: sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    want = sorted(by_name(S.search_many(index, motifs)) + [("word", *r[1:]) for r in by_name(S.search_many(index, {"x": "EDCA"}))], key=repr)
    assert by_name(S.search_many(index, df)) == want
    assert by_name(S.search_many(index, df, augment=True, dgrams=True)) == want
    monkeypatch.setattr(batches, "ALTERNATIVES_LIMIT", 10)  # most motifs are then searched for everywhere
    monkeypatch.setattr(batches, "GROUP", 2)
    assert by_name(S.search_many(index, df)) == want


def test_table_candidates(spark, many_bins):
    data, index = many_bins
    motifs = {"one": data[5][2][:6], "two": data[9][2][:7], "none": "QQQQQQ"}
    df = spark.createDataFrame([*motifs.items(), ("any", "AC")], "id string, motif string")
    want = rows(S.candidate_bins_many(index, motifs))
    got = S.candidate_bins_many(index, df)
    assert rows(got.where("bin IS NOT NULL")) == want
    assert rows(got.where("bin IS NULL").select("motif_id")) == [("any",)]


def test_malformed_pattern_in_a_table_fails(spark, many_bins):
    df = spark.createDataFrame([("x", "A(B")], "id string, motif string")
    with pytest.raises(Exception, match="unbalanced"):
        S.search_many(many_bins[1], df).collect()


def test_many_unfiltered_motifs_share_a_pass(spark):
    rng = random.Random(7)
    data = [(f"b{i}", f"r{i}", "".join(rng.choice("ACDE") for _ in range(30))) for i in range(70)]
    index = S.build_index(frame(spark, data), k=4)
    motifs = {a + b + e: a + b + e for a in "ACDE" for b in "ACDE" for e in ("", ".", "[AC]", "(A|CA)*")}
    columns = ["motif_id", "bin", "name", "match", "start", "end"]
    want = sorted((m, *r) for m, p in motifs.items() for r in rows(S.scan(index.records, p).select(columns[1:])))
    assert rows(S.search_many(index, motifs).select(columns)) == want


def test_graphs_are_broadcast_in_bounded_groups():
    class Graph:
        def __init__(self, n):
            self.edges = range(n)

    sizes = [600_000, 500_000, 10, 2_000_000, 5]
    groups = candidates._in_groups({str(i): Graph(n) for i, n in enumerate(sizes)})
    assert [sorted(g) for g in groups] == [["0"], ["1", "2"], ["3"], ["4"]] and candidates._in_groups({}) == []
