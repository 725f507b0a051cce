"""Postings folded in arrays are those of the column expressions, in tasks of bounded size."""

import random

import numpy as np
import pyarrow as pa
import pytest

from seqsieve.operators import index as I
from seqsieve.operators import kmers as K
from seqsieve.operators import postings as R


def texts():
    draw = random.Random(3)
    letters = "ACDEFGHIKLMNPQRSTVWYXB"
    rows = [(f"r{i}", "".join(draw.choices(letters, k=draw.randrange(0, 90)))) for i in range(300)]
    return [*rows, ("none", None), ("none", None), ("empty", ""), ("short", "AC"), ("mixed", "ACDEÄGHIKLÖMNPQ"), ("long", "ACDEFGHIK" * 40)]


@pytest.fixture
def placed(spark):
    rows = [(name, seq, i % 7, i % 64) for i, (name, seq) in enumerate(texts())]
    return spark.createDataFrame(rows, "name string, seq string, block int, lane int")


def meta(k, reduction=None):
    return {"k": k, "reduction": reduction, "residues": 20_000, "n_blocks": 7, "n_records": 306}


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("k, reduction", [(3, None), (8, None), (5, "murphy")])
def test_kmers(placed, monkeypatch, k, reduction):
    monkeypatch.setattr(R, "STRETCH", 100)  # windows lie across stretches
    got = R.ranged_kmers(placed, meta(k, reduction), False, 5)
    want = K.kmer_postings(placed, k, "aa", reduction, False).where("length(kmer) > 0")
    assert rows(got) == rows(want)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1  # there were two, and a run more to find the ranges


def test_dgrams(placed, monkeypatch):
    monkeypatch.setattr(R, "STRETCH", 100)
    assert rows(R.ranged_dgrams(placed, meta(4), (1, 3), 5)) == rows(K.dgram_postings(placed, 1, 3))


def test_a_task_holds_bounded_rows(monkeypatch):
    monkeypatch.setattr(R, "HELD_ROWS", 500)
    monkeypatch.setattr(R, "STRETCH", 200)
    some = [(seq, i % 7, i % 64) for i, (_, seq) in enumerate(texts()) if seq]
    columns = [pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.string(), pa.int32(), pa.int32()), strict=True)]
    batch = pa.RecordBatch.from_arrays(columns, names=["seq", "block", "lane"])
    sizes = [len(key) for key, _, _ in R.fold_texts(iter([batch] * 3), R.kmer_keys(4, True), 4)]
    assert len(sizes) > 3 and max(sizes) <= 500 + 200


def test_bloom_bits_take_tasks_by_their_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(R, "ROWS_PER_TASK", 100)
    postings = spark.range(1000).selectExpr("hex(id) AS kmer", "0 AS block", "1L AS mask")
    I._write_bloom(postings, {"hash_count": 2, "bin_bits": 5000, "slot_bits": 5000}, str(tmp_path / "bloom"))
    assert len(list((tmp_path / "bloom").glob("slot=*/*.parquet"))) > 8


def test_rows_are_shuffled_and_folded_as_arrays(placed, monkeypatch):
    """Row by row, the aggregation of gapped k-mers took most of an index's time."""
    monkeypatch.setattr(R, "STRETCH", 100)
    monkeypatch.setattr(R, "SENT_ROWS", 64)  # many chunks of a range
    monkeypatch.setattr(R, "HELD_ROWS", 1000)  # a range is folded more than once
    got = R.ranged_dgrams(placed.repartition(6), meta(4), (1, 3), 2)
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == rows(K.dgram_postings(placed, 1, 3))


def test_chunks_travel_packed():
    """A row of a chunk took 20 bytes, whatever it held."""
    draw = np.random.default_rng(4)
    key = np.sort(draw.integers(0, 200_000_000, 50_000).astype(np.uint64))
    block, mask = draw.integers(0, 100, len(key)).astype(np.int32), np.left_shift(np.int64(1), draw.integers(0, 64, len(key)))
    bounds = np.array([50_000_000, 50_000_001, 120_000_000], np.int64)
    batches = list(R._chunks((key, block, mask), bounds))
    assert sum(batch.column("data").nbytes for batch in batches) < 5 * len(key)
    for got, want in zip(zip(*map(R._unpacked, batches), strict=True), (key, block, mask), strict=True):
        assert np.array_equal(np.concatenate(got), want)
    for rows in ((np.array([2**64 - 1], np.uint64), np.array([7], np.int32), np.array([-1])), tuple(np.zeros(0, k) for k in (np.uint64, np.int32, np.int64))):
        assert all(np.array_equal(a, b) for a, b in zip(R._unpacked_chunk(R._packed_chunk(list(rows)), len(rows[0])), rows, strict=True))


def test_gapped_kmers_are_stored_as_steps(placed, tmp_path):
    """As a dictionary or plain numbers, codes took most of the table."""
    import pyarrow.parquet as pq

    I._store_dgrams(R.ranged_dgrams(placed, meta(4), (1, 3), 1), str(tmp_path / "dgrams"))
    files = list((tmp_path / "dgrams").glob("gap=*/*.parquet"))
    columns = [c for f in files for c in map(pq.read_metadata(f).row_group(0).column, range(3)) if c.path_in_schema == "code"]
    assert columns and all("DELTA_BINARY_PACKED" in c.encodings for c in columns)
    stored = placed.sparkSession.read.parquet(str(tmp_path / "dgrams")).select("code", "block", "mask")
    assert rows(stored) == rows(K.dgram_postings(placed, 1, 3))
