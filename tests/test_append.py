"""Indexes that grow: the same answers as one built at once, before and after compaction."""

import random

import pytest
from pyspark.sql import functions as F

import seqsieve as S
from seqsieve.operators import candidates
from test_search import frame, rows

MOTIFS = {"a": "ACD", "b": "(AC|CA)DE", "c": "E.{2}ADC", "d": "A+CC", "e": "K", "f": "MNA", "g": "AC[DE]{2}A"}


def parts(rng):
    def text(letters="ACDE"):
        return "".join(rng.choice(letters) for _ in range(rng.randrange(2, 60)))

    first = [(f"b{i % 90}", f"r{i}", text()) for i in range(200)]
    second = [(f"b{i % 130}", f"s{i}", text("ACDEM")) for i in range(150)]  # known bins and new ones
    third = [(f"n{i}", f"t{i}", text("ACDEMN")) for i in range(80)]
    return [first, second, third]


def answers(index):
    found = rows(S.search_many(index, MOTIFS).select("motif_id", "bin", "name", "match", "start", "end"))
    bins = rows(S.candidate_bins_many(index, MOTIFS))
    counts = rows(index.bins.select("bin", "n_records", "n_indexed", "n_kmers", "residues"))
    return found, bins, counts


@pytest.mark.parametrize("options", [{}, {"dgram_gaps": (1, 3)}, {"layout": "bloom"}], ids=str)
def test_appended_equals_built_at_once(spark, options, monkeypatch):
    data = parts(random.Random(1))
    whole = S.build_index(frame(spark, sum(data, [])), k=3, **options)
    index = S.build_index(frame(spark, data[0]), k=3, **options)
    for more in data[1:]:
        index = S.append(index, frame(spark, more))
    want, got = answers(whole), answers(index)
    assert got[0] == want[0] and got[2] == want[2]
    exact = "layout" not in options
    assert not exact or got[1] == want[1]
    slots = index.bins.select("block", "lane", "bin_id").collect()
    assert len({(r.block, r.lane) for r in slots}) == len({r.bin_id for r in slots}) == len(slots) == index.n_bins
    single = {m: rows(S.search(whole, p, augment=True, dgrams=True)) for m, p in MOTIFS.items()}
    assert {m: rows(S.search(index, p, augment=True, dgrams=True)) for m, p in MOTIFS.items()} == single
    table = spark.createDataFrame(list(MOTIFS.items()), "id string, motif string")
    assert rows(S.search_many(index, table).select("motif_id", "bin", "name", "match", "start", "end")) == want[0]
    compacted = S.compact(index)
    again = answers(compacted)
    assert not compacted.segments and again[0] == want[0] and again[2] == want[2] and (not exact or again[1] == want[1])
    monkeypatch.setattr(candidates, "FETCHED_MASKS", 0)
    assert answers(index)[0] == want[0] and (not exact or answers(index)[1] == want[1])


def test_dgrams_of_a_grown_index(spark):
    data = parts(random.Random(2))
    index = S.append(S.build_index(frame(spark, data[0]), k=3), frame(spark, data[1]))
    index = S.load_index(spark, S.add_dgrams(index, 1, 2).path)
    assert rows(S.search(index, "ACD.ECA", augment=True, dgrams=True)) == rows(S.scan(index.records, "ACD.ECA"))


def test_a_failed_append_leaves_the_index_as_it_was(spark):
    data = parts(random.Random(3))
    index = S.build_index(frame(spark, data[0]), k=3)
    usual = answers(index)
    broken = frame(spark, data[1]).withColumn("seq", F.when(F.col("name") == "s70", F.raise_error(F.lit("lost"))).otherwise(F.col("seq")))
    with pytest.raises(Exception, match="lost"):
        S.append(index, broken)
    assert answers(S.load_index(spark, index.path)) == usual
    assert S.append(index, frame(spark, data[1]).limit(0)).n_bins == index.n_bins


def test_stream_of_files(spark, tmp_path):
    data = parts(random.Random(4))
    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, records):
        (folder / name).write_text("".join(f">{n} note\n{s[:20]}\n{s[20:]}\n" for _, n, s in records))

    from seqsieve.sources.fasta import read_fasta

    put("one.fa", data[0])
    index = S.build_index(read_fasta(spark, [str(folder / "one.fa")]), k=3)
    (folder / "one.fa").rename(tmp_path / "one.fa")
    checkpoint = str(tmp_path / "checkpoint")
    for name, records in (("two.fa", data[1]), ("three.fa", data[2])):
        put(name, records)
        S.append_stream(index, str(folder), checkpoint).awaitTermination()
    S.append_stream(index, str(folder), checkpoint).awaitTermination()
    grown = S.load_index(spark, index.path)
    assert grown.n_bins == 3 and len(grown.segments) == 2
    names = {n for group in data for _, n, s in group if "ACD" in s}
    assert {r.name for r in S.search(grown, "ACD").collect()} == names
    # a batch that is run again changes nothing
    again = S.append(grown, grown.records.limit(5), (checkpoint, 0))
    assert again.meta["n_records"] == grown.meta["n_records"]
