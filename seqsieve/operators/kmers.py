"""k-mers and gapped k-mers of records, and the postings built from them.

A posting is ``(key, block, mask)``: bins are numbered in blocks of 64 and bit
``lane`` of ``mask`` says whether that bin of the block holds the key. Folding bins
with ``bit_or`` keeps one BIGINT of state per key and block, so a key that occurs
everywhere is combined map-side and never becomes an oversized group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqsieve.functions import alphabet

# Arrays exploded here are never empty. The *_outer forms keep the optimizer from adding
# "array is not empty" filters, which would compute every array twice.

# Sequences are cut into overlapping slices so that one very long record never
# becomes one array of all its positions.
SLICE = 16_384


def _slices(records: DataFrame, span: int, keep: list[str]) -> DataFrame:
    """One row per slice; windows of ``span`` residues lie in exactly one slice each."""
    size = F.octet_length("seq")
    # substring() of binary is a copy from an offset, of a string a walk from the start
    raw = F.col("seq").cast("binary")
    return (
        records.where(size >= span)
        .select(
            *keep,
            raw.alias("raw"),
            F.explode_outer(F.sequence(F.lit(1), size - span + 1, F.lit(SLICE))).alias("begin"),
        )
        .select(
            *keep,
            "begin",
            F.substring("raw", F.col("begin"), F.lit(SLICE + span - 1)).cast("string").alias("slice"),
        )
    )


def _window(text: str | Column, start: Column, size: int) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.substring(text.cast("binary"), start, F.lit(size)).cast("string")


def kmer_windows(
    records: DataFrame, k: int, molecule: str, reduction: str | None, keep: list[str]
) -> DataFrame:
    """Every k-mer of every record: ``keep`` columns, ``at`` (0-based) and ``kmer``.

    Nucleotide k-mers are canonical, but still in code order (see ``both_strands``)
    so that hot loops do two copies and one comparison only.
    """
    cut = _slices(records, k, keep)
    at = F.explode_outer(F.sequence(F.lit(1), F.octet_length("slice") - k + 1)).alias("i")
    if molecule == "na":
        forward, backward = alphabet.both_strands(F.col("slice"))
        rows = cut.select(*keep, "begin", forward.alias("fw"), backward.alias("bw"))
        rows = rows.select(*keep, "begin", "fw", "bw", F.octet_length("fw").alias("n"), F.explode_outer(
            F.sequence(F.lit(1), F.octet_length("fw") - k + 1)).alias("i"))
        mirrored = F.col("n") - F.col("i") - k + 2
        kmer = F.least(_window("fw", F.col("i"), k), _window("bw", mirrored, k))
    else:
        reduced = alphabet.reduce_alphabet(F.col("slice"), reduction).alias("slice")
        rows = cut.select(*keep, "begin", reduced).select(*keep, "begin", "slice", at)
        kmer = _window("slice", F.col("i"), k)
    return rows.select(*keep, (F.col("begin") + F.col("i") - 2).alias("at"), kmer.alias("kmer"))


def kmers(
    records: DataFrame,
    k: int,
    molecule: str = "aa",
    reduction: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """k-mers in plain letters, one row per occurrence."""
    keep = ["bin"] if keep is None else keep
    rows = kmer_windows(records, k, molecule, reduction, keep)
    return rows.withColumn("kmer", alphabet.from_code_order(F.col("kmer"))) if (
        molecule == "na"
    ) else rows


def lane_bit(lane: str | Column = "lane") -> Column:
    lane = F.col(lane) if isinstance(lane, str) else lane
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), lane)


def has_lane(mask: str | Column, lane: str | Column) -> Column:
    mask = F.col(mask) if isinstance(mask, str) else mask
    return mask.bitwiseAND(lane_bit(lane)) != 0


def kmer_postings(
    placed: DataFrame, k: int, molecule: str, reduction: str | None, ascii_only: bool = True
) -> DataFrame:
    """``(kmer, block, mask)`` of records that already carry ``block`` and ``lane``."""
    rows = kmer_windows(placed, k, molecule, reduction, ["block", "lane"])
    if not ascii_only:
        # windows are bytes; those touching other characters are never looked up
        rows = rows.where(~F.col("kmer").rlike(r"[^\x00-\x7F]"))
    postings = rows.groupBy("kmer", "block").agg(F.bit_or(lane_bit()).alias("mask"))
    if molecule == "na":
        postings = postings.withColumn("kmer", alphabet.from_code_order(F.col("kmer")))
    return postings


def dgram_windows(records: DataFrame, low: int, high: int, keep: list[str]) -> DataFrame:
    """Gapped k-mers as ``keep`` columns, ``gap`` and the six residue digits."""
    last = F.least(F.lit(high), F.octet_length("slice") - F.col("i") - 5)
    # slices carry the longest window behind every start, as far as the record goes
    size = F.length("seq")
    cut = (
        records.where(size >= low + 6)
        .select(
            *keep,
            alphabet.amino_digits(F.col("seq")).cast("binary").alias("raw"),
            F.explode_outer(F.sequence(F.lit(1), size - low - 5, F.lit(SLICE))).alias("begin"),
        )
        .select(
            *keep,
            F.substring("raw", F.col("begin"), F.lit(SLICE + high + 5)).cast("string").alias("slice"),
        )
    )
    starts = F.least(F.lit(SLICE), F.octet_length("slice") - low - 5)
    return (
        cut.select(*keep, "slice", F.explode_outer(F.sequence(F.lit(1), starts)).alias("i"))
        .select(*keep, "slice", "i", _window("slice", F.col("i"), 3).alias("left"), last.alias("last"))
        .where(F.instr("left", "~") == 0)
        .select(*keep, "slice", "i", "left", F.explode_outer(F.sequence(F.lit(low), F.col("last"))).alias("gap"))
        .select(
            *keep,
            "gap",
            F.concat("left", _window("slice", F.col("i") + F.col("gap") + 3, 3)).alias("residues"),
        )
        .where(F.instr("residues", "~") == 0)
    )


def dgram_postings(placed: DataFrame, low: int, high: int) -> DataFrame:
    """``(code, block, mask)`` of three residues, a gap in low..high, three residues."""
    return (
        dgram_windows(placed, low, high, ["block", "lane"])
        .groupBy("gap", "residues", "block")
        .agg(F.bit_or(lane_bit()).alias("mask"))
        .select(alphabet.dgram_code(F.col("gap"), F.col("residues")).alias("code"), "block", "mask")
    )
