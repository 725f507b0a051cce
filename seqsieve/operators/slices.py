"""Matches in very long records, cut into slices that many tasks share.

A slice owns the matches that start in it. It carries a halo: behind, as much text as a match
can reach; in front, a run-up in which its own search begins. Matches do not overlap, so what a
slice finds depends on where the last match before it ended. The run-up mostly makes the slice
arrive at the same matches as its neighbour, and this is checked at every seam: the match that
crosses it must be the same from both sides. By induction from the first slice, a record whose
seams all agree has exactly the matches of one search from its start. The others (a repeat that
never lets the run-up settle) are searched whole.

A record may be longer than any row: ``joined`` lays the texts of many rows end to end, in pieces
that carry halos of fixed size and are indexed and searched as the slices above. Records whose
seams do not agree are then searched piece after piece, from where the last match ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqsieve.functions.spans import FirstMatcher, LongestMatcher
from seqsieve.plans import pattern as P
from seqsieve.session import remove_folder, scratch_folder, ship_package

CUT = 1 << 18  # residues above which a record is cut
SLICE = 1 << 16
#: Of joined records: residues that a piece owns, and its halos in front and behind.
PIECE, LEAD, BEHIND = 1 << 14, 1280, 256
JOINED_BYTES = 64 << 20  # of texts that one task puts in order


def reach(node) -> int | None:
    """How far a match can reach, for patterns that may be searched for in slices."""
    sizes = P.lengths(node)
    if sizes is None or P._has(node, lambda n: isinstance(n, P.Anchor)):
        return None
    return max(sizes) if max(sizes) <= SLICE // 16 else None


def in_slices(hits: DataFrame, kept: list[str], reach: int, spans: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Matches of texts (ASCII) that hold one: ``kept``, match, start and end.

    ``spans`` finds the matches of the texts it is given.
    """
    lead = min(SLICE // 2, 4 * reach + 256)
    key = [*kept, "_size"]
    sized = hits.withColumn("_size", F.octet_length("seq"))
    begins = F.explode(F.sequence(F.lit(0), F.greatest(F.col("_size") - 1, F.lit(0)), F.lit(SLICE)))
    others = [c for c in hits.columns if c != "seq"]
    cut = sized.select(*others, "_size", F.col("seq").cast("binary").alias("_raw"), begins.alias("_begin"))
    first = F.greatest(F.col("_begin") - lead, F.lit(0))
    piece = F.substring("_raw", first + 1, F.col("_begin") - first + SLICE + reach - 1).cast("string")
    cut = cut.select(*others, "_size", "_begin", first.alias("_first"), piece.alias("seq"))
    # a number is given, as otherwise tasks would be joined until they read enough bytes
    tasks = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = cut.repartition(tasks, *key, "_begin")
    own, unsettled = _settled(spans(cut), key, SLICE)
    columns = [*kept, "match", "start", "end"]
    if unsettled.isEmpty():
        return own.select(columns)
    settled = own.join(unsettled, _same(own, unsettled, key), "left_anti")
    whole = sized.join(unsettled, _same(sized, unsettled, key), "left_semi")
    return settled.select(columns).unionByName(spans(whole).select(columns))


def _settled(found: DataFrame, key: list[str], size: int) -> tuple[DataFrame, DataFrame]:
    """The matches that slices of ``size`` own, and the records in which two do not agree.

    ``found``: what the slices (``_begin``, text from ``_first``) hold.
    """
    spark = found.sparkSession
    found = found.select(
        *key, "_begin", "match", (F.col("start") + F.col("_first")).alias("start"), (F.col("end") + F.col("_first")).alias("end")
    )
    path = scratch_folder(spark)
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    behind = F.col("_begin") + size
    own = found.where((F.col("start") >= F.col("_begin")) & (F.col("start") < behind))
    open_ = found.select(*key, "end", F.explode(F.array(
        F.struct(F.col("_begin").alias("seam"), F.lit(0).alias("side")), F.struct(behind.alias("seam"), F.lit(1).alias("side"))
    )).alias("at"), "start").where("start < at.seam AND end > at.seam AND at.seam < _size")
    unsettled = (
        open_.groupBy(*key, "at.seam")
        .agg(F.min("end").alias("low"), F.max("end").alias("high"), F.min("at.side").alias("left"), F.max("at.side").alias("right"))
        .where("low <> high OR left = right")
        .select(*key)
        .distinct()
    )
    path = scratch_folder(spark)
    unsettled.write.parquet(path)
    return own, spark.read.schema(unsettled.schema).parquet(path)


# ------------------------------------------------------- records longer than a row
def joined(parts: DataFrame, order: str) -> DataFrame:
    """Records (bin, name) made of the texts of many rows, by ``order`` and text, in pieces.

    A piece (bin, name, seq) owns PIECE residues from ``piece_begin`` on, its text begins at
    ``piece_first`` and its record has ``piece_size``. Null texts are empty; rows that are equal
    come in as often as they are. No task holds a record, and no row more than a piece or a part.
    """
    spark = parts.sparkSession
    ship_package(spark)
    parts = parts.select("bin", "name", F.col(order).alias("_order"), F.coalesce("seq", F.lit("")).alias("seq"))
    first, second, path = (scratch_folder(spark) for _ in range(3))
    parts.write.parquet(first)
    parts = spark.read.schema(parts.schema).parquet(first)
    size = parts.agg(F.coalesce(F.sum(F.octet_length("seq").cast("bigint")), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // JOINED_BYTES)
    ordered = parts.repartitionByRange(tasks, "bin", "name", "_order").sortWithinPartitions("bin", "name", "_order", "seq")
    numbered = ordered.select("bin", "name", F.spark_partition_id().alias("_task"), F.length("seq").cast("bigint").alias("_length"), "seq")
    kinds = {f.name: f.dataType.simpleString() for f in numbered.schema}
    placed = numbered.mapInArrow(_running, ", ".join(f"{c} {kind}" for c, kind in [*kinds.items(), ("_inside", "bigint")]))
    placed.write.parquet(second)
    placed = spark.read.schema(placed.schema).parquet(second)

    key = ["bin", "name", "_task"]
    record = Window.partitionBy("bin", "name")
    earlier = record.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*key).agg(F.sum("_length").alias("_sum"))  # a row per record and task
    totals = totals.select(
        *[F.col(c).alias(f"_of_{c}") for c in key],
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"), F.sum("_sum").over(record).alias("piece_size"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in key]
    placed = placed.join(totals, same[0] & same[1] & same[2]).withColumn("_at", F.col("_base") + F.col("_inside"))
    placed = placed.where("_length > 0 OR _at = 0")  # an empty record is one empty piece

    # every part goes to the pieces that it reaches into
    low = F.greatest(F.floor((F.col("_at") - BEHIND) / PIECE), F.lit(0))
    last = F.floor((F.greatest("piece_size", F.lit(1)) - 1) / PIECE)
    high = F.least(last, F.greatest(F.floor((F.col("_at") + F.col("_length") + LEAD - 1) / PIECE), low))
    dealt = placed.withColumn("_piece", F.explode(F.sequence(low, high)))
    dealt = dealt.withColumn("piece_begin", F.col("_piece") * PIECE)
    dealt = dealt.withColumn("piece_first", F.greatest(F.col("piece_begin") - LEAD, F.lit(0)))
    start = F.greatest("_at", "piece_first")
    end = F.least(F.col("_at") + F.col("_length"), F.col("piece_begin") + PIECE + BEHIND)
    text = F.substring("seq", (start - F.col("_at") + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
    glued = F.array_sort(F.collect_list(F.struct(start.alias("at"), text.alias("text"))))
    glued = F.array_join(F.transform(glued, lambda part: part["text"]), "")
    pieces = dealt.groupBy("bin", "name", "piece_begin", "piece_first", "piece_size").agg(glued.alias("seq"))
    pieces.write.parquet(path)
    for step in (first, second):
        remove_folder(spark, step)
    return spark.read.schema(pieces.schema).parquet(path)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what of its record lies before each part in this task."""
    record, total = None, 0
    for batch in batches:
        before = []
        for bin, name, size in zip(*(batch.column(c).to_pylist() for c in ("bin", "name", "_length")), strict=True):
            if (bin, name) != record:
                record, total = (bin, name), 0
            before.append(total)
            total += size
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64())], names=[*batch.schema.names, "_inside"])


def in_pieces(hits: DataFrame, kept: list[str], nodes: dict, spans: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Matches of ``joined`` records, by their pieces that may hold one: ``kept``, match, start and end.

    ``nodes``: by motif id its pattern, and whether the longest matches are wanted.
    """
    key = [*kept, "_size"]
    names = {"piece_begin": "_begin", "piece_first": "_first", "piece_size": "_size"}
    pieces = hits.select(*[F.col(c).alias(names.get(c, c)) for c in hits.columns if c in {*kept, *names, "regex", "seq"}])
    own, unsettled = _settled(spans(pieces), key, PIECE)
    columns = [*kept, "match", "start", "end"]
    if unsettled.isEmpty():
        return own.select(columns)
    settled = own.join(unsettled, _same(own, unsettled, key), "left_anti")
    again = pieces.join(unsettled, _same(pieces, unsettled, key), "left_semi")
    return settled.select(columns).unionByName(_in_order(again, key, nodes, own.schema).select(columns))


def _in_order(pieces: DataFrame, key: list[str], nodes: dict, schema) -> DataFrame:
    """Matches of records searched piece after piece; a task holds one batch of pieces at a time."""
    ship_package(pieces.sparkSession)
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size, own_key = PIECE, [schema[c] for c in key]
    types = [(c, schema[c].dataType) for c in ("match", "start", "end")]
    declared = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own_key)
    declared += "".join(f", {name} {kind.simpleString()}" for name, kind in types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = {m: (LongestMatcher if longest else FirstMatcher)(node) for m, (node, longest) in nodes.items()}
        record, resume = None, 0
        for batch in batches:
            for i in range(len(batch)):  # a batch of output per piece
                row = batch.slice(i, 1)
                name = tuple(row.column(c)[0].as_py() for c in key)
                begin, first, text = (row.column(c)[0].as_py() for c in ("_begin", "_first", "seq"))
                resume = max(begin, resume if name == record else 0)
                record = name
                at = resume
                motif = row.column("motif_id")[0].as_py()
                found = [(s["match"], s["start"] + at, s["end"] + at) for s in matchers[motif].spans(text[at - first :])]
                found = [s for s in found if s[1] < begin + size]
                if not found:
                    continue
                resume = found[-1][2]
                again = pa.array([0] * len(found), pa.int32())
                columns = [row.column(c).take(again) for c in key]
                columns += [pa.array(c) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*key, "match", "start", "end"])

    dealt = pieces.select(*key, "_begin", "_first", "seq").repartition(tasks, *key).sortWithinPartitions(*key, "_begin")
    return dealt.mapInArrow(run, declared)


def _same(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    condition = F.lit(True)
    for name in key:
        condition = condition & a[name].eqNullSafe(b[name])
    return condition
