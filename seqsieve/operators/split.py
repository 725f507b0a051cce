"""Cutting a collection into parts of equal number or bounded size, in record order.

Both rules look sequential: where a part ends depends on where it began. They are
computed here from running totals, which Spark takes chunk by chunk: a window per
chunk of consecutive records plus a window over one row per chunk. Chunks and buckets are
quantiles wherever numbers or sizes are uneven.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqsieve.session import scratch_folder

CHUNK = 65_536  # consecutive record numbers that share one window


def record_size(
    name: Column | None, seq: Column, measure: str = "all", line_length: int = 100, eol: str = "\n"
) -> Column:
    """Size of a record: ``count`` of records, ``seq`` residues or ``all`` bytes written.

    ``name`` is the whole header line without ``>``.
    """
    if measure == "count":
        return F.lit(1).cast("bigint")
    residues = F.length(seq).cast("bigint")
    if measure == "seq":
        return residues
    if measure != "all":
        raise ValueError("measure must be 'all', 'seq' or 'count'")
    lines = F.ceil(residues / line_length).cast("bigint") if line_length else F.lit(1)
    return residues + F.length(name) + 1 + len(eol) * (1 + lines)


def with_order(records: DataFrame) -> DataFrame:
    """Number the records of one file read by ``read_fasta`` in file order, as ``ord``.

    ``rec_id`` rises within a file split; counting the records of every split gives
    each one its offset.
    """
    by_split = records.withColumn("_chunk", F.struct("split_start", F.shiftright("rec_id", 33)))
    chunks = by_split.groupBy("_chunk").agg(F.count("*").alias("_count"))
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select(
        "_chunk", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_chunk").orderBy("rec_id")
    return (
        by_split.join(offsets, "_chunk")
        .withColumn("ord", F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_chunk", "_offset")
    )


def _chunked(rows: DataFrame, order: str) -> DataFrame:
    """Add ``_chunk``: about CHUNK consecutive records each, whatever their numbers are.

    Nearly dense numbers are simply divided. Others, such as hashes, are dealt to tasks by
    range; the table written then fixes the chunks.
    """
    spread = rows.agg(F.min(order), F.max(order), F.count("*")).first()
    if spread[2] == 0 or spread[1] - spread[0] <= 4 * spread[2]:
        return rows.withColumn("_chunk", F.floor((F.col(order) - (spread[0] or 0)) / CHUNK))
    path = f"{scratch_folder(rows.sparkSession)}/chunks"
    ranged = rows.repartitionByRange(max(1, spread[2] // CHUNK), order).withColumn("_chunk", F.spark_partition_id())
    ranged.write.parquet(path)
    return rows.sparkSession.read.schema(ranged.schema).parquet(path)


def _running(
    rows: DataFrame, order: str, values: dict[str, tuple[Callable, Column]], whole: list[str] = ()
) -> DataFrame:
    """Add running aggregates over ``order``; ``values`` maps a name to (fold, input).

    ``fold`` is ``F.sum`` or ``F.min``. Names in ``whole`` also get the aggregate over
    all rows, as ``<name>_all``.
    """
    if "_chunk" not in rows.columns:
        rows = _chunked(rows, order)
    for name, (_, value) in values.items():
        rows = rows.withColumn(f"_{name}", value)
    folds = {name: fold for name, (fold, _) in values.items()}
    chunks = rows.groupBy("_chunk").agg(*[f(f"_{n}").alias(f"_{n}_c") for n, f in folds.items()])
    # one row per chunk: few enough for a window without partitions
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    offsets = chunks.select(
        "_chunk",
        *[f(f"_{n}_c").over(earlier).alias(f"_{n}_b") for n, f in folds.items()],
        *[folds[n](f"_{n}_c").over(everything).alias(f"{n}_all") for n in whole],
    )
    inside = Window.partitionBy("_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(offsets, "_chunk")
    for name, fold in folds.items():
        here = fold(f"_{name}").over(inside)
        before = F.col(f"_{name}_b")
        total = F.coalesce(before, F.lit(0)) + here if fold is F.sum else F.least(before, here)
        joined = joined.withColumn(name, total)
    return joined.drop(*[c for n in folds for c in (f"_{n}", f"_{n}_b")])


def split_n_parts(records: DataFrame, n_parts: int, order: str, size: Column) -> DataFrame:
    """Add ``part`` (1..n_parts): a record opens the next part when its middle lies
    beyond the part's ideal end, at most one part per record.

    With ``reach`` the number of ideal ends before a record's middle, the part of the
    n-th record follows ``part(n) = min(part(n-1), reach(n)) + 1``, that is the running
    minimum of ``reach + 1 - n``, plus ``n``. Records of size zero never count.
    """
    if n_parts < 1:
        raise ValueError("n_parts must be positive")
    sized = records.withColumn("_size", size)
    counted = F.when(F.col("_size") > 0, F.lit(1).cast("bigint")).otherwise(0)
    totals = _running(
        sized, order, {"_upto": (F.sum, F.col("_size")), "_n": (F.sum, counted)}, whole=["_upto"]
    )
    total = F.col("_upto_all")
    twice_middle = F.col("_upto") * 2 - F.col("_size")

    def beyond_end(part: Column) -> Column:
        end = F.floor(total.cast("double") / n_parts * part) + F.when(part > 1, 1).otherwise(0)
        return twice_middle > end * 2

    half = F.floor((twice_middle - 1) / 2)
    guess = F.greatest(F.ceil(half * n_parts / total).cast("bigint") - 1, F.lit(0))
    totals = totals.withColumn("_guess", guess)
    reach = (
        F.when(beyond_end(F.col("_guess") + 1), F.col("_guess") + 1)
        .when((F.col("_guess") > 0) & ~beyond_end(F.col("_guess")), F.col("_guess") - 1)
        .otherwise(F.col("_guess"))
    )
    totals = totals.withColumn("_reach", reach)
    slack = F.when(
        F.col("_size") > 0,
        F.when(F.col("_n") == 1, F.lit(0).cast("bigint")).otherwise(F.col("_reach") + 1 - F.col("_n")),
    )
    marked = _running(totals, order, {"_slack": (F.min, slack)})
    part = F.coalesce(F.col("_n") + F.col("_slack"), F.lit(1))
    empty = F.when(F.col("_n") > 0, F.least(part + 1, F.col("_reach") + 1)).otherwise(1)
    return marked.withColumn("part", F.when(F.col("_size") > 0, part).otherwise(empty)).select(
        *records.columns, "part"
    )


def split_part_size(
    records: DataFrame, part_size: int, order: str, size: Column, max_parts: int | None = None
) -> DataFrame:
    """Add ``part``: greedy packing, a record opens a new part when it would overfill one.

    With ``max_parts`` only the records of the first parts are returned.

    From running totals every record gets the record that would open the next part if
    a part began with it. The parts are the chain of these links from the first record,
    followed by doubling: every round squares the links, so a chain of n parts takes
    log2(n) joins.
    """
    if part_size < 1:
        raise ValueError("part_size must be positive")
    spark = records.sparkSession
    folder = scratch_folder(spark)
    sized = records.withColumn("_size", size)
    one = F.lit(1).cast("bigint")
    totals = _running(sized, order, {"_upto": (F.sum, F.col("_size")), "_n": (F.sum, one)}).select(
        F.col("_n").alias("n"), (F.col("_upto") - F.col("_size")).alias("before"), F.col("_upto").alias("upto")
    )
    totals.write.parquet(f"{folder}/totals")
    totals = spark.read.parquet(f"{folder}/totals")

    # first record that ends beyond before + part_size, but not the one the part began with
    full = _first_above(totals, F.col("before") + part_size, F.col("upto"), f"{folder}/full")
    grown = _first_above(totals, F.col("before"), F.col("before"), f"{folder}/grown")
    links = full.join(grown.withColumnRenamed("next", "moved"), "n")
    links = links.where("next is not null and moved is not null").select(
        "n", F.greatest("next", "moved").alias("next")
    )
    links.write.parquet(f"{folder}/links_0")

    spark.range(1, 2).select(F.col("id").alias("n")).write.parquet(f"{folder}/starts_0")
    known, level = 1, 0
    while True:
        links = spark.read.parquet(f"{folder}/links_{level}")
        starts = spark.read.parquet(f"{folder}/starts_{level}")
        reached = links.join(starts, "n", "left_semi").select(F.col("next").alias("n"))
        level += 1
        starts.union(reached).distinct().write.parquet(f"{folder}/starts_{level}")
        now = spark.read.parquet(f"{folder}/starts_{level}").count()
        if now == known:
            break
        known = now
        onward = links.select(F.col("n").alias("next"), F.col("next").alias("after"))
        links.join(onward, "next").select("n", F.col("after").alias("next")).write.parquet(
            f"{folder}/links_{level}"
        )
    starts = spark.read.parquet(f"{folder}/starts_{level}").withColumn("_start", one)
    numbered = _running(records, order, {"n": (F.sum, one)})
    flagged = numbered.join(starts, "n", "left").withColumn("_start", F.coalesce("_start", F.lit(0)))
    parts = _running(flagged, order, {"part": (F.sum, F.col("_start"))}).select(*records.columns, "part")
    return parts if max_parts is None else parts.where(F.col("part") <= max_parts)


def _first_above(totals: DataFrame, bound: Column, value: Column, path: str) -> DataFrame:
    """For every record the first record whose ``value`` exceeds its ``bound``: (n, next).

    Values rise with n. Bounds and values meet in buckets, quantiles of both together, so
    that one giant record takes no more room than others; a bound with no larger value in
    its bucket takes the first value of the next filled bucket. The table written to
    ``path`` fixes the buckets.
    """
    none = F.lit(None).cast("bigint")
    values = totals.select(value.alias("at"), F.col("n").alias("found"), none.alias("n"))
    bounds = totals.select(bound.alias("at"), none.alias("found"), F.col("n"))
    both = values.unionByName(bounds).repartitionByRange("at").withColumn("bucket", F.spark_partition_id())
    both.write.parquet(path)
    both = totals.sparkSession.read.schema(both.schema).parquet(path)
    # equal values do not exceed a bound: sort them before it, then look at what follows
    onward = (
        Window.partitionBy("bucket")
        .orderBy(F.desc("at"), F.desc_nulls_last("n"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    inside = (
        both.withColumn("next", F.min("found").over(onward))
        .where("n is not null")
        .select("n", "bucket", "next")
    )
    filled = both.groupBy("bucket").agg(F.min("found").alias("first"))
    later = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    fallback = filled.select("bucket", F.min("first").over(later).alias("fallback"))
    return inside.join(fallback, "bucket").select("n", F.coalesce("next", "fallback").alias("next"))
