"""Mixing sources to target weights by weighted pivotal rounding.

Every document of a source has the same expected number of copies, the source's target
over its size. The whole part is given to all; the fractions are rounded together: two
documents at a time exchange probability, at a random side's cost, until one of the two
is 0 or 1. The exchange keeps ``words * probability`` of the pair and each document's
expectation, so a source's words hit its target to within one document. Documents meet
in blocks, the one undecided document of each block meets those of other blocks a level
higher, and so on: a reduction tree per source, whose blocks split hot sources.

Cases: null text and text without words have size 0 and never move a source; a null
source is a source of its own and comes last; an empty table gives an empty result;
rows with equal ``doc_id``, ``source`` and ``text`` are one unit, of which as many rows take one
more copy as their fractions add up to, the last one by rounding; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqsieve.llm.common import text_hash, uniform, word_count, written

CYCLE = (5, 2, 1)
MAX_COPIES = 3
BLOCK = 64
KEY = ["doc_id", "source", "row_hash"]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", text_hash(docs["text"]).alias("row_hash"), word_count(docs["text"]).alias("size"))


def source_targets(units: DataFrame, cycle: tuple = CYCLE, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source: words, weight, target. Weights repeat in code-point order, null last.

    A target is ``min(max_copies * size, level * weight)`` with the one level at which the
    targets add up to all words. With the sources sorted by the level at which each fills up,
    what is left after filling the first few, shared by the others, grows while those do fill
    up and shrinks after: the level is its maximum.
    """
    per_source = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).cast("bigint").alias("source_size"), F.count("*").alias("n_units")
    )
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    # one short row per source: these windows see the list of sources, never documents
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    full = F.col("source_size") * F.lit(float(max_copies))
    table = per_source.withColumn("weight", F.element_at(weights, (F.pmod(rank, F.lit(len(cycle))) + 1).cast("int")))
    filling = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(full).over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy()
    table = table.withColumn("share", (F.sum("source_size").over(everything) - before) / rest)
    table = table.withColumn("level", F.max("share").over(everything))
    return table.select(
        "source", "source_size", "n_units", "weight",
        F.coalesce(F.least(full, F.col("level") * F.col("weight")), F.lit(0.0)).alias("target"),
    )


def _pivot(state: Column, item: Column) -> Column:
    """One meeting: ``open`` (the undecided document so far) and ``item`` exchange probability."""
    one = state["open"]
    ratio = item["weight"] / one["weight"]
    up = F.least(1 - one["p"], item["p"] * ratio)  # gained by the open document if it wins
    down = F.least(one["p"], (1 - item["p"]) * ratio)  # lost by it otherwise
    wins = item["u"] * (up + down) < down
    # the side that becomes integral is set to 0 or 1 exactly, rounding errors aside
    open_p = F.when(wins, F.when(1 - one["p"] <= item["p"] * ratio, 1.0).otherwise(one["p"] + up)).otherwise(
        F.when(one["p"] <= (1 - item["p"]) * ratio, 0.0).otherwise(one["p"] - down)
    )
    item_p = F.when(wins, F.when(1 - one["p"] >= item["p"] * ratio, 0.0).otherwise(item["p"] - up / ratio)).otherwise(
        F.when(one["p"] >= (1 - item["p"]) * ratio, 1.0).otherwise(item["p"] + down / ratio)
    )
    first, second = one.withField("p", open_p), item.withField("p", item_p)
    whole = lambda x: (x["p"] == 0.0) | (x["p"] == 1.0)
    decided = F.filter(F.array(first, second), whole)
    undecided = F.filter(F.array(first, second), lambda x: ~whole(x))
    met = F.struct(F.concat(state["done"], decided).alias("done"), F.get(undecided, F.lit(0)).alias("open"))
    return F.when(one.isNull(), F.struct(state["done"].alias("done"), item.alias("open"))).otherwise(met)


def _level(items: DataFrame, unit_type: str) -> DataFrame:
    """Lets the documents of each block meet in a fixed random order."""
    blocks = items.groupBy("source", "block").agg(F.sort_array(F.collect_list("unit")).alias("units"))
    start = F.struct(
        F.lit(None).cast(f"array<{unit_type}>").alias("done"), F.lit(None).cast(unit_type).alias("open")
    ).withField("done", F.array().cast(f"array<{unit_type}>"))
    return blocks.select("source", "block", F.aggregate("units", start, _pivot).alias("met")).select(
        "source", "block", "met.done", "met.open"
    )


def decide(docs: DataFrame, cycle: tuple = CYCLE, max_copies: int = MAX_COPIES, seed: int = 7) -> DataFrame:
    """One row per distinct document: KEY, size, rows, source_size, target, whole (copies of each row)
    and extra (how many of its rows take one copy more)."""
    units = written(_rows(docs).groupBy(*KEY, "size").agg(F.count("*").alias("rows")))
    targets = written(source_targets(units, cycle, max_copies))
    largest = targets.agg(F.max("n_units")).head()[0] or 0
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = (
        units.alias("u")
        .join(targets.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source")))
        .select("u.*", "source_size", "target", "n_units", (F.col("rows") * (share - F.floor(share))).alias("part"))
        # of the fractions of equal rows only what is left after whole rows is rounded
        .withColumn("more", F.floor("part"))
        .withColumn("p", F.col("part") - F.col("more"))
    )
    settled = (F.col("p") == 0) | (F.col("size") == 0)
    ids = [F.col("doc_id"), F.col("row_hash"), F.lit(seed)]
    level_of = lambda n: F.greatest(F.lit(1), F.ceil(F.col("n_units") / n))
    unit = F.struct(
        uniform(*ids).alias("u"), "doc_id", "row_hash", "size", "rows", "more",
        F.col("size").cast("double").alias("weight"), "p",
    )
    items = known.where(~settled).select(
        "source", "n_units", F.pmod(F.xxhash64(*ids, F.lit("block")), level_of(BLOCK)).alias("block"), unit.alias("unit")
    )
    unit_type = items.schema["unit"].dataType.simpleString()
    decided, width = [], BLOCK
    while True:
        level = written(_level(items, unit_type))
        decided.append(level.select("source", F.explode("done").alias("unit")))
        if width >= largest:
            break
        width *= BLOCK
        items = (
            level.where(F.col("open").isNotNull())
            .alias("l")
            .join(targets.alias("t"), F.col("l.source").eqNullSafe(F.col("t.source")))
            .select(
                "l.source", "n_units", F.pmod(F.col("block"), level_of(width)).alias("block"),
                F.col("open").withField("u", uniform(F.col("open.doc_id"), F.col("open.row_hash"), F.lit(seed + width))).alias("unit"),
            )
        )
    last = level.where(F.col("open").isNotNull()).select(
        "source",
        F.col("open").withField(
            "p", (uniform(F.col("open.row_hash"), F.lit(seed), F.lit("last")) < F.col("open.p")).cast("double")
        ).alias("unit"),
    )
    rounded = last
    for part in decided:
        rounded = rounded.unionByName(part)
    rounded = rounded.select("source", "unit.doc_id", "unit.row_hash", "unit.size", "unit.rows", "unit.more", F.col("unit.p").alias("extra"))
    plain = known.where(settled).select(
        "source", "doc_id", "row_hash", "size", "rows", "more",
        (uniform(*ids) < F.col("p")).cast("double").alias("extra"),
    )
    return (
        rounded.unionByName(plain)
        .alias("d")
        .join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select(
            "d.doc_id", "d.source", "d.row_hash", "d.size", "d.rows", "t.source_size", "t.target",
            F.floor(share).cast("bigint").alias("whole"), (F.col("more") + F.col("extra")).cast("bigint").alias("extra"),
        )
    )


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, source, copies."""
    rows = decide(docs, **options).select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("row"))
    copies = F.col("whole") + (F.col("row") <= F.col("extra")).cast("bigint")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "source", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it."""
    choice = decide(docs, **options).where("whole + extra > 0")
    choice = choice.select(*[F.col(c).alias(f"_mix_{c}") for c in [*KEY, "rows", "whole", "extra"]])
    match = (
        docs["doc_id"].eqNullSafe(F.col("_mix_doc_id"))
        & docs["source"].eqNullSafe(F.col("_mix_source"))
        & (text_hash(docs["text"]) == F.col("_mix_row_hash"))
    )
    names = list(docs.columns)
    taken = docs.join(choice, match).select(*[docs[c] for c in names], *choice.columns)
    # all rows of a unit take the same unless only some take one more; those are numbered
    even = F.col("_mix_extra") % F.col("_mix_rows") == 0
    same = taken.where(even).withColumn("_mix_copies", F.col("_mix_whole") + F.floor(F.col("_mix_extra") / F.col("_mix_rows")))
    several = taken.where(~even).withColumn("_mix_part", F.spark_partition_id()).withColumn("_mix_nth", F.monotonically_increasing_id())
    several = written(several)
    unit = [f"_mix_{c}" for c in KEY]
    # by unit and task, and then by the tasks of a unit, so that no unit is sorted as one group
    inside = F.row_number().over(Window.partitionBy(*unit, "_mix_part").orderBy("_mix_nth"))
    counts = several.groupBy(*unit, "_mix_part").agg(F.count("*").alias("_mix_n"))
    before = F.sum("_mix_n").over(Window.partitionBy(*unit).orderBy("_mix_part")) - F.col("_mix_n")
    offsets = counts.withColumn("_mix_before", before).select(*[F.col(c).alias(f"{c}_of") for c in [*unit, "_mix_part"]], "_mix_before")
    numbered = several.withColumn("_mix_row", inside)
    here = F.lit(True)
    for c in [*unit, "_mix_part"]:
        here = here & numbered[c].eqNullSafe(offsets[f"{c}_of"])
    numbered = numbered.join(offsets, here)
    one_more = (F.col("_mix_row") + F.col("_mix_before") <= F.col("_mix_extra")).cast("bigint")
    numbered = numbered.withColumn("_mix_copies", F.col("_mix_whole") + one_more)
    columns = [*names, "_mix_copies"]
    both = same.select(columns).unionByName(numbered.select(columns))
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_mix_copies")))
    return both.where("_mix_copies > 0").select(*names, copy.alias("_mix_copy")).drop("_mix_copy")
