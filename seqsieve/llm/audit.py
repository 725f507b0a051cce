"""How filters overlap: what each removes in every order of them, from tables of failing ids.

Each filter stores the rows that fail it as one table of row ids. What survives a set of filters
is the rows left when its tables are taken away by left-anti joins; it depends on the set, not
the order, so all prefixes of all orders are answered by one chain of joins over the sets. A
left-semi join of the survivors with a filter's table gives what the filter removes after that
prefix, and left-semi joins with the labelled ids give what is lost. Rows that fail no filter are
counted and never joined.

Cases: a null text is empty; a null language is the part ''; a null id is smaller than none and
has none smaller, and no label; a repeated row is a row of its own, and rows that share an id do
not count as copies of each other; a label given twice counts if one of its rows says so; an
empty table gives no parts; further columns are ignored. Long texts are looked at whole.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqsieve.llm.common import join_few, written

FILTERS = "ABCDE"
ALL_SETS = 1 << len(FILTERS)


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def orders() -> list[tuple[str, int, int, int]]:
    """(filter order, step, set of the filters before, number of this step's filter)."""
    return [
        ("".join(order), step + 1, sum(map(bit, order[:step])), FILTERS.index(name))
        for order in permutations(FILTERS)
        for step, name in enumerate(order)
    ]


def conditions(text: Column) -> dict[str, Column]:
    """Failure of the filters that look at one text."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    count, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": count < 200,
        "B": 100 * distinct < 50 * count,
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _rows(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, part, a digest of the text and the failures but for copies; written, so that row_id stays."""
    text = F.coalesce("text", F.lit(""))
    plain = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    failed = [c.alias(name) for name, c in conditions(F.col("text")).items()]
    return written(plain.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "part", digest, *failed))


def failing_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The row ids that fail each filter, one written table per filter."""
    tables = {name: written(rows.where(name).select("row_id")) for name in FILTERS[:-1]}
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    copies = join_few(rows.select("row_id", "doc_id", "digest"), least, ["digest"], rows="n")
    tables[FILTERS[-1]] = written(copies.where("doc_id > least").select("row_id"))
    return tables


def _labelled(rows: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    named = labels.where(F.col(column) == 1).select("doc_id")
    return written(rows.select("row_id", "doc_id").join(named, "doc_id", "left_semi").select("row_id"))


def _survivors(rows: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """row_id, part and ``past``: every set of filters that a failing row survives."""
    failing = reduce(DataFrame.union, tables.values()).distinct()
    left = rows.select("row_id", "part").join(failing, "row_id", "left_semi").repartition("row_id")
    left = left.select("row_id", "part", F.explode(F.sequence(F.lit(0), F.lit(ALL_SETS - 1))).alias("past"))
    for name, table in tables.items():
        gone = table.withColumnRenamed("row_id", "gone")
        applied = F.col("past").bitwiseAND(bit(name)) != 0
        left = left.join(gone, (F.col("row_id") == F.col("gone")) & applied, "left_anti")
    return written(left)


def _removed(survivors: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """part, past, next and row_id: rows the next filter removes after those before it."""
    parts = []
    for number, (name, table) in enumerate(tables.items()):
        before = survivors.where(F.col("past").bitwiseAND(bit(name)) == 0)
        parts.append(before.join(table, "row_id", "left_semi").withColumn("next", F.lit(number)))
    return reduce(DataFrame.unionByName, parts)


def _counts(removed: DataFrame, name: str) -> DataFrame:
    return removed.groupBy("part", "past", "next").agg(F.count("*").alias(name))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter order and step with the counts of that step."""
    rows = _rows(docs)
    tables = failing_tables(rows)
    survivors = _survivors(rows, tables)
    removed = written(_removed(survivors, tables))
    good, toxic = _labelled(rows, labels, "quality"), _labelled(rows, labels, "toxic")
    counts = (
        _counts(removed, "removed")
        .join(_counts(removed.join(good, "row_id", "left_semi"), "good_lost"), ["part", "past", "next"], "left")
        .join(_counts(removed.join(toxic, "row_id", "left_semi"), "toxic_lost"), ["part", "past", "next"], "left")
    )
    # per part: at most 80 counts of removals and 32 of survivors
    key = F.col("past") * len(FILTERS) + F.col("next")
    entry = F.struct(key.alias("key"), F.struct("removed", F.coalesce("good_lost", F.lit(0)).alias("good"), F.coalesce("toxic_lost", F.lit(0)).alias("toxic")).alias("value"))
    by_part = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("steps"))
    staying = survivors.groupBy("part", "past").agg(F.count("*").alias("n"))
    staying = staying.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("past", "n"))).alias("left"))
    # rows that fail nothing survive everything; only the others have been joined
    sizes = rows.groupBy("part").agg(F.count("*").alias("size"))
    parts = sizes.join(by_part, "part", "left").join(staying, "part", "left")

    def step(past: Column, number: Column, field: str) -> Column:
        found = F.try_element_at(F.col("steps"), (past * len(FILTERS) + number).cast("int"))
        return F.coalesce(found[field], F.lit(0)).cast("bigint")

    def surviving(past: Column) -> Column:
        never = F.coalesce(F.try_element_at(F.col("left"), F.lit(0)), F.lit(0))
        return F.col("size") - never + F.coalesce(F.try_element_at(F.col("left"), past.cast("int")), F.lit(0))

    spark = docs.sparkSession
    steps = [(n, *order) for n, order in enumerate(orders())]
    table = F.broadcast(spark.createDataFrame(steps, "n int, filter_order string, step int, past int, next int"))
    parts = parts.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))
    past, number = F.col("past"), F.col("next")
    own = F.call_function("shiftleft", F.lit(1), number)
    share = F.aggregate(
        F.filter(F.sequence(F.lit(0), F.lit(ALL_SETS - 1)), lambda s: s.bitwiseAND(own) == 0),
        F.lit(0).cast("bigint"),
        lambda total, s: total + step(s, number, "removed") * _orders_with(s),
    )
    return parts.join(table, "n").select(
        "part", "filter_order", "step",
        surviving(past.bitwiseOR(own)).alias("kept"),
        step(past, number, "removed").alias("removed"),
        (step(F.lit(0), number, "removed") - step(past, number, "removed")).alias("redundant"),
        step(F.lit(ALL_SETS - 1).bitwiseXOR(own), number, "removed").alias("unique_fails"),
        step(past, number, "good").alias("good_lost"),
        step(past, number, "toxic").alias("toxic_lost"),
        share.alias("shapley"),
    )


def _orders_with(past: Column) -> Column:
    """In how many orders exactly the filters of ``past`` come before a given other one."""
    n = len(FILTERS)
    ways = F.array(*[F.lit(factorial(i) * factorial(n - 1 - i)) for i in range(n)])
    return F.get(ways, F.bit_count(past))
