"""What several corpus operators share: words, row keys, tables written between steps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqsieve.session import scratch_folder, ship_package

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the session's shared folder: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = scratch_folder(spark)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The rows of highest ``n``, all above some bound, that are ``limit`` at most.

    The bound comes from the numbers of rows by size class, so no task hands on more than
    it keeps; rows of one class come or go together.
    """
    counts = counts.withColumn("_class", F.floor(F.log2("n") * 8).cast("int"))
    least, total = None, 0
    for size, rows in sorted(map(tuple, counts.groupBy("_class").count().collect()), reverse=True):
        total += rows
        if total > limit:
            break
        least = size
    return counts.where(F.lit(False) if least is None else F.col("_class") >= least).drop("_class")


def on_workers(spark: SparkSession) -> None:
    """Makes this package importable in Python workers."""
    ship_package(spark)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("bigint")


def text_hash(text: Column) -> Column:
    """With ``doc_id`` the key of a row; rows equal in both have the same text."""
    return F.xxhash64(text)


def crc_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone, so that reruns agree."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def same_key(left: DataFrame, right: DataFrame, names: Iterable[str]) -> Column:
    """Null-safe equality of the named columns."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def join_few(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", rows: str | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has one row per key, where some keys of ``left`` are hot.

    Keys that more than a thousandth of the rows share are fewer than a thousand; their rows of
    ``right`` are broadcast. The others are joined as usual. Nulls are equal to nulls. ``rows``
    names a column of ``right`` with the rows of each key, if known; it is not handed on.
    """
    least = max(left.count(), 1000)
    counts = right.withColumnRenamed(rows, "count") if rows else left.groupBy(*keys).count()
    right = right.drop(rows) if rows else right
    hot = counts.where(F.col("count") * 1000 > least).select(*keys, F.lit(True).alias("_hot"))
    hot = written(hot.repartition(1))  # less than a thousand rows

    def matched(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
        renamed = b.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in b.columns])
        condition = F.lit(True)
        for c in keys:
            condition = condition & a[c].eqNullSafe(renamed[f"_r_{c}"])
        return a.join(renamed, condition, kind).drop(*[f"_r_{c}" for c in keys])

    if hot.isEmpty():
        return matched(left, right, how)
    marked = matched(left, F.broadcast(hot), "left")
    heated, cold = marked.where("_hot").drop("_hot"), marked.where("_hot IS NULL").drop("_hot")
    few = matched(right, F.broadcast(hot), "inner").drop("_hot")
    return matched(heated, F.broadcast(few), how).unionByName(matched(cold, right, how))
