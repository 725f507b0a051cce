"""Connected components of links between ids, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsieve.llm.common import forget, written


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` of every id in ``links`` (columns a and b, bigint).

    Each round every root moves to the neighbour of least hash, if that is less than its
    own, and links between the new roots go on. Hashes make the order random, so a
    constant share of the roots goes each round, in chains as in stars; a hub's many links
    are combined before they are shuffled. The root is any node of the component.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = written(both.select("node", F.col("node").alias("root")))
    while not edges.isEmpty():
        sides = edges.select("a", "b").union(edges.select("b", "a")).toDF("root", "other")
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        moved = written(
            sides.groupBy("root")
            .agg(F.min(rank("other")).alias("best"))
            .select("root", F.least(F.col("best"), rank("root"))["id"].alias("to"))
            .where("root <> to")
        )
        older, labels = labels, written(
            labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        )
        ends = [moved.select(F.col("root").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b")]
        now = edges.join(ends[0], "a", "left").join(ends[1], "b", "left")
        now = now.select(F.coalesce("a_to", "a").alias("x"), F.coalesce("b_to", "b").alias("y")).where("x <> y")
        former, edges = edges, written(now.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        forget(older, former, moved)
    forget(edges)
    return labels
