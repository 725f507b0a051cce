"""Near-duplicate vectors by spherical-cap filters from a structured random product code.

A random rotation cuts each vector into BLOCKS parts; a filter direction joins one random
unit vector of a small code per part, so few codes make many directions. List decoding
finds every direction whose product with a vector comes within REACH of the vector's best
one (the cap's height follows the vector, so none is left without filters). Vectors that
share a filter are compared exactly, in double precision.

Equal vectors are one class. A filter held by many is split into blocks, each pair of
blocks being one piece of work; a piece returns how many links each vector got and a
forest of them, never the pairs. A pair that shares several filters counts in the first.

Cases: vectors that are null, empty, zero or hold a null or non-finite component link with
nothing and are kept; so do vectors of different lengths with each other; ties and repeated
rows link like any others; an empty table gives an empty result; further columns, such as
labels, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqsieve.llm.common import on_workers, written
from seqsieve.llm.components import components

BLOCKS = 4
REACH = 0.035
#: Directions per vector, about: the code's size follows the number of classes.
DIRECTIONS = 4
BUCKET = 512


class ProductCode:
    """Filter directions for vectors of one length."""

    def __init__(self, length: int, codes: int, seed: int = 11) -> None:
        rng = np.random.default_rng([seed, length])
        rotation, _ = np.linalg.qr(rng.standard_normal((length, length)))
        self.parts = [(rotation[:, at], self._unit(rng, codes, len(at))) for at in np.array_split(np.arange(length), BLOCKS) if len(at)]

    @staticmethod
    def _unit(rng, codes: int, length: int) -> np.ndarray:
        vectors = rng.standard_normal((codes, length))
        return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).T

    def decode(self, units: np.ndarray) -> list[np.ndarray]:
        """Sorted filters of each unit vector, part by part: a prefix stays while the best rest could still reach."""
        scores = [units @ rotation @ code / np.sqrt(len(self.parts)) for rotation, code in self.parts]
        out = []
        for i in range(len(units)):
            own = [s[i] for s in scores]
            best = [s.max() for s in own]
            least = sum(best) - REACH
            filters, sums = np.zeros(1, np.int64), np.zeros(1)
            for b, s in enumerate(own):
                total = sums[:, None] + s
                at, code = np.nonzero(total + sum(best[b + 1 :]) >= least)
                filters, sums = filters[at] * len(s) + code, total[at, code]
            out.append(np.sort(filters))
        return out


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _code_size(classes: int) -> int:
    return int(np.clip(np.ceil((DIRECTIONS * max(classes, 1)) ** (1 / BLOCKS)), 4, 128))


def _classes(vectors: DataFrame) -> DataFrame:
    """One row per different usable vector: cid, embedding, copies, first (its least vec_id)."""
    usable = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    grouped = vectors.where(F.col("embedding").isNotNull() & ~usable & nonzero).groupBy("embedding")
    counted = grouped.agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    return written(counted.select(F.monotonically_increasing_id().alias("cid"), "embedding", "copies", "first"))


def _filters(classes: DataFrame, codes: int) -> DataFrame:
    """cid, copies, embedding and its filters (sorted)."""
    made: dict[int, ProductCode] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            found: list = [None] * len(vectors)
            for length in sorted({len(v) for v in vectors}):
                at = [i for i, v in enumerate(vectors) if len(v) == length]
                code = made.setdefault(length, ProductCode(length, codes))
                for i, filters in zip(at, code.decode(unit_vectors(np.array([vectors[i] for i in at], float))), strict=True):
                    found[i] = filters
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.int64()))],
                names=["cid", "copies", "embedding", "filters"],
            )

    plain = classes.select("cid", "copies", "embedding")
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("filters", T.ArrayType(T.LongType()))]))


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    todo, edges = linked.any(1), []
    while todo.any():
        stack = [int(np.argmax(todo))]
        todo[stack[0]] = False
        while stack:
            node = stack.pop()
            new = np.flatnonzero(linked[node] & todo)
            todo[new] = False
            edges += [(node, int(other)) for other in new]
            stack += new.tolist()
    return edges


def _earlier(filters: list[np.ndarray], this: int) -> np.ndarray:
    """Which pairs share a filter before this one."""
    before = [f[f < this] for f in filters]
    values, place, counts = np.unique(np.concatenate(before), return_inverse=True, return_counts=True)
    several = counts > 1
    column = np.cumsum(several) - 1
    owner = np.repeat(np.arange(len(filters)), [len(b) for b in before])
    use = several[place]
    held = np.zeros((len(filters), int(several.sum())), np.float32)
    held[owner[use], column[place[use]]] = 1
    return held @ held.T > 0


def _compared(piece: list, threshold: float) -> Iterator[tuple]:
    """(a, None, links) for each vector of a piece that has links, (a, b, 0) for a forest of them."""
    filter_, left, right = piece[0][0], piece[0][1], piece[0][2]
    lengths = {len(p[6]) for p in piece}
    for length in sorted(lengths):
        rows = [p for p in piece if len(p[6]) == length]
        if len(rows) < 2:
            continue
        units = unit_vectors(np.array([p[6] for p in rows], float))
        linked = units @ units.T >= threshold
        np.fill_diagonal(linked, False)
        if left != right:  # pairs within one block are another piece's work
            side = np.array([p[3] for p in rows])
            linked &= side[:, None] != side
        if not linked.any():
            continue
        linked &= ~_earlier([np.array(p[7]) for p in rows], filter_)
        copies = np.array([p[5] for p in rows], np.int64)
        ids = [p[4] for p in rows]
        counts = linked @ copies
        for i in np.flatnonzero(counts):
            yield ids[i], None, int(counts[i])
        for a, b in _forest(linked):
            yield ids[a], ids[b], 0


def near_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    on_workers(vectors.sparkSession)
    vectors = vectors.select("vec_id", "embedding")
    classes = _classes(vectors)
    found = written(_filters(classes, _code_size(classes.count())))
    held = found.select("cid", F.explode("filters").alias("filter"))
    crowded = written(held.groupBy("filter").agg(F.count("*").alias("n")).where("n > 1").select("filter", F.ceil(F.col("n") / BUCKET).alias("blocks")))
    rows = found.select("cid", "copies", "embedding", "filters", F.explode("filters").alias("filter")).join(crowded, "filter")
    own = F.pmod(F.xxhash64("cid"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    rows = rows.select("*", own.alias("own")).select("*", other.alias("other"))
    pieces = rows.select(
        "filter", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own", "cid", "copies", "embedding", "filters"
    )
    pieces = pieces.repartition("filter", "left", "right").sortWithinPartitions("filter", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece: list = []
        out: list = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if piece and row[:3] != piece[0][:3]:
                    out += _compared(piece, threshold)
                    piece = []
                piece.append(row)
            yield _edges(out)
            out = []
        if piece:
            yield _edges(_compared(piece, threshold))

    compared = written(pieces.mapInArrow(run, "a bigint, b bigint, n bigint"))
    roots = components(compared.where("b IS NOT NULL").select("a", "b"))
    links = compared.groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    placed = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    placed = written(placed.join(links, "cid", "left").select("embedding", "copies", "first", "root", F.coalesce("links", F.lit(0)).alias("links")))
    least = written(placed.groupBy("root").agg(F.min("first").alias("least")))
    by_vector = placed.join(least, "root").select(
        F.col("embedding").alias("same"), (F.col("copies") - 1 + F.col("links")).alias("n"), "least"
    )
    joined = vectors.join(by_vector, vectors["embedding"] == by_vector["same"], "left")
    component = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return joined.select(
        "vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def _edges(rows) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n"])
