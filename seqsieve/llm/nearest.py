"""Nearest neighbours by cross-polytope hashing with several probes per table.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) turns a unit
vector; the nearest signed axis is its hash. A code joins as many hashes as give buckets of
about BUCKET vectors, the last one over a part of the axes. Each of TABLES tables holds every
vector once; a query looks into the buckets its rotated vector comes closest to, PROBES times
the square root of the number of buckets. All candidates found there are compared exactly, in
double precision, on the original vectors.

Equal vectors are one class, and a query is answered once for its class. What leaves a task
is the best few per query, never the pairs. Buckets with a common beginning are one piece of
work; a piece of more than PIECE vectors is cut into blocks, which bounds memory and drops
nothing. Queries for which too few candidates turn up are compared with all vectors, in blocks.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part;
vectors of different lengths are not compared; ties go to the smaller vec_id, null last; rows
that repeat are rows like others, and each query row leaves out itself only; a repeated query
row is answered each time; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqsieve.llm.common import join_few, on_workers, written

TABLES = 6
BUCKET = 32
PROBES = 2.0
PIECE = 16_384
QUERIES_AT_ONCE = 256
NO_ID = (1 << 63) - 1


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Orthonormal Hadamard transform of every row; lengths are powers of two."""
    out, half = rows, 1
    length = rows.shape[1]
    while half < length:
        pairs = out.reshape(len(rows), length // (2 * half), 2, half)
        left, right = pairs[:, :, 0], pairs[:, :, 1]
        out = np.stack([left + right, left - right], axis=2).reshape(len(rows), length)
        half *= 2
    return out / np.sqrt(length)


class PolytopeCode:
    """Bucket codes of one table for vectors of one length."""

    def __init__(self, length: int, vectors: int, table: int) -> None:
        self.padded = 1 << (length - 1).bit_length()
        rng = np.random.default_rng([17, length, table])
        self.widths: list[int] = []
        wanted = vectors / BUCKET
        while wanted > 1:
            width = min(2 * self.padded, 1 << int(np.ceil(np.log2(wanted))))
            self.widths.append(width)
            wanted /= width
        self.signs = rng.choice([-1.0, 1.0], (max(1, len(self.widths)), 3, self.padded))
        self.buckets = int(np.prod(self.widths, dtype=np.int64)) if self.widths else 1
        #: buckets of one piece: those that differ in the last hash only
        self.fine = self.widths[-1] if self.widths else 1
        self.probes = min(self.buckets, int(np.ceil(PROBES * np.sqrt(self.buckets))))

    def scores(self, units: np.ndarray) -> list[np.ndarray]:
        """Per hash, every row's product with each of its signed axes."""
        padded = np.zeros((len(units), self.padded))
        padded[:, : units.shape[1]] = units
        out = []
        for width, signs in zip(self.widths, self.signs, strict=False):
            turned = padded
            for sign in signs:
                turned = hadamard(turned * sign)
            axes = turned[:, : width // 2]
            out.append(np.concatenate([axes, -axes], axis=1))
        return out

    def codes(self, units: np.ndarray) -> np.ndarray:
        code = np.zeros(len(units), np.int64)
        for width, own in zip(self.widths, self.scores(units), strict=True):
            code = code * width + own.argmax(axis=1)
        return code

    def probed(self, units: np.ndarray) -> np.ndarray:
        """The buckets (rows x probes) with the least sums of squared distances to the best axes."""
        codes, losses = np.zeros((len(units), 1), np.int64), np.zeros((len(units), 1))
        for width, own in zip(self.widths, self.scores(units), strict=True):
            loss = (own.max(axis=1, keepdims=True) - own) ** 2
            losses = (losses[:, :, None] + loss[:, None, :]).reshape(len(units), -1)
            codes = (codes[:, :, None] * width + np.arange(width)).reshape(len(units), -1)
            if losses.shape[1] > self.probes:
                best = np.argpartition(losses, self.probes - 1, axis=1)[:, : self.probes]
                codes, losses = np.take_along_axis(codes, best, 1), np.take_along_axis(losses, best, 1)
        return codes


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; only vectors whose squares would leave the range are scaled before."""
    sides = []
    for side in (a, b):
        top = np.abs(side).max(axis=1, keepdims=True)
        side = np.where((top > 1e100) | (top < 1e-100), side / top, side)
        sides.append((side, np.sqrt((side * side).sum(axis=1))))
    (a, norm_a), (b, norm_b) = sides
    return (a * b).sum(axis=1) / (norm_a * norm_b)


def _by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    lengths = np.array([len(v) for v in batch.column("embedding")], np.int64)
    for length in np.unique(lengths):
        yield batch.filter(pa.array(lengths == length))


def _coder():
    made: dict[tuple, PolytopeCode] = {}

    def code(length: int, vectors: int, table: int) -> PolytopeCode:
        key = (length, vectors, table)
        if key not in made:
            made[key] = PolytopeCode(*key)
        return made[key]

    return code


def _units_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, tab, unit) of every vector in every table."""
    code = _coder()
    for batch in batches:
        for part in _by_length(batch):
            rows = unit_rows(_matrix(part.column("embedding")))
            for table in range(TABLES):
                own = code(rows.shape[1], part.column("n")[0].as_py(), table)
                unit = own.codes(rows) // own.fine
                names = ["length", "tab", "unit"]
                columns = [np.full(len(rows), rows.shape[1], np.int32), np.full(len(rows), table, np.int32), unit]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


_PLACED = "length int, tab int, unit bigint, cid bigint, asks boolean, fines array<int>, ids array<bigint>, embedding array<double>"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per table for every vector, and one per piece it looks into for every query."""
    code = _coder()
    for batch in batches:
        for part in _by_length(batch):
            rows = unit_rows(_matrix(part.column("embedding")))
            asking = np.flatnonzero(part.column("asked").to_numpy(zero_copy_only=False))
            for table in range(TABLES):
                own = code(rows.shape[1], part.column("n")[0].as_py(), table)
                codes = own.codes(rows)
                yield _placed_rows(part, rows.shape[1], table, np.arange(len(rows)), codes // own.fine, [[f] for f in (codes % own.fine).tolist()], False)
                if len(asking):
                    probed = np.sort(own.probed(rows[asking]), axis=1)
                    source, unit, fines = [], [], []
                    for i, found in zip(asking.tolist(), probed, strict=True):
                        units, starts = np.unique(found // own.fine, return_index=True)
                        for u, fine in zip(units.tolist(), np.split(found % own.fine, starts[1:]), strict=True):
                            source.append(i)
                            unit.append(u)
                            fines.append(fine.tolist())
                    yield _placed_rows(part, rows.shape[1], table, np.array(source), np.array(unit), fines, True)


def _placed_rows(part, length: int, table: int, source, unit, fines, asks: bool) -> pa.RecordBatch:
    taken = part.take(pa.array(source))
    n = len(source)
    columns = [
        pa.array(np.full(n, length, np.int32)), pa.array(np.full(n, table, np.int32)), pa.array(unit, pa.int64()),
        taken.column("cid"), pa.array(np.full(n, asks)), pa.array(fines, pa.list_(pa.int32())),
        taken.column("ids"), taken.column("embedding"),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PLACED.split(", ")])


_BEST = "asker bigint, cid bigint, score double, ids array<bigint>"


def _best_of_piece(k: int):
    """For each query of a piece its k best candidates there, by score and least id."""

    def run(piece: pa.Table) -> pa.Table:
        piece = piece.combine_chunks()
        asks = piece.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        asking, held = piece.filter(pa.array(asks)), piece.filter(pa.array(~asks))
        found: list[tuple] = []
        if len(asking) and len(held):
            vectors = _matrix(held.column("embedding").combine_chunks())
            units = unit_rows(vectors)
            fine = held.column("fines").combine_chunks().flatten().to_numpy()
            values, place = np.unique(fine, return_inverse=True)
            ids = held.column("ids").to_pylist()
            first = np.array([NO_ID if i[0] is None else i[0] for i in ids], np.int64)
            cids = held.column("cid").to_numpy()
            for at in range(0, len(asking), QUERIES_AT_ONCE):
                some = asking.slice(at, QUERIES_AT_ONCE).combine_chunks()
                own = _matrix(some.column("embedding").combine_chunks())
                probes = some.column("fines").combine_chunks()
                looked = np.zeros((len(some), len(values)), bool)
                where = np.searchsorted(values, probes.flatten().to_numpy())
                row = np.repeat(np.arange(len(some)), probes.value_lengths().to_numpy())
                inside = where < len(values)
                inside[inside] = values[where[inside]] == probes.flatten().to_numpy()[inside]
                looked[row[inside], where[inside]] = True
                near = unit_rows(own) @ units.T
                near[~looked[:, place]] = -np.inf
                least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(some), -2.0)
                q, c = np.nonzero(near >= np.maximum(least, -2.0)[:, None] - 1e-9)
                score = cosine(own[q], vectors[c])
                order = np.lexsort((first[c], -score, q))
                q, c, score = q[order], c[order], score[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                askers = some.column("cid").to_numpy()
                found += [(int(askers[q[i]]), int(cids[c[i]]), float(score[i]), ids[c[i]]) for i in np.flatnonzero(rank < k)]
        columns = list(zip(*found, strict=True)) or [(), (), (), ()]
        types = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())]
        return pa.table({n.split()[0]: pa.array(v, t) for n, v, t in zip(_BEST.split(", "), columns, types, strict=True)})

    return run


def _classes(vectors: DataFrame, is_query: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """Different usable vectors (cid, embedding, ids, asked, n, total) and the query rows."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.where(~bad & F.exists("embedding", lambda x: x != 0))
    usable = usable.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = usable.where(is_query)
    # only the first few ids of a class can be among anyone's nearest
    place = F.row_number().over(Window.partitionBy("embedding").orderBy(F.asc_nulls_last("vec_id")))
    few = usable.withColumn("place", place).where(F.col("place") <= k)
    ids = F.sort_array(F.collect_list(F.struct("place", "vec_id")))
    classes = few.groupBy("embedding").agg(F.transform(ids, lambda x: x["vec_id"]).alias("ids"))
    asking = asked.select("embedding").distinct().withColumn("asked", F.lit(True))
    classes = classes.join(asking, "embedding", "left").select(
        F.monotonically_increasing_id().alias("cid"), "embedding", "ids", F.coalesce("asked", F.lit(False)).alias("asked")
    )
    classes = written(classes)
    length = F.size("embedding").alias("length")
    sizes = classes.groupBy(length).agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("total"))
    return classes.join(written(sizes), F.size("embedding") == F.col("length")).drop("length"), asked


def _top(found: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    return found.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= k)


def _answers(pieces: DataFrame, k: int) -> DataFrame:
    """The k best rows per asker: asker and best, an array of (place, score, id, own)."""
    best = pieces.groupBy("length", "tab", "unit", "block").applyInArrow(_best_of_piece(k), _BEST)
    first = F.coalesce(F.col("ids")[0], F.lit(NO_ID))
    classes = _top(best.dropDuplicates(["asker", "cid"]), "asker", k, F.desc("score"), F.asc(first)).drop("place")
    rows = classes.select("asker", "score", F.explode("ids").alias("id"), (F.col("asker") == F.col("cid")).alias("own"))
    rows = _top(rows, "asker", k, F.desc("score"), F.asc_nulls_last("id"))
    return rows.groupBy("asker").agg(F.sort_array(F.collect_list(F.struct("place", "score", "id", "own"))).alias("best"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of every query row."""
    on_workers(vectors.sparkSession)
    classes, asked = _classes(vectors.select("vec_id", "embedding"), is_query, k + 1)
    kept = k + 1  # the query's own row may be among them
    crowded = classes.select("embedding", "n").mapInArrow(_units_of, "length int, tab int, unit bigint")
    crowded = crowded.groupBy("length", "tab", "unit").count().where(F.col("count") > PIECE)
    crowded = written(crowded.select("length", "tab", "unit", F.ceil(F.col("count") / PIECE).cast("int").alias("blocks")))
    plain = classes.select("cid", "embedding", "ids", "asked", "n")
    placed = plain.mapInArrow(_placed, _PLACED).join(crowded, ["length", "tab", "unit"], "left")
    answers = written(_answers(_in_blocks(placed, F.coalesce("blocks", F.lit(1))), kept))

    # a query with too few rows found is compared with all vectors of its length
    asking = classes.where("asked").select("cid", "embedding", "ids", "n", "total")
    held = asking.join(answers.withColumnRenamed("asker", "cid"), "cid", "left")
    short = written(held.where(F.coalesce(F.size("best"), F.lit(0)) < F.least(F.lit(kept), "total")).drop("best", "total"))
    if not short.isEmpty():
        every = [
            F.size("embedding").alias("length"), F.lit(-1).alias("tab"), F.lit(0).cast("bigint").alias("unit"), "cid",
            F.lit(False).alias("asks"), F.array(F.lit(0)).alias("fines"), "ids", "embedding", F.ceil(F.col("n") / PIECE).cast("int").alias("blocks"),
        ]
        both = classes.select(*every).unionByName(short.select(*every[:4], F.lit(True).alias("asks"), *every[5:]))
        exact = written(_answers(_in_blocks(both, F.col("blocks")), kept))
        answers = answers.join(exact, "asker", "left_anti").unionByName(exact)
    by_vector = asking.select("cid", "embedding").join(answers, F.col("cid") == F.col("asker")).select("embedding", "best")
    rows = join_few(asked, by_vector, ["embedding"])
    own = F.array_position(F.transform("best", lambda x: x["own"] & x["id"].eqNullSafe(F.col("vec_id"))), True).cast("int")
    rows = rows.select("vec_id", "best", own.alias("at"))
    others = F.when(F.col("at") == 0, F.col("best")).otherwise(
        F.concat(F.slice("best", F.lit(1), F.greatest(F.col("at") - 1, F.lit(0))), F.slice("best", F.col("at") + 1, F.lit(kept)))
    )
    rows = rows.select("vec_id", F.posexplode(F.slice(others, 1, k)).alias("at", "hit"))
    return rows.select(
        F.col("vec_id").alias("query_id"), (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score")
    )


def _in_blocks(placed: DataFrame, blocks: Column) -> DataFrame:
    """A vector lies in one block of its piece; a query looks into all of them."""
    own = F.array(F.pmod(F.xxhash64("cid"), blocks).cast("int"))
    every = F.sequence(F.lit(0), blocks - 1)
    return placed.select(
        "length", "tab", "unit", F.explode(F.when(F.col("asks"), every).otherwise(own)).alias("block"), "cid", "asks", "fines", "ids", "embedding"
    )
