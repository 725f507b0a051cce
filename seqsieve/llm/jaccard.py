"""N-gram Jaccard join by prefix filters under several token orders.

A document's tokens are the hashes of its word n-grams. Sorted by any one global order, two
sets of a Jaccard similarity of at least the threshold share a token among the first
``n - ceil(threshold * n) + 1`` of each, and the first one they share stands early enough
in both to leave room for the overlap. Three orders are used, all with frequent tokens last
(counted over all documents) and otherwise by unrelated hashes; a candidate pair must be
found under the first and share prefix tokens under the other two before its sets are
compared.

Documents with the same set are one class, so exact copies meet nobody. Groups of near
copies are not expanded into pairs: every class is first compared with one hub per shared
token, the one that has it earliest, and the links found make components. Then, within a
token, classes outside the hub's component are compared with those of other components;
pairs inside a component cannot change the result.

Cases: null text and text without words give an empty set, linked with nothing; with fewer
words than the n-gram has, the whole sequence is one token; a null doc_id counts as larger
than all others in a component; repeated rows are exact copies; texts are read whole;
further columns are not looked at. Tokens and classes are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqsieve.llm.common import forget, most_frequent, on_workers, text_hash, written
from seqsieve.llm.components import components

#: Tokens seen this often stand behind all others; at most so many are told apart (by
#: count, the most frequent first). Both only shape the orders: any order finds all links.
FREQUENT, MAX_FREQUENT = 8, 300_000
#: Tokens that a task counts at a time.
COUNTED = 4_000_000
_WORDS_KEPT = 200_000
#: Rows of three numbers, about 10 MB, that may be sent to all executors.
BROADCAST_PLACES = 300_000
#: Seeds of the second and third order.
ORDERS = [0x5851F42D4C957F2D, 0x14057B7EF767814F]
#: Bits of a token that candidates meet by; a chance meeting is found out later.
TOKEN_BITS = 44


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < _WORDS_KEPT:
            self[word] = value
        return value


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no pattern."""
    x = (x ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def tokens(text: bytes, width: int, hashes: dict) -> np.ndarray:
    """The sorted distinct hashes of the n-grams of ``text``."""
    words = text.lower().split()  # of bytes: A-Z, ASCII white space
    if not words:
        return np.array([], np.uint64)
    if len(words) < width:
        whole = xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))
        return np.array([whole], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    grams = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        grams = _mixed(grams + h[i : i + len(grams)], i + 1)
    return np.unique(grams)


def _signature(found: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes()))))


def _batches(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """A row per document (doc_id, row_hash, n, cid), and rows of tokens that a task saw twice."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", kind), T.StructField("row_hash", T.LongType()), T.StructField("n", T.LongType()),
            T.StructField("cid", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType())),
            T.StructField("counts", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _WordHashes(), set()
        pending, size = [], 0
        counted = (np.array([], np.uint64), np.array([], np.int64))

        def merged():
            keys, place = np.unique(np.concatenate([counted[0], *pending]), return_inverse=True)
            weights = np.concatenate([counted[1], np.ones(size, np.int64)])
            n = np.bincount(place, weights=weights, minlength=len(keys)).astype(np.int64)
            return keys[n > 1], n[n > 1]

        types = None
        for batch in batches:
            rows: list[list] = [[], []]
            for text in batch.column(2):
                found = tokens(text.as_py() or b"", width, hashes)
                cid = _signature(found)
                rows[0].append(len(found))
                rows[1].append(cid)
                if cid not in seen:
                    seen.add(cid)
                    pending.append(found)
                    size += len(found)
                    if size >= COUNTED:
                        counted, pending, size = merged(), [], 0
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            empty = pa.nulls(batch.num_rows, types[4])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), empty, empty],
                names=schema.names,
            )
        if types:
            keys, n = merged()
            for at in range(0, len(keys), 10_000):
                part = [[keys[at : at + 10_000].astype(np.int64)], [n[at : at + 10_000]]]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.nulls(1, t) for t in types[:4]), *(pa.array(x, types[4]) for x in part)], names=schema.names
                )

    return docs.select("doc_id", text_hash(docs["text"]).alias("row_hash"), docs["text"].cast("binary")).mapInArrow(run, schema)


def _frequent(scanned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pairs = scanned.where("counts IS NOT NULL").select(F.explode(F.arrays_zip("tokens", "counts")).alias("t"))
    counted = pairs.groupBy("t.tokens").agg(F.sum("t.counts").alias("n")).where(F.col("n") >= FREQUENT)
    top = most_frequent(counted, MAX_FREQUENT).toPandas()
    keys = top["tokens"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(keys)
    return keys[order], top["n"].to_numpy(np.int64)[order]


class _Prefixes:
    def __init__(self, keys: np.ndarray, counts: np.ndarray, share: tuple[int, int]) -> None:
        self.keys, self.counts, self.share = keys, counts, share

    def first(self, found: np.ndarray) -> np.ndarray:
        """The prefix under the first order, TOKEN_BITS of each token."""
        return (self._prefixes(found, [0])[0] >> np.uint64(64 - TOKEN_BITS)).astype(np.int64)

    def others(self, found: np.ndarray) -> list[np.ndarray]:
        """The prefixes under the other orders, 32 bits of each token."""
        return [x.astype(np.uint32).astype(np.int32) for x in self._prefixes(found, ORDERS)]

    def _prefixes(self, found: np.ndarray, seeds: list[int]) -> list[np.ndarray]:
        num, den = self.share
        length = len(found) - (num * len(found) + den - 1) // den + 1
        counts = np.zeros(len(found), np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            counts = np.where(self.keys[at] == found, self.counts[at], 0)
        rare = found[counts == 0]
        out = []
        for seed in seeds:
            if len(rare) >= length:
                key = _mixed(rare, seed) if seed else rare
                out.append(np.sort(key)[:length])
            else:
                key = _mixed(found, seed) if seed else found
                out.append(key[np.lexsort((key, counts))[:length]])
        return out


def _classes(docs: DataFrame, prefixes, width: int) -> DataFrame:
    """A row per class and task that met it: id (small, so that entries stay narrow), cid, n
    and its prefix under the first order."""
    arrow = pa.schema([("cid", pa.int64()), ("n", pa.int64()), ("first", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, prefix = _WordHashes(), set(), prefixes.value.first
        for batch in batches:
            rows: list[list] = [[] for _ in arrow]
            for text in batch.column(0):
                found = tokens(text.as_py() or b"", width, hashes)
                cid = _signature(found)
                if len(found) and cid not in seen:
                    seen.add(cid)
                    for column, value in zip(rows, (cid, len(found), prefix(found)), strict=True):
                        column.append(value)
            yield _batches(rows, arrow)

    found = docs.select(docs["text"].cast("binary")).mapInArrow(run, "cid bigint, n bigint, first array<bigint>")
    return found.select(F.monotonically_increasing_id().alias("id"), "*")


def _room(a: str, b: str, share: tuple[int, int]) -> Column:
    """Whether the tokens from the shared one on can make up the overlap that is asked for."""
    left = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    return (share[0] + share[1]) * left >= share[0] * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, prefixes, width: int, share: tuple[int, int]) -> DataFrame:
    """Of the pairs (a, b; a table, used up) those that share prefix tokens under the other
    orders too and whose whole sets are as similar as asked for."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    places = rows.join(wanted, "cid", "left_semi").groupBy("cid").agg(F.min(F.struct("doc_id", "row_hash")).alias("row"))
    places = written(places.select("cid", F.col("row.doc_id").alias("at_id"), F.col("row.row_hash").alias("at_hash")))
    keyed = docs.select("doc_id", text_hash(docs["text"]).alias("row_hash"), docs["text"].cast("binary").alias("text"))

    def texts(places: DataFrame) -> DataFrame:
        near = F.broadcast(places) if places.count() <= BROADCAST_PLACES else places  # else texts are shuffled to them
        match = keyed["doc_id"].eqNullSafe(near["at_id"]) & (keyed["row_hash"] == near["at_hash"])
        return keyed.join(near, match).select("cid", "text")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
        hashes = _WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield part.column(0), [tokens(text.as_py() or b"", width, hashes) for text in part.column(1)]

    def prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = prefixes.value.others
        for cids, sets in sets_of(batches):
            found = [others(s) for s in sets]
            columns = [pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in range(len(ORDERS))]
            yield pa.RecordBatch.from_arrays([cids, *columns], names=["cid", "second", "third"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cids, sets in sets_of(batches):
            yield pa.RecordBatch.from_arrays([cids, pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["cid", "tokens"])

    # repeated rows come up several times: the pairs below are made distinct again
    heads = written(texts(places).mapInArrow(prefixed, "cid bigint, second array<int>, third array<int>"))
    sides = [heads.select(F.col("cid").alias(c), F.col("second").alias(f"{c}2"), F.col("third").alias(f"{c}3")) for c in "ab"]
    met = pairs.join(sides[0], "a").join(sides[1], "b").where(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3"))
    met = written(met.select("a", "b").distinct())
    # whole sets are made, written and shuffled of the few classes that are left only
    left = met.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    fewer = written(places.join(left, "cid", "left_semi"))
    sets = written(texts(fewer).mapInArrow(whole, "cid bigint, tokens array<bigint>"))
    sides = [sets.select(F.col("cid").alias(c), F.col("tokens").alias(f"t{c}")) for c in "ab"]
    common = F.size(F.array_intersect("ta", "tb"))
    union = F.size("ta") + F.size("tb") - common
    links = met.join(sides[0], "a").join(sides[1], "b").where(share[1] * common >= share[0] * union).select("a", "b").distinct()
    links = written(links)
    forget(heads, sets, met, pairs, places, fewer)
    return links


def similar_classes(docs: DataFrame, width: int = 5, share: tuple[int, int] = (4, 5)) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row_hash, n, cid) of all documents, and links between their classes (a, b)
    that connect every class with all it can reach."""
    on_workers(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    scanned = written(_scan(docs, width))
    rows = scanned.where("cid IS NOT NULL").drop("tokens", "counts")
    prefixes = docs.sparkSession.sparkContext.broadcast(_Prefixes(*_frequent(scanned), share))
    classes = written(_classes(docs, prefixes, width))
    entries = classes.select("id", F.posexplode("first").alias("pos", "token"))
    # a token that occurs once leads nowhere; counting needs the narrowest rows
    shared = written(entries.groupBy("token").agg(F.count("*").alias("times")).where("times > 1").select("token"))
    entries = entries.join(shared, "token").join(classes.select("id", "cid", "n"), "id")
    entries = written(entries.select("token", "cid", "n", "pos").distinct())
    hubs = written(entries.groupBy("token").agg(F.min(F.struct("pos", "n", "cid")).alias("hub")))
    entries_, entries = entries, written(entries.join(hubs, "token").select("token", "cid", "n", "pos", "hub"))
    forget(classes, shared, hubs, entries_)
    to_hub = entries.where((F.col("cid") != F.col("hub.cid")) & (
        (share[0] + share[1]) * F.least(F.col("n") - F.col("pos"), F.col("hub.n") - F.col("hub.pos"))
        >= share[0] * (F.col("n") + F.col("hub.n"))
    ))
    pairs = written(_ordered(to_hub.select(F.col("cid").alias("a"), F.col("hub.cid").alias("b"))).distinct())
    links = _verified(written(pairs), docs, rows, prefixes, width, share)
    roots = components(links)

    root = lambda side, c: roots.select(F.col("node").alias(c), F.col("root").alias(side))
    placed = entries.join(root("own", "cid"), "cid", "left").withColumn("own", F.coalesce("own", "cid"))
    placed = placed.withColumn("hub_cid", F.col("hub.cid")).join(root("hub_root", "hub_cid"), "hub_cid", "left")
    placed = written(placed.select("token", "cid", "n", "pos", "own", F.coalesce("hub_root", "hub_cid").alias("hub_root")))
    outside = placed.where("own <> hub_root")
    tokens_left = outside.select("token").distinct()
    others = placed.join(tokens_left, "token", "left_semi").alias("y")
    crossing = (
        outside.alias("x")
        .join(others, F.col("x.token") == F.col("y.token"))
        .where((F.col("x.own") != F.col("y.own")) & ((F.col("y.own") == F.col("y.hub_root")) | (F.col("x.cid") < F.col("y.cid"))))
        .where(_room("x", "y", share))
    )
    more = _ordered(crossing.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))).distinct()
    more = written(more.join(pairs, ["a", "b"], "left_anti"))
    forget(entries, pairs, placed, roots)
    return rows, written(links.unionByName(_verified(more, docs, rows, prefixes, width, share)))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _placed(docs: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """doc_id, row_hash, n and the root of its component for every row."""
    rows, links = similar_classes(docs, width, share)
    roots = components(links)
    placed = rows.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    return written(placed.drop("cid"))


def near_duplicates(docs: DataFrame, width: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id, row_hash, n_shingles and component_id (smallest doc_id within reach) of every row.

    ``share`` is the least Jaccard similarity as a fraction.
    """
    placed = _placed(docs, width, share)
    least = written(placed.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least")))
    return placed.join(least, "root", "left").select(
        "doc_id", "row_hash", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, width: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: that of the smallest doc_id,
    null last (of several texts with it, the one of least hash, as often as it is repeated).
    Documents with empty sets all stay."""
    placed = _placed(docs, width, share)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_hash")
    first = placed.where("n > 0").groupBy("root").agg(F.min(rank).alias("row")).select("row.doc_id", "row.row_hash")
    kept = written(first.union(placed.where("n = 0").select("doc_id", "row_hash").distinct()).toDF("_kept_id", "_kept_hash"))
    match = docs["doc_id"].eqNullSafe(kept["_kept_id"]) & (text_hash(docs["text"]) == kept["_kept_hash"])
    return docs.join(kept, match, "left_semi")
