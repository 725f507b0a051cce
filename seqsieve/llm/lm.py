"""Scores of whole documents by a gated recurrent language model and by word counts.

Words are counted over all training documents. The model knows the most frequent ones
and, by their last two bytes, groups of all others; a word of a group has the group's
probability times its share of the group's counts (plus 0.1, and as much for all words
never seen). Counts, classes, shares and the recurrent weights come from all of them.

Every text becomes ids once; they are stored, and serve training and scoring. The recurrent
weights learn in one pass over all training documents, which ROUNDS share out: in a round, each
of at most TASKS tasks trains the weights so far on its documents, SHARD_TOKENS words at a time,
and the mean of what the tasks arrive at, weighted by words, goes into the next round. Who trains
on what follows from id, text and place alone. Training starts afresh within a document every
PIECE words, so a long document is trained on whole, by several tasks; scores carry the
state through.

Counts of the KNOWN most frequent words, a list of bounded size, go to the workers; those
of all others are joined to the few occurrences of such words in each document.

Cases: null text is empty and scores its end token alone; null ids hash as empty text;
texts are read whole, however long; repeated rows are scored each; without training
documents all counts are 0 and the model is uniform over what it has; further columns
are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqsieve.llm.common import crc_remainder, most_frequent, on_workers, uniform, written
from seqsieve.llm.gru import GatedModel

CLASSES, CLASS_SIZE = 48, 48
GROUPS = 64
KNOWN = 200_000
ROUNDS, SHARD_TOKENS, SHARD_LANES = 3, 2_000_000, 512
#: Tasks of a round, and weights that one task averages; so TASKS / FAN_IN come to the driver.
TASKS, FAN_IN = 4096, 64
PIECE = 4096
#: Tokens that a task scores at a time; bytes of text that it cuts into words at a time.
SCORED, CUT = 1_500_000, 16_000_000


def held_out() -> Column:
    return crc_remainder(F.col("doc_id"), 10) == 0


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # of bytes: A-Z, ASCII white space


def _cut(texts: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray, pa.Array]]:
    """The words of binary ``texts``, about CUT bytes at a time: the rows, the number of words of each,
    every word's place among the distinct ones, and those."""
    plain, kind = (pa.large_binary(), pa.large_string()) if pa.types.is_large_binary(texts.type) else (pa.binary(), pa.string())
    texts = pc.fill_null(texts, b"")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(texts):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + CUT, "right")))
        part = texts.slice(begin, end - begin)
        # as strings only in name: nothing is decoded, and bytes that are no UTF-8 pass
        part = pa.Array.from_buffers(kind, len(part), part.buffers(), offset=part.offset)
        split = pc.ascii_split_whitespace(pc.ascii_lower(part))
        bounds = split.offsets.to_numpy()
        words = split.flatten().dictionary_encode()
        places, distinct = words.indices.to_numpy(), words.dictionary
        distinct = pa.Array.from_buffers(plain, len(distinct), distinct.buffers()).cast(pa.binary())
        lengths = np.diff(bounds).astype(np.int64)
        empty = pc.index(distinct, b"").as_py()
        if empty >= 0:  # white space at the ends
            full = places != empty
            lengths = np.diff(np.concatenate([[0], np.cumsum(full)])[bounds - bounds[0]])
            places = places[full]
        yield slice(begin, end), lengths, places, distinct
        begin = end


def _group(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % GROUPS


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary) and n over all rows."""
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, places, distinct in _cut(batch.column(0)):
                counts = np.bincount(places, minlength=len(distinct))
                counts = pa.RecordBatch.from_arrays([distinct, pa.array(counts, pa.int64())], names=["word", "n"])
                yield counts.filter(pc.field("n") > 0)

    parts = docs.select(docs["text"].cast("binary")).mapInArrow(run, "word binary, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class Scorer:
    """What a worker needs: counts of known words, their ids, and the model."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, kinds: int, documents: int, groups: dict) -> None:
        n_ids = CLASSES * CLASS_SIZE
        inside = n_ids - GROUPS - 1
        self.words = words
        self.total, self.kinds = total, kinds  # N and V, the end token included
        c = np.array(counts, float)
        self.base = np.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
        self.end_base = float(np.log10((documents + 0.1) / (total + 0.1 * (kinds + 1))))
        self.end_known = documents > 0
        # what the words outside the model have in each group: all words less the model's own
        mass = np.array([groups.get(g, (0, 0)) for g in range(GROUPS)], float).reshape(GROUPS, 2)
        for word, n in zip(words[:inside], counts[:inside], strict=True):
            mass[_group(word)] -= (n, 1)
        self.group_log = np.log10(mass[:, 0] + 0.1 * (mass[:, 1] + 1))
        # ids by frequency, the end token first
        frequency = np.concatenate([[documents], c[:inside], mass[:, 0] + 1])
        order = np.argsort(-frequency[1:], kind="stable") + 1
        ids = np.zeros(len(frequency), np.int64)
        ids[order] = np.arange(1, len(frequency))
        self.frequency = np.concatenate([frequency[:1] + 1, frequency[order]])
        self.group_ids = ids[1 + min(len(words), inside) :]
        outside = [_group(word) for word in words[inside:]]
        self.ids = np.concatenate([ids[1 : 1 + min(len(words), inside)], self.group_ids[outside]]).astype(np.int64)
        self.share = np.concatenate([np.zeros(min(len(words), inside)), np.log10(c[inside:] + 0.1) - self.group_log[outside]])
        self.model = GatedModel(CLASSES, CLASS_SIZE)
        self.model.set_frequencies(self.frequency)
        self.model.freeze()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "places"}

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word its id, its part of the base score, its log10 share, and its group if it is an other word, else -1.

        An other word has 0 for what its count decides.
        """
        if "places" not in self.__dict__:
            self.places = pa.array(self.words, pa.binary())
        at = pc.fill_null(pc.index_in(words, value_set=self.places), -1).to_numpy(zero_copy_only=False)
        known, others = at >= 0, np.flatnonzero(at < 0)
        ids, base, share = np.zeros(len(words), np.int64), np.zeros(len(words)), np.zeros(len(words))
        ids[known], base[known], share[known] = self.ids[at[known]], self.base[at[known]], self.share[at[known]]
        group = np.full(len(words), -1)
        group[others] = list(map(_group, words.take(pa.array(others)).to_pylist()))
        ids[others] = self.group_ids[group[others]]
        return ids, base, share, group

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, float, float, int, Counter]:
        """Ids with the end; of known words the base score, log10 shares and number; the other words."""
        ids, base, share, group = self.look_up(pa.array(words, pa.binary()))
        others = Counter(words[i] for i in np.flatnonzero(group >= 0))
        return np.append(ids, 0), float(base.sum()), float(share.sum()), int((group < 0).sum()), others


def count(docs: DataFrame) -> tuple[Scorer, DataFrame]:
    """A scorer with what all rows of ``docs`` count, its recurrent weights untrained, and the table of all word counts."""
    counts = written(count_words(docs))
    group = F.crc32(F.substring("word", -2, 2)) % GROUPS
    sums = counts.groupBy(group.cast("int").alias("g")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    groups = {row.g: (row.n, row.v) for row in sums}
    documents = docs.count()
    tokens = sum(n for n, _ in groups.values())
    top = most_frequent(counts, KNOWN).toPandas().sort_values(["n", "word"], ascending=[False, True])
    kinds = sum(v for _, v in groups.values()) + (documents > 0)
    words = [bytes(w) for w in top["word"]]
    return Scorer(words, top["n"].tolist(), tokens + documents, kinds, documents, groups), counts


def _ids(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<u2").astype(np.int64)


def encode(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """Per row its ids, all that needs no counts of rare words, and its rare words; written, so that row_id stays."""
    on_workers(docs.sparkSession)
    docs = docs.select("doc_id", "text").withColumn("row_id", F.monotonically_increasing_id())
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    rare = T.StructType().add("word", "binary").add("times", "long").add("share", "double")
    schema = T.StructType([docs.schema["row_id"], docs.schema["doc_id"]]).add("n_tokens", "long").add("n_known", "long")
    schema = schema.add("base_score", "double").add("share", "double").add("rare", T.ArrayType(rare)).add("ids", "binary")

    def listed(rows: int, owners: np.ndarray, places: np.ndarray, distinct: pa.Array, shares: np.ndarray) -> pa.Array:
        """The rare words of each row, as arrays of all rows together."""
        pairs, times = np.unique(owners * len(distinct) + places, return_counts=True)
        owners, places = np.divmod(pairs, max(1, len(distinct)))
        offsets = np.searchsorted(owners, np.arange(rows + 1)).astype(np.int32)
        items = [distinct.take(pa.array(places)), pa.array(times, pa.int64()), pa.array(shares[places])]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(items, ["word", "times", "share"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for batch in batches:
            for rows, lengths, places, distinct in _cut(batch.column(2)):
                ends = np.cumsum(lengths + 1)  # each row's words and then its end
                starts, size = ends - lengths - 1, int(ends[-1])
                inside = np.ones(size, bool)
                inside[ends - 1] = False

                def laid(by_word: np.ndarray, end: float) -> np.ndarray:
                    out = np.full(size, end, by_word.dtype)  # noqa: B023
                    out[inside] = by_word[places]  # noqa: B023
                    return out

                ids, base, share, group = scorer.look_up(distinct)
                sums = [((group < 0).astype(np.int64), int(scorer.end_known)), (base, scorer.end_base), (share, 0.0)]
                sums = [np.add.reduceat(laid(*part), starts) for part in sums]
                rare = np.flatnonzero(group[places] >= 0)
                owners = np.repeat(np.arange(len(lengths)), lengths)[rare]
                stored = [None, pa.py_buffer(np.append(0, 2 * ends).astype(np.int32)), pa.py_buffer(laid(ids.astype("<u2"), 0))]
                columns = [pa.array(lengths + 1), *map(pa.array, sums), listed(len(lengths), owners, places[rare], distinct, -scorer.group_log[group])]
                keys = [batch.column(c).slice(rows.start, len(lengths)) for c in (0, 1)]
                columns = [*keys, *columns, pa.Array.from_buffers(pa.binary(), len(lengths), stored)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return written(docs.select("row_id", "doc_id", docs["text"].cast("binary")).mapInArrow(run, schema))


def train(encoded: DataFrame, model: GatedModel) -> None:
    """Trains ``model`` on all rows, in ROUNDS over disjoint parts of them."""
    tokens = encoded.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    place = F.explode(F.sequence(F.lit(0), F.col("n_tokens") - 1, F.lit(PIECE))).alias("place")
    cut = encoded.select("doc_id", F.col("ids").alias("all"), F.xxhash64("ids").alias("hash"), place)
    piece = F.substring("all", (F.col("place") * 2 + 1).cast("int"), F.lit(2 * PIECE))
    draw = uniform(F.col("doc_id"), F.col("hash"), F.col("place"), F.lit("recurrent piece"))
    pieces = cut.select(draw.alias("draw"), piece.alias("ids"))
    for number in range(ROUNDS if tokens else 0):
        low, high = number / ROUNDS, (number + 1) / ROUNDS
        own = pieces.where((F.col("draw") >= low) & (F.col("draw") < high))
        _train_round(own, model, min(TASKS, -(-tokens // (ROUNDS * SHARD_TOKENS))))


def _train_round(pieces: DataFrame, model: GatedModel, tasks: int) -> None:
    names = sorted(model.p)
    shared = pieces.sparkSession.sparkContext.broadcast(model.p)
    schema = "task bigint, size bigint, weights binary"

    def stored(task: int, size: int, weights: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([task], pa.int64()), pa.array([size], pa.int64()), pa.array([weights.astype("<f4").tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["task", "size", "weights"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = GatedModel(CLASSES, CLASS_SIZE)
        own.p = {k: v.copy() for k, v in shared.value.items()}
        moments: dict = {}
        docs, size, total, task = [], 0, 0, None
        for batch in batches:
            for number, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                task = number if task is None else task
                docs.append(_ids(ids.as_py()))
                size += len(docs[-1])
                if size >= SHARD_TOKENS:
                    own.train(docs, passes=1, lanes=SHARD_LANES, moments=moments)
                    docs, size, total = [], 0, total + size
        if docs:
            own.train(docs, passes=1, lanes=SHARD_LANES, moments=moments)
        if task is not None:
            yield stored(task, total + size, np.concatenate([own.p[k].ravel() for k in names]))

    def mean(table: pa.Table) -> pa.Table:
        weights, sizes = 0.0, 0
        for task, size, own in sorted(zip(*(table.column(c).to_pylist() for c in ("task", "size", "weights")), strict=True)):
            weights, sizes = weights + size * np.frombuffer(own, "<f4").astype(float), sizes + size
        return pa.Table.from_batches([stored(table.column("task")[0].as_py() // FAN_IN, sizes, weights / sizes)])

    # as many partitions as asked for: by size they would be merged into too few tasks
    dealt = pieces.withColumn("task", F.pmod(F.xxhash64("draw"), F.lit(tasks))).repartition(tasks, "task")
    trained = dealt.sortWithinPartitions("task", "draw", "ids").select("task", "ids").mapInArrow(train, schema)
    if tasks > FAN_IN:
        trained = trained.groupBy(F.floor(F.col("task") / FAN_IN)).applyInArrow(mean, schema)
    rows = trained.collect()
    if not rows:
        return
    table = pa.table({n: [row[n] for row in rows] for n in ("task", "size", "weights")})
    weights = np.frombuffer(mean(table).column("weights")[0].as_py(), "<f4")
    for k in names:
        model.p[k] = weights[: model.p[k].size].reshape(model.p[k].shape).copy()
        weights = weights[model.p[k].size :]
    model.freeze()


def _recurrent(encoded: DataFrame, model: GatedModel) -> DataFrame:
    """row_id and the model's score of the ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(rows: list, docs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(shared.value.score(docs), pa.float64())], names=["row_id", "recurrent"])

        rows, docs, size = [], [], 0
        for batch in batches:
            for row, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows.append(row)
                docs.append(_ids(ids.as_py()))
                size += len(docs[-1])
                if size >= SCORED:
                    yield settle(rows, docs)
                    rows, docs, size = [], [], 0
        if rows:
            yield settle(rows, docs)

    return encoded.select("row_id", "ids").mapInArrow(run, "row_id bigint, recurrent double")


def score(encoded: DataFrame, scorer: Scorer, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every encoded row."""
    rare = encoded.select("row_id", F.explode("rare").alias("r")).select("row_id", "r.word", "r.times", "r.share")
    c = F.coalesce(F.col("n"), F.lit(0))
    own = F.log10(c + F.lit(0.1))
    sums = (
        rare.join(counts, "word", "left")
        .groupBy("row_id")
        .agg(
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * (own - F.lit(float(np.log10(scorer.total + 0.1 * (scorer.kinds + 1)))))).alias("more_base"),
            F.sum(F.col("times") * (own + F.col("share"))).alias("more_score"),
        )
    )
    whole = encoded.drop("rare", "ids").join(_recurrent(encoded, scorer.model), "row_id").join(sums, "row_id", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0)))
    return whole.select(
        "doc_id", "n_tokens", plus("n_known", "more_known").alias("n_known"), F.lit(scorer.total).cast("long").alias("train_tokens"),
        plus("base_score", "more_base").alias("base_score"), (plus("share", "more_score") + F.col("recurrent")).alias("score"),
    )


def score_corpus(docs: DataFrame) -> DataFrame:
    """Scores of all rows by what the rows that are not held out teach."""
    scorer, counts = count(docs.where(~held_out()))
    encoded = encode(docs, scorer)
    train(encoded.where(~held_out()), scorer.model)
    return score(encoded, scorer, counts).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
