"""Language identification by prediction by partial matching over bytes.

Each language's statistics are a tree of byte contexts up to ORDER long, counted on a
sample of labelled texts and then frozen. A byte costs, in bits, what an arithmetic coder
would pay: in the longest known context its share of the counts, or else the escape
(as frequent as the context has successors) and its cost in the next shorter context,
where bytes known to the longer one are excluded; bytes never seen share what is left.
A text's language is the one with the shortest code; the score is its posterior
probability, all languages being equally likely before.

All byte strings of ORDER + 1 seen in some language have their costs worked out once; the
few others are worked out as they come up. Texts are lower-cased and runs of anything but
letters count as one space.

Cases: null text and text without a letter are ``und`` with score 0, and so is everything
if no labelled text was there to learn from; ties go to the first language in order; long
texts are scored in blocks; repeated rows and further columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqsieve.llm.common import crc_remainder, on_workers, uniform

ORDER = 3
#: Characters of sample per language, about, and of all languages together.
SAMPLE_CHARS, SAMPLE_TOTAL = 400_000, 4_000_000
#: Texts of a language that are learned from at least, and parts of the range of hashes.
LEAST_TEXTS, CELLS = 8, 4096
BLOCK = 1 << 20
UNKNOWN = "und"


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}]++", " ")


def _grams(block: np.ndarray) -> np.ndarray:
    """Codes of all strings of ORDER + 1 bytes, the last byte lowest."""
    block = block.astype(np.uint32)
    codes = np.zeros(len(block) - ORDER, np.uint32)
    for i in range(ORDER + 1):
        codes = (codes << np.uint32(8)) | block[i : i + len(codes)]
    return codes


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys``, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


class ContextTree:
    """One language's counts: per order the strings of context and byte, and the contexts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.grams, self.contexts = [], []
        for order in range(ORDER + 1):
            mask = np.uint32((1 << 8 * (order + 1)) - 1)
            keys, place = np.unique(grams & mask, return_inverse=True)
            n = np.bincount(place, weights=counts, minlength=len(keys))
            self.grams.append((keys, n))
            contexts, place = np.unique(keys >> np.uint32(8), return_inverse=True)
            totals = np.bincount(place, weights=n)
            kinds = np.bincount(place).astype(float)
            shorter = np.zeros(len(contexts))  # counts that the context's own bytes have one order below
            if order:
                below, n_below = self.grams[order - 1]
                at, _ = _find(below, keys & np.uint32((1 << 8 * order) - 1))
                shorter = np.bincount(place, weights=n_below[at])
            self.contexts.append((contexts, totals, kinds, shorter))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each string after the bytes before it."""
        cost = np.zeros(len(grams))
        open_ = np.arange(len(grams))
        out, out_kinds = np.zeros(len(grams)), np.zeros(len(grams))  # excluded: counts, kinds of bytes
        for order in range(ORDER, -1, -1):
            part = grams[open_] & np.uint32((1 << 8 * (order + 1)) - 1)
            contexts, totals, kinds, shorter = self.contexts[order]
            at, known = _find(contexts, part >> np.uint32(8))
            escapes = np.where(known, kinds[at] - out_kinds[open_], 0)
            all_ = np.where(known, totals[at] - out[open_], 0) + escapes
            keys, n = self.grams[order]
            where, seen = _find(keys, part)
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(seen, np.log2(all_ / n[where]), np.where(escapes > 0, np.log2(all_ / escapes), 0))
            cost[open_] += step
            out[open_] = np.where(known, shorter[at], 0)
            out_kinds[open_] = np.where(known, kinds[at], 0)
            open_ = open_[~seen]
        cost[open_] += np.log2(256 - out_kinds[open_])
        return cost


@dataclass
class Model:
    """Frozen statistics of all languages."""

    languages: list[str]
    trees: list[ContextTree]
    grams: np.ndarray
    costs: np.ndarray

    @staticmethod
    def of(counted: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
        languages = sorted(counted)
        trees = [ContextTree(*counted[lang]) for lang in languages]
        grams = np.unique(np.concatenate([counted[lang][0] for lang in languages])) if languages else np.array([], np.uint32)
        costs = np.stack([tree.bits(grams) for tree in trees], axis=1) if languages else np.zeros((0, 0))
        return Model(languages, trees, grams, costs.astype(np.float32))

    def block_bits(self, block: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits by language of the strings that start in each [bounds[i], bounds[i + 1])."""
        grams = _grams(block)
        at, seen = _find(self.grams, grams)
        costs = self.costs[at]
        if not seen.all():
            rare, place = np.unique(grams[~seen], return_inverse=True)
            costs[~seen] = np.stack([tree.bits(rare) for tree in self.trees], axis=1)[place]
        costs = np.concatenate([costs, np.zeros((1, len(self.trees)), np.float32)])
        return np.add.reduceat(costs, np.minimum(bounds, len(grams)), axis=0, dtype=np.float64)

    def text_bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths of whole texts by language; texts and parts of long ones share blocks."""
        total = np.zeros((len(texts), len(self.languages)))
        parts, owners, bounds, size = [], [], [], 0

        def settle() -> None:
            if parts:
                block = np.frombuffer(b"".join(parts), np.uint8)
                bits = self.block_bits(block, np.array(bounds))[::2]
                np.add.at(total, owners, bits)

        for i, text in enumerate(texts):
            padded = b" " * ORDER + text
            for start in range(0, len(text), BLOCK):
                part = padded[start : start + BLOCK + ORDER]
                parts.append(part)
                owners.append(i)
                bounds += [size, size + len(part) - ORDER]
                size += len(part)
                if size >= BLOCK:
                    settle()
                    parts, owners, bounds, size = [], [], [], 0
        settle()
        return total


def learn(docs: DataFrame, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model from the labelled rows of ``docs`` (doc_id, text, lang).

    The classifier is fitted on a sample: texts of each language in the order of a hash of
    id and text, until they have about ``sample_chars`` characters, and LEAST_TEXTS at least
    (all, if there are fewer). Strings are counted on Spark; the driver gets distinct strings
    with counts, at most as many as the sample has bytes.
    """
    on_workers(docs.sparkSession)
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang", "text")
    labelled = labelled.withColumn("draw", uniform(F.col("doc_id"), F.col("text"), F.lit("language sample")))
    # no language is sorted as a whole: a cell is a small part of the range of hashes
    cell = F.floor(F.col("draw") * CELLS).cast("int")
    cells = labelled.groupBy("lang", cell.alias("cell")).agg(F.count("*").alias("texts"), F.sum(F.length("text")).alias("chars"))
    before = Window.partitionBy("lang").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("texts", "chars")]
    kinds = labelled.select("lang").distinct().count()
    budget = min(sample_chars, SAMPLE_TOTAL // max(1, kinds))
    wanted = (F.col("texts_before") < LEAST_TEXTS) | (F.col("chars_before") < budget)
    taken = cells.select("lang", "cell", *sums).where(wanted)
    sample = labelled.withColumn("cell", cell).join(F.broadcast(taken), ["lang", "cell"]).select("lang", "text", "draw", "texts_before", "chars_before")
    # within the last cell the same rule, text by text
    row = Window.partitionBy("lang", "texts_before").orderBy("draw", "text").rowsBetween(Window.unboundedPreceding, -1)
    earlier = [F.coalesce(F.count("text").over(row), F.lit(0)), F.coalesce(F.sum(F.length("text")).over(row), F.lit(0))]
    sample = sample.withColumn("t", F.col("texts_before") + earlier[0]).withColumn("c", F.col("chars_before") + earlier[1])
    sample = sample.where((F.col("t") < LEAST_TEXTS) | (F.col("c") < budget)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                for text, other in zip(batch.column(1), langs, strict=True):
                    if other == lang and (text := text.as_py()):
                        padded = np.frombuffer(b" " * ORDER + text, np.uint8)
                        codes, n = np.unique(_grams(padded), return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))],
                            names=["lang", "gram", "n"],
                        )

    grams = sample.select("lang", normal_text(F.col("text")).cast("binary").alias("text")).mapInArrow(
        count, "lang string, gram bigint, n bigint"
    )
    counted = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return Model.of(
        {
            lang: (part["gram"].to_numpy(np.uint32), part["n"].to_numpy(float))
            for lang, part in counted.sort_values("gram").groupby("lang")
        }
    )


def language(docs: DataFrame, model: Model) -> Column:
    """A struct of lang_pred and score for the column ``text`` of ``docs``."""
    spark = docs.sparkSession
    on_workers(spark)
    if not model.languages:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for texts in batches:
            texts = [text if text and text.strip() else b"" for text in texts]
            empty = np.array([not text for text in texts], bool)
            bits = model.text_bits(texts)
            best = bits.argmin(axis=1) if len(texts) else np.array([], int)
            gap = bits - bits.min(axis=1, keepdims=True) if len(texts) else bits
            posterior = 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)
            yield pd.DataFrame({"lang_pred": names[np.where(empty, -1, best)], "score": np.where(empty, 0.0, posterior)})

    return score(normal_text(docs["text"]).cast("binary"))


def held_out() -> Column:
    return crc_remainder(F.col("doc_id"), 4) == 2


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; held-out rows teach nothing."""
    model = learn(docs.where(~held_out()))
    return docs.select("doc_id", held_out().alias("held_out"), language(docs, model).alias("found")).select(
        "doc_id", "held_out", "found.lang_pred", "found.score"
    )
