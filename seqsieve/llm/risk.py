"""Quality rules whose cutoffs keep the risk of rejecting good documents below a limit.

A rule rejects documents whose measure exceeds a cutoff. Labelled documents decide the
cutoffs: one is admissible in a stratum if, were the true rate of false rejections above
the rule's share of the limit, so few rejections among the stratum's good documents would
have a probability of at most ``confidence`` over all tests made (the exact binomial bound,
Bonferroni-corrected over strata, rules and cutoffs). The shares of all rules add up to
``limit``, so the rules together keep to it. Of the admissible cutoffs the one that rejects
most bad documents is taken, the highest of several; a rule that catches none is not used.

Cases: null text has no words and fails the base rule, as empty text does; documents
without words have ratios of 0; texts are read whole, one at a time; repeated rows are
measured alike; a document with several labels is good if all of them say so, labels with
a null id or value are left out; with no or too few labels no cutoff is admissible and the
base rule decides alone; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqsieve.llm.common import on_workers, written

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

#: A rule's measure and the cutoffs tried, from the strictest to the laxest.
RULES: dict[str, tuple[Column | str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [0.02 * 1.35**i for i in range(16)]),
    "repeats": ("n_repeat_words / n_words", [0.02 + 0.03 * i for i in range(16)]),
    "dup_lines": ("n_dup_lines / n_lines", [0.02 * 1.3**i for i in range(15)]),
    "long_words": ("word_chars / n_words", [5.0 + 0.5 * i for i in range(20)]),
    "short_words": ("- word_chars / n_words", [-6.0 + 0.25 * i for i in range(20)]),
}
#: Length bands: words from which each starts.
BANDS = [0, 200, 1000]


def _repeated_words(ids: np.ndarray) -> int:
    """Positions covered by three-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    n = int(ids.max()) + 1
    pairs = ids[:-1] * n + ids[1:]
    if n >= 1 << 20:  # three ids no longer fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def _measure(text: bytes) -> tuple[int, ...]:
    words = text.split()  # of bytes: at ASCII white space
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(word, len(known)) for word in words], dtype=np.int64)
    lines, seen, repeated = text.split(b"\n"), set(), 0
    filled = [line for line in lines if line.strip()]
    for line in filled:
        repeated += line in seen
        seen.add(line)
    continuation = np.frombuffer(text, np.uint8)
    points = len(text) - int(np.count_nonzero((continuation & 0xC0) == 0x80))
    spaces = sum(text.count(c) for c in b"\t\n\v\f\r ")
    symbols = sum(text.count(c) for c in b"#*$%&|<>")
    return len(words), points - spaces, symbols, repeated, _repeated_words(ids), len(filled)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row's whole text."""
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_measure(text.as_py() or b"") for text in batch.column(1)]
            counts = np.array(rows, dtype=np.int64).reshape(len(rows), len(COUNTS))
            columns = [batch.column(0), *(pa.array(counts[:, i]) for i in range(len(COUNTS)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTS])

    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in COUNTS)]
    )
    return docs.select("doc_id", docs["text"].cast("binary")).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def length_band() -> Column:
    return reduce(lambda band, start: F.when(F.col("n_words") >= start, start).otherwise(band), BANDS[1:], F.lit(BANDS[0]))


def _measures() -> dict[str, Column]:
    return {name: F.coalesce(F.expr(f"try_divide({' , '.join(m.split(' / '))})"), F.lit(0.0)) for name, (m, _) in RULES.items()}


def binomial_tail(n: int, k: int, p: float) -> float:
    """P(at most k of n) at rate p, exactly: the incomplete beta function by its continued fraction."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    return _beta(n - k, k + 1, 1 - p)


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    total = d
    for m in range(1, 10_000_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d if abs(1 + top * d) > 1e-300 else 1e-300)
            c = 1 + top / c if abs(1 + top / c) > 1e-300 else 1e-300
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def choose_cutoffs(counted: dict, limit: float, confidence: float) -> dict[tuple, float]:
    """Cutoffs by (stratum, rule). ``counted``: by (stratum, rule), good and bad documents by
    the number of cutoffs that their measure exceeds (lists of one more than the cutoffs)."""
    tests = sum(len(RULES[rule][1]) for _, rule in counted)
    chosen = {}
    for (stratum, rule), (good, bad) in counted.items():
        cutoffs, best = RULES[rule][1], 0
        for i, cutoff in enumerate(cutoffs):
            rejected, caught = sum(good[i + 1 :]), sum(bad[i + 1 :])
            if caught and caught >= best and binomial_tail(sum(good), rejected, limit / len(RULES)) <= (1 - confidence) / tests:
                best, chosen[stratum, rule] = caught, cutoff
    return chosen


def learn_cutoffs(
    measured: DataFrame, labels: DataFrame, stratum: Column | None = None, limit: float = 0.05, confidence: float = 0.95
) -> dict[tuple, float]:
    """Cutoffs from the labelled documents among ``measured``; only counts reach the driver."""
    stratum = length_band() if stratum is None else stratum
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_good"))
    exceeded = [
        F.struct(F.lit(name).alias("rule"), sum((value > c).cast("int") for c in RULES[name][1]).alias("exceeded"))
        for name, value in _measures().items()
    ]
    rows = (
        measured.where(~base_failed())
        .join(known, "doc_id")
        .select(stratum.alias("stratum"), "_good", F.explode(F.array(*exceeded)).alias("m"))
        .groupBy("stratum", "m.rule", "m.exceeded", "_good")
        .count()
        .collect()
    )
    counted: dict = {}
    for row in rows:
        sides = counted.setdefault((row.stratum, row.rule), tuple([0] * (len(RULES[row.rule][1]) + 1) for _ in range(2)))
        sides[row._good != 1][row.exceeded] += row["count"]
    return choose_cutoffs(dict(sorted(counted.items(), key=repr)), limit, confidence)


def judge(docs: DataFrame, labels: DataFrame, stratum: Column | None = None, **options) -> DataFrame:
    """doc_id, COUNTS, base_failed and kept of every row."""
    measured = written(measure(docs))
    cutoffs = learn_cutoffs(measured, labels, stratum, **options)
    stratum = length_band() if stratum is None else stratum
    rejected = F.lit(False)
    for (band, rule), cutoff in cutoffs.items():
        rejected = rejected | (stratum.eqNullSafe(F.lit(band)) & (_measures()[rule] > cutoff))
    return measured.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~(base_failed() | rejected)).alias("kept"))
