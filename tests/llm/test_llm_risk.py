import math
import random
from collections import Counter

import numpy as np
import pytest

from seqsieve.llm import risk


def plain(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def texts(seed):
    rng = random.Random(seed)
    out = ["", "a", "a b c a b c", "a a a a", "x\ny\nx\n\n \nx", "é # ü b \x1c $", "one\r\none\r\n", "\n".join(["same line"] * 30)]
    out += [" ".join(rng.choice(["a", "b", "#", "c\n", "é"]) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    return out


def test_counts_equal_brute_force(table):
    rows = [(i, t, "en", "s") for i, t in enumerate(texts(1))] + [(None, None, None, None)]
    got = {r.doc_id: r for r in risk.measure(table(rows, clashing=True)).collect()}
    for doc_id, text, *_ in rows:
        assert tuple(got[doc_id][c] for c in risk.COUNTS[:5]) == plain(text), text


def test_many_different_words():
    ids = np.arange(2_200_000)
    assert risk._repeated_words(np.concatenate([ids, [0, 1, 2, 3]])) == 8


@pytest.mark.parametrize("n, k, p", [(5, 0, 0.3), (20, 3, 0.1), (400, 11, 0.05), (400, 399, 0.99), (1000, 500, 0.5), (7, 7, 0.2)])
def test_binomial_tail_is_exact(n, k, p):
    want = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert risk.binomial_tail(n, k, p) == pytest.approx(min(want, 1.0), rel=1e-9)


def test_cutoffs_keep_to_the_limit():
    cutoffs = len(risk.RULES["symbols"][1])
    good = [6000] + [0] * (cutoffs - 1) + [5]
    bad = [10] + [0] * (cutoffs - 1) + [90]
    chosen = risk.choose_cutoffs({("s", "symbols"): (good, bad)}, 0.05, 0.95)
    assert chosen == {("s", "symbols"): risk.RULES["symbols"][1][-1]}  # the laxest that catches as much
    assert risk.choose_cutoffs({("s", "symbols"): ([g // 100 for g in good], bad)}, 0.05, 0.95) == {}  # too few labels
    assert risk.choose_cutoffs({("s", "symbols"): ([4000] + [0] * (cutoffs - 1) + [400], bad)}, 0.05, 0.95) == {}
    assert risk.choose_cutoffs({("s", "symbols"): (good, [100] + [0] * cutoffs)}, 0.05, 0.95) == {}


def test_false_rejections_stay_below_the_limit():
    """Repeated draws: the chosen cutoffs' true rate exceeds its share in at most 5 % of them."""
    rng, broken = np.random.default_rng(0), 0
    cutoffs = len(risk.RULES["symbols"][1])
    rates = np.linspace(0.03, 0.002, cutoffs)  # true false rejections by cutoff
    for _ in range(200):
        u = rng.random(8000)
        exceeded = (u[:, None] < rates).sum(1)
        good = np.bincount(exceeded, minlength=cutoffs + 1).tolist()
        for (_, rule), cutoff in risk.choose_cutoffs({("s", "symbols"): (good, [0] * cutoffs + [50])}, 0.05, 0.95).items():
            broken += rates[risk.RULES[rule][1].index(cutoff)] > 0.05 / len(risk.RULES)
    assert broken <= 10


def test_judge(spark, table):
    rng = random.Random(2)
    clean = [(i, " ".join(f"w{rng.randrange(999)}" for _ in range(80)), "en", "s") for i in range(4000)]
    junk = [(10_000 + i, " ".join(f"w{rng.randrange(999)}###" for _ in range(80)), "en", "s") for i in range(300)]
    edge = [(None, None, None, None), (20_000, "", "en", "s"), (20_001, "too short", "en", "s"), (20_002, "again and " * 50, "en", "s"), (20_002, "again and " * 50, "en", "s")]
    labels = [(r[0], 1) for r in clean[:3500]] + [(r[0], 0) for r in junk[:200]] + [(5, 1), (None, 1), (7, None), (10_000, 1)]
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = risk.judge(table(clean + junk + edge, clashing=True), labels).collect()
    assert len(got) == len(clean + junk + edge)
    assert all(r.kept and not r.base_failed for r in got if r.doc_id is not None and r.doc_id < 4000)
    assert not any(r.kept for r in got if r.doc_id is None or r.doc_id >= 10_000)
    assert all(r.base_failed for r in got if r.doc_id is None or r.doc_id >= 20_000)
    unlabelled = risk.judge(table(clean[:20] + junk[:20]), labels.limit(0)).collect()
    assert all(r.kept for r in unlabelled)
    assert risk.judge(table([]), labels).collect() == []
