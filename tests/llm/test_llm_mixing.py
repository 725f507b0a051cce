import random
from collections import defaultdict

import pytest

from seqsieve.llm import mixing


def plain_targets(sizes, cycle=(5, 2, 1), cap=3):
    """Shares by weight; what exceeds a cap is shared by the others, until nothing does."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        free -= over
    return target


def corpus(seed, n=400):
    rng = random.Random(seed)
    sources = ["a", "b", "é", "Z", None, "tiny"]
    rows = []
    for i in range(n):
        source = "tiny" if i == 0 else rng.choices(sources[:5], [8, 1, 1, 1, 1])[0]
        rows.append((i, " ".join(["w"] * rng.randrange(0, 60)), "en", source))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_its_targets(table, seed):
    rows = corpus(seed)
    got = mixing.mix_report(table(rows)).collect()
    sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for doc_id, text, _, source in rows:
        sizes[source] += len(text.split())
        largest[source] = max(largest[source], len(text.split()))
    want = plain_targets(dict(sizes))
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.size * r.copies and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for source in sizes:
        assert abs(taken[source] - want[source]) <= largest[source]
    assert sorted(got) == sorted(mixing.mix_report(table(rows).repartition(7)).collect())


def test_copies_follow_their_expectation(table):
    """Over many seeds a document's mean copies approach its source's share."""
    rows = [(i, "w " * (1 + i % 7), "en", "ab"[i % 3 > 0]) for i in range(60)]
    docs = table(rows).cache()
    total = defaultdict(int)
    for seed in range(12):
        for r in mixing.decide(docs, seed=seed).collect():
            total[r.source] += (r.whole * r.rows + r.extra) * r.size
    for r in mixing.source_targets(mixing._rows(docs).selectExpr("*", "1L AS rows")).collect():
        assert total[r.source] / 12 == pytest.approx(r.target, abs=8)


def test_edges(table):
    rows = [(1, None, None, None), (2, "", "en", "s"), (None, "one two", "en", "s"), (3, "a b c", "en", "s"), (3, "a b c", "en", "s")]
    got = mixing.mix_report(table(rows, clashing=True)).collect()
    assert len(got) == 5
    assert {r.size for r in got if r.doc_id == 1} == {0}
    same = [r for r in got if r.doc_id == 3]
    assert len(same) == 2 and abs(same[0].copies - same[1].copies) <= 1
    assert mixing.mix_report(table([])).collect() == []
    assert mixing.mix(table([])).collect() == []


def test_mix_repeats_whole_rows(table):
    docs = table(corpus(3, 80), clashing=True)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mixing.mix_report(docs).collect()}
    seen = defaultdict(int)
    for r in mixed.collect():
        seen[r.doc_id] += 1
    assert {k: v for k, v in copies.items() if v} == seen


def test_equal_rows_meet_the_target_too(table):
    """Rows equal throughout, in either place, are not all or nothing."""
    rows = [(1, "a b c d e f g h i j", "en", "x")] * 500 + [(i, "k l", "en", "y") for i in range(2, 2502)]
    docs = table(rows)
    got = mixing.mix_report(docs).collect()
    for source in "xy":
        taken = sum(r.taken for r in got if r.source == source)
        assert abs(taken - next(r.target for r in got if r.source == source)) <= 10
    seen = defaultdict(int)
    for r in mixing.mix(docs.repartition(7)).collect():
        seen[r.source] += len(r.text.split())
    assert all(abs(seen[r.source] - r.target) <= 10 for r in got)
    assert {r.copies for r in got if r.source == "x"} == {1, 2}


def test_one_very_long_text(table):
    rows = [(1, "w " * 300_000, "en", "x")] + [(i, "k l", "en", "y") for i in range(2, 200)]
    assert {r.size for r in mixing.mix_report(table(rows)).collect()} == {300_000, 2}
