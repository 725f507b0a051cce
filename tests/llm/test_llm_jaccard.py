import random

import pytest

from seqsieve.llm import jaccard
from seqsieve.llm.components import components


def shingles(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < width else frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def plain(rows, width, num, den):
    sets = [shingles(t, width) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        least.setdefault(find(i), []).append(doc_id)
    return sorted((doc_id, len(s), min(least[find(i)])) for i, ((doc_id, *_), s) in enumerate(zip(rows, sets)))


def corpus(seed):
    """Groups of near copies of different closeness, shared passages, short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(60)}"
    passage = [word() for _ in range(40)]
    texts = []
    for size, edits in ((12, 1), (40, 3), (25, 6), (5, 0)):
        base = [word() for _ in range(rng.randrange(60, 160))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(edits + 1)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    for _ in range(30):
        texts.append(" ".join([*(word() for _ in range(rng.randrange(5, 80))), *passage, *(word() for _ in range(5))]))
    chain = [word() for _ in range(100)]
    for i in range(12):
        texts.append(" ".join(chain[i * 2 :] + [f"t{j}" for j in range(i * 2)]))
    texts += [" ".join(word() for _ in range(rng.randrange(1, 16))) for _ in range(30)]
    texts += ["a", "A", "a b", "b a", "", " \n", "THE cat sat\ton it", "the CAT sat on it"]
    rng.shuffle(texts)
    return [(i, t, "en", "s") for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed, width, num, den", [(1, 3, 9, 10), (2, 5, 4, 5), (3, 2, 7, 10)])
def test_components_equal_brute_force(table, seed, width, num, den):
    rows = corpus(seed)
    got = jaccard.near_duplicates(table(rows).repartition(5), width, (num, den)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(rows, width, num, den)


def test_edges(table):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (None, text, "en", "s"), (7, text, None, None), (7, text, "en", "s"), (7, "other words " * 30, "en", "s"), (9, "x " * 50_000, "en", "s")]
    docs = table(rows, clashing=True)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, 3, (9, 10)).collect()), key=repr)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (None, 8, 7), (7, 8, 7), (7, 8, 7), (7, 2, 7), (9, 1, 9)], key=repr)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, ""), (2, ""), (7, text), (7, text), (7, "other words " * 30), (9, "x " * 50_000)])
    assert jaccard.near_duplicates(table([])).collect() == [] and jaccard.keep_one(table([])).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    groups = {}
    for node, root in got.items():
        groups.setdefault(root, set()).add(node)
    assert sorted(map(sorted, groups.values())) == [list(range(61)), list(range(1000, 1050)), [5000, 5001]]


def test_whole_sets_are_shuffled_of_pairs_that_share_all_prefixes_only(table, monkeypatch):
    """A passage that texts share makes candidates, but none of their sets is written."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    passages = [[word() for _ in range(8)] for _ in range(12)]
    texts = [" ".join([*(word() for _ in range(80)), *passages[i % 12], *(word() for _ in range(80))]) for i in range(60)]
    texts += [texts[0] + " x", texts[0] + " y"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    tables, kept = {}, jaccard.written

    def written(df):
        out = kept(df)
        for kind in ("second", "tokens"):
            if "cid" in df.columns and kind in df.columns and "counts" not in df.columns:
                tables.setdefault(kind, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", written)
    got = jaccard.near_duplicates(table(rows), 3, (9, 10)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(rows, 3, 9, 10)
    assert sum(tables["second"]) > 3 * sum(tables["tokens"]) > 0
