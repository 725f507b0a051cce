import numpy as np
from pyspark.sql import functions as F

from seqsieve.llm import nearest as N

SCHEMA = "vec_id bigint, embedding array<float>"


def plain(rows, every, k=5):
    """Brute force over rows; (query, rank) -> (vec_id, score)."""
    usable = [(n, i, np.array(v, np.float32).astype(float)) for n, (i, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for n, i, v in usable:
        if i is None or i % every:
            continue
        others = [(m, j, w) for m, j, w in usable if m != n and len(w) == len(v)]
        scored = [(-float(N.cosine(v[None], w[None])[0]), np.inf if j is None else j, j) for m, j, w in others]
        scored.sort(key=lambda s: s[:2])
        out += [(i, r + 1, s[2], -s[0]) for r, s in enumerate(scored[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted([(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()], key=repr)


def run(spark, rows, every, schema=SCHEMA):
    return N.nearest(spark.createDataFrame(rows, schema), F.col("vec_id") % every == 0)


def test_hadamard_keeps_lengths_and_products():
    rows = np.random.default_rng(1).standard_normal((5, 16))
    turned = N.hadamard(rows)
    assert np.allclose(turned @ turned.T, rows @ rows.T) and np.allclose(N.hadamard(turned), rows)


def test_own_bucket_is_the_first_probe():
    code = N.PolytopeCode(12, 40_000, 0)
    units = N.unit_rows(np.random.default_rng(2).standard_normal((50, 12)))
    assert len(code.widths) > 1
    probed = code.probed(units)
    assert all(c in p for c, p in zip(code.codes(units), probed))
    # the probes are those of least loss among all buckets
    first, second = code.scores(units)[:2]
    if len(code.widths) == 2:
        loss = ((first.max(1, keepdims=True) - first) ** 2)[:, :, None] + ((second.max(1, keepdims=True) - second) ** 2)[:, None, :]
        loss = loss.reshape(len(units), -1)
        for own, p in zip(loss, probed):
            assert np.isclose(np.sort(own)[: code.probes].sum(), own[p].sum())


def test_few_vectors_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(25)]
    assert found(run(spark, rows, 5)) == plain(rows, 5)


def test_copies_ties_and_repeated_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(20)] + [(i, [2.0, 0.0]) for i in range(20, 30)] + [(0, [1.0, 0.0]), (None, [1.0, 0.0]), (None, [0.0, 3.0]), (33, [1.0, 1.0]), (40, [0.0, 3.0])]
    assert found(run(spark, rows, 10)) == plain(rows, 10)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(0, None), (10, []), (20, [0.0, 0.0]), (30, [nan, 1.0]), (40, [None, 1.0]), (50, [inf, 1.0])]
    rows = [*bad, (60, [1.0, 2.0]), (61, [1e30, 0.0]), (70, [1.0, 2.0, 3.0]), (80, [1e-30, 1e-30])]
    assert found(run(spark, rows, 10)) == plain(rows, 10)
    extra = [(*r, "x", 1, 2) for r in rows]
    wide = SCHEMA + ", cid string, n int, total int"
    assert found(run(spark, extra, 10, wide)) == plain(rows, 10)
    assert found(N.nearest(spark.createDataFrame(rows, SCHEMA).limit(0), F.col("vec_id") % 10 == 0)) == []


def test_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((9000, 32)).astype(np.float32)
    near = base[:600] + 0.1 * rng.standard_normal((600, 32)).astype(np.float32)
    vectors = np.concatenate([base, near])
    rows = list(enumerate(vectors.tolist()))
    got = found(run(spark, rows, 100))
    units = N.unit_rows(vectors.astype(float))
    hits = total = 0
    for q in range(0, len(rows), 100):
        score = units @ units[q]
        score[q] = -2
        best = set(np.argsort(-score)[:5].tolist())
        mine = [g for g in got if g[0] == q]
        assert [g[1] for g in mine] == [1, 2, 3, 4, 5] and all(abs(g[3] - score[g[2]]) < 1e-12 for g in mine)
        hits += len(best & {g[2] for g in mine})
        total += 5
    assert hits >= 0.9 * total


def test_too_few_found_are_compared_with_all(spark, monkeypatch):
    monkeypatch.setattr(N, "TABLES", 1)
    monkeypatch.setattr(N, "BUCKET", 1)
    monkeypatch.setattr(N, "PROBES", 0.1)
    monkeypatch.setattr(N, "PIECE", 7)
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(40)]
    got = found(run(spark, rows, 4))
    assert len(got) == 50 and {g[0] for g in got} == set(range(0, 40, 4))
