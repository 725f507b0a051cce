import numpy as np
import pytest

from seqsieve.llm import caps


def clustered(seed, n=300, length=24):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, length))
    near = [base[0] + 0.02 * rng.standard_normal(length) for _ in range(150)]
    near += [base[i] + 0.1 * rng.standard_normal(length) for i in range(1, 100)]
    return np.concatenate([base, near]).astype(np.float32)


def plain(vectors, threshold=0.95):
    units = caps.unit_vectors(vectors.astype(float))
    linked = units @ units.T >= threshold
    np.fill_diagonal(linked, False)
    return linked


def test_links_components_and_recall(spark):
    vectors = clustered(2)
    linked = plain(vectors)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r for r in caps.near_vectors(df).collect()}
    n = np.array([got[i].n_links for i in range(len(vectors))])
    assert (n <= linked.sum(1)).all() and n.sum() >= 0.95 * linked.sum()
    reach = {i: i for i in got}
    for a, b in zip(*np.nonzero(linked)):
        low, high = sorted((reach[a], reach[b]))
        reach = {k: low if v == high else v for k, v in reach.items()}
    same = sum(got[i].component_id == reach[i] for i in got)
    assert same >= 0.97 * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_pieces_count_each_pair_once():
    """Blocks of a crowded filter, and pairs that share several filters."""
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((1, 8)) + 0.05 * rng.standard_normal((20, 8))
    filters = [sorted(rng.choice(6, 3, replace=False).tolist()) for _ in vectors]
    block = rng.integers(0, 2, len(vectors))
    counts, edges = np.zeros(len(vectors), int), []
    for f in range(6):
        held = [i for i in range(len(vectors)) if f in filters[i]]
        for left, right in ((0, 0), (0, 1), (1, 1)):
            piece = [(f, left, right, int(block[i]), i, 1, vectors[i].tolist(), filters[i]) for i in held if block[i] in (left, right)]
            for a, b, n in caps._compared(piece, 0.9) if piece else ():
                counts[a] += n
                edges += [(a, b)] if b is not None else []
    shared = np.array([[bool(set(f) & set(g)) for g in filters] for f in filters])
    want = plain(vectors, 0.9) & shared
    assert counts.tolist() == want.sum(1).tolist()
    assert all(want[a, b] for a, b in edges)


def test_list_decoding_finds_all_filters_in_reach():
    code = caps.ProductCode(10, 5)
    units = caps.unit_vectors(np.random.default_rng(3).standard_normal((30, 10)))
    scores = [units @ rotation @ part / 2 for rotation, part in code.parts]
    for i, found in enumerate(code.decode(units)):
        total = (scores[0][i][:, None, None, None] + scores[1][i][:, None, None] + scores[2][i][:, None] + scores[3][i]).reshape(-1)
        assert found.tolist() == np.flatnonzero(total >= total.max() - caps.REACH).tolist() or np.isclose(total, total.max() - caps.REACH, atol=1e-12).any()


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [0.0, 1.0]), (12, [1e30, 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, cid string, n int")
    got = sorted(map(tuple, caps.near_vectors(df).collect()), key=repr)
    want = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 11)] + [(7, 5, 7, True), (8, 5, 7, False), (9, 5, 7, False), (9, 5, 7, False), (12, 5, 7, False), (None, 5, 7, False)]
    assert got == sorted(want, key=repr)
    assert caps.near_vectors(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 10_000, 10**9])
def test_code_grows_with_the_data(n):
    assert 4 <= caps._code_size(n) <= 128
