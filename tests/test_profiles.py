"""Profiles: branch and bound against all strings, searches against all windows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import seqsieve as S
from seqsieve.operators import profiles as R


def columns_of(rng, size, letters="ACDEF"):
    return [{r: rng.randrange(-5, 9) for r in rng.sample(letters, rng.randrange(2, 6))} for _ in range(size)]


def test_strings_that_reach_a_threshold():
    rng = random.Random(3)
    for _ in range(60):
        columns = columns_of(rng, 4)
        least = rng.randrange(-5, 30)
        plain = {
            "".join(r for r, _ in cells) for cells in itertools.product(*(c.items() for c in columns)) if sum(w for _, w in cells) >= least
        }
        assert set(R.reaching(columns, least, 10_000)) == plain
        if len(plain) > 3:
            assert R.reaching(columns, least, 3) is None


def test_every_match_holds_a_required_kmer():
    rng = random.Random(4)
    for _ in range(40):
        columns = columns_of(rng, 6, "ACDE" + "F")
        cells = [(i, r, w) for i, c in enumerate(columns) for r, w in c.items()]
        least = sum(max(c.values()) for c in columns) - rng.randrange(0, 6)
        kmers = set(R.required_kmers(cells, least, 3))
        for own in itertools.product(*(c.items() for c in columns)):
            if sum(w for _, w in own) >= least:
                text = "".join(r for r, _ in own)
                assert any(text[i : i + 3] in kmers for i in range(4))
    assert R.required_kmers([(0, "A", 1.0), (1, "C", 1.0)], 3, 2) == []  # out of reach
    assert R.required_kmers([(0, "A", 1.0), (2, "C", 1.0)], 1, 2) == []  # a position without residues
    assert R.required_kmers([(0, "A", 1.0)], 1, 2) is None  # shorter than k


def test_window_scores_equal_sums():
    rng = random.Random(5)
    columns = columns_of(rng, 3)
    matrix = R._matrix(tuple((i, r, float(w)) for i, c in enumerate(columns) for r, w in c.items()))
    for text in ("", "AC", "ACDEFACDEF", "ACé\U0001f600DEF", "A" * 50):
        want = [sum(columns[j].get(text[i + j], -np.inf) for j in range(3)) for i in range(len(text) - 2)]
        assert R.window_scores(text, matrix).tolist() == want


@pytest.mark.parametrize("layout", ["exact", "bloom"])
def test_profiles_find_all_windows(spark, layout, monkeypatch):
    monkeypatch.setattr(R, "KMERS", 200)
    rng = random.Random(6)
    texts = [(f"b{i % 40:02d}", f"r{i}", "".join(rng.choices("ACDEFX", k=rng.randrange(0, 60)))) for i in range(200)]
    index = S.build_index(spark.createDataFrame(texts, "bin string, name string, seq string"), k=3, layout=layout)
    kept = {r["name"] for r in index.records.select("name").collect()}
    cells, least, want = [], [], set()
    for p, (size, slack) in enumerate([(5, 2), (6, 4), (8, 3), (2, 1), (5, 60), (4, -1)]):
        columns = columns_of(rng, size)
        cells += [(f"p{p}", i, r, w) for i, c in enumerate(columns) for r, w in c.items()]
        threshold = float(sum(max(c.values()) for c in columns) - slack)
        least.append((f"p{p}", threshold))
        for bin, name, text in texts:
            for at in range(len(text) - size + 1):
                score = sum(columns[j].get(text[at + j], -np.inf) for j in range(size))
                if score >= threshold and name in kept:
                    want.add((f"p{p}", bin, name, at, at + size, text[at : at + size], float(score)))
    profiles = spark.createDataFrame(cells, "profile_id string, position int, residue string, weight long")
    found = S.search_profiles(index, profiles, spark.createDataFrame(least, "profile_id string, threshold double"))
    got = [tuple(r) for r in found.select("profile_id", "bin", "name", "start", "end", "match", "score").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {p for p, *_ in got} >= {"p0", "p3", "p4"}
    assert S.search_profiles(index, profiles.limit(0), spark.createDataFrame([], "profile_id string, threshold double")).count() == 0


def test_windows_of_many_texts_at_once():
    """Scored text by text and window by window, also those that could not reach the threshold any more."""
    rng = random.Random(7)
    for letters in ("ACDEF", "ACDEÉ\U0001f600"):
        texts = ["", "A", *("".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(30))]
        columns = [columns_of(rng, size) for size in (1, 3, 6)]
        matrices = [(R._matrix(tuple((i, r, float(w)) for i, c in enumerate(own) for r, w in c.items())), t) for own, t in zip(columns, (3.0, 8.0, -np.inf), strict=True)]
        wanted = [None, np.arange(0, 32, 3), np.arange(32)]
        got = [(n, t, s, m, x) for n, *c in R._hits_of(texts, wanted, matrices) for t, s, m, x in zip(c[0].tolist(), c[1].tolist(), c[2].to_pylist(), c[3].tolist(), strict=True)]
        want = []
        for n, (own, (matrix, least)) in enumerate(zip(wanted, matrices, strict=True)):
            for t in range(32) if own is None else own.tolist():
                scores = R.window_scores(texts[t], matrix)
                want += [(n, t, s, texts[t][s : s + len(matrix)], scores[s]) for s in np.flatnonzero(scores >= least).tolist()]
        assert got == want


def test_a_text_is_joined_once(spark):
    """A row per text and profile was joined, and a row per k-mer, profile and bin before that."""
    texts = [(f"b{i}", f"r{i}", "ACDEFACDEF"[i % 5 :]) for i in range(20)]
    index = S.build_index(spark.createDataFrame(texts, "bin string, name string, seq string"), k=3)
    cells = spark.createDataFrame([(f"p{p}", i, c, 1.0) for p in range(9) for i, c in enumerate("ACDE")], "profile_id string, position int, residue string, weight double")
    least = spark.createDataFrame([(f"p{p}", 4.0) for p in range(9)], "profile_id string, threshold double")
    found = S.search_profiles(index, cells, least)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "explode" not in plan.lower() and "Union" not in plan
    assert found.count() == 9 * sum(t.count("ACDE") for _, _, t in texts)


def test_profiles_need_plain_peptides(spark):
    records = spark.createDataFrame([("b", "r", "ACGTACGT")], "bin string, name string, seq string")
    with pytest.raises(ValueError):
        S.search_profiles(S.build_index(records, k=3, molecule="na"), None, None)
