import random
import re
import warnings

import pytest

import seqsieve as S
from seqsieve.functions import alphabet as A
from seqsieve.plans import pattern as P
from test_pattern import brute_longest, random_pattern

FIVE_BINS = [
    ("sequence1.fa", "Sequence1", "ACTGACTGACTGATCC"),
    ("sequence2.fa", "Sequence2", "GTGACTGAGTGATTCG"),
    ("sequence3.fa", "Sequence3", "AAAAAAACGATCGACA"),
    ("sequence4.fa", "Sequence4", "CCCGTACCCTTGTGAA"),
    ("sequence5.fa", "Sequence5", "CCCGTACCCGTGTGAA"),
]
TWO_BINS = [
    ("file1.fa", "Snippet1.1", "AACCGG"),
    ("file1.fa", "Snippet1.2", "AACGG"),
    ("file2.fa", "Snippet2.1", "AACCTT"),
    ("file2.fa", "Snippet2.2", "TTCCAA"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "bin string, name string, seq string").coalesce(1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def five(spark):
    return S.build_index(frame(spark, FIVE_BINS), k=3, molecule="na")


def test_both_strands(five):
    found = S.search(five, "A(C+|G+)T").select("bin", "strand", "match", "start", "end")
    assert rows(found) == sorted(
        [
            ("sequence1.fa", "+", "ACT", 0, 3),
            ("sequence1.fa", "+", "ACT", 4, 7),
            ("sequence1.fa", "+", "ACT", 8, 11),
            ("sequence2.fa", "+", "ACT", 3, 6),
            ("sequence2.fa", "+", "AGT", 7, 10),
            ("sequence4.fa", "+", "ACCCT", 5, 10),
            ("sequence1.fa", "-", "AGT", 5, 8),
            ("sequence1.fa", "-", "AGT", 9, 12),
            ("sequence1.fa", "-", "AGT", 13, 16),
            ("sequence2.fa", "-", "ACT", 6, 9),
            ("sequence2.fa", "-", "AGT", 10, 13),
            ("sequence4.fa", "-", "AGGGT", 6, 11),
        ]
    )
    bins = {r["bin"] for r in S.candidate_bins(five, "A(C+|G+)T").collect()}
    assert {"sequence1.fa", "sequence2.fa", "sequence4.fa"} <= bins
    assert bins < {r[0] for r in FIVE_BINS}


def test_two_bins(spark):
    index = S.build_index(frame(spark, TWO_BINS), k=3, molecule="na")
    assert (index.meta["n_indexed"], index.n_bins) == (4, 2)
    found = S.search(index, "AC+G").select("bin", "name", "strand", "match", "start", "end")
    assert rows(found) == [
        ("file1.fa", "Snippet1.1", "+", "ACCG", 1, 5),
        ("file1.fa", "Snippet1.2", "+", "ACG", 1, 4),
    ]


@pytest.mark.parametrize(
    "k, text, pattern, expected",
    [
        (3, "MKWAACCYGF", "MKW(A|C)*YGF", [("MKWAACCYGF", 0, 10)]),
        (3, "MKAAKM", "C|A{2}", [("AA", 2, 4)]),
        (4, "AACDEF", "(AAA|AA)CDEF", [("AACDEF", 0, 6)]),
        (6, "MKL", "KL", [("KL", 1, 3)]),
        (2, "ACD", "A|AC", [("AC", 0, 2)]),
        (3, "AAAB", "^A", [("A", 0, 1)]),
        (3, "MKXLM", "MK.LM", [("MKXLM", 0, 5)]),
        (3, "AAAA", "WWWWWW", []),
        (3, "Z", "Z", [("Z", 0, 1)]),
        (3, "ZY", "Z[^Q]", [("ZY", 0, 2)]),
        (3, "ZY", "Z.?Y", [("ZY", 0, 2)]),
        (2, "ab[c]", r"b\[c", [("b[c", 1, 4)]),
    ],
)
def test_edge_cases(spark, k, text, pattern, expected):
    index = S.build_index(frame(spark, [("x", "r", text), ("y", "s", "QQQQQQQQ")]), k=k)
    found = S.search(index, pattern)
    assert found.columns == ["bin", "name", "match", "start", "end"]
    assert rows(found) == [("x", "r", *e) for e in expected]
    if len(text) < k:
        assert S.candidate_bins(index, pattern).count() == 2


def test_dgram_of_minimal_length(spark):
    index = S.build_index(
        frame(spark, [("x", "r", "ACDKKKEFG"), ("y", "s", "ACDKKKKEFG")]), k=3, dgram_gaps=(3, 5)
    )
    rich = "ACD.{3}EFG"
    assert rows(S.search(index, rich, augment=True, dgrams=True)) == [("x", "r", "ACDKKKEFG", 0, 9)]
    assert rows(S.candidate_bins(index, rich, augment=True, dgrams=True)) == [("x",)]
    assert rows(S.candidate_bins(index, rich, augment=True)) == [("x",), ("y",)]


def test_one_bin_is_scanned(spark):
    index = S.build_index(frame(spark, [("x", "r", "MKLMKL")]), k=3)
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        assert rows(S.search(index, "KL")) == [("x", "r", "KL", 1, 3), ("x", "r", "KL", 4, 6)]
    assert any("one bin" in str(w.message) for w in caught)


def collection(rng, letters, n_bins=9):
    out = []
    for b in range(n_bins):
        for r in range(rng.randint(1, 3)):
            size = rng.choice([0, 2, 5, 12, 25])
            out.append((f"b{b}", f"b{b}r{r}", "".join(rng.choice(letters) for _ in range(size))))
    return out


@pytest.mark.parametrize(
    "options",
    [
        {"k": 3},
        {"k": 2, "dgram_gaps": (1, 4)},
        {"k": 4, "store_records": False},
        {"k": 3, "layout": "bloom", "fpr": 0.2},
        {"k": 3, "reduction": "murphy"},
        {"k": 3, "reduction": "li"},
        {"k": 3, "molecule": "na"},
    ],
    ids=str,
)
def test_indexed_search_equals_brute_force(spark, options, monkeypatch):
    from seqsieve.operators import candidates

    rng = random.Random(str(options))
    nucleotide = options.get("molecule") == "na"
    letters = "ACGTNU" if nucleotide else "ACDEKX"
    rows_in = collection(rng, letters)
    index = S.build_index(frame(spark, rows_in), **options)
    table = A.REDUCTIONS.get(options.get("reduction"), {})
    batch, expected = {}, []
    while len(batch) < 24:
        pattern = random_pattern(rng, letters[:4])
        node = P.map_letters(P.parse(pattern), table)
        if P.nullable(node):
            continue
        motif = f"m{len(batch)}"
        batch[motif] = pattern
        for bin, name, seq in rows_in:
            if nucleotide:
                back = seq.translate(str.maketrans("ACGTU", "TGCAA"))[::-1]
                regex = re.compile(P.render(node, text_end=r"\Z"))
                for strand, text in (("+", seq), ("-", back)):
                    expected += [
                        (motif, bin, name, strand, text[slice(*m.span())], *m.span())
                        for m in regex.finditer(text)
                    ]
            else:
                text = "".join(table.get(c, c) for c in seq)
                expected += [
                    (motif, bin, name, text[s:e], s, e) for s, e in brute_longest(node, text)
                ]
    columns = ["motif_id", "bin", "name", *(["strand"] if nucleotide else []), "match", "start", "end"]
    for extra in ({}, {"augment": True, "dgrams": True}):
        found = S.search_many(index, batch, **extra).select(columns)
        assert rows(found) == sorted(expected)
    table = spark.createDataFrame(list(batch.items()), "id string, motif string")
    assert rows(S.search_many(index, table, **extra).select(columns)) == sorted(expected)
    monkeypatch.setattr(candidates, "FETCHED_MASKS", 0)  # lookups that are never settled first
    assert rows(S.search_many(index, batch).select(columns)) == sorted(expected)
    some = list(batch)[:3]
    for motif in some:
        single = S.search(index, batch[motif]).select(columns[1:])
        assert rows(single) == sorted(e[1:] for e in expected if e[0] == motif)
    for pair in (some[:2], some):
        held = [{e[2] for e in expected if e[0] == m and "-" not in e} for m in pair]
        both = S.search_all_of(index, [batch[m] for m in pair])
        assert {r["name"] for r in both.collect()} == set.intersection(*held)


def test_graph_evaluation_gives_the_same_candidates(spark, monkeypatch):
    from seqsieve.operators import candidates

    rng = random.Random(3)
    index = S.build_index(frame(spark, collection(rng, "ACDE", n_bins=150)), k=3)
    assert index.n_blocks == 3
    patterns = ["AC(D|EE)A", "A[CD]E.A", "(AC|CA)+DE", "AAA|CCC"]
    listed = [rows(S.candidate_bins(index, p)) for p in patterns]
    found = [rows(S.search(index, p)) for p in patterns]
    monkeypatch.setattr(candidates, "FETCHED_MASKS", 0)
    assert [rows(S.candidate_bins(index, p)) for p in patterns] == listed
    monkeypatch.setattr(candidates, "ALTERNATIVES_LIMIT", 0)
    assert [rows(S.candidate_bins(index, p)) for p in patterns] == listed
    assert [rows(S.search(index, p)) for p in patterns] == found
    assert any(0 < len(bins) < 150 for bins in listed)


@pytest.mark.parametrize("limit", [0, 20_000, None])
def test_key_free_branches_and_ids_that_are_patterns(spark, monkeypatch, limit):
    """Blocks that hold none of a graph's keys, and ids that another motif would match by."""
    from seqsieve.operators import candidates

    if limit is not None:
        monkeypatch.setattr(candidates, "FETCHED_MASKS", 0)
        monkeypatch.setattr(candidates, "ALTERNATIVES_LIMIT", limit)
    rng = random.Random(11)
    rows_in = collection(rng, "ACDE", n_bins=40)
    rows_in += [(f"z{i}", f"z{i}r", rng.choice(["MKLMKLM", "LLL", "KLAC"])) for i in range(100)]
    index = S.build_index(frame(spark, rows_in), k=4)
    assert index.n_blocks == 3
    patterns = ["KL|A[CDE]{2}CA[CDE]{1,2}E(A|C)", "ACDE", "(A|CA)+CD", "KLAC"]
    while len(patterns) < 16:
        pattern = random_pattern(rng, "ACDE")
        pattern = f"KL|{pattern}" if rng.random() < 0.4 else pattern
        if not P.nullable(P.parse(pattern)) and pattern not in patterns:
            patterns.append(pattern)
    batch = dict(zip(patterns[1:] + patterns[:1], patterns))  # every id is another's pattern
    expected = [
        (motif, bin, name, seq[s:e], s, e)
        for motif, pattern in batch.items()
        for bin, name, seq in rows_in
        for s, e in brute_longest(P.parse(pattern), seq)
    ]
    found = S.search_many(index, batch).select("motif_id", "bin", "name", "match", "start", "end")
    assert rows(found) == sorted(expected)
    for motif in list(batch)[:4]:
        single = S.search(index, batch[motif]).select("bin", "name", "match", "start", "end")
        assert rows(single) == sorted(e[1:] for e in expected if e[0] == motif)


def test_wide_gaps_stay_in_the_jvm(spark):
    text = "AM" + "C" * 2400 + "K" + "C" * 99 + "K" + "C" * 50 + "K"
    index = S.build_index(frame(spark, [("a", "a", text), ("b", "b", "MK")]), k=3)
    found = S.search(index, "M.{1,2500}K")
    assert [(r.start, r.end) for r in found.collect()] == [(1, 2503)]
    gap = S.search(index, "C.{0,80}K")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in gap


def test_without_broadcasts_nothing_changes(spark, monkeypatch):
    from seqsieve.operators import candidates, search

    rng = random.Random(4)
    index = S.build_index(frame(spark, collection(rng, "ACDE", n_bins=150)), k=3)
    batch = {"a": "AC(D|EE)A", "b": "A[CD]E.A", "c": "A"}
    usual = rows(S.search_many(index, batch))
    monkeypatch.setattr(candidates, "FETCHED_MASKS", 0)
    for limit in (0, 4):
        monkeypatch.setattr(candidates, "BROADCAST_ROWS", limit)
        monkeypatch.setattr(search, "BROADCAST_ROWS", limit)
        assert rows(S.search_many(index, batch)) == usual


def test_many_groups_of_bins_and_shards(spark, monkeypatch):
    from seqsieve.operators import candidates
    from seqsieve.operators import index as I

    rng = random.Random(6)
    data = frame(spark, collection(rng, "ACDE", n_bins=300))
    usual = rows(S.search(S.build_index(data, k=3), "AC.A"))
    monkeypatch.setattr(I, "BINS_PER_GROUP", 70)
    monkeypatch.setattr(I, "SHARD_RESIDUES", 1000)
    index = S.build_index(data, k=3)
    assert index.meta["shards"] > 1
    slots = index.bins.select("block", "lane", "bin_id").collect()
    assert len({(r.block, r.lane) for r in slots}) == len({r.bin_id for r in slots}) == 300
    assert all(0 <= r.lane < 64 for r in slots)
    found = S.search(index, "AC.A")
    assert rows(found) == usual
    assert "shard" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
    monkeypatch.setattr(candidates, "FETCHED_MASKS", 0)
    assert rows(S.search(index, "AC.A")) == usual
    assert "dynamicpruning" in S.search(index, "AC.A")._jdf.queryExecution().executedPlan().toString()


def test_long_records_are_sliced(spark, monkeypatch):
    from seqsieve.operators import kmers as K

    rng = random.Random(8)
    text = "".join(rng.choice("ACDEF") for _ in range(500))
    data = frame(spark, [("x", "r", text), ("y", "s", text[:7]), ("z", "t", "AC")])
    monkeypatch.setattr(K, "SLICE", 16)
    found = K.kmers(data, 4, keep=["name", "bin"]).where("bin = 'x'").select("at", "kmer")
    assert rows(found) == [(i, text[i : i + 4]) for i in range(497)]
    grams = K.dgram_windows(data, 2, 5, ["bin"]).where("bin = 'x'")
    expected = sorted(
        A.dgram_text_code(text[i : i + 3], g, text[i + 3 + g : i + 6 + g])
        for g in range(2, 6)
        for i in range(500 - g - 5)
    )
    from pyspark.sql import functions as F

    codes = grams.select(A.dgram_code(F.col("gap"), F.col("residues")))
    assert [c[0] for c in rows(codes)] == expected


def test_non_ascii_text_is_not_pruned(spark):
    data = frame(spark, [("x", "r", "MKéLM"), ("y", "s", "QQQQQQ"), ("z", "t", "MKLéé")])
    index = S.build_index(data, k=2)
    assert rows(S.search(index, "MK.LM")) == [("x", "r", "MKéLM", 0, 5)]
    assert rows(S.search(index, "Lé+")) == [("z", "t", "Léé", 2, 5)]


def test_stored_index_can_be_reopened(spark, tmp_path):
    data = frame(spark, FIVE_BINS)
    path = str(tmp_path / "idx")
    S.build_index(data, k=3, path=path)
    S.add_dgrams(S.load_index(spark, path), 1, 2)
    index = S.load_index(spark, path)
    assert index.meta["dgram_gaps"] == [1, 2]
    assert S.search(index, "GATC").count() == 1 + 1
    info = S.inspect(index).first()
    assert (info.index_type, info.bin_count, info.k, info.n_records) == ("EXACT", 5, 3, 5)
    assert (info.bin_bits, info.hash_count, info.fpr) == (None, None, None)
    assert "digraph" in S.pattern_dot(index, "AC(G|T)A")


def test_parameters_are_checked(spark):
    data = frame(spark, TWO_BINS)
    for wrong in (
        {"k": 13}, {"k": 0}, {"molecule": "rna"}, {"reduction": "x"}, {"layout": "tree"},
        {"molecule": "na", "reduction": "li"}, {"molecule": "na", "dgram_gaps": (1, 2)}, {"fpr": 1.0},
    ):
        with pytest.raises(ValueError):
            S.build_index(data, **wrong)


def test_many_matches_in_one_record(spark):
    text = "AC" * 3000 + "D"
    data = frame(spark, [("x", "r", text), ("y", "s", "EEEE")])
    found = S.scan(data, "AC").orderBy("start").collect()
    assert [(m.start, m.end) for m in found] == [(i, i + 2) for i in range(0, 6000, 2)]
    assert [tuple(m)[2:] for m in S.scan(data, "(AC)+D").collect()] == [(text, 0, 6001)]


@pytest.mark.parametrize("molecule", ["aa", "na"])
def test_long_runs_of_group_loops(spark, molecule):
    run = "ACG" * 30_000
    data = frame(spark, [("x", "r", run + "TA"), ("y", "s", "CCCC" + "A" * 50_000), ("z", "t", "ACACG")])
    index = S.build_index(data, k=3, molecule=molecule)
    for pattern in ("(A|CG)+T", "(AC|ACG|G)+T", "(AC|G)+T"):
        found = S.search(index, pattern)
        if molecule == "na":
            found = found.where("strand = '+'").drop("strand")
        assert rows(found) == [("x", "r", run + "T", 0, 90_001)], pattern
    for longest in (True, False):
        assert S.search(index, "(A|AA)+CC", longest=longest).where("bin = 'y'").count() == 0
    hits = S.search_all_of(index, ["(AC|ACG|G)+T", "(A|CG)+TA", "G*"])
    assert [r["name"] for r in hits.collect()] == ["r"]


def test_original_letters_of_reduced_matches(spark):
    data = [("b", "r", "XADRNBX"), ("c", "s", "SKDDA")]
    for k in (2, 3):
        index = S.build_index(frame(spark, data), k=k, reduction="murphy")
        for pattern in ("KB", "D", "(B|BB)+", "(BB|B)+A?"):
            for row in S.search(index, pattern, original=True).collect():
                seq = {n: t for _, n, t in data}[row.name]
                assert row.original == seq[row.start : row.end]
                assert "".join(A.REDUCTIONS["murphy"].get(c, c) for c in row.original) == row.match
