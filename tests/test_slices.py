"""Long records in slices: the same matches as one search, also where run-ups do not settle."""

import random

import pytest

import seqsieve as S
from seqsieve.operators import slices
from seqsieve.plans import pattern as P
from test_search import frame, rows

PATTERNS = ["AC", "A.A", "A[CD]{1,3}E", "(A|AC|ACA)D?", "AA", "AAA", "A{2,5}C?", "(AC){2}", "E|EE|EEE", ".{7}"]


def long_texts(rng):
    texts = ["".join(rng.choice("ACDE") for _ in range(rng.randrange(600, 2000))) for _ in range(4)]
    texts += ["A" * 1501, "AC" * 700, "A" * 500 + "C" + "A" * 900, "ACDE", "A", ""]
    return [(f"b{i % 3}", f"r{i}", t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("molecule", ["aa", "na"])
def test_slices_equal_one_search(spark, monkeypatch, molecule):
    rng = random.Random(molecule)
    data = long_texts(rng)
    if molecule == "na":
        data = [(b, n, t.translate(str.maketrans("DE", "GT"))) for b, n, t in data]
    data += data[:1]  # a repeated record
    index = S.build_index(frame(spark, data), k=3, molecule=molecule)
    letters = str.maketrans("DE", "GT") if molecule == "na" else {}
    patterns = [p.translate(letters) for p in PATTERNS]
    whole = {p: rows(S.search(index, p)) for p in patterns}
    monkeypatch.setattr(slices, "CUT", 400)
    monkeypatch.setattr(slices, "SLICE", 128)
    assert index.meta["longest"] > 400
    for p in patterns:
        assert slices.reach(P.parse(p)) and rows(S.search(index, p)) == whole[p], p
    found = S.search_many(index, {p: p for p in [*patterns, "A+C", "^A"]})
    some = {p: rows(found.where(f"motif_id = '{p}'").drop("motif_id").select(S.search(index, p).columns)) for p in patterns[:3]}
    assert some == {p: whole[p] for p in patterns[:3]}


def test_what_is_not_cut():
    assert slices.reach(P.parse("A+")) is None and slices.reach(P.parse("^AC")) is None and slices.reach(P.parse("A.{3}C")) == 5


def test_long_records_are_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(slices, "CUT", 1000)
    monkeypatch.setattr(slices, "SLICE", 512)
    rng = random.Random(9)
    text = "".join(rng.choice("ACDE") for _ in range(50_000))
    index = S.build_index(frame(spark, [("x", "r", text), ("y", "s", "ACD")]), k=3)
    tasks = []
    usual = slices.in_slices

    def counted(hits, kept, reach, spans):
        def seen(texts):
            tasks.append(texts.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect())
            return spans(texts)
        return usual(hits, kept, reach, seen)

    monkeypatch.setattr(slices, "in_slices", counted)
    found = S.search(index, "AC.E")
    assert found.count() == len(S.scan(index.records, "AC.E").collect()) > 0
    assert sum(n > 0 for n in tasks[0]) > 3


def in_parts(rng, data):
    """Texts cut into parts, some empty or null, in any order."""
    out = []
    for bin, name, text in data:
        at, parts = 0, [None, ""]
        while at < len(text):
            parts.append(text[at : at + rng.randrange(1, 300)])
            at += len(parts[-1])
        out += [(bin, name, i, part) for i, part in enumerate(parts)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("longest", [True, False])
def test_joined_records_equal_whole_ones(spark, monkeypatch, longest):
    monkeypatch.setattr(slices, "PIECE", 128)
    monkeypatch.setattr(slices, "LEAD", 40)
    monkeypatch.setattr(slices, "BEHIND", 16)
    rng = random.Random(7)
    data = long_texts(rng)
    parts = spark.createDataFrame(in_parts(rng, data), "bin string, name string, n int, seq string").repartition(3)
    pieces = slices.joined(parts, "n")
    held = sorted((r.bin, r.name, r.piece_begin, r.piece_first, r.piece_size, r.seq) for r in pieces.collect())
    assert held == sorted(
        (b, n, at, max(at - 40, 0), len(t), t[max(at - 40, 0) : at + 128 + 16]) for b, n, t in data for at in range(0, max(len(t), 1), 128)
    )
    index, whole = S.build_index(pieces, k=3), S.build_index(frame(spark, data), k=3)
    unsettled = []
    usual = slices._in_order
    monkeypatch.setattr(slices, "_in_order", lambda *a: unsettled.append(a) or usual(*a))
    for p in PATTERNS:
        assert rows(S.search(index, p, longest=longest)) == rows(S.search(whole, p, longest=longest)), p
    assert unsettled  # repeats whose seams do not agree
    found = S.search_many(index, {p: p for p in PATTERNS[:3]})
    assert rows(found) == rows(S.search_many(whole, {p: p for p in PATTERNS[:3]}).select(found.columns))
    for refused in ("A+", "^A", "A.{20}C"):
        with pytest.raises(ValueError):
            S.search(index, refused)
    with pytest.raises(ValueError):
        S.search_all_of(index, ["AC"])


def test_joined_rows_that_repeat_and_one_long_part(spark):
    long = "ACDE" * 20_000
    parts = [("b", "r", 2, long), ("b", "r", 1, "DD"), ("b", "r", 2, "AA"), ("b", "r", 1, "DD"), ("c", "s", None, None)]
    pieces = slices.joined(spark.createDataFrame(parts, "bin string, name string, n int, seq string"), "n").collect()
    text = "DDDD" + "AA" + long
    own = [r.seq[r.piece_begin - r.piece_first :][: slices.PIECE] for r in sorted(pieces, key=lambda r: r.piece_begin) if r.bin == "b"]
    assert "".join(own) == text and {r.piece_size for r in pieces} == {len(text), 0}


def test_no_row_holds_all_documents_of_a_language(spark, tmp_path):
    import __spark_entry__ as E

    docs = [(i, "the ten thereafter then " * 100, ("en", None)[i % 5 == 0], "web") for i in range(300)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.bin, r.match): (r.n, r.starts) for r in E.queries()["search_joined_sources"](spark, str(tmp_path)).collect()}
    for bin, n in (("en", 240), ("", 60)):
        text = "THETENTHEREAFTERTHEN" * 100 * n
        for match in ("THEN", "TEN"):
            starts = [i for i in range(len(text)) if text.startswith(match, i)] if match == "THEN" else []
            assert found.get((bin, match), (0, 0)) == (len(starts), sum(starts))
    index = E._indexes[spark.sparkContext.applicationId, str(tmp_path), "joined"]
    assert index.records.selectExpr("max(length(seq))").first()[0] <= slices.PIECE + slices.LEAD + slices.BEHIND
