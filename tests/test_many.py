"""Many motifs in one pass find what Python's search finds."""

import random
import re

import pytest

import seqsieve as S
from seqsieve.functions import many
from seqsieve.operators import search as X
from seqsieve.plans import pattern as P

TAILS = ["", "[AE]", "[^A]", ".", "A?", "(A|E)?", "A{2}", "[AE]{1,2}", "$", "A+", "E*$", "(AE)+"]
MOTIFS = [stem + tail for stem in ("AA", "AE", "EA", "EL") for tail in TAILS]


def texts():
    draw = random.Random(5)
    return ["", "A", "AA", "AAAA\nAAE", *("".join(draw.choices("AEL", k=draw.randrange(60))) for _ in range(80))]


def want(motif, text):
    found = re.finditer(P.render(P.parse(motif), text_end=r"\Z"), text)
    return [(m.start(), m.end()) for m in found]


def test_spans():
    tables = [(many.head(P.parse(m)), many.table(P.parse(m))) for m in MOTIFS]
    assert all(t is not None for _, t in tables)
    for text, hits in zip(texts(), many.hits_of(texts(), tables).to_pylist(), strict=True):
        for number, motif in enumerate(MOTIFS):
            assert [(h["start"], h["end"]) for h in hits if h["number"] == number] == want(motif, text), (motif, text)


@pytest.mark.parametrize("pattern", ["^AA", "A", "[AE]A", "(AA|AE)L"])
def test_others_have_no_table(pattern):
    assert many.table(P.parse(pattern)) is None


def test_batch_is_one_pass(spark):
    rows = [(f"b{i % 3}", f"r{i}", text) for i, text in enumerate(texts())] + [("b0", "none", None)]
    index = S.build_index(spark.createDataFrame(rows, "bin string, name string, seq string"), k=6)
    found = S.search_many(index, {m: m for m in MOTIFS})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.lower()  # every text was searched again for each motif it holds
    got = sorted((r.bin, r.name, r.motif_id, r.start, r.end, r.match) for r in found.collect())
    assert got == sorted((b, n, m, s, e, t[s:e]) for b, n, t in rows if t is not None for m in MOTIFS for s, e in want(m, t))
    assert X.TRIED_EACH < len(MOTIFS)


def test_filtered_motifs_join_the_pass(spark):
    """A text was a row for every motif whose k-mers its bin holds, and was searched again for each."""
    rows = [(f"b{i:02d}", f"r{i}", text) for i, text in enumerate(texts())]
    index = S.build_index(spark.createDataFrame(rows, "bin string, name string, seq string"), k=3)
    motifs = [m for m in MOTIFS if m.endswith(("A", "]", "+", "A?", "2}", "E)?"))] + [a + b + "L" for a in ("AA", "AE", "EA") for b in "AEL"]
    motifs += [stem + tail for stem in ("AL", "LA", "LE", "EE") for tail in (".", "E?", "A?", "L?", "[^E]", "[AE]?")] + MOTIFS
    motifs = list(dict.fromkeys(motifs))
    looked_up = X._look_up(index, [X.prepare(m, m) for m in motifs], False, False)
    assert min(len(looked_up.unfiltered), len(motifs) - len(looked_up.unfiltered)) > X.TRIED_EACH
    found = S.search_many(index, {m: m for m in motifs})
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    got = sorted((r.name, r.motif_id, r.start, r.end, r.match) for r in found.collect())
    assert got == sorted((n, m, s, e, t[s:e]) for _, n, t in rows for m in motifs for s, e in want(m, t))


def test_hits_by_motif():
    tables = [(many.head(P.parse(m)), many.table(P.parse(m))) for m in MOTIFS]
    for some in (texts(), texts()[:3]):
        flat = many.hits_of(some, tables)
        back = [[{"number": g["number"], **s} for g in own for s in g["spans"]] for own in many.grouped(flat).to_pylist()]
        assert back == flat.to_pylist()
        assert all(len({g["number"] for g in own}) == len(own) for own in many.grouped(flat).to_pylist())
