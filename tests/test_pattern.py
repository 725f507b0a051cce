import itertools
import random
import re

import pytest

from seqsieve.functions.spans import FirstMatcher, LongestMatcher
from seqsieve.operators.search import prepare
from seqsieve.plans import pattern as P
from seqsieve.plans.windows import IndexShape, window_graph


@pytest.mark.parametrize(
    "text",
    ["", "A{2,}", "[]", "[^]", "[A", "A{3,2}", "A{", "A{x}", "*A", "(A", "A)", "A**?", "\\", "A\\", "\\d", "(?:A)", "[B-A]"],
)
def test_malformed_patterns_are_rejected(text):
    with pytest.raises(ValueError):
        P.parse(text)


@pytest.mark.parametrize(
    "text, regex",
    [
        ("ACD", "ACD"),
        ("A|C", "[AC]"),
        ("A|CD", "A|CD"),
        ("(A|CD)E", "(?:A|CD)E"),
        ("[CA-]", r"[\-AC]"),
        ("[A-D]", "[ABCD]"),
        ("[^P]", "[^P]"),
        ("A.{2,3}", r"A[^\n]{2,3}"),
        ("^A$", r"^A\z"),
        (r"\.\*", r"\.\*"),
        ("(A+)*", "A*"),
        ("(AC)?D{3}", "(?:AC)?D{3}"),
    ],
)
def test_rendering(text, regex):
    assert P.render(P.parse(text)) == regex


def test_attributes():
    node = P.parse("A(C|DE)?F{2,3}")
    assert P.lengths(node) == {3, 4, 5, 6}
    assert P.lengths(P.parse("A+")) is None
    assert P.nullable(P.parse("A*B?")) and not P.nullable(P.parse("A*B"))
    assert P.count_strings(P.parse("A(C|DE)[FG]{2}"), 20) == 8
    assert P.required_literal(P.parse("TH(A|EE)RST.")) == "RST"


def test_trimming_and_gaps():
    assert P.trim(P.parse("^.*[^P]{2}AC.+$")) == P.parse("(AC)")
    node = P.gaps_for_complex_parts(P.parse("AC.{2}[^P]{1,2}DE"), 20)
    assert P.Gap(frozenset({3, 4})) in node.items


def test_nullable_patterns_are_rejected():
    with pytest.raises(ValueError):
        prepare("A*")


def brute_longest(node, text):
    """Leftmost-longest spans by trying every substring."""
    whole = re.compile(P.render(node, text_end=r"\Z"))
    out, at = [], 0
    while at < len(text):
        ends = [e for e in range(len(text), at, -1) if whole.fullmatch(text, at, e)]
        if ends:
            out.append((at, ends[0]))
            at = ends[0]
        else:
            at += 1
    return out


def random_pattern(rng, letters, depth=2):
    def atom():
        choice = rng.random()
        if choice < 0.5 or depth == 0:
            return rng.choice(letters)
        if choice < 0.6:
            return "."
        if choice < 0.75:
            return "[" + "".join(rng.sample(letters, 2)) + "]"
        if choice < 0.8:
            return "[^" + rng.choice(letters) + "]"
        branches = [random_pattern(rng, letters, depth - 1) for _ in range(rng.choice([1, 2, 2, 3]))]
        return "(" + "|".join(branches) + ")"

    def quantified():
        return atom() + rng.choice(["", "", "", "", "?", "*", "+", "{2}", "{1,2}", "{0,2}"])

    return "".join(quantified() for _ in range(rng.randint(1, 4)))


def test_longest_matching_against_brute_force():
    rng = random.Random(5)
    ways = set()
    loops = ["(AC)+D", "(A|CD)+E", "A(CD|E)*A", "(AC?D)+", "(A+C)*D", "(AC|D){1,200}E"] * 20
    for n in range(600 + len(loops)):
        pattern = loops[n] if n < len(loops) else random_pattern(rng, "ACD")
        node = P.parse(pattern)
        if P.nullable(node):
            continue
        text = "".join(rng.choice("ACDE") for _ in range(rng.randint(1, 14)))
        expected = brute_longest(node, text)
        motif = prepare(pattern)
        ways.add((motif.walk, bool(re.search(r"[*+?}]\+", motif.regex)), motif.regex == P.render(node)))
        walked = [(s["start"], s["end"]) for s in LongestMatcher(node).spans(text)]
        assert walked == expected, (pattern, text)
        first = [m.span() for m in re.finditer(P.render(node, text_end=r"\Z"), text)]
        assert [(s["start"], s["end"]) for s in FirstMatcher(node).spans(text)] == first
        if not motif.walk:
            regex = motif.regex.replace(r"\z", r"\Z")
            assert [m.span() for m in re.finditer(regex, text)] == expected, (pattern, text)
    # as it is, split by length, walked, with loops that give nothing back
    assert {w[:2] for w in ways} == {(None, False), (None, True), ("longest", False)}
    assert (None, False, False) in ways


def test_window_graph_never_loses_a_matching_text():
    rng = random.Random(11)
    pruned = 0
    for _ in range(1500):
        k = rng.choice([1, 2, 3, 4])
        pattern = random_pattern(rng, "ACD")
        node = P.parse(pattern)
        gaps = rng.choice([None, (1, 3)])
        text = "".join(rng.choice("ACDE") for _ in range(rng.randint(1, 16)))
        # letters of a text shorter than k are not known to the index
        known = frozenset(text) if len(text) >= k else frozenset(rng.choice(["", "A", "CE"]))
        shape = IndexShape(k, rng.choice([known, frozenset("ACDE")]), dgram_gaps=gaps)
        tree = P.trim(node)
        if rng.random() < 0.5:
            tree = P.gaps_for_complex_parts(tree, 2)
        graph = window_graph(tree, shape)
        alternatives = graph.required_sets(5000)
        held = {"k" + text[i : i + k] for i in range(len(text) - k + 1)}
        if gaps:
            from seqsieve.functions.alphabet import dgram_text_code

            held |= {
                f"d{dgram_text_code(text[i : i + 3], g, text[i + 3 + g : i + 6 + g])}"
                for g in range(gaps[0], gaps[1] + 1)
                for i in range(len(text) - g - 5)
            }
        names = {n: key for key, n in graph.keys.items()}
        reach = {0}
        for source, target, key in graph.edges:
            if source in reach and (key < 0 or names[key] in held):
                reach.add(target)
        candidate = graph.accept in reach
        if alternatives is not None:
            listed = any({names[n] for n in a} <= held for a in alternatives)
            assert listed == candidate
        if re.search(P.render(node, text_end=r"\Z"), text):
            assert candidate, (pattern, k, text)
        else:
            pruned += not candidate
    assert pruned > 100


def test_window_graph_stays_bounded():
    node = P.parse("W.{9}[LIVM]{30}(A|CD)*.{40}P")
    graph = window_graph(P.trim(node), IndexShape(6, frozenset("ACDEFGHIKLMNPQRSTVWY")))
    assert len(graph.edges) < 1_000_000
    for source, target, _ in graph.edges:
        assert source < target


def test_expansions_of_finite_patterns():
    graph = window_graph(P.parse("AC(D|EF)G"), IndexShape(3, None))
    names = {n: key[1:] for key, n in graph.keys.items()}
    sets = {frozenset(names[n] for n in a) for a in graph.required_sets(1000)}
    expected = {
        frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in ("ACDG", "ACEFG")
    }
    assert sets == expected


def test_products():
    for low, high in itertools.product(range(3), range(1, 4)):
        if low <= high:
            assert P.lengths(P.parse(f"A{{{low},{high}}}")) == set(range(low, high + 1))
