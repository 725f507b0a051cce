"""From a pattern to the k-mers its matches must contain.

A pattern is walked once over *windows* (the residues seen since the last break)
and yields a small acyclic graph: every edge may demand one indexed key, a k-mer or
a gapped k-mer, and a bin can hold a match only if some path from the start to the
end finds all its keys in that bin. Whenever the walk cannot or should not be
precise (long loops, too many windows, characters that were never indexed as such)
it *breaks*: windows are shortened or emptied, which drops constraints and so never
loses a bin.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from seqsieve.functions.alphabet import dgram_text_code
from seqsieve.plans import pattern as P


@dataclass(frozen=True)
class IndexShape:
    """What the walk needs to know about an index."""

    k: int
    alphabet: frozenset | None  # characters seen while indexing; None: unknown
    canonical: Callable[[str], str] | None = None  # nucleotide k-mers are stored canonically
    dgram_gaps: tuple[int, int] | None = None


@dataclass
class WindowGraph:
    """States are numbered so that every edge goes from a lower to a higher number."""

    edges: list = field(default_factory=list)  # (from, to, key number or -1)
    keys: dict = field(default_factory=dict)  # key -> key number
    n_states: int = 1

    @property
    def accept(self) -> int:
        return self.n_states - 1

    def key_number(self, key: str) -> int:
        return self.keys.setdefault(key, len(self.keys))

    def needs_no_key(self) -> bool:
        """Whether some path through the graph asks for no key at all."""
        free = {0}
        for source, target, key in self.edges:
            if key < 0 and source in free:
                free.add(target)
        return self.accept in free

    def required_sets(self, limit: int) -> list[frozenset] | None:
        """Alternatives, each a set of keys that must all be present.

        ``[frozenset()]`` means that nothing is required; None that there are too
        many alternatives to list and the graph itself must be evaluated.
        """
        at: list[set] = [set() for _ in range(self.n_states)]
        at[0].add(frozenset())
        size = 0
        for source, target, key in self.edges:
            extra = frozenset() if key < 0 else frozenset([key])
            before = len(at[target])
            at[target] |= {s | extra for s in at[source]}
            size += (len(at[target]) - before) * (1 + len(extra))
            if size > limit:
                return None
        alternatives = sorted(at[self.accept], key=len)
        if len(alternatives) > 256:
            return alternatives
        kept: list[frozenset] = []
        for candidate in alternatives:  # a superset of another alternative is redundant
            if not any(k <= candidate for k in kept):
                kept.append(candidate)
        return kept


MAX_WINDOWS = 2048  # live windows at one pattern position before they are shortened
UNSEEN = "\0"  # stands for every character outside the indexed alphabet
MAX_EDGES = 200_000  # edges before every further wildcard or class breaks


def window_graph(node, shape: IndexShape) -> WindowGraph:
    graph = WindowGraph()
    k = shape.k

    def edge(source: int, live: dict, key, needle: int = -1) -> None:
        if key not in live:
            live[key] = graph.n_states
            graph.n_states += 1
        graph.edges.append((source, live[key], needle))

    def merged(parts: list[dict]) -> dict:
        if len(parts) == 1:
            return parts[0]
        live: dict = {}
        for part in parts:
            for key, source in part.items():
                edge(source, live, key)
        return live

    def broken(live: dict) -> dict:
        if set(live) == {("", None)}:
            return live
        out: dict = {}
        for source in live.values():
            edge(source, out, ("", None))
        return out

    def shortened(live: dict) -> dict:
        """Forget the oldest residue of the longest windows, which makes many equal."""
        longest = max(len(window) for window, _ in live)
        if longest == 0 or any(pending for _, pending in live):
            return broken(live)
        out: dict = {}
        for (window, pending), source in live.items():
            edge(source, out, (window[-longest + 1 :] if longest > 1 else "", pending))
        return out

    def spelled(node: P.Chars):
        """The characters to branch over; None when they cannot be listed.

        All characters that no k-mer contains are one: they can only occur in records
        shorter than k.
        """
        known = shape.alphabet
        if known is None:
            chars = None if node.negated else node.chars
        elif node.negated:
            chars = (known - node.chars) | {UNSEEN}
        else:
            chars = frozenset(c if c in known else UNSEEN for c in node.chars)
        if chars is not None and any(ord(c) > 127 for c in chars):
            return None
        return chars

    def step(node: P.Chars, live: dict) -> dict:
        chars = spelled(node)
        if chars is None or len(chars) > MAX_WINDOWS or (
            len(chars) > 1 and len(graph.edges) > MAX_EDGES
        ):
            return broken(live)
        while len(live) * len(chars) > MAX_WINDOWS:
            live = shortened(live)
        out: dict = {}
        for (window, pending), source in live.items():
            for char in sorted(chars):
                text = window + char
                if pending is not None:  # collecting the right half of a gapped k-mer
                    if len(text) < 3:
                        edge(source, out, (text, pending))
                        continue
                    left, gap = pending
                    code = dgram_text_code(left, gap, text)
                    needle = -1 if code is None else graph.key_number(f"d{code}")
                    edge(source, out, (text, None), needle)
                    continue
                needle = -1
                if len(text) >= k:
                    kmer = text[-k:]
                    if UNSEEN in kmer:
                        continue
                    kmer = shape.canonical(kmer) if shape.canonical else kmer
                    needle = graph.key_number(f"k{kmer}")
                edge(source, out, (text[-keep:], None), needle)
        return out

    keep = max(k - 1, 3 if shape.dgram_gaps else 1)

    def gap(node: P.Gap, live: dict) -> dict:
        out: dict = {}
        for (window, _), source in live.items():
            for size in sorted(node.lengths):
                if size == 0:
                    edge(source, out, (window, None))
                    continue
                indexed = shape.dgram_gaps and (
                    shape.dgram_gaps[0] <= size <= shape.dgram_gaps[1]
                )
                start = (window[-3:], size) if indexed and len(window) >= 3 else None
                edge(source, out, ("", start))
        return out

    def walk(node, live: dict) -> dict:
        if isinstance(node, P.Chars):
            return step(node, live)
        if isinstance(node, P.Anchor):
            return live
        if isinstance(node, P.Gap):
            return gap(node, live)
        if isinstance(node, P.Cat):
            for item in node.items:
                live = walk(item, live)
            return live
        if isinstance(node, P.Alt):
            return merged([walk(item, live) for item in node.items])
        return repeat(node, live)

    def repeat(node: P.Rep, live: dict) -> dict:
        # B{lo} first. Of the optional iterations up to k-1 are spelled out; a longer
        # run is k-1 iterations, a break, and k-1 iterations again: both pieces are
        # contiguous in any text with that many iterations.
        if node.lo > 4 * k + 64:  # a long fixed run: its first and last iterations
            head = walk(P.Rep(node.body, k, k), live)
            live = walk(P.Rep(node.body, k, k), broken(head))
        else:
            for _ in range(node.lo):
                live = walk(node.body, live)
        spelled_out = k - 1 if node.hi is None else min(k - 1, node.hi - node.lo)
        ends, current = [live], live
        for _ in range(spelled_out):
            current = walk(node.body, current)
            ends.append(current)
        if node.hi is None or node.hi - node.lo > spelled_out:
            current = broken(current)
            for _ in range(max(1, k - 1)):
                current = walk(node.body, current)
            ends.append(current)
        return merged(ends)

    final = walk(node, {("", None): 0})
    last = graph.n_states
    graph.n_states += 1
    graph.edges.extend((source, last, -1) for source in final.values())
    graph.edges.sort(key=lambda e: e[0])
    return graph


def to_dot(graph: WindowGraph) -> str:
    """Graphviz text of a window graph, for looking at how a pattern is searched."""
    names = {number: key for key, number in graph.keys.items()}
    lines = [
        f'  {source} -> {target} [label="{names.get(key, "")[1:]}"];'
        for source, target, key in graph.edges
    ]
    return "\n".join(["digraph pattern {", "  rankdir=LR;", *lines, "}"])
