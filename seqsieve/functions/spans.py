"""Find-all with coordinates, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from seqsieve.plans import pattern as P

SPAN_TYPE = "array<struct<match:string,start:int,end:int>>"


def running_sum(values: str) -> str:
    """SQL for the prefix sums of an integer array, in log2(n) rounds of shift-and-add."""
    shift = "least(shiftleft(1, round), size(acc))"
    return f"""aggregate(
        sequence(0, cast(ceil(log2(size({values}))) AS int)),
        {values},
        (acc, round) -> zip_with(
            acc,
            concat(array_repeat(0, {shift}), slice(acc, 1, size(acc) - {shift})),
            (a, b) -> a + b))"""


def spans_from_pieces(matches: str, pieces: str) -> Column:
    """Spans from all matches of a record and the text pieces between them.

    Needs at least one match. A match ends after all pieces and matches up to it.
    """
    widths = f"""zip_with(slice({pieces}, 1, size({matches})), {matches},
        (piece, match) -> coalesce(length(piece) + length(match), 0))"""
    return F.expr(f"""zip_with({matches}, {running_sum(widths)}, (match, end) ->
        named_struct('match', match, 'start', end - length(match), 'end', end))""")


class LongestMatcher:
    """Leftmost-longest spans for patterns no first-match search can express.

    A backward pass over the text notes, per residue, the pattern positions that can
    consume it and still reach the end of a match. Forward runs keep to those, so they
    start only where a match starts and stop where it can grow no more. Both passes
    remember the sets they have seen: one dictionary lookup per residue.
    """

    #: entries of each memory; a full one is emptied, which only costs time
    REMEMBERED = 50_000

    def __init__(self, node) -> None:
        self.pattern = P.positions(node)
        self.steps: dict = {}
        self.backs: dict = {}

    def remember(self, memory: dict, key, value):
        if len(memory) >= self.REMEMBERED:
            memory.clear()
        memory[key] = value
        return value

    def back(self, following: frozenset, char: str) -> frozenset:
        marks = (P.START_MARK, P.END_MARK)
        return frozenset(
            p
            for p, residues in enumerate(self.pattern.classes)
            if (char in residues.chars) != residues.negated
            and not (residues.negated and char in marks)
            and (p in self.pattern.last or self.pattern.follow[p] & following)
        )

    def step(self, state: frozenset | None, useful: frozenset) -> tuple[frozenset, bool]:
        pattern = self.pattern
        ahead = pattern.first if state is None else frozenset().union(*(pattern.follow[p] for p in state))
        target = ahead & useful
        return target, bool(target & pattern.last)

    def longest_end(self, useful: list[frozenset], begin: int) -> int:
        """End of the longest match at ``begin``, -1 if there is none."""
        state, end = None, -1
        for i in range(begin, len(useful)):
            key = (state, useful[i])
            found = self.steps.get(key)
            if found is None:
                found = self.remember(self.steps, key, self.step(*key))
            state, accepting = found
            if not state:
                break
            if accepting:
                end = i + 1
        return end

    def spans(self, text: str) -> list[dict]:
        marked = P.START_MARK + text + P.END_MARK
        useful, state = [], frozenset()
        for char in reversed(marked):
            key = (state, char)
            state = self.backs.get(key)
            if state is None:
                state = self.remember(self.backs, key, self.back(*key))
            useful.append(state)
        useful.reverse()
        out, at = [], 0
        while at < len(text):
            end = self.end_at(text, useful, at)
            if end > at:
                out.append({"match": text[at:end], "start": at, "end": end})
                at = end
            else:
                at += 1
        return out

    def end_at(self, text: str, useful: list[frozenset], at: int) -> int:
        end = self.longest_end(useful, at + 1)
        if at == 0:
            end = max(end, self.longest_end(useful, 0))
        return min(end - 1, len(text))  # back to coordinates without the marks


class FirstMatcher(LongestMatcher):
    """Leftmost-first spans by Python's own matching, which does not recurse.

    It is asked only where a match exists, which spares it hopeless backtracking.
    """

    def __init__(self, node) -> None:
        super().__init__(node)
        self.match = re.compile(P.render(node, text_end=r"\Z")).match

    def end_at(self, text: str, useful: list[frozenset], at: int) -> int:
        if super().end_at(text, useful, at) <= at:
            return -1
        return self.match(text, at).end()


def walked_spans(nodes: dict[str, object], longest: bool):
    """Pandas UDF (text, motif id) -> spans; ``nodes`` maps motif ids to patterns."""

    @F.pandas_udf(SPAN_TYPE)
    def spans(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        matcher = LongestMatcher if longest else FirstMatcher
        matchers = {motif: matcher(node) for motif, node in nodes.items()}
        for texts, motifs in batches:
            yield pd.Series(
                # other motifs of a batch may pass by when Spark runs this before a join
                [matchers[m].spans(t) if m in matchers else [] for t, m in zip(texts, motifs)],
                dtype=object,
            )

    return spans
