"""Which of many literals a text holds, in one pass over it."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

DEPTH = 32  # letters of a literal that are walked; longer ones are compared where these stand
CELLS = 1 << 24  # of the table of a machine: 64 MB
HEADS = 1 << 20  # states behind three letters that are tabled
CHARS = 1 << 18  # of texts that are searched together


def held_numbers(literals: list[str]):
    """Pandas UDF text -> numbers of the literals it holds; the empty literal is in every text.

    The literals are one automaton, built once per task, so a text is read once however
    many they are.
    """

    @F.pandas_udf("array<int>")
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        numbers: dict[str, list[int]] = {}
        for number, literal in enumerate(literals):
            numbers.setdefault(literal, []).append(number)
        always = numbers.pop("", [])
        machine = ahocorasick.Automaton()
        for literal in numbers:
            machine.add_word(literal, literal)
        if numbers:
            machine.make_automaton()

        def of(text: str | None) -> list[int]:
            if text is None:
                return []
            seen: set[str] = set()
            if numbers:
                for _, literal in machine.iter(text):
                    if literal not in seen:
                        seen.add(literal)
                        if len(seen) == len(numbers):
                            break
            return always + [n for literal in seen for n in numbers[literal]]

        for texts in batches:
            yield pd.Series([of(text) for text in texts], dtype=object)

    return held


class Machine:
    """A trie of sorted literals as arrays, walked from all places of a text at once."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, fresh: np.ndarray, letters: int):
        depth = codes.shape[1]
        nodes = np.cumsum(fresh.ravel(order="F")).reshape(fresh.shape, order="F").astype(np.int32)
        self.letters = letters
        self.steps = np.zeros((int(nodes[-1, -1]) + 1) * letters, np.int32)
        parents = np.concatenate([np.zeros((len(codes), 1), np.int32), nodes[:, :-1]], axis=1)
        self.steps[(parents.astype(np.int64) * letters + codes)[fresh]] = nodes[fresh]
        self.ends = np.full(len(self.steps) // letters, -1, np.int32)
        own = np.flatnonzero(sizes <= depth)
        self.ends[nodes[own, sizes[own] - 1]] = own
        self.longer: dict[int, list[int]] = {}
        for i in np.flatnonzero(sizes > depth):
            self.longer.setdefault(int(nodes[i, -1]), []).append(int(i))
        self.least = min(int(sizes.min()), depth)
        self.heads = None  # states behind three letters
        if self.least >= 3 and letters**3 <= HEADS:
            one = self.steps.reshape(-1, letters)
            two = np.where(one[0][:, None] != 0, one[one[0]], 0)
            self.heads = np.where(two[:, :, None] != 0, one[two], 0).ravel()

    def walk(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Rows of literals and where they begin, by depth; with True: rows of ``longer`` to be compared."""
        if self.heads is None:
            states, depth = self.steps.take(codes), 1
        else:
            m = self.letters
            states, depth = self.heads.take((codes[:-2] * m + codes[1:-1]) * m + codes[2:]), 3
        begins = np.flatnonzero(states)
        states = states.take(begins)
        while len(begins):
            if depth >= self.least:
                rows = self.ends.take(states)
                hit = np.flatnonzero(rows >= 0)
                yield rows.take(hit), begins.take(hit), False
                if self.longer and depth == DEPTH:
                    for node in np.intersect1d(states, list(self.longer)).tolist():
                        places = begins[states == node]
                        for row in self.longer[node]:
                            yield np.full(len(places), row, np.int32), places, True
            states = self.steps.take(states * np.int64(self.letters) + codes.take(begins + depth))
            going = np.flatnonzero(states)
            begins, states, depth = begins.take(going), states.take(going), depth + 1


class LiteralFinder:
    """All matches of many different literals, in arrays; matches of one literal do not overlap."""

    def __init__(self, literals: list[str]):
        self.order = np.array(sorted(range(len(literals)), key=literals.__getitem__), np.int32)
        literals = [literals[i] for i in self.order]
        points = [np.frombuffer(w.encode("utf-32-le"), "<u4") for w in literals]
        self.alphabet = np.unique(np.concatenate(points))
        self.coded = np.zeros(128, np.int64)  # of ASCII; 0 is any character that no literal has
        plain = self.alphabet[self.alphabet < 128]
        self.coded[plain] = np.arange(1, len(plain) + 1)
        self.sizes = np.array([len(p) for p in points], np.int32)
        depth = int(min(DEPTH, self.sizes.max()))
        codes = np.zeros((len(points), depth), np.int32)
        filled = np.arange(depth) < self.sizes[:, None]
        codes[filled] = self._codes(np.concatenate([p[:depth] for p in points]))
        self.points = {i: self._codes(points[i]) for i in np.flatnonzero(self.sizes > depth).tolist()}
        # literals that overlap themselves: only their matches are compared with each other
        self.bordered = self.sizes > depth
        for shift in range(1, depth):
            fits = (codes[:, shift:] == codes[:, : depth - shift]) | ~filled[:, shift:]
            self.bordered |= (self.sizes > shift) & fits.all(axis=1)
        fresh = np.ones(codes.shape, bool)
        fresh[1:] = np.logical_or.accumulate(codes[1:] != codes[:-1], axis=1)
        fresh &= filled
        letters = len(self.alphabet) + 1
        # a machine has a bounded table; the literals of the next one are spelled anew
        part = np.cumsum(fresh.sum(axis=1)) // max(1, CELLS // letters)
        self.machines = []
        for own in np.split(np.arange(len(points)), np.flatnonzero(np.diff(part)) + 1):
            first = fresh[own]
            first[0] = filled[own[0]]
            self.machines.append((own[0], Machine(codes[own], self.sizes[own], first, letters)))

    def _codes(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, 0)

    def _joined(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the texts, a 0 behind each, and where each text begins."""
        ends = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)
        ends = ends[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        sizes = np.diff(ends)
        if len(data) and data.max() >= 128:
            plain = [text or "" for text in texts.to_pylist()]
            sizes = np.array([len(text) for text in plain])
            codes = self._codes(np.frombuffer("".join(plain).encode("utf-32-le"), "<u4"))
        else:
            codes = self.coded.take(data)
        begins = np.cumsum(sizes + 1) - sizes - 1
        out = np.zeros(len(codes) + len(sizes), np.int64)
        inside = np.ones(len(out), bool)
        inside[begins + sizes] = False
        out[inside] = codes
        return out, begins

    def _compared(self, codes: np.ndarray, row: int, begins: np.ndarray) -> np.ndarray:
        """Those of the places where a long literal stands."""
        own = self.points[row]
        begins = begins[begins + len(own) <= len(codes)]
        return np.array([b for b in begins.tolist() if np.array_equal(codes[b : b + len(own)], own)], np.int64)

    def _apart(self, rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Which matches a search from left to right for each literal takes."""
        taken = np.ones(len(rows), bool)
        own = np.flatnonzero(self.bordered[rows])
        own = own[np.lexsort((begins[own], rows[own]))]
        row, begin = rows[own], begins[own]
        close = np.zeros(len(own) + 1, bool)
        close[1:-1] = (row[1:] == row[:-1]) & (begin[1:] < begin[:-1] + self.sizes[row[:-1]])
        free = 0
        for i in np.flatnonzero(close[:-1] | close[1:]).tolist():
            if close[i] and begin[i] < free:
                taken[own[i]] = False
            else:
                free = begin[i] + self.sizes[row[i]]
        return taken

    def spans(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """How many matches each text has, and of these number, start and end."""
        codes, first = self._joined(texts)
        rows, begins = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for base, machine in self.machines:
            for row, begin, unsure in machine.walk(codes):
                row = row + np.int32(base)
                if unsure and len(row):
                    begin = self._compared(codes, int(row[0]), begin)
                    row = row[: len(begin)]
                rows.append(row)
                begins.append(begin)
        row, begin = np.concatenate(rows), np.concatenate(begins)
        taken = self._apart(row, begin)
        row, begin = row[taken], begin[taken]
        text = np.searchsorted(first, begin, "right") - 1
        order = np.argsort(text.astype(np.uint16) if len(first) < 1 << 16 else text, kind="stable")
        row, begin, text = row[order], begin[order], text[order]
        start = (begin - first[text]).astype(np.int32)
        return np.bincount(text, minlength=len(first)), self.order[row], start, start + self.sizes[row]


def literal_spans(literals: list[str]):
    """Arrow UDF text -> number, start and end of what a search for each of different literals finds."""

    @F.arrow_udf("array<struct<number:int,start:int,end:int>>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = LiteralFinder(literals)
        for texts in batches:
            parts, begin = [], 0
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            while begin < len(texts):  # as many texts at a time as make about CHARS
                end = max(begin + 1, int(np.searchsorted(sizes, CHARS + (sizes[begin - 1] if begin else 0), "right")))
                parts.append(finder.spans(texts.slice(begin, end - begin)))
                begin = end
            counts, *columns = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int32)] * 4
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            found = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], ["number", "start", "end"])
            yield pa.ListArray.from_arrays(pa.array(offsets), found)

    return spans
