"""All matches of many motifs in one pass over ASCII texts, in arrays.

For motifs that begin with two given letters and whose leftmost-first match is the longest. The
places of every pair of letters are found once; a motif's table of states then advances from
all places of its pair at the same time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqsieve.plans import pattern as P

END = 128  # stands behind every text; no ASCII text has it
STATES = 200  # of a motif's table
CHARS = 1 << 20  # of texts that are searched together
GROUPS = "array<struct<number:int,spans:array<struct<start:int,end:int>>>>"


def head(node) -> str | None:
    """The two letters that every match begins with."""
    items = node.items[:2] if isinstance(node, P.Cat) else ()
    fixed = [next(iter(i.chars)) for i in items if isinstance(i, P.Chars) and len(i.chars) == 1 and not i.negated]
    return "".join(fixed) if len(fixed) == 2 and all(ord(c) < 128 for c in fixed) else None


def table(node) -> tuple[np.ndarray, np.ndarray, int] | None:
    """Next states by state and character, accepting states, the state behind the head; 0 is dead.

    None for motifs that are not searched for in this way.
    """
    start = head(node)
    if start is None or not P.first_match_is_longest(node) or P._has(node, lambda n: isinstance(n, P.Anchor) and not n.end):
        return None
    automaton = P.positions(node)
    takes = np.zeros((len(automaton.classes), END + 1), bool)
    for p, residues in enumerate(automaton.classes):
        takes[p, END] = not residues.negated and P.END_MARK in residues.chars
        for c in range(END):
            takes[p, c] = (chr(c) in residues.chars) != residues.negated
        if residues.negated and not residues.chars:
            takes[p, ord("\n")] = False
        if takes[p, END]:
            takes[p, :END] = False
    names = {frozenset(): 0, frozenset([-1]): 1}
    sets, rows = list(names), []
    for state in sets:  # grows on the way
        ahead = automaton.first if -1 in state else frozenset().union(*(automaton.follow[p] for p in state))
        row = np.zeros(END + 1, np.int16)
        for c in np.flatnonzero(takes[list(ahead)].any(axis=0)) if ahead else ():
            target = frozenset(p for p in ahead if takes[p, c])
            if target not in names:
                names[target] = len(sets)
                sets.append(target)
            row[c] = names[target]
        rows.append(row)
        if len(sets) > STATES:
            return None
    steps = np.array(rows)
    accepts = np.array([bool(state & automaton.last) for state in sets])
    return steps, accepts, int(steps[steps[1, ord(start[0])], ord(start[1])])


def _ends(data: np.ndarray, begins: np.ndarray, steps: np.ndarray, accepts: np.ndarray, state: int) -> np.ndarray:
    """The end of the longest match at each place where the head stands, 0 if there is none."""
    end = begins + 2 if accepts[state] else np.zeros_like(begins)
    ahead = steps.any(axis=1)  # states that a further letter can change
    if not ahead[state]:
        return end
    open_, at, states = None, begins + 2, None
    while len(at):
        char = data.take(at)
        states = steps[state].take(char) if states is None else steps[states, char]
        hit = np.flatnonzero(accepts.take(states))
        end[hit if open_ is None else open_.take(hit)] = at.take(hit) + (char.take(hit) != END)
        going = np.flatnonzero(ahead.take(states) & (char != END))
        open_ = going if open_ is None else open_.take(going)
        at, states = at.take(going) + 1, states.take(going)
    return end


def _apart(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which matches a search from left to right takes: none begins in one that it took."""
    taken = np.ones(len(begins), bool)
    if (begins[1:] >= ends[:-1]).all():
        return taken
    new = np.concatenate([[True], begins[1:] >= np.maximum.accumulate(ends)[:-1]])
    alone = new & np.concatenate([new[1:], [True]])
    free = 0
    for i in np.flatnonzero(~alone):
        taken[i] = begins[i] >= free
        if taken[i]:
            free = ends[i]
    return taken


def hits_of(texts: list[str], tables: list[tuple[str, tuple]]) -> pa.Array:
    """Per text its matches: number of the motif, start and end. ``tables`` holds head and table of each."""
    data = np.frombuffer(b"".join(t.encode("ascii") + bytes([END]) for t in texts) + bytes([END, END]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    pairs = data[:-1].astype(np.uint16) * np.uint16(256) + data[1:]
    order = np.argsort(pairs, kind="stable").astype(np.int32)
    pairs = pairs[order]
    found: list[tuple[np.ndarray, ...]] = []
    for number, (start, (steps, accepts, state)) in enumerate(tables):
        pair = np.uint16(ord(start[0]) * 256 + ord(start[1]))
        begins = order[np.searchsorted(pairs, pair, "left") : np.searchsorted(pairs, pair, "right")]
        if not len(begins):
            continue
        ends = _ends(data, begins, steps, accepts, state)
        begins, ends = begins[ends > 0], ends[ends > 0]
        if len(begins):
            own = _apart(begins, ends)
            found.append((np.full(int(own.sum()), number, np.int32), begins[own], ends[own]))
    number, begins, ends = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    # numbers of texts that fit 16 bits are sorted digit by digit
    text = np.arange(len(texts), dtype=np.uint16 if len(texts) < 1 << 16 else np.int64).repeat(sizes).take(begins)
    order = np.argsort(text, kind="stable")
    text = text[order]
    parts = [number[order], begins[order] - first[text], ends[order] - first[text]]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))]).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(p.astype(np.int32)) for p in parts], ["number", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets), spans)


def grouped(hits: pa.ListArray) -> pa.ListArray:
    """The same by motif: per text and motif its number and spans, so that a motif is named once per text."""
    number, start, end = (c.to_numpy() for c in hits.values.flatten())
    offsets = hits.offsets.to_numpy()
    first = np.ones(len(number) + 1, bool)
    first[1:-1] = number[1:] != number[:-1]
    first[offsets] = True
    cuts = np.flatnonzero(first)
    spans = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"])
    lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), spans)
    groups = pa.StructArray.from_arrays([pa.array(number[cuts[:-1]]), lists], ["number", "spans"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(cuts, offsets).astype(np.int32)), groups)


def many_spans(texts: DataFrame, nodes: dict[str, object]) -> DataFrame:
    """``texts`` (seq is ASCII) with motif_id, match, start and end, for motifs that have a table."""
    columns = texts.columns
    where = columns.index("seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [(head(node), table(node)) for node in nodes.values()]
        for batch in batches:
            seqs = [t or "" for t in batch.column(where).to_pylist()]
            begin = size = 0
            for i, seq in enumerate(seqs, 1):
                size += len(seq) + 1
                if size >= CHARS or i == len(seqs):
                    part = batch.slice(begin, i - begin)
                    yield pa.RecordBatch.from_arrays([*part.columns, grouped(hits_of(seqs[begin:i], tables))], names=[*columns, "_hits"])
                    begin, size = i, 0

    schema = T.StructType([*texts.schema.fields, T.StructField("_hits", T._parse_datatype_string(GROUPS))])
    names = texts.sparkSession.createDataFrame(list(enumerate(nodes)), "number int, motif_id string")
    hits = texts.mapInArrow(run, schema).select(*columns, F.inline("_hits"))
    match = F.substring(F.col("seq").cast("binary"), F.col("start") + 1, F.col("end") - F.col("start")).cast("string")
    # named before the spans become rows
    rows = hits.join(F.broadcast(names), "number").select(*columns, "motif_id", F.inline("spans"))
    return rows.select(*columns, "motif_id", match.alias("match"), "start", "end")
