"""Postings written by ranges of keys, folded where the records lie.

Stored records are sorted by bin, so the windows of a stretch of text belong to few blocks.
Each task folds stretch after stretch into rows ``(key, block, mask)`` in arrays of bounded
size, whatever it reads; one shuffle then brings the rows of a range of keys together. The
ranges are quantiles of the rows that a sample of the blocks yields: they shape the files and
the tasks only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsieve.functions import alphabet
from seqsieve.session import ship_package

STRETCH = 1 << 21  # window starts folded at once
HELD_ROWS = 1 << 22  # folded rows that a task keeps to fold them further: below 500 MB
SENT_ROWS = 1 << 17  # rows of one batch of output
ROWS_PER_TASK = 1_000_000  # short rows that a task folds and sorts: below 400 MB
SAMPLED_RESIDUES = 4_000_000
SAMPLED_RECORDS, SAMPLED_LENGTH = 2000, 1 << 16
STRIDE = 64  # every so many rows of the sample one is fetched
PACKED_K = 8  # residues in a packed key

Windows = Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]


# ------------------------------------------------------------------ windows
def kmer_keys(k: int, ascii_only: bool) -> Windows:
    """Windows of ``k`` bytes as numbers, the first byte highest."""

    def keys(data: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, whole = len(left), left >= k
        data = np.concatenate([data, np.zeros(n + k - len(data), np.uint8)])
        key = np.zeros(n, np.uint64)
        for i in range(k):
            key = (key << np.uint64(8)) | data[i : i + n]
        if not ascii_only:  # windows are bytes; those touching other characters are never looked up
            for i in range(k):
                whole = whole & (data[i : i + n] < 128)
        at = np.flatnonzero(whole)
        yield key[at], at

    return keys


def dgram_keys(low: int, high: int) -> Windows:
    """Codes of three residues, a gap in low..high and three residues, of base-20 digits."""
    digit = np.full(256, 20, np.int64)
    for i in range(20):
        digit[ord(alphabet._DIGITS[i])] = i

    def keys(data: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = len(left)
        digits = np.full(n + high + 6, 20, np.int64)
        digits[: len(data)] = digit[data]
        known = digits < 20
        three = digits[:-2] * 400 + digits[1:-1] * 20 + digits[2:]
        known = known[:-2] & known[1:-1] & known[2:]
        for gap in range(low, high + 1):
            after = slice(gap + 3, gap + 3 + n)
            at = np.flatnonzero(known[:n] & known[after] & (left >= gap + 6))
            key = gap * 20**6 + three[:n][at] * 8000 + three[after][at]
            yield key.astype(np.uint64), at

    return keys


def stretches(column: pa.Array, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The bytes of texts by stretches: bytes, and per window start its text and what is left of it.

    A stretch has ``span - 1`` bytes more than starts, for the windows that begin at its end.
    """
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    for begin in range(int(ends[0]), int(ends[-1]), STRETCH):
        end = min(begin + STRETCH, int(ends[-1]))
        first, last = np.searchsorted(ends, begin, "right") - 1, np.searchsorted(ends, end, "left")
        own = np.repeat(np.arange(first, last), np.diff(np.clip(ends[first : last + 1], begin, end)))
        yield data[begin : min(end + span - 1, int(ends[-1]))], own, ends[own + 1] - np.arange(begin, end)


# ------------------------------------------------------------------- folding
def _packed(key: np.ndarray, block: np.ndarray, spare: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, int]:
    """Key and block as one number with ``spare`` free low bits; how to read it back."""
    blocks, rank = np.unique(block, return_inverse=True)
    bits = max(1, int(len(blocks) - 1).bit_length())
    names = None
    if int(key.max()).bit_length() + bits + spare > 64:
        names, key = np.unique(key, return_inverse=True)
        key = key.astype(np.uint64)
    return (key << np.uint64(bits + spare)) | (rank.astype(np.uint64) << np.uint64(spare)), names, blocks, bits


def _read_back(packed: np.ndarray, names: np.ndarray | None, blocks: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    key = packed >> np.uint64(bits)
    block = blocks[(packed & np.uint64((1 << bits) - 1)).astype(np.int64)]
    return (key if names is None else names[key.astype(np.int64)]), block


def _starts(groups: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))


def folded(key: np.ndarray, block: np.ndarray, lane: np.ndarray) -> tuple[np.ndarray, ...]:
    """``key``, ``block`` and ``mask``, sorted, of windows in lanes of blocks."""
    packed, *names = _packed(key, block, 6)
    packed |= lane.astype(np.uint64)
    packed.sort()
    groups = packed >> np.uint64(6)
    at = _starts(groups)
    bits = np.left_shift(np.int64(1), (packed & np.uint64(63)).astype(np.int64))
    return *_read_back(groups[at], *names), np.bitwise_or.reduceat(bits, at)


def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The same of folded rows."""
    if len(parts) == 1:
        return parts[0]
    key, block, mask = (np.concatenate(columns) for columns in zip(*parts, strict=True))
    packed, *names = _packed(key, block, 0)
    order = np.argsort(packed, kind="stable")
    packed = packed[order]
    at = _starts(packed)
    return *_read_back(packed[at], *names), np.bitwise_or.reduceat(mask[order], at)


def fold_texts(batches: Iterator[pa.RecordBatch], keys: Windows, span: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Folded rows of batches (seq, block, lane); a key and block may come again after HELD_ROWS others."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        block, lane = (batch.column(i).to_numpy() for i in (1, 2))
        for data, own, left in stretches(batch.column(0), span):
            for key, at in keys(data, left):
                if not len(key):
                    continue
                rows = own[at]
                held.append(folded(key, block[rows], lane[rows]))
                size += len(held[-1][0])
                if size > HELD_ROWS:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > HELD_ROWS // 2:
                        yield held.pop()
                        size = 0
    if held:
        yield merged(held)


def _spelled(key: np.ndarray, k: int) -> pa.Array:
    letters = np.ascontiguousarray(key.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - k :])
    offsets = np.arange(len(key) + 1, dtype=np.int32) * k
    return pa.StringArray.from_buffers(len(key), pa.py_buffer(offsets), pa.py_buffer(letters))


# ------------------------------------------------------------------- on Spark
def _sampled(placed: DataFrame, meta: dict) -> tuple[DataFrame, float]:
    """Some whole blocks or, of few blocks, some records; and their share."""
    blocks = max(1, meta["residues"] // SAMPLED_RESIDUES)
    if meta["n_blocks"] // blocks >= 8:
        some, share = placed.where(F.pmod(F.xxhash64("block"), F.lit(blocks)) == 0), 1 / blocks
    else:
        share = min(1.0, SAMPLED_RECORDS / max(1, meta["n_records"]))
        some = placed.where(F.rand(7) < share) if share < 1 else placed
    return some.withColumn("seq", F.substring("seq", 1, SAMPLED_LENGTH)), share


def _bounds(placed: DataFrame, meta: dict, keys: Windows, span: int, tasks: int) -> np.ndarray:
    """Bounds of ranges of keys with about as many rows each, ``tasks`` ranges or more."""
    some, share = _sampled(placed, meta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, _ in fold_texts(batches, keys, span):
            yield pa.RecordBatch.from_arrays([pa.array(key[STRIDE // 2 :: STRIDE].astype(np.int64))], names=["key"])

    found = np.sort(some.mapInArrow(run, "key bigint").toArrow().column(0).to_numpy())
    tasks = max(tasks, min(50_000, int(len(found) * STRIDE / share) // ROWS_PER_TASK))
    return np.unique(found[np.arange(1, tasks) * len(found) // tasks]) if len(found) else found


_CHUNK = "part int, rows int, data binary"
_KINDS = (np.uint64, np.uint32, np.uint64)  # of key, block and mask on the way
_CODEC = "zstd"


def _planes(values: np.ndarray) -> np.ndarray:
    """Bytes of the numbers, all lowest ones first: the upper ones of small numbers are a run of zeros."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.ravel()


def _packed_chunk(rows: list[np.ndarray]) -> bytes:
    """Sorted rows in few bytes: steps from key to key, blocks and masks, by planes of bytes."""
    steps = np.diff(rows[0].astype(np.uint64, copy=False), prepend=np.uint64(0))
    data = np.concatenate([_planes(c.astype(kind, copy=False)) for c, kind in zip((steps, *rows[1:]), _KINDS, strict=True)])
    return pa.Codec(_CODEC, 1).compress(pa.py_buffer(data), asbytes=True)


def _unpacked_chunk(data: bytes, n: int) -> list[np.ndarray]:
    whole = np.frombuffer(pa.Codec(_CODEC).decompress(data, n * sum(np.dtype(k).itemsize for k in _KINDS)), np.uint8)
    out, at = [], 0
    for kind in _KINDS:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(whole[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return [np.cumsum(out[0], dtype=np.uint64), out[1].view(np.int32), out[2].view(np.int64)]


def _chunks(rows: tuple[np.ndarray, ...], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted rows as chunks: a range of keys, how many rows and these packed, of SENT_ROWS at most."""
    key = rows[0]
    cuts = np.searchsorted(key, bounds.astype(np.uint64))
    cuts = np.unique(np.concatenate([cuts, np.arange(0, len(key), SENT_ROWS), [len(key)]]))
    part = np.searchsorted(bounds, key[cuts[:-1]].astype(np.int64), "right").astype(np.int32)
    # as many chunks to a batch as make about SENT_ROWS rows
    step = max(1, len(part) * SENT_ROWS // len(key))
    for at in range(0, len(part), step):
        own = cuts[at : at + step + 1]
        data = [_packed_chunk([c[low:high] for c in rows]) for low, high in zip(own[:-1], own[1:], strict=True)]
        columns = [pa.array(part[at : at + step]), pa.array(np.diff(own).astype(np.int32)), pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "rows", "data"])


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """The rows of a batch of chunks."""
    parts = [_unpacked_chunk(data, n) for n, data in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
    return tuple(np.concatenate(columns) for columns in zip(*parts, strict=True))


def ranged_postings(placed: DataFrame, meta: dict, keys: Windows, span: int, k: int | None, tasks: int) -> DataFrame:
    """``(key, block, mask)`` by ranges of keys, sorted in each; ``k`` spells the keys as k-mers.

    ``placed`` has seq, block and lane; one range if ``tasks`` is 1. Rows are shuffled as arrays,
    a chunk per task and range, and a range, which one task holds, is folded as arrays.
    """
    ship_package(placed.sparkSession)
    placed = placed.select("seq", "block", "lane").where("octet_length(seq) > 0")
    bounds = _bounds(placed, meta, keys, span, tasks) if tasks > 1 else np.zeros(0, np.int64)
    kind, name = ("string", "kmer") if k else ("bigint", "code")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in fold_texts(batches, keys, span):
            yield from _chunks(rows, bounds)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a range has all rows of its keys, so they need no further shuffle
        held, size = [], 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(_unpacked(batch))
            size += len(held[-1][0])
            if size > HELD_ROWS:
                held = [merged(held)]
                size = 0  # what is folded counts no more, so that it is folded again only with as much besides
        if not held:
            return
        key, block, mask = merged(held + [tuple(c[:0] for c in held[0])])  # sorts a single batch, too
        for at in range(0, len(key), SENT_ROWS):
            own = key[at : at + SENT_ROWS]
            shown = _spelled(own, k) if k else pa.array(own.astype(np.int64))
            columns = [shown, pa.array(block[at : at + SENT_ROWS], pa.int32()), pa.array(mask[at : at + SENT_ROWS])]
            yield pa.RecordBatch.from_arrays(columns, names=[name, "block", "mask"])

    chunks = placed.mapInArrow(send, _CHUNK).repartitionById(len(bounds) + 1, "part")
    return chunks.mapInArrow(fold, f"{name} {kind}, block int, mask bigint")


def ranged_kmers(placed: DataFrame, meta: dict, ascii_only: bool, tasks: int) -> DataFrame:
    """Postings of peptide k-mers (k up to PACKED_K), of reduced residues where the index is reduced."""
    k = meta["k"]
    placed = placed.withColumn("seq", alphabet.reduce_alphabet(F.col("seq"), meta["reduction"]))
    return ranged_postings(placed, meta, kmer_keys(k, ascii_only), k, k, tasks)


def ranged_dgrams(placed: DataFrame, meta: dict, gaps: tuple[int, int], tasks: int) -> DataFrame:
    """Postings of gapped k-mers."""
    placed = placed.withColumn("seq", alphabet.amino_digits(F.col("seq")))
    return ranged_postings(placed, meta, dgram_keys(*gaps), gaps[1] + 6, None, tasks)
