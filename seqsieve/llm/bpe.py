"""Byte-level BPE over whole texts: a local rank file, encoded and decoded by tiktoken.

Texts are cut into pieces of bounded length where no match of the splitting pattern can
reach across: between anything and a following space or line feed. Runs of white space
too long for the pattern's backtracking are encoded apart, as the one match they are.

Cases: null is an empty text, whose ids are empty; texts of any length keep bounded work
per piece; repeated rows, ties and further columns change nothing; an empty table gives
an empty result. Ids are decoded as raw bytes, so cut or invalid UTF-8 comes back as it is.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seqsieve.llm.common import on_workers

#: The characters that the pattern's \s stands for (Unicode's White_Space).
SPACE = "\t-\r \x85\xa0  -     　"
#: Shorter runs of white space are left to the pattern.
LONG_RUN = 10_000
#: Characters of a piece, about.
PIECE = 1 << 16

_long_runs = re.compile(f"[{SPACE}]{{{LONG_RUN},}}")
_safe_cut = re.compile(r"(?<=\S)(?=[ \n])")


class Codec:
    """Encodes and decodes by the ranks of one file and one splitting pattern."""

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines())}
        self.by_pattern = tiktoken.Encoding("split", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.ranks = ranks

    @functools.cached_property
    def whole(self) -> tiktoken.Encoding:
        return tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """The ids of ``text``, special tokens' names being plain text."""
        if len(text) <= PIECE:
            if len(text) < LONG_RUN or not _long_runs.search(text):
                return np.array(self.by_pattern.encode_ordinary(text), dtype="<u4")
        ids, at = [], 0
        for run in _long_runs.finditer(text):
            # the pattern leaves the last space of a run to the word that follows, if one does
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += map(self.by_pattern.encode_ordinary, pieces(text, at, run.start()))
            ids.append(self.whole.encode_ordinary(text[run.start() : end]))
            at = end
        ids += map(self.by_pattern.encode_ordinary, pieces(text, at, len(text)))
        return np.concatenate([np.array(part, dtype="<u4") for part in ids]) if ids else np.array([], dtype="<u4")

    def decode(self, ids) -> bytes:
        return self.by_pattern.decode_bytes(ids)


def pieces(text: str, at: int, end: int) -> Iterator[str]:
    """``text[at:end]`` in pieces that end where a match ends."""
    while end - at > PIECE:
        cut = _safe_cut.search(text, at + PIECE, end)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    if at < end:
        yield text[at:end]


@functools.lru_cache(maxsize=2)
def _codec(rank_file: bytes, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def _with_codec(docs: DataFrame, rank_path: str, pattern: str, work, schema: T.StructType) -> DataFrame:
    """``work(codec, batch)`` over batches of ``docs``; the rank file (of one vocabulary) is sent to the workers."""
    on_workers(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(Path(rank_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                yield work(codec, batch.slice(start, 256))

    return docs.mapInArrow(run, schema)


def _texts(column: pa.Array) -> Iterator[str]:
    for text in column:
        yield (text.as_py() or b"").decode("utf-8", "replace")


def _schema(docs: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *fields])


def encode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every row."""

    def work(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [codec.encode(text).astype("<i4") for text in _texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    keyed = docs.select("doc_id", docs["text"].cast("binary"))
    return _with_codec(keyed, rank_path, pattern, work, _schema(docs, T.StructField("ids", T.ArrayType(T.IntegerType()))))


def decode(coded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id and bytes (binary) of every row of doc_id and ids."""

    def work(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [codec.decode(ids.as_py() or []) for ids in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "bytes"])

    return _with_codec(
        coded.select("doc_id", "ids"), rank_path, pattern, work, _schema(coded, T.StructField("bytes", T.BinaryType()))
    )


def round_trip(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to, in one pass."""

    def work(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in _texts(batch.column(1)):
            ids = codec.encode(text)
            back = hashlib.sha256(codec.decode(ids.tolist())).hexdigest()
            rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), back))
        counts, digests, decoded = zip(*rows, strict=True) if rows else ((), (), ())
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = _schema(
        docs,
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    )
    return _with_codec(docs.select("doc_id", docs["text"].cast("binary")), rank_path, pattern, work, schema)
