import hashlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from seqsieve.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CODEC = bpe.Codec(Path(RANKS).read_bytes(), public_tokenizers.PATTERN)
TEXTS = ["", "a", "Don't you'll we've 'stop", "naïve  café\n\n\tx  y", " lead", "trail   ", "x" * 500, "12 345,6", "日本語 text\u00a0nbsp\u3000wide", "a\r\n b \x1c c\x85d", "<|endoftext|> is text", "\U0001f600\U0001f600 ok"]


def plain(text):
    return CODEC.by_pattern.encode_ordinary(text)


@pytest.mark.parametrize("piece, run", [(1, 2), (3, 3), (7, 5), (40, 10)])
def test_cuts_change_nothing(monkeypatch, piece, run):
    import re

    monkeypatch.setattr(bpe, "PIECE", piece)
    monkeypatch.setattr(bpe, "LONG_RUN", run)
    monkeypatch.setattr(bpe, "_long_runs", re.compile(f"[{bpe.SPACE}]{{{run},}}"))
    for text in [*TEXTS, "".join(TEXTS), "    ".join(TEXTS)]:
        ids = CODEC.encode(text)
        assert ids.tolist() == plain(text)
        assert CODEC.decode(ids.tolist()) == text.encode()


def test_each_match_apart_as_the_library_does():
    own = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})
    for text in TEXTS:
        assert CODEC.encode(text).tolist() == own.encode_ordinary(text)


def test_very_long_runs():
    for text in (" " * 1_500_000 + "x", "\n \t" * 300_000, "a" * 300_000, "b " * 200_000):
        ids = CODEC.encode(text)
        assert CODEC.decode(ids.tolist()) == text.encode()


def test_operators(table):
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(None, None, None, None), (3, "again", "en", "s"), (3, "again", "en", "s")]
    docs = table(rows, clashing=True)
    got = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = np.array(plain(text or ""), "<u4")
        want.append((doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    coded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(coded, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((t or "").encode() for _, t, *_ in rows)
    assert bpe.round_trip(table([]), RANKS, public_tokenizers.PATTERN).collect() == []
