"""Indexed motif search over binned sequence collections, on Spark."""

from seqsieve.operators.index import add_dgrams, append, append_stream, build_index, compact, inspect, load_index
from seqsieve.operators.profiles import search_profiles
from seqsieve.operators.search import (
    candidate_bins,
    candidate_bins_many,
    pattern_dot,
    scan,
    search,
    search_all_of,
    search_files,
    search_many,
    search_observed,
)

__all__ = [
    "add_dgrams",
    "append",
    "append_stream",
    "build_index",
    "candidate_bins",
    "candidate_bins_many",
    "compact",
    "inspect",
    "load_index",
    "pattern_dot",
    "scan",
    "search",
    "search_all_of",
    "search_files",
    "search_many",
    "search_observed",
    "search_profiles",
]
