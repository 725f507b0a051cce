"""URL rules in a trie over reversed host labels, then path segments.

A rule is a host and the start of a path; it fits its host and all subdomains where the
url's path starts with the rule's. Of the rules that fit a url the longest (host and path
together) decides, a block before an allow of the same length; where none fits, the
default does.

Cases: a null url, or one without ``://``, has an empty host and path and fits no rule;
empty tables give empty results; repeated rows are judged alike; further columns are not
looked at. Rules are a list in the caller's memory, at most MAX_RULE_CHARS long, so the
trie that is sent to the workers is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from seqsieve.llm.common import on_workers

MAX_RULE_CHARS = 64_000_000
_LOWER = {code: code + 32 for code in range(ord("A"), ord("Z") + 1)}
_host_end = re.compile(r"[/?#]")
_path_end = re.compile(r"[?#]")


@dataclass
class Node:
    """A host label or path segment: what follows it, and the rules that end here."""

    labels: dict[str, Node] = field(default_factory=dict)
    segments: dict[str, Node] = field(default_factory=dict)
    #: by the start of the next segment that the rule asks for: its length and verdict
    tails: dict[str, tuple[int, str, str]] = field(default_factory=dict)
    root_path: Node | None = None


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = _host_end.search(rest)
    if not end:
        return rest.translate(_LOWER), ""
    at = end.start()
    host = rest[:at].translate(_LOWER)
    return host, _path_end.split(rest[at:], maxsplit=1)[0]


class RuleTrie:
    def __init__(self, rules: Iterable[tuple[str, str]]) -> None:
        """``rules``: pairs of ``allow`` or ``block`` and ``host/path``."""
        self.root, chars = Node(), 0
        for verdict, rule in rules:
            if verdict not in ("allow", "block") or "/" not in rule or rule.startswith("/"):
                raise ValueError(f"not a rule: {verdict} {rule}")
            chars += len(rule)
            if chars > MAX_RULE_CHARS:
                raise ValueError("more rules than a broadcast trie may hold")
            host, _, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.labels.setdefault(label, Node())
            node.root_path = node = node.root_path or Node()
            *segments, tail = path.split("/")
            for segment in segments:
                node = node.segments.setdefault(segment, Node())
            found = (len(rule), verdict, rule)
            node.tails[tail] = max(found, node.tails.get(tail, found))  # "block" sorts after "allow"

    def judge(self, host: str, path: str) -> tuple[str, str] | None:
        """Verdict and rule of the longest rule that fits, if one does."""
        best, node = (0, "", ""), self.root
        segments = path[1:].split("/") if path else []
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            at = node.root_path
            for segment in segments:
                if at is None:
                    break
                for tail, found in at.tails.items():
                    if segment.startswith(tail):
                        best = max(best, found)
                at = at.segments.get(segment)
        return (best[1], best[2]) if best[0] else None


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null where none fits) and verdict of every row."""
    spark = pages.sparkSession
    on_workers(spark)
    trie = spark.sparkContext.broadcast(RuleTrie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = trie.value.judge
        for batch in batches:
            hosts, paths, texts, verdicts = [], [], [], []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                verdict, rule = judge(host, path) or (default, None)
                hosts.append(host)
                paths.append(path)
                texts.append(rule)
                verdicts.append(verdict)
            columns = [batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, texts, verdicts))]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", "rule", "verdict"])

    schema = T.StructType(
        [T.StructField("page_id", pages.schema["page_id"].dataType)]
        + [T.StructField(name, T.StringType()) for name in ("host", "path", "rule", "verdict")]
    )
    return pages.select("page_id", "url").mapInArrow(run, schema)
