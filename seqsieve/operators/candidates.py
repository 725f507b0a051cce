"""Which bins can hold a match of a motif: lookups in the postings.

Every motif arrives as a window graph. Most graphs unfold into a modest number of
alternatives (sets of keys that must all be present); these are answered with one
join and two aggregations: ``bit_and`` over the keys of an alternative, ``bit_or``
over the alternatives. Path-rich graphs are evaluated as graphs, per group of
blocks, over the postings of their keys.

A lookup that can bring back few masks only (keys times blocks) is settled first: its
postings are fetched in one stage and combined on the driver, as a broadcast would be. The
bins it finds are then known when the records are read, as ranges the reader can skip by.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqsieve.operators.index import MotifIndex, bloom_position
from seqsieve.operators.kmers import has_lane
from seqsieve.plans.windows import WindowGraph
from seqsieve.session import ship_package

ALTERNATIVES_LIMIT = 20_000  # keys over all alternatives before a graph is kept as it is
BROADCAST_ROWS = 500_000  # lookup rows are short: this is below 50 MB
PUSHED_KEYS = 100  # equalities or ranges handed to the reader; with more, wider ranges
BLOCKS_PER_TASK_GROUP = 64
FETCHED_MASKS = 500_000  # masks fetched at once: below 20 MB
BROADCAST_EDGES = 1_000_000  # edges of graphs shipped together: below 50 MB
FETCHED_EDGES = 500_000  # edges of graphs that are evaluated on the driver


# Spark's Python API costs a round trip per column object; on this path, which every
# search takes, expressions are written as SQL text.


def _lookup_rows(index: MotifIndex, rows: list[tuple], key: str) -> DataFrame:
    """Local table (motif_id, part, needed, key_no and ``key``) of what to look up."""
    motif, part, needed, number, keys = zip(*rows)
    table = pa.table(
        {
            "motif_id": pa.array(motif, pa.string()),
            "part": pa.array(part, pa.int32()),
            "needed": pa.array(needed, pa.int32()),
            "key_no": pa.array(number, pa.int32()),
            key: pa.array(keys, pa.string() if key == "kmer" else pa.int64()),
        }
    )
    frame = index.spark.createDataFrame(table)
    return F.broadcast(frame) if len(rows) <= BROADCAST_ROWS else frame


def _kmer_hits(index: MotifIndex, rows: list[tuple]) -> DataFrame:
    if index.meta["layout"] == "bloom":
        return _bloom_hits(index, rows)
    found = _near_kmers(index, sorted({row[4] for row in rows})).join(_lookup_rows(index, rows, "kmer"), "kmer")
    return joined_segments(index, found, "motif_id", "part", "needed", "key_no", "block")


def joined_segments(index: MotifIndex, found: DataFrame, *key: str) -> DataFrame:
    """One mask per key and block, where segments may have brought one each."""
    return found.groupBy(*key).agg(F.bit_or("mask").alias("mask")) if index.segments else found


def _near_kmers(index: MotifIndex, keys: list[str]) -> DataFrame:
    """Postings of the sorted keys, with others between them when the keys are many."""
    prefix = min(index.meta["prefix"], index.k)
    by_prefix: dict[str, list] = {}
    for key in keys:
        by_prefix.setdefault(key[:prefix], []).append(key)
    near = f"prefix IN ({_literals(sorted(by_prefix))})"  # directories
    # row groups, sorted by k-mer: equalities reach the reader each for itself, however
    # many there are, while longer IN lists do so as one range only
    spans = [(key, key) for key in keys]
    if len(spans) > PUSHED_KEYS:
        spans = [(part[0], part[-1]) for part in by_prefix.values()]
    if len(spans) > PUSHED_KEYS:
        spans = [(keys[0], keys[-1])]
    return index.table("postings").where(f"{near} AND ({_any_of('kmer', spans)})")


def _literals(values: list) -> str:
    """Values as SQL: numbers, or texts by their bytes, which need no quoting."""
    return ", ".join(str(v) if isinstance(v, int) else f"CAST(X'{v.encode().hex()}' AS STRING)" for v in values)


def _any_of(column: str, spans: list[tuple]) -> str:
    """SQL for one of the equalities or ranges."""
    return " OR ".join(
        f"{column} = {_literals([low])}" if low == high else f"{column} BETWEEN {_literals([low])} AND {_literals([high])}"
        for low, high in spans
    )


def _bloom_probes(index: MotifIndex, kmers: list[str]) -> dict[str, list[int]]:
    """The bit positions of each k-mer."""
    hashes, bits = index.meta["hash_count"], index.meta["bin_bits"]
    table = index.spark.createDataFrame(pa.table({"kmer": pa.array(kmers, pa.string())}))
    # hashing a local table runs on the driver, without a job; the positions then name
    # the directories to read
    hashed = table.select("kmer", *[bloom_position(F.col("kmer"), F.lit(s), bits).alias(f"p{s}") for s in range(hashes)])
    return {row[0]: list(row[1:]) for row in hashed.collect()}


def _near_positions(index: MotifIndex, positions: list[int]) -> DataFrame:
    slots = sorted({p // index.meta["slot_bits"] for p in positions})
    few = len(positions) <= PUSHED_KEYS
    spans = [(p, p) for p in positions] if few else [(positions[0], positions[-1])]
    return index.table("bloom").where(f"slot IN ({_literals(slots)}) AND ({_any_of('position', spans)})")


def _bloom_hits(index: MotifIndex, rows: list[tuple]) -> DataFrame:
    """A bin holds a k-mer, up to false positives, when all its hash positions are set."""
    at = _bloom_probes(index, sorted({row[4] for row in rows}))
    probes = [(*row[:4], position) for row in rows for position in at[row[4]]]
    found = _near_positions(index, sorted({probe[4] for probe in probes})).join(_lookup_rows(index, probes, "position"), "position")
    found = joined_segments(index, found, "motif_id", "part", "needed", "key_no", "position", "block")
    return (
        found.groupBy("motif_id", "part", "needed", "key_no", "block")
        .agg(F.bit_and("mask").alias("mask"), F.count("*").alias("found"))
        .where((F.col("found") == index.meta["hash_count"]) & (F.col("mask") != 0))
    )


def _near_dgrams(index: MotifIndex, codes: list[int]) -> DataFrame:
    by_gap: dict[int, list] = {}
    for code in codes:
        by_gap.setdefault(code // 20**6, []).append(code)
    spans = [(code, code) for code in codes]
    if len(spans) > PUSHED_KEYS:
        spans = [(some[0], some[-1]) for some in by_gap.values()]
    near = f"gap IN ({_literals(sorted(by_gap))}) AND ({_any_of('code', spans)})"  # directories, row groups
    return index.table(index.meta["dgram_table"]).where(near)


def _hits(index: MotifIndex, rows: list[tuple]) -> DataFrame:
    """Postings of the wanted keys: motif_id, part, needed, key_no, block and mask."""
    kmers = [row[:4] + (row[4][1:],) for row in rows if row[4][0] == "k"]
    dgrams = [row[:4] + (int(row[4][1:]),) for row in rows if row[4][0] == "d"]
    found = _kmer_hits(index, kmers) if kmers else None
    if dgrams:
        near = _near_dgrams(index, sorted({row[4] for row in dgrams}))
        gapped = near.join(_lookup_rows(index, dgrams, "code"), "code")
        gapped = joined_segments(index, gapped, "motif_id", "part", "needed", "key_no", "block")
        columns = ["motif_id", "part", "needed", "key_no", "block", "mask"]
        found = gapped if found is None else found.select(columns).union(gapped.select(columns))
    return found


def _by_alternatives(index: MotifIndex, rows: list[tuple]) -> DataFrame:
    return (
        _hits(index, rows)
        # one shuffle serves both aggregations; a key occurs once per block, so there
        # is nothing to combine before it
        .repartition("motif_id", "block")
        .groupBy("motif_id", "part", "needed", "block")
        .agg(F.expr("bit_and(mask) AS mask"), F.expr("count(*) AS found"))
        .where("found = needed AND mask != 0")
        .groupBy("motif_id", "block")
        .agg(F.expr("bit_or(mask) AS mask"))
    )


def _in_groups(graphs: dict[str, WindowGraph]) -> list[dict[str, WindowGraph]]:
    """Graphs that are broadcast together: up to BROADCAST_EDGES edges, or one graph (which has a limit of its own)."""
    groups: list[dict] = []
    size = BROADCAST_EDGES + 1
    for motif, graph in graphs.items():
        size += len(graph.edges)
        if size > BROADCAST_EDGES:
            groups.append({})
            size = len(graph.edges)
        groups[-1][motif] = graph
    return groups


def _by_graph(index: MotifIndex, graphs: dict[str, WindowGraph]) -> DataFrame:
    rows = [
        (motif, 0, 0, number, key)
        for motif, graph in graphs.items()
        for key, number in graph.keys.items()
    ]
    ship_package(index.spark)
    edges = {m: (g.edges, g.n_states, len(g.keys)) for m, g in graphs.items()}
    shared = index.spark.sparkContext.broadcast(edges)

    def evaluate(pdf: pd.DataFrame) -> pd.DataFrame:
        motif = pdf["motif_id"].iloc[0]
        steps, n_states, n_keys = shared.value[motif]
        blocks, column = np.unique(pdf["block"].to_numpy(), return_inverse=True)
        held = np.zeros((n_keys, len(blocks)), dtype=np.int64)
        held[pdf["key_no"].to_numpy(), column] = pdf["mask"].to_numpy()
        mask = reached(steps, n_states, held, len(blocks))
        return pd.DataFrame({"motif_id": motif, "block": blocks, "mask": mask}).query("mask != 0")

    group = F.floor(F.col("block") / BLOCKS_PER_TASK_GROUP).alias("block_group")
    return (
        _hits(index, rows)
        .select("motif_id", "block", "key_no", "mask", group)
        .groupBy("motif_id", "block_group")
        .applyInPandas(evaluate, "motif_id string, block int, mask bigint")
    )


# ------------------------------------------------------- lookups settled on the driver
def _fetched(near: DataFrame, key: str, keys: list) -> pa.Table:
    """``key``, ``block`` and ``mask`` of exactly the given keys."""
    if len(keys) > PUSHED_KEYS:  # then ``near`` has others between them
        kind = pa.string() if key == "kmer" else pa.int64()
        near = near.join(F.broadcast(near.sparkSession.createDataFrame(pa.table({key: pa.array(keys, kind)}))), key)
    return near.select(key, "block", "mask").toArrow()


def _held(index: MotifIndex, keys: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The blocks that hold any of the keys, and per key its mask in each of them."""
    kmers = sorted(key[1:] for key in keys if key[0] == "k")
    codes = sorted(int(key[1:]) for key in keys if key[0] == "d")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # keys, blocks, masks
    sources: dict = {}
    if kmers and index.meta["layout"] == "bloom":
        at = _bloom_probes(index, kmers)
        positions = sorted({p for probe in at.values() for p in probe})
        sources["b"] = _fetched(_near_positions(index, positions), "position", positions)
    elif kmers:
        sources["k"] = _fetched(_near_kmers(index, kmers), "kmer", kmers)
    if codes:
        sources["d"] = _fetched(_near_dgrams(index, codes), "code", codes)
    for kind, table in sources.items():
        names = np.array([f"{kind}{key}" for key in table.column(0).to_pylist()], dtype=object)
        found.append((names, table.column("block").to_numpy(), table.column("mask").to_numpy()))
    blocks = np.unique(np.concatenate([f[1] for f in found])) if found else np.zeros(0, np.int32)
    held: dict[str, np.ndarray] = {}
    for names, own, masks in found:
        place = np.searchsorted(blocks, own)
        for i, name in enumerate(names):
            if name not in held:
                held[name] = np.zeros(len(blocks), np.int64)
            held[name][place[i]] |= masks[i]  # a block may have a mask per segment
    if "b" in sources:
        nothing = np.zeros(len(blocks), np.int64)
        for kmer, probe in at.items():
            held[f"k{kmer}"] = np.bitwise_and.reduce([held.get(f"b{p}", nothing) for p in probe])
    return blocks, held


def reached(steps: list[tuple], n_states: int, masks: list[np.ndarray], width: int) -> np.ndarray:
    """Masks of the bins in which some path through a graph finds all its keys."""
    reach = np.zeros((n_states, width), dtype=np.int64)
    reach[0] = -1
    for source, target, key in steps:
        reach[target] |= reach[source] if key < 0 else reach[source] & masks[key]
    return reach[n_states - 1]


def _settled(index: MotifIndex, graphs: dict[str, WindowGraph]) -> pa.Table | None:
    """The masks as a local table, or None when they may be too many to fetch."""
    keys = sorted({key for graph in graphs.values() for key in graph.keys})
    probes = index.meta["hash_count"] if index.meta["layout"] == "bloom" else 1
    if len(keys) * probes * index.n_blocks > FETCHED_MASKS or len(graphs) * index.n_blocks > FETCHED_MASKS:
        return None
    if sum(len(graph.edges) for graph in graphs.values()) > FETCHED_EDGES:
        return None
    blocks, held = _held(index, keys)
    nothing = np.zeros(len(blocks), np.int64)
    ids, places, masks = [], [], []
    for motif, graph in graphs.items():
        own = [held.get(key, nothing) for key in graph.keys]
        mask = reached(graph.edges, graph.n_states, own, len(blocks))
        at = np.flatnonzero(mask)
        ids += [motif] * len(at)
        places.append(blocks[at])
        masks.append(mask[at])
    columns = [pa.array(ids, pa.string()), *(
        pa.array(np.concatenate(parts) if parts else [], kind) for parts, kind in ((places, pa.int32()), (masks, pa.int64()))
    )]
    return pa.table(columns, names=["motif_id", "block", "mask"])


def bins_in(masks: pa.Table) -> np.ndarray:
    """Sorted numbers of the bins that any row of a local table of masks names."""
    blocks, place = np.unique(masks.column("block").to_numpy(), return_inverse=True)
    joined = np.zeros(len(blocks), np.int64)
    np.bitwise_or.at(joined, place, masks.column("mask").to_numpy())
    lanes = (joined[:, None] >> np.arange(64)) & 1
    at, lane = np.nonzero(lanes)
    return blocks[at].astype(np.int64) * 64 + lane


@dataclass
class Candidates:
    """What lookups found: masks (motif_id, block, mask), motifs without any filter and, where
    known beforehand, the numbers of all candidate bins."""

    masks: DataFrame | None
    unfiltered: list[str]
    bins: np.ndarray | None = None


def candidate_masks(index: MotifIndex, graphs: dict[str, WindowGraph]) -> Candidates:
    """The candidate bins of motifs.

    Motifs that demand no key at all are without a filter: every bin is a candidate.
    """
    unfiltered = [motif for motif, graph in graphs.items() if graph.needs_no_key()]
    graphs = {motif: graph for motif, graph in graphs.items() if motif not in set(unfiltered)}
    if not graphs:
        return Candidates(None, unfiltered)
    settled = _settled(index, graphs)
    if settled is not None:
        return Candidates(index.spark.createDataFrame(settled), unfiltered, bins_in(settled))
    listed: list[tuple] = []
    rich: dict[str, WindowGraph] = {}
    for motif, graph in graphs.items():
        alternatives = graph.required_sets(ALTERNATIVES_LIMIT)
        names = {number: key for key, number in graph.keys.items()}
        if alternatives is None:
            rich[motif] = graph
        else:
            listed.extend(
                (motif, part, len(alternative), number, names[number])
                for part, alternative in enumerate(alternatives)
                for number in sorted(alternative)
            )
    found = [_by_alternatives(index, listed)] if listed else []
    found += [_by_graph(index, group) for group in _in_groups(rich)]
    masks = None
    for frame in found:
        masks = frame if masks is None else masks.unionByName(frame)
    return Candidates(masks, unfiltered)


def bins_of(index: MotifIndex, masks: DataFrame) -> DataFrame:
    """``(motif_id, bin)`` for a table of masks."""
    return (
        index.bins.select("bin", "block", "lane")
        .join(masks, "block")
        .where(has_lane("mask", "lane"))
        .select("motif_id", "bin")
    )
