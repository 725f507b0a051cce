"""Searching an index: single motifs, batches and conjunctions.

Whatever the index says, the rows returned are those a regular-expression scan over
all records would return; the index only decides which records are looked at.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from seqsieve.functions import alphabet
from seqsieve.functions.literals import held_numbers
from seqsieve.functions.many import many_spans, table
from seqsieve.functions.spans import spans_from_pieces, walked_spans
from seqsieve.operators.candidates import BROADCAST_ROWS, Candidates, bins_of, candidate_masks
from seqsieve.operators.index import BROADCAST_BYTES, MotifIndex
from seqsieve.operators import slices
from seqsieve.operators.kmers import has_lane
from seqsieve.plans import pattern as P
from seqsieve.plans.windows import IndexShape, WindowGraph, to_dot, window_graph
from seqsieve.session import ship_package
from seqsieve.sources.fasta import read_fasta


@dataclass(frozen=True)
class Motif:
    """One pattern, ready to run; ``walk`` is set when Java's search cannot be used,
    to ``longest`` or ``first`` matches."""

    id: str
    text: str
    node: object
    regex: str
    literal: str
    walk: str | None = None
    #: whether Java may try the pattern on a whole text, if only to see that it matches
    testable: bool = True
    #: whether leftmost-longest matches are wanted
    longest: bool = True


def prepare(
    pattern: str,
    motif_id: str | None = None,
    reduction: str | None = None,
    longest: bool = True,
) -> Motif:
    """Parse a pattern and decide how its matches are found.

    ``longest`` asks for leftmost-longest matches (as amino-acid searches do),
    otherwise the first alternative that matches wins (as nucleotide searches do).
    """
    node = P.map_letters(P.parse(pattern), alphabet.REDUCTIONS.get(reduction))
    if P.nullable(node):
        raise ValueError(f"pattern {pattern!r} can match the empty string")
    runnable, walk, possessive = node, None, False
    if longest and not P.first_match_is_longest(node):
        simpler = P.factored(node)
        runnable = simpler if P.first_match_is_longest(simpler) else node
    if P.has_long_group_loop(runnable):
        possessive = P.unambiguous(runnable)
        walk = None if possessive else "longest" if longest else "first"
    elif longest and not P.first_match_is_longest(runnable):
        runnable = P.longest_first(node)
        walk = "longest" if runnable is None else None
    regex = P.render(node if walk else runnable, possessive=possessive)
    return Motif(
        regex if motif_id is None else motif_id,
        pattern,
        node,
        regex,
        P.required_literal(node),
        walk,
        possessive or not P.has_long_group_loop(node if walk else runnable),
        longest,
    )


def motif_graph(motif: Motif, shape: IndexShape, molecule: str, augment: bool = False) -> WindowGraph:
    """Window graph of a motif; ``augment`` turns path-rich parts into gaps."""
    node = P.trim(motif.node) if molecule == "aa" else motif.node
    if augment:
        letters = len(shape.alphabet) if shape.alphabet else len(alphabet.AMINO_ACIDS)
        node = P.gaps_for_complex_parts(node, letters, shape.k)
    return window_graph(node, shape)


def graph_of(index: MotifIndex, motif: Motif, augment: bool = False, dgrams: bool = False) -> WindowGraph:
    return motif_graph(motif, index.shape(with_dgrams=augment and dgrams), index.meta["molecule"], augment)


def pattern_dot(index: MotifIndex, pattern: str, augment: bool = False, dgrams: bool = False) -> str:
    """Graphviz text of the window graph of ``pattern``."""
    motif = prepare(pattern, reduction=index.meta["reduction"])
    return to_dot(graph_of(index, motif, augment, dgrams))


# ------------------------------------------------------------------ scanning
_KEPT = ("bin", "name", "rec_id", "strand")
TRIED_EACH = 16  # motifs that are tried on a text one after another; more are one automaton


def _motif_table(index: MotifIndex, motifs: list[Motif]) -> DataFrame:
    rows = pa.table(
        {
            "motif_id": [m.id for m in motifs],
            "regex": [m.regex for m in motifs],
            "literal": [m.literal for m in motifs],
            "testable": [m.testable for m in motifs],
        }
    )
    table = index.spark.createDataFrame(rows)
    return F.broadcast(table) if len(motifs) <= BROADCAST_ROWS else table


def _candidates(index: MotifIndex, found: Candidates, motifs: list[Motif], alone: bool, original: bool) -> DataFrame:
    """Texts of candidate bins that a motif matches, one row per text and motif.

    ``found`` may hold masks of other motifs, unless this one is ``alone``. Then, if the bins
    are known, the records of those are scanned for it. Otherwise the pattern comes from a
    joined table (of a motif that is alone: is its id). That keeps the test behind the joins:
    as a predicate on the records alone it would be pushed below them and run on every
    record of a block.
    """
    molecule, reduction = index.meta["molecule"], index.meta["reduction"]
    if alone and found.bins is not None:
        return _everywhere(_texts(index.of_bins(found.bins), molecule, reduction, original), motifs)
    masks = found.masks
    if not alone:  # masks of other groups are not shipped to the records of this one
        masks = masks.join(_motif_table(index, motifs).select("motif_id"), "motif_id", "left_semi")
    if index.n_blocks * len(motifs) > BROADCAST_ROWS >= index.n_blocks:
        # too many masks to broadcast: first drop the records no motif wants, by one
        # combined mask per block, so that only the rest is shuffled to its masks
        combined = F.broadcast(masks.groupBy("block").agg(F.bit_or("mask").alias("mask")))
        placed = index.in_blocks(combined, found.bins).drop("mask").join(masks, "block")
        placed = placed.where(has_lane("mask", "lane"))
    else:
        few = index.n_blocks * len(motifs) <= BROADCAST_ROWS
        placed = index.in_blocks(F.broadcast(masks) if few else masks, found.bins)
    texts = _texts(placed, molecule, reduction, original)
    if alone and motifs[0].id == motifs[0].regex:  # its id is the pattern
        texts = texts.where(F.contains("seq", F.lit(motifs[0].literal)))
        return texts.where("regexp_instr(seq, motif_id) > 0") if motifs[0].testable else texts
    texts = texts.join(_motif_table(index, motifs), "motif_id").where("contains(seq, literal)")
    if all(m.testable for m in motifs):
        return texts.where("regexp_instr(seq, regex) > 0")
    return texts.where("NOT testable OR regexp_instr(seq, regex) > 0")


def _everywhere(texts: DataFrame, motifs: list[Motif]) -> DataFrame:
    """The same without an index: one pass over the texts, all motifs tried on each."""
    if len(motifs) == 1:
        return texts.where(_contains_match(motifs[0])).select(
            "*", F.lit(motifs[0].id).alias("motif_id"), F.lit(motifs[0].regex).alias("regex")
        )
    if len(motifs) > TRIED_EACH:
        ship_package(texts.sparkSession)
        held = held_numbers([m.literal for m in motifs])
        rows = [(n, m.id, m.regex, m.testable) for n, m in enumerate(motifs)]
        table = texts.sparkSession.createDataFrame(rows, "number int, motif_id string, regex string, testable boolean")
        hits = texts.select("*", F.explode(held("seq")).alias("number"))
        # as in _candidates, the test reads the joined pattern and stays behind the join
        return hits.join(F.broadcast(table), "number").where("NOT testable OR regexp_instr(seq, regex) > 0").drop("number", "testable")
    tests = [
        F.when(
            _contains_match(m),
            F.struct(F.lit(m.id).alias("motif_id"), F.lit(m.regex).alias("regex")),
        )
        for m in motifs
    ]
    hit = F.explode(F.array_compact(F.array(*tests))).alias("hit")
    return texts.select("*", hit).select("*", "hit.*").drop("hit")


def _matches(hits: DataFrame, motifs: list[Motif], cut: bool = False) -> DataFrame:
    """Explode every hit text into its matches; with ``cut``, slice by slice."""
    kept = [c for c in _KEPT if c in hits.columns] + ["motif_id"]
    if cut and "piece_begin" in hits.columns:
        return slices.in_pieces(hits, kept, {m.id: (m.node, m.longest) for m in motifs}, _native_spans)
    if motifs and motifs[0].walk:
        ship_package(hits.sparkSession)
        spans = walked_spans({m.id: m.node for m in motifs}, motifs[0].walk == "longest")
        plain = ["plain_seq"] if "plain_seq" in hits.columns else []
        found = hits.select(*kept, *plain, spans("seq", "motif_id").alias("spans"))
        found = found.select(*kept, _with_original(F.col("spans"), plain).alias("spans"))
        return found.select(*kept, F.inline_outer("spans")).where("match IS NOT NULL")
    if cut:
        return slices.in_slices(hits, kept, max(slices.reach(m.node) for m in motifs), _native_spans)
    found = _native_spans(hits)
    return found.select(*kept, "match", "start", "end", *(["original"] if "original" in found.columns else []))


def _native_spans(texts: DataFrame) -> DataFrame:
    """The columns of ``texts``, without the text, for every match."""
    regex = "regex" if "regex" in texts.columns else "motif_id"
    others = [c for c in texts.columns if c != "seq"]
    found = texts.selectExpr(
        *others,
        f"regexp_extract_all(seq, {regex}, 0) AS matches",
        f"split(seq, {regex}, -1) AS pieces",
    )
    if "_begin" not in texts.columns:
        # every hit has a match; plain inline would add a filter that computes spans twice
        return found.select(*others, _with_original(spans_from_pieces("matches", "pieces"), others).alias("spans")).select(
            *[c for c in others if c != "plain_seq"], F.inline_outer("spans")
        )
    found = found.where("size(matches) > 0").select(*others, spans_from_pieces("matches", "pieces").alias("spans"))
    return found.select(*others, F.inline("spans"))


def _with_original(spans: Column, columns: list[str]) -> Column:
    """Spans with the residues they stand for, where the unreduced text is at hand."""
    if "plain_seq" not in columns:
        return spans
    return F.transform(spans, lambda s: s.withField("original", F.substring("plain_seq", s["start"] + 1, s["end"] - s["start"])))


def _texts(records: DataFrame, molecule: str, reduction: str | None, original: bool = False) -> DataFrame:
    """What patterns are matched against: both strands, or the reduced residues.

    Both strands come out of one read of the record.
    """
    if molecule == "na":
        strands = F.array(
            F.struct(F.lit("+").alias("strand"), F.col("seq").alias("text")),
            F.struct(
                F.lit("-").alias("strand"),
                alphabet.reverse_complement(F.col("seq")).alias("text"),
            ),
        )
        others = [c for c in records.columns if c != "seq"]
        return records.select(*others, F.inline_outer(strands)).withColumnRenamed("text", "seq")
    if original:
        records = records.withColumn("plain_seq", F.col("seq"))
    if reduction:
        return records.withColumn("seq", alphabet.reduce_alphabet(F.col("seq"), reduction))
    return records


LISTED_FILES = 10_000  # paths handed to one reader by name


def _look_up(index: MotifIndex, motifs: list[Motif], augment: bool, dgrams: bool) -> Candidates:
    if index.n_bins == 1:
        warnings.warn("the index has one bin only: scanning all records", stacklevel=4)
        return Candidates(None, [m.id for m in motifs])
    return candidate_masks(index, {m.id: graph_of(index, m, augment, dgrams) for m in motifs})


def _search(index: MotifIndex, motifs: list[Motif], augment: bool, dgrams: bool, original: bool = False) -> DataFrame:
    if len({m.id for m in motifs}) != len(motifs):
        raise ValueError("motif ids must be distinct")
    looked_up = _look_up(index, motifs, augment, dgrams)
    unfiltered = set(looked_up.unfiltered)  # and those that need no row per text and motif
    texts = _texts(index.records, index.meta["molecule"], index.meta["reduction"], original)
    parts = []
    # long records are cut for the motifs that allow it; a text is then not tested whole before
    long = index.meta.get("longest", 0) > slices.CUT and not index.meta["n_not_ascii"] and not original
    cuttable = {m.id for m in motifs if long and not m.walk and slices.reach(m.node)}
    if index.pieced:
        near = [m for m in motifs if not m.walk and 0 < (slices.reach(m.node) or 0) <= slices.BEHIND]
        if len(near) < len(motifs) or original or index.meta["molecule"] == "na":
            raise ValueError(f"records in pieces take peptide patterns of {slices.BEHIND} residues at most, without anchors")
        cuttable = {m.id for m in motifs}
    motifs = [replace(m, testable=False) if m.id in cuttable else m for m in motifs]
    # where all texts are read in one pass anyway, it finds the filtered motifs, too, instead of a row per text and motif
    if not original and not index.pieced:
        free = {m.id for m in motifs if not m.walk and m.id not in cuttable}
        if len(_tabled(index, [m for m in motifs if m.id in free and m.id in unfiltered])) > TRIED_EACH:
            more = _tabled(index, [m for m in motifs if m.id in free and m.id not in unfiltered])
            unfiltered |= more.keys() if len(more) > TRIED_EACH else set()
    for walk, cut in ((None, False), (None, True), ("longest", False), ("first", False)):
        chosen = [m for m in motifs if m.walk == walk and (m.id in cuttable) == cut]
        filtered = [m for m in chosen if m.id not in unfiltered]
        if filtered and looked_up.masks is not None:
            parts.append(_matches(_candidates(index, looked_up, filtered, len(motifs) == 1, original), filtered, cut))
        everywhere = [m for m in chosen if m.id in unfiltered]
        if walk is None and not cut and not original:
            everywhere = _in_one_pass(index, texts, everywhere, parts)
        if everywhere:
            parts.append(_matches(_everywhere(texts, everywhere), everywhere, cut))
    if not parts:  # no motif can match anywhere: no rows, but all columns
        parts.append(_matches(_everywhere(texts.where(F.lit(False)), motifs[:1]), motifs[:1]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _tabled(index: MotifIndex, motifs: list[Motif]) -> dict[str, object]:
    """Trees of the motifs that one pass over the texts can find, if there are many."""
    if len(motifs) <= TRIED_EACH or index.meta["n_not_ascii"]:
        return {}
    return {m.id: m.node for m in motifs if table(m.node) is not None}


def _in_one_pass(index: MotifIndex, texts: DataFrame, motifs: list[Motif], parts: list[DataFrame]) -> list[Motif]:
    """Adds the matches of the motifs that one pass over the texts can find; returns the others."""
    nodes = _tabled(index, motifs)
    if nodes:
        ship_package(texts.sparkSession)
        kept = [c for c in _KEPT if c in texts.columns]
        parts.append(many_spans(texts.select(*kept, "seq"), nodes).select(*kept, "motif_id", "match", "start", "end"))
    return [m for m in motifs if m.id not in nodes]


def search(
    index: MotifIndex,
    pattern: str,
    *,
    augment: bool = False,
    dgrams: bool = False,
    longest: bool | None = None,
    original: bool = False,
) -> DataFrame:
    """All matches of one pattern: bin, name, match, start, end (and strand for nucleotides).

    Coordinates are 0-based and half-open; on the ``-`` strand they refer to the
    reverse complement of the record. With a reduced alphabet ``match`` is in reduced
    letters; ``original`` adds the record's own letters under it. ``augment`` skips
    path-rich parts of the pattern when looking up k-mers, ``dgrams`` bridges them with
    gapped k-mers if the index has them.
    """
    longest = index.meta["molecule"] == "aa" if longest is None else longest
    motif = prepare(pattern, reduction=index.meta["reduction"], longest=longest)
    if original and index.meta["molecule"] == "na":
        raise ValueError("matches of nucleotides are the record's own letters")
    return _search(index, [motif], augment, dgrams, original).drop("motif_id")


def search_observed(
    index: MotifIndex,
    pattern: str,
    *,
    augment: bool = False,
    dgrams: bool = False,
    longest: bool | None = None,
) -> tuple[DataFrame, Callable[[], dict]]:
    """``search`` and, to be called when its rows have been written or collected, what that counted.

    candidate_bins, records_read, records_matched and matches are counted inside the search's
    own job; nothing is read again for them.
    """
    index.need_whole_records()
    longest = index.meta["molecule"] == "aa" if longest is None else longest
    motif = prepare(pattern, reduction=index.meta["reduction"], longest=longest)
    looked_up = _look_up(index, [motif], augment, dgrams)
    everywhere = looked_up.bins is None and looked_up.masks is None
    if everywhere:
        records, n_bins = index.records, index.n_bins
    elif looked_up.bins is not None:
        records, n_bins = index.of_bins(looked_up.bins), len(looked_up.bins)
    else:  # too many masks to have been fetched
        records = index.in_blocks(looked_up.masks.select("block", "mask"))
        n_bins = looked_up.masks.agg(F.coalesce(F.sum(F.bit_count("mask")), F.lit(0))).first()[0]
    if motif.id in looked_up.unfiltered:
        records, n_bins = index.records, index.n_bins
    if not n_bins:
        empty = _matches(_everywhere(_texts(index.records.where(F.lit(False)), index.meta["molecule"], index.meta["reduction"]), [motif]), [motif])
        return empty.drop("motif_id"), lambda: {"candidate_bins": 0, "records_read": 0, "records_matched": 0, "matches": 0}
    counted = {name: Observation() for name in ("records_read", "records_matched", "matches")}
    one = F.count(F.lit(1)).alias("n")
    texts = _texts(records.observe(counted["records_read"], one), index.meta["molecule"], index.meta["reduction"])
    hits = _everywhere(texts, [motif]).observe(counted["records_matched"], one)
    found = _matches(hits, [motif]).drop("motif_id").observe(counted["matches"], one)
    return found, lambda: {"candidate_bins": int(n_bins), **{name: seen.get["n"] for name, seen in counted.items()}}


def search_many(
    index: MotifIndex,
    motifs: dict[str, str] | DataFrame,
    *,
    augment: bool = False,
    dgrams: bool = False,
    longest: bool | None = None,
) -> DataFrame:
    """All matches of a batch ``{motif id: pattern}`` with ``motif_id``.

    A batch may also be a table (``id``, ``motif``) of any size, see ``operators.batches``;
    in it an id may stand for several patterns. The postings are read once for the whole
    batch and so are the candidate records.
    """
    longest = index.meta["molecule"] == "aa" if longest is None else longest
    if isinstance(motifs, DataFrame):
        from seqsieve.operators import batches  # made of the parts of this module

        return batches.search_table(index, motifs, augment, dgrams, longest)
    prepared = [prepare(p, i, index.meta["reduction"], longest) for i, p in motifs.items()]
    if not prepared:
        raise ValueError("no motifs given")
    return _search(index, prepared, augment, dgrams)


def candidate_bins_many(
    index: MotifIndex, motifs: dict[str, str] | DataFrame, *, augment: bool = False, dgrams: bool = False
) -> DataFrame:
    """The bins (``motif_id``, ``bin``) a search for each motif of a batch would look at."""
    if isinstance(motifs, DataFrame):
        from seqsieve.operators import batches

        return batches.candidates_table(index, motifs, augment, dgrams)
    prepared = [prepare(p, i, index.meta["reduction"]) for i, p in motifs.items()]
    if index.n_bins == 1:
        found = Candidates(None, list(motifs))
    else:
        found = candidate_masks(index, {m.id: graph_of(index, m, augment, dgrams) for m in prepared})
    masks, unfiltered = found.masks, found.unfiltered
    every = F.explode(F.array(*map(F.lit, unfiltered)).cast("array<string>"))
    out = index.bins.select(every.alias("motif_id"), "bin")
    return out if masks is None else out.union(bins_of(index, masks))


def candidate_bins(
    index: MotifIndex, pattern: str, *, augment: bool = False, dgrams: bool = False
) -> DataFrame:
    """The bins (``bin``) a search for ``pattern`` would look at."""
    return candidate_bins_many(index, {"": pattern}, augment=augment, dgrams=dgrams).select("bin")


def search_all_of(
    index: MotifIndex, patterns: list[str], *, augment: bool = False, dgrams: bool = False
) -> DataFrame:
    """Records that every pattern matches somewhere, in any order: bin, name, motifs."""
    index.need_whole_records()
    reduction = index.meta["reduction"]
    if not patterns:
        raise ValueError("no patterns given")
    motifs = [_test_for(p, str(i), reduction) for i, p in enumerate(patterns)]
    records = index.records
    if reduction:
        records = records.withColumn("seq", alphabet.reduce_alphabet(F.col("seq"), reduction))
    found = _look_up(index, motifs, augment, dgrams)
    masks, unfiltered = found.masks, found.unfiltered
    filtered = [m for m in motifs if m.id not in set(unfiltered)]
    if filtered and masks is None:
        records = records.where(F.lit(False))
    elif filtered:
        pattern = F.struct("motif_id", "literal", "regex")
        common = (
            masks.join(_motif_table(index, filtered), "motif_id")
            .groupBy("block")
            .agg(
                F.bit_and("mask").alias("mask"),
                F.sort_array(F.collect_list(pattern)).alias("patterns"),  # one per motif
            )
            .where((F.size("patterns") == len(filtered)) & (F.col("mask") != 0))
        )
        size = index.n_blocks * sum(len(m.regex) + 64 for m in filtered)
        common = F.broadcast(common) if size <= BROADCAST_BYTES else common
        # as in _candidates, tests that read the joined patterns stay behind the join
        records = index.in_blocks(common, found.bins)
        if reduction:
            records = records.withColumn("seq", alphabet.reduce_alphabet(F.col("seq"), reduction))
        for i, motif in enumerate(sorted(filtered, key=lambda m: m.id)):
            own = F.col("patterns")[i]
            records = records.where(F.contains("seq", own["literal"]))
            if motif.testable:
                records = records.where(F.regexp_instr("seq", own["regex"]) > 0)
    for motif in motifs:
        if motif.id in set(unfiltered):
            records = records.where(_contains_match(motif))
    walked = [m for m in motifs if m.walk]
    if walked:
        ship_package(index.spark)
        spans = walked_spans({m.id: m.node for m in walked}, longest=True)
        for motif in walked:
            records = records.where(F.size(spans("seq", F.lit(motif.id))) > 0)
    kept = [c for c in _KEPT if c in records.columns]
    return records.select(*kept, F.array(*[F.lit(m.text) for m in motifs]).alias("motifs"))


def _test_for(pattern: str, motif_id: str, reduction: str | None) -> Motif:
    """A motif to be tested for only; one that can be empty is found in every record."""
    node = P.map_letters(P.parse(pattern), alphabet.REDUCTIONS.get(reduction))
    if P.nullable(node):
        return Motif(motif_id, pattern, node, regex="", literal="")
    motif = prepare(pattern, motif_id, reduction, longest=False)
    return replace(motif, walk="longest") if motif.walk else motif


def _contains_match(motif: Motif) -> Column:
    holds = F.col("seq").contains(motif.literal)
    return holds & F.col("seq").rlike(motif.regex) if motif.testable else holds


def scan(
    records: DataFrame,
    pattern: str,
    *,
    molecule: str = "aa",
    reduction: str | None = None,
    longest: bool | None = None,
) -> DataFrame:
    """All matches without an index, over any DataFrame with bin, name and seq."""
    longest = molecule == "aa" if longest is None else longest
    motif = prepare(pattern, reduction=reduction, longest=longest)
    texts = _texts(records, molecule, reduction)
    return _matches(_everywhere(texts, [motif]), [motif]).drop("motif_id")


def search_files(
    index: MotifIndex,
    pattern: str,
    *,
    augment: bool = False,
    dgrams: bool = False,
    longest: bool | None = None,
) -> DataFrame:
    """``search`` for an index of FASTA files that keeps no copy of the records.

    The candidate bins are paths. They are looked up first, so that only those files are
    opened, by as many readers as it takes.
    """
    molecule, reduction = index.meta["molecule"], index.meta["reduction"]
    found = candidate_bins(index, pattern, augment=augment, dgrams=dgrams).toLocalIterator()
    paths = [row["bin"] for row in found]
    groups = [paths[i : i + LISTED_FILES] for i in range(0, len(paths), LISTED_FILES)]
    readers = [read_fasta(index.spark, group) for group in groups] or [index.records.where(F.lit(False))]
    records = reduce(DataFrame.unionByName, readers)
    return scan(records, pattern, molecule=molecule, reduction=reduction, longest=longest)
