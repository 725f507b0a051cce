"""Building, storing and describing a motif index.

On disk an index is a folder of parquet tables:

* ``bins``      one row per bin with its block, lane and counts
* ``records``   the searchable records, blocks spread over directories (``shard``), sorted
  by bin and written in small pages, so that a reader of some bins skips the others
* ``postings``  (kmer, block, mask), one directory per k-mer prefix, sorted by k-mer
* ``bloom``     (position, block, mask), by ranges of positions, instead of postings
* ``dgrams``    (code, block, mask) of gapped k-mers, when asked for
* ``meta``      one JSON line with the parameters; written last
* ``segments``  what was appended later, each a folder of the same tables

Appended records get blocks of their own unless their bin is known; a key may then have a mask
per segment for one block, and lookups join them by ``bit_or``. A segment counts from the
moment ``meta`` names it, so what a failed attempt leaves behind is never read.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqsieve.functions import alphabet
from seqsieve.operators import kmers as K
from seqsieve.operators import postings as R
from seqsieve.plans.windows import IndexShape
from seqsieve.session import scratch_folder
from seqsieve.sources.fasta import records_of, stream_fasta

SCHEMAS = {
    "bin_stats": "bin string, n_records bigint, n_indexed bigint, n_kmers bigint,"
    " residues bigint, n_not_ascii bigint, longest int",
    "bins": "bin string, n_records bigint, n_indexed bigint, n_kmers bigint,"
    " residues bigint, n_not_ascii bigint, longest int, block int, lane int, bin_id bigint",
    "postings": "kmer string, block int, mask bigint, prefix string",
    "bloom": "position bigint, block int, mask bigint, slot int",
    "dgrams": "code bigint, block int, mask bigint, gap int",
}
BINS_PER_GROUP = 4096  # bins numbered together; bounds the sort that numbers them
BROADCAST_BYTES = 64 << 20  # a side is broadcast only when known to be smaller
SHARD_RESIDUES = 256 << 20  # residues per directory of stored records ...
MAX_SHARDS = 20_000  # ... unless that makes too many directories
BLOOM_SLOTS = (8, 1024)  # directories of Bloom bits of a small or large collection
TINY_RESIDUES, SMALL_RESIDUES = 1_000_000, 50_000_000
PAGE_BYTES, PAGE_ROWS = 64 << 10, 1000  # of stored records: what a reader can skip
PUSHED_SPANS = 128  # ranges of bins handed to the reader; more are joined at their least gaps
# gapped k-mers are stored as steps from code to code, not as a dictionary of them
SORTED_CODES = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#code": "false"}
MAX_LETTERS = 64  # with more distinct letters, wildcards are not spelled out


def _read(spark: SparkSession, path: str, name: str, segments: tuple = ()) -> DataFrame:
    """A table of the index; the schema is given, so opening it runs no job."""
    return _of_segments(spark, path, name, segments, SCHEMAS[name.split("_")[0] if name.startswith("dgrams") else name])


def _of_segments(spark: SparkSession, path: str, name: str, segments: tuple, schema) -> DataFrame:
    homes = [path, *(f"{path}/segments/{segment}" for segment in segments)]
    return reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(f"{home}/{name}") for home in homes])


def _read_bins(spark: SparkSession, path: str, segments: tuple = ()) -> DataFrame:
    bins = _read(spark, path, "bins", segments)
    if not segments:
        return bins
    sums = [F.sum(c).alias(c) for c in ("n_records", "n_indexed", "n_kmers", "residues", "n_not_ascii")]
    merged = bins.groupBy("bin", "block", "lane", "bin_id").agg(*sums, F.max("longest").alias("longest"))
    return merged.select(bins.columns)


@dataclass
class MotifIndex:
    spark: SparkSession
    path: str
    meta: dict
    records: DataFrame  # bin, name, seq, block, lane (and rec_id, comment when given)
    bins: DataFrame
    _tables: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = _read(self.spark, self.path, name, self.segments)
        return self._tables[name]

    @property
    def segments(self) -> tuple:
        return tuple(self.meta.get("segments", ()))

    @property
    def k(self) -> int:
        return self.meta["k"]

    @property
    def n_bins(self) -> int:
        return self.meta["n_bins"]

    @property
    def n_blocks(self) -> int:
        return self.meta["n_blocks"]

    @property
    def pieced(self) -> bool:
        """Whether records are stored in pieces (``slices.joined``), which the counts of records then count."""
        return "piece_begin" in self.records.columns

    def need_whole_records(self) -> None:
        if self.pieced:
            raise ValueError("records in pieces can be searched by search and search_many only")

    def shape(self, with_dgrams: bool) -> IndexShape:
        letters = self.meta["letters"]
        return IndexShape(
            k=self.k,
            alphabet=None if letters is None else frozenset(letters),
            canonical=alphabet.canonical_text if self.meta["molecule"] == "na" else None,
            dgram_gaps=tuple(self.meta["dgram_gaps"])
            if with_dgrams and self.meta["dgram_gaps"]
            else None,
        )

    def of_bins(self, bins: np.ndarray | None) -> DataFrame:
        """Records of the given bins (sorted numbers; None: all) and, at worst, of some between them.

        The numbers become ranges that the reader tests against directories, row groups
        and pages, so that most of what is not asked for is not read.
        """
        if bins is None or not len(bins):
            return self.records if bins is None else self.records.where(F.lit(False))
        # indexes written by earlier versions have no bin numbers in their records
        if len(bins) == self.n_bins or "bin_id" not in self.records.columns:
            return self.records
        wanted = " OR ".join(f"bin_id BETWEEN {low} AND {high}" for low, high in spans_of(bins, PUSHED_SPANS))
        shards = self.meta["shards"] or 1
        if shards > 1:
            near = np.unique((bins >> 6) % shards)
            wanted = f"({wanted}) AND shard IN ({', '.join(map(str, near))})"
        return self.records.where(wanted)

    def in_blocks(self, masks: DataFrame, bins: np.ndarray | None = None) -> DataFrame:
        """Records joined with rows per block (given ``block``, ``mask``), lanes tested.

        The join names the directory column too, so that Spark reads only directories
        with a wanted block.
        """
        keys = ["block"]
        if (self.meta["shards"] or 1) > 1:
            masks = masks.withColumn("shard", F.col("block") % self.meta["shards"])
            keys = ["shard", "block"]
        return self.of_bins(bins).join(masks, keys).where("(mask & shiftleft(1L, lane)) != 0")


def spans_of(numbers: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Sorted different numbers as at most ``limit`` ranges, joined where the gaps are least."""
    gaps = np.diff(numbers)
    cuts = np.flatnonzero(gaps > 1)
    if len(cuts) >= limit:
        cuts = np.sort(cuts[np.argsort(-gaps[cuts], kind="stable")[: limit - 1]])
    starts, ends = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(numbers) - 1]])
    return list(zip(numbers[starts].tolist(), numbers[ends].tolist(), strict=True))


def _number_bins(stats: DataFrame, n_bins: int) -> DataFrame:
    """Give every bin a block of 64 and a lane in it, without a global sort."""
    groups = math.ceil(n_bins / BINS_PER_GROUP)
    group = F.pmod(F.xxhash64("bin"), F.lit(groups)).cast("int")
    rank = F.row_number().over(Window.partitionBy("grp").orderBy("bin")) - 1
    return (
        stats.withColumn("grp", group)
        .withColumn("rank", rank)
        .withColumn("block", F.col("grp") + groups * F.floor(F.col("rank") / 64).cast("int"))
        .withColumn("lane", (F.col("rank") % 64).cast("int"))
        .withColumn("bin_id", F.col("block").cast("bigint") * 64 + F.col("lane"))
        .drop("grp", "rank")
    )


def _bin_stats(records: DataFrame, k: int) -> DataFrame:
    size = F.length("seq")
    return records.groupBy("bin").agg(
        F.count("*").alias("n_records"),
        F.count_if(size >= k).alias("n_indexed"),
        F.sum(F.greatest(size - (k - 1), F.lit(0)).cast("bigint")).alias("n_kmers"),
        F.sum(size.cast("bigint")).alias("residues"),
        F.count_if(F.octet_length("seq") != size).alias("n_not_ascii"),
        F.max(size).alias("longest"),
    )


def bloom_bits(largest: int | Column, fpr: float) -> Column | int:
    """Bits per bin for the largest bin at a false-positive rate."""
    per_key = -math.log(fpr) / math.log(2) ** 2
    if isinstance(largest, int):
        return max(1, math.ceil(largest * per_key))
    return F.ceil(largest * F.lit(per_key)).cast("bigint")


def bloom_position(kmer: Column, seed: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(kmer, seed), F.lit(bits))


def _prefix_length(molecule: str, residues: int) -> int:
    """Letters of a k-mer that name its directory: few for small indexes, more for large."""
    step = 0 if residues < SMALL_RESIDUES else 1 if residues < 50_000_000_000 else 2
    return (1 + step) * (2 if molecule == "na" else 1)


def _letters(postings: DataFrame, molecule: str) -> list | None:
    """Letters of all k-mers, which a wildcard may stand for; None when there are many."""
    found = postings.select(F.explode(F.split("kmer", "")).alias("letter"))
    found = found.where("letter != ''").distinct().limit(MAX_LETTERS + 1)
    letters = {row[0] for row in found.collect()}
    if len(letters) > MAX_LETTERS or any(ord(c) > 127 for c in letters):
        return None
    if molecule == "na":  # canonical k-mers show one strand only, and U as T
        table = alphabet.COMPLEMENT | {a.lower(): b.lower() for a, b in alphabet.COMPLEMENT.items()}
        letters |= {table.get(c, c) for c in letters}
        letters |= {u for t, u in (("T", "U"), ("t", "u")) if t in letters}
    return sorted(letters)


def _place(records: DataFrame, bins: DataFrame, bin_bytes: int) -> DataFrame:
    slots = bins.select("bin", "block", "lane", "bin_id")
    return records.join(F.broadcast(slots) if bin_bytes <= BROADCAST_BYTES else slots, "bin")


def _shards(residues: int, n_blocks: int) -> int:
    """Directories of the records table; a block lies in one of them."""
    return max(1, min(n_blocks, MAX_SHARDS, math.ceil(residues / SHARD_RESIDUES)))


def _laid_out(placed: DataFrame, shards: int) -> DataFrame:
    """Arrange records for writing: a shard per task, a hot shard over several tasks, by bin.

    A collection of one shard is spread over all cores instead, so that reading it
    back is parallel too.
    """
    if shards == 1:
        tasks = placed.sparkSession.sparkContext.defaultParallelism
        spread = placed.repartitionByRange(tasks, "bin_id", F.xxhash64("name"))  # a large bin over several
    else:
        spread = placed.hint("rebalance", "shard")  # adaptive execution splits what is too large
    return spread.sortWithinPartitions("shard", "bin_id")


def _write_records(placed: DataFrame, shards: int, path: str) -> None:
    (
        _laid_out(placed, shards)
        .write.partitionBy("shard")
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary#seq", "false")  # a dictionary would be read whole
        .parquet(path)
    )


def build_index(
    records: DataFrame,
    *,
    k: int = 6,
    molecule: str = "aa",
    reduction: str | None = None,
    layout: str = "exact",
    fpr: float = 0.05,
    hash_count: int = 3,
    dgram_gaps: tuple[int, int] | None = None,
    store_records: bool = True,
    path: str | None = None,
) -> MotifIndex:
    """Index ``records`` (columns ``bin``, ``name``, ``seq``) and return the stored index.

    With ``store_records=False`` no copy of the records is kept and searches read
    the given DataFrame again.
    """
    spark = records.sparkSession
    if molecule not in ("aa", "na"):
        raise ValueError("molecule must be 'aa' or 'na'")
    if reduction not in (None, "murphy", "li") or (reduction and molecule == "na"):
        raise ValueError("reduction must be 'murphy' or 'li', for amino acids only")
    if not 1 <= k <= (12 if molecule == "aa" else 31):
        raise ValueError("k is at most 12 for amino acids and 31 for nucleotides")
    if layout not in ("exact", "bloom") or not 0 < fpr < 1 or hash_count < 1:
        raise ValueError("layout must be 'exact' or 'bloom', 0 < fpr < 1, hash_count >= 1")
    if dgram_gaps and (molecule == "na" or reduction):
        raise ValueError("gapped k-mers are defined on the full amino-acid alphabet only")

    path = path or scratch_folder(spark)
    _bin_stats(records, k).write.parquet(f"{path}/bin_stats")
    stats = _read(spark, path, "bin_stats")
    total = _totals(stats)
    if not total["n_bins"]:
        raise ValueError("nothing to index")
    _number_bins(stats, total["n_bins"]).write.parquet(f"{path}/bins")
    bins = _read(spark, path, "bins")

    n_blocks = math.ceil(total["n_bins"] / 64)
    if total["n_bins"] > BINS_PER_GROUP:  # several groups, each with a last block not full
        n_blocks = bins.select("block").distinct().count()
    shards = _shards(total["residues"], n_blocks)
    placed = _place(records, bins, total["bin_bytes"])
    if store_records:
        sharded = placed.withColumn("shard", F.col("block") % shards)
        _write_records(sharded, shards, f"{path}/records")
        placed = spark.read.schema(sharded.schema).parquet(f"{path}/records")

    ascii_only = total["n_not_ascii"] == 0
    meta = {
        "type": "EXACT" if layout == "exact" else "IBF",
        "k": k,
        "molecule": molecule,
        "reduction": reduction,
        "layout": layout,
        "fpr": fpr,
        "hash_count": hash_count,
        "bin_bits": bloom_bits(total["largest_bin"], fpr),
        "dgram_gaps": list(dgram_gaps) if dgram_gaps else None,
        "store_records": store_records,
        "n_blocks": n_blocks,
        "shards": shards if store_records else None,
        "prefix": _prefix_length(molecule, total["residues"]),
        **total,
    }

    # the Bloom layout keeps its bit table only; exact postings are a stage of building it
    home = path if layout == "exact" else scratch_folder(spark)
    _write_kmers(placed, meta, ascii_only, f"{home}/postings")
    stored = _read(spark, home, "postings")
    meta["slot_bits"] = math.ceil(meta["bin_bits"] / BLOOM_SLOTS[total["residues"] >= SMALL_RESIDUES])
    meta["letters"] = _letters(stored, molecule) if ascii_only else None
    if layout == "bloom":
        _write_bloom(stored, meta, f"{path}/bloom")
    index = MotifIndex(spark, path, meta, placed, bins)
    if dgram_gaps:
        add_dgrams(index, *dgram_gaps)
    _write_meta(index)
    return index


def _tasks(df: DataFrame, rows: int = 0) -> int:
    """Shuffle partitions for ``rows`` short rows: the configured number or more."""
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, min(50_000, rows // R.ROWS_PER_TASK))


def _write_kmers(placed: DataFrame, meta: dict, ascii_only: bool, path: str) -> None:
    """Postings of records in their blocks."""
    if meta["molecule"] == "aa" and meta["k"] <= R.PACKED_K:
        tasks = 1 if meta["residues"] < TINY_RESIDUES else _tasks(placed)
        _store_postings(R.ranged_kmers(placed, meta, ascii_only, tasks), meta, path)
    else:
        _write_postings(K.kmer_postings(placed, meta["k"], meta["molecule"], meta["reduction"], ascii_only), meta, path)


def _store_postings(ranged: DataFrame, meta: dict, path: str) -> None:
    prefixed = ranged.withColumn("prefix", F.substring("kmer", 1, min(meta["prefix"], meta["k"])))
    prefixed.sortWithinPartitions("prefix", "kmer", "block").write.partitionBy("prefix").parquet(path)


def _write_postings(postings: DataFrame, meta: dict, path: str) -> None:
    postings = postings.withColumn("prefix", F.substring("kmer", 1, min(meta["prefix"], meta["k"])))
    if meta["residues"] < TINY_RESIDUES:
        ranged = postings.repartition(1)
    else:
        # ranges of k-mers are even: a frequent prefix is spread over many tasks
        tasks = _tasks(postings, meta["residues"] // 30)
        ranged = postings.repartitionByRange(tasks, "prefix", "kmer")
    _store_postings(ranged, meta, path)


def _write_bloom(postings: DataFrame, meta: dict, path: str) -> None:
    seeds = F.explode(F.array(*map(F.lit, range(meta["hash_count"])))).alias("seed")
    position = bloom_position(F.col("kmer"), F.col("seed"), meta["bin_bits"])
    tasks = _tasks(postings, postings.count() * meta["hash_count"])
    (
        postings.select("kmer", "block", "mask", seeds)
        .select(position.alias("position"), "block", "mask")
        .withColumn("slot", F.floor(F.col("position") / meta["slot_bits"]).cast("int"))
        # few k-mers share a position, so all are brought together at once, in tasks of bounded size
        .repartitionByRange(tasks, "slot", "position")
        .groupBy("slot", "position", "block")
        .agg(F.bit_or("mask").alias("mask"))
        .sortWithinPartitions("slot", "position", "block")
        .write.partitionBy("slot")
        .parquet(path)
    )


def _write_meta(index: MotifIndex) -> None:
    # a new version is added, so that a failure leaves the one before readable
    index.meta["version"] = index.meta.get("version", 0) + 1
    line = index.spark.range(1).select(F.lit(json.dumps(index.meta)).alias("value"))
    line.coalesce(1).write.mode("append").text(f"{index.path}/meta")


def add_dgrams(index: MotifIndex, low: int = 3, high: int = 21) -> MotifIndex:
    """Index gapped k-mers (three residues, a gap of low..high, three residues)."""
    if index.meta["molecule"] != "aa" or index.meta["reduction"]:
        raise ValueError("gapped k-mers are defined on the full amino-acid alphabet only")
    if not 0 < low <= high:
        raise ValueError("need 0 < low <= high")
    folder = f"dgrams_{low}_{high}"
    _write_dgrams(index.records, (low, high), index.meta, f"{index.path}/{folder}")
    for segment in index.segments:  # the table above has what they hold, too
        empty = index.spark.createDataFrame([], SCHEMAS["dgrams"])
        empty.write.mode("overwrite").parquet(f"{index.path}/segments/{segment}/{folder}")
    index.meta["dgram_gaps"] = [low, high]
    index.meta["dgram_table"] = folder
    _write_meta(index)
    return index


def _write_dgrams(records: DataFrame, gaps: tuple, meta: dict, path: str) -> None:
    _store_dgrams(R.ranged_dgrams(records, meta, gaps, _tasks(records)), path)


def _store_dgrams(ranged: DataFrame, path: str) -> None:
    (
        ranged.withColumn("gap", F.expr(f"cast(code div {20**6} AS int)"))
        .sortWithinPartitions("gap", "code", "block")
        .write.mode("overwrite")
        .partitionBy("gap")
        .options(**SORTED_CODES)
        .parquet(path)
    )


def load_meta(spark: SparkSession, path: str) -> dict:
    versions = spark.read.text(f"{path}/meta").select("value", F.get_json_object("value", "$.version").cast("int").alias("v"))
    return json.loads(versions.orderBy(F.desc("v")).first()[0])


def load_index(spark: SparkSession, path: str, records: DataFrame | None = None) -> MotifIndex:
    """Open a stored index; ``records`` is needed when it keeps no copy of them."""
    meta = load_meta(spark, path)
    segments = tuple(meta.get("segments", ()))
    bins = _read_bins(spark, path, segments)
    if meta["store_records"]:
        schema = spark.read.parquet(f"{path}/records").schema
        placed = _of_segments(spark, path, "records", segments, schema)
    elif records is not None:
        placed = _place(records, bins, meta["bin_bytes"])
    else:
        raise ValueError("this index stores no records; pass the DataFrame it was built from")
    return MotifIndex(spark, path, meta, placed, bins)


# ------------------------------------------------------------------------ growing
_SUMMED = ("n_records", "n_indexed", "residues", "n_not_ascii")


def _totals(stats: DataFrame) -> dict:
    total = stats.agg(
        F.count("*").alias("n_bins"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMMED],
        F.coalesce(F.max("n_kmers"), F.lit(0)).alias("largest_bin"),
        F.coalesce(F.max("longest"), F.lit(0)).alias("longest"),
        F.coalesce(F.sum(F.octet_length("bin") + 32), F.lit(0)).alias("bin_bytes"),
    ).first().asDict()
    return {name: int(value) for name, value in total.items()}


def append(index: MotifIndex, records: DataFrame, batch: tuple[str, int] | None = None) -> MotifIndex:
    """The index with more records, of new bins or of known ones, as one more segment.

    Only the new records are read and indexed. ``batch`` names a stream and the number of
    its batch; a batch that is in already changes nothing. The Bloom layout keeps the number
    of bits it was built with, so large additions raise its rate of false positives until
    the index is compacted.
    """
    spark, meta = index.spark, dict(index.meta)
    if not meta["store_records"]:
        raise ValueError("an index that stores no records cannot be appended to")
    streams = dict(meta.get("streams", {}))
    if batch and streams.get(batch[0], -1) >= batch[1]:
        return index
    name = uuid.uuid4().hex
    path = f"{index.path}/segments/{name}"
    columns = [c for c in index.records.columns if c not in ("block", "lane", "bin_id", "shard")]
    records = records.select(columns)
    _bin_stats(records, meta["k"]).write.parquet(f"{path}/bin_stats")
    stats = _read(spark, path, "bin_stats")
    slots = index.bins.select(F.col("bin").alias("_bin"), "block", "lane", "bin_id")
    known = stats.join(slots, F.col("bin") == F.col("_bin")).drop("_bin")
    fresh = stats.join(slots, F.col("bin") == F.col("_bin"), "left_anti")
    n_fresh = fresh.count()
    first = (index.bins.agg(F.max("block")).first()[0] or 0) + 1
    numbered = _number_bins(fresh, max(n_fresh, 1)).withColumn("block", F.col("block") + first)
    numbered = numbered.withColumn("bin_id", F.col("block").cast("bigint") * 64 + F.col("lane"))
    known.select(index.bins.columns).union(numbered.select(index.bins.columns)).write.parquet(f"{path}/bins")
    bins = _read(spark, path, "bins")
    total = _totals(stats)
    if not total["n_bins"]:
        return index
    placed = _place(records, bins, total["bin_bytes"]).withColumn("shard", F.col("block") % meta["shards"])
    _write_records(placed, meta["shards"], f"{path}/records")
    placed = spark.read.schema(placed.schema).parquet(f"{path}/records")
    ascii_only = total["n_not_ascii"] == 0
    sized = meta | total | {"n_blocks": math.ceil(total["n_bins"] / 64)}
    home = path if meta["layout"] == "exact" else scratch_folder(spark)
    _write_kmers(placed, sized, ascii_only, f"{home}/postings")
    stored = _read(spark, home, "postings")
    if meta["layout"] == "bloom":
        _write_bloom(stored, meta, f"{path}/bloom")
    if meta["dgram_gaps"]:
        _write_dgrams(placed, meta["dgram_gaps"], sized, f"{path}/{meta['dgram_table']}")
    letters = _letters(stored, meta["molecule"]) if ascii_only else None
    meta["letters"] = sorted({*meta["letters"], *letters}) if letters is not None and meta["letters"] is not None else None
    meta["segments"] = [*index.segments, name]
    meta["n_bins"] += n_fresh
    meta["n_blocks"] += bins.where(F.col("block") >= first).select("block").distinct().count()
    for column in _SUMMED:
        meta[column] += total[column]
    for column in ("largest_bin", "longest"):
        meta[column] = max(meta.get(column, 0), total[column])
    meta["bin_bytes"] += total["bin_bytes"]
    if batch:
        meta["streams"] = streams | {batch[0]: batch[1]}
    grown = MotifIndex(spark, index.path, meta, index.records, index.bins)
    _write_meta(grown)
    return load_index(spark, index.path)


def append_stream(index: MotifIndex, files: str, checkpoint: str):
    """Appends FASTA files as they arrive in a folder, a segment per micro-batch.

    Returns the query, which stops when all files there are in. A batch that is run again
    after a failure is not added twice.
    """
    path, spark = index.path, index.spark

    def add(chunks: DataFrame, number: int) -> None:  # to what earlier batches have made of it
        append(load_index(spark, path), records_of(chunks), (checkpoint, number))

    stream = stream_fasta(spark, files)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(index: MotifIndex, path: str | None = None) -> MotifIndex:
    """The same index in one piece, in another folder.

    Exact postings of the segments are merged without a look at the records; the Bloom
    layout is built anew with the bits that its largest bin needs now.
    """
    spark, meta = index.spark, dict(index.meta)
    path = path or scratch_folder(spark)
    plain = [c for c in index.records.columns if c not in ("block", "lane", "bin_id", "shard")]
    if meta["layout"] == "bloom":
        gaps = tuple(meta["dgram_gaps"]) if meta["dgram_gaps"] else None
        return build_index(
            index.records.select(plain), k=meta["k"], molecule=meta["molecule"], reduction=meta["reduction"],
            layout="bloom", fpr=meta["fpr"], hash_count=meta["hash_count"], dgram_gaps=gaps, path=path,
        )
    index.bins.write.parquet(f"{path}/bins")
    placed = index.records.drop("shard")
    meta["shards"] = _shards(meta["residues"], meta["n_blocks"])
    meta["prefix"] = _prefix_length(meta["molecule"], meta["residues"])
    sharded = placed.withColumn("shard", F.col("block") % meta["shards"])
    _write_records(sharded, meta["shards"], f"{path}/records")
    stored = index.table("postings").select("kmer", "block", "mask")
    ranged = stored.repartitionByRange(_tasks(stored, stored.count()), "kmer")
    _store_postings(ranged.groupBy("kmer", "block").agg(F.bit_or("mask").alias("mask")), meta, f"{path}/postings")
    if meta["dgram_gaps"]:
        stored = index.table(meta["dgram_table"])
        ranged = stored.repartitionByRange(_tasks(stored, stored.count()), "gap", "code")
        gapped = ranged.groupBy("gap", "code", "block").agg(F.bit_or("mask").alias("mask")).select("code", "block", "mask")
        _store_dgrams(gapped, f"{path}/{meta['dgram_table']}")
    meta["segments"] = []
    whole = MotifIndex(spark, path, meta, index.records, index.bins)
    _write_meta(whole)
    return load_index(spark, path)


def inspect(index: MotifIndex) -> DataFrame:
    """One row of parameters and counts; ``index.bins`` lists the bins themselves."""
    meta = index.meta
    bloom = meta if meta["layout"] == "bloom" else {}  # exact postings have no bits
    return index.bins.agg(
        F.lit(meta["type"]).alias("index_type"),
        F.count("*").alias("bin_count"),
        F.lit(bloom.get("bin_bits")).cast("bigint").alias("bin_bits"),
        F.lit(bloom.get("hash_count")).cast("int").alias("hash_count"),
        F.lit(bloom.get("fpr")).cast("double").alias("fpr"),
        F.lit(meta["k"]).alias("k"),
        F.lit(meta["molecule"]).alias("molecule"),
        F.lit((meta["reduction"] or "none").upper()).alias("reduction"),
        F.sum("n_records").alias("n_records"),
        F.sum("n_indexed").alias("n_indexed"),
        F.sum("n_kmers").alias("n_kmers"),
    )
