"""Reading sequence files and motif lists, writing matches and sequence parts."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seqsieve.session import ship_package

SUFFIXES = (".fa", ".fa.gz", ".fasta", ".fasta.gz", ".fna", ".fna.gz")


def expand_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Sequence files among ``paths``, with ``.lst`` manifests replaced by their lines."""
    out: list[str] = []
    for path in paths:
        if path.endswith(".lst"):
            lines = spark.read.text(path).where("trim(value) != ''").toLocalIterator()
            out.extend(row[0].strip() for row in lines)
        else:
            out.append(path)
    for path in out:
        if not path.endswith(SUFFIXES) and "*" not in path and "/part=" not in path:
            raise ValueError(f"{path}: expected one of {', '.join(SUFFIXES)} or .lst")
    if not out:
        raise ValueError("no sequence files given")
    return out


def _file_bin(path: Column) -> Column:
    """The file as the caller would name it; the files of one written part are one bin."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(F.regexp_replace(plain, "^file:/+", "/"), "(/part=[^/]+)/[^/]+$", "$1")


def read_fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """FASTA files as records: bin (the file), name, comment, seq, rec_id, split_start.

    Splittable: one row per ``>`` record straight from the text source, ``.gz`` included.
    Files start with a record. ``rec_id`` is unique and rises in file order within the
    file split that begins at byte ``split_start``.
    """
    return records_of(_chunks(spark.read.option("lineSep", "\n>").text(expand_paths(spark, paths))))


def stream_fasta(spark: SparkSession, folder: str) -> DataFrame:
    """Files as they arrive in a folder, in pieces of which ``records_of`` makes records, batch by batch."""
    return _chunks(spark.readStream.option("lineSep", "\n>").text(folder))


def _chunks(text: DataFrame) -> DataFrame:
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split_start"))


def records_of(chunks: DataFrame) -> DataFrame:
    record = F.regexp_replace("value", r"^\s*>", "")
    header = F.rtrim(F.substring_index("record", "\n", 1), F.lit("\r"))
    return (
        chunks.select(
            _file_bin(F.col("file")).alias("bin"),
            F.monotonically_increasing_id().alias("rec_id"),
            "split_start",
            record.alias("record"),
        )
        .where("trim(record) != ''")
        .select("bin", "rec_id", "split_start", "record", F.split(header, r"[ \t]", 2).alias("words"))
        .select(
            "bin",
            F.col("words")[0].alias("name"),
            F.coalesce(F.get("words", F.lit(1)), F.lit("")).alias("comment"),
            F.when(
                F.instr("record", "\n") > 0,
                # removing the line ends of everything behind the header line
                F.translate(F.expr("substring(record, instr(record, '\n') + 1)"), "\r\n", ""),
            )
            .otherwise("")
            .alias("seq"),
            "rec_id",
            "split_start",
        )
    )


# ------------------------------------------- FASTA and FASTQ by the file reader's rules
class _FilePartition(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def parse_fastx(lines: Iterator[str]) -> Iterator[tuple[str, str, str]]:
    """(name, comment, seq) of FASTA or FASTQ lines.

    A record starts at ``>`` or ``@``, the first one anywhere in the file; ``+`` starts
    the quality, which is as long as the sequence. A short quality ends the file.
    """
    header = None
    for line in lines:  # everything before the first record is skipped
        starts = [i for i in (line.find(">"), line.find("@")) if i >= 0]
        if starts:
            header = line[min(starts) + 1 :]
            break
    while header is not None:
        words = header.rstrip("\r\n").replace("\t", " ").split(" ", 1)
        seq: list[str] = []
        header = None
        for line in lines:
            if line[0] in ">@":
                header = line[1:]
                break
            if line[0] == "+":
                size, quality = sum(map(len, seq)), 0
                while quality < size and (line := next(lines, None)) is not None:
                    quality += len(line.rstrip("\r\n"))
                if quality != size:
                    return
                for line in lines:
                    if line[0] in ">@":
                        header = line[1:]
                        break
                break
            seq.append(line.rstrip("\r\n"))
        yield words[0], words[1] if len(words) > 1 else "", "".join(seq)


class FastxReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.paths = options["paths"].split("\n")

    def partitions(self) -> list[InputPartition]:
        return [_FilePartition(path) for path in self.paths]

    def read(self, partition: _FilePartition) -> Iterator[tuple]:
        opener = gzip.open if partition.path.endswith(".gz") else open
        with opener(partition.path, "rt", newline="\n") as lines:
            for number, record in enumerate(parse_fastx(iter(lines))):
                yield (partition.path, *record, number)


class FastxSource(DataSource):
    """``spark.read.format("fastx")``: one task per file, streamed."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return "bin string, name string, comment string, seq string, rec_id bigint"

    def reader(self, schema) -> FastxReader:
        return FastxReader(self.options)


def read_fastx(spark: SparkSession, paths: list[str]) -> DataFrame:
    """FASTA or FASTQ files on a file system every executor mounts.

    Quality lines may start with any character, so a FASTQ file cannot be cut at line
    ends; files are read in parallel, each by one streaming task.
    """
    ship_package(spark)
    spark.dataSource.register(FastxSource)
    return spark.read.format("fastx").option("paths", "\n".join(paths)).load()


# ---------------------------------------------------------------- motif batches
def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    """Motif batch (``id``, ``motif``): lines of id, tab, pattern; lines without both are skipped.

    An id may stand for several patterns; it then has the matches of each.
    """
    fields = F.split("value", "\t")
    rows = spark.read.text(path).select(F.get(fields, F.lit(0)).alias("id"), F.get(fields, F.lit(1)).alias("motif"))
    return rows.where("motif != ''")


# ------------------------------------------------------------------------ sinks
def match_lines(matches: DataFrame) -> DataFrame:
    """Matches as tab-separated lines: bin, >name, match, start,end."""
    place = F.concat_ws(",", "start", "end")
    if "strand" in matches.columns:
        place = F.when(F.col("strand") == "-", "REVERSE STRAND HIT").otherwise(place)
    line = F.concat_ws("\t", "bin", F.concat(F.lit(">"), "name"), "match", place)
    by = ["motif_id"] if "motif_id" in matches.columns else []
    return matches.select(*by, line.alias("value"))


def write_matches(matches: DataFrame, path: str) -> None:
    """Write match lines; batches get one directory per motif id."""
    lines = match_lines(matches)
    writer = lines.write.partitionBy("motif_id") if "motif_id" in lines.columns else lines.write
    writer.text(path)


def conjunction_lines(records: DataFrame) -> DataFrame:
    """Records of a conjunction as lines: bin, >name, N --> a --> b --> C."""
    chain = F.concat(F.lit("N --> "), F.array_join("motifs", " --> "), F.lit(" --> C"))
    return records.select(
        F.concat_ws("\t", "bin", F.concat(F.lit(">"), "name"), chain).alias("value")
    )


def fasta_text(line_length: int = 100, eol: str = "\n") -> Column:
    """A record (name, comment, seq) as FASTA text with wrapped lines."""
    title = F.concat(
        F.lit(">"), "name", F.when(F.col("comment") != "", F.concat(F.lit(" "), "comment")).otherwise("")
    )
    wrapped = (
        F.regexp_replace("seq", f"(.{{{line_length}}})(?=.)", f"$1{eol}") if line_length else F.col("seq")
    )
    return F.concat(title, F.lit(eol), wrapped)


def write_fasta_parts(
    parts: DataFrame, path: str, order: str, line_length: int = 100, eol: str = "\n"
) -> None:
    """Write records carrying ``part`` to one directory per part, in order.

    Range partitioning lets a part larger than a task become several ordered files.
    """
    if "comment" not in parts.columns:
        parts = parts.withColumn("comment", F.lit(""))
    (
        parts.repartitionByRange("part", order)
        .sortWithinPartitions("part", order)
        .select("part", fasta_text(line_length, eol).alias("value"))
        .write.option("lineSep", eol)
        .partitionBy("part")
        .text(path)
    )


def write_fasta_files(
    parts: DataFrame,
    folder: str,
    base: str,
    order: str,
    *,
    prefix: str = ".part-",
    pad: bool = True,
    extension: str = ".fasta",
    line_length: int = 100,
    eol: str = "\n",
) -> list[str]:
    """Write records carrying ``part`` to one file per part; returns the files' paths.

    A file is named ``base``, ``prefix``, the part's number (padded to equal width) and
    ``extension``. One task streams a part, in order. The files are written aside and moved
    when all are complete, so the folder never shows a part that is not whole.
    """
    spark = parts.sparkSession
    if "comment" not in parts.columns:
        parts = parts.withColumn("comment", F.lit(""))
    aside = f"{folder.rstrip('/')}/_writing-{uuid.uuid4().hex}"
    (
        parts.repartition("part")
        .sortWithinPartitions("part", order)
        .select("part", fasta_text(line_length, eol).alias("value"))
        .write.option("lineSep", eol)
        .partitionBy("part")
        .text(aside)
    )
    # names only from here on: one listing and one move per part
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    files = path_of(aside).getFileSystem(spark._jsc.hadoopConfiguration())
    found = {int(s.getPath().getParent().getName().split("=")[1]): s.getPath() for s in files.globStatus(path_of(f"{aside}/part=*/part-*")) or ()}
    width = len(str(max(found))) if pad and found else 0
    targets = []
    for number, source in sorted(found.items()):
        target = f"{folder.rstrip('/')}/{base}{prefix}{number:0{width}d}{extension}"
        if not files.rename(source, path_of(target)):
            raise OSError(f"cannot write {target}: it exists or the folder is not writable")
        targets.append(target)
    files.delete(path_of(aside), True)
    return targets
