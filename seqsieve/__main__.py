"""Command line: ``python -m seqsieve index|track|query|inspect|convert|rev_translate|split``."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import seqsieve as S
from seqsieve.functions import motifs as M
from seqsieve.operators import split as SP
from seqsieve.sources import fasta


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqsieve", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    index = commands.add_parser("index", help="index sequence files, one bin per file")
    index.add_argument("-k", "--ksize", type=int, default=6)
    index.add_argument("-p", "--fpr", type=float, default=0.05)
    index.add_argument("-c", "--hash_count", type=int, default=3)
    index.add_argument("-n", "--nucleic_acid", action="store_true")
    index.add_argument("-i", "--ibf", action="store_true", help="Bloom layout instead of exact postings")
    index.add_argument("-r", "--reduce", choices=["murphy", "li"])
    index.add_argument("output")
    index.add_argument("files", nargs="+")

    track = commands.add_parser("track", help="add gapped k-mers to an index")
    track.add_argument("-l", "--lower", type=int, default=3)
    track.add_argument("-u", "--upper", type=int, default=21)
    track.add_argument("index")

    query = commands.add_parser("query", help="search an index")
    query.add_argument("-d", "--draw", help="write the window graph to this Graphviz file")
    query.add_argument("-v", "--verbose", action="store_true")
    query.add_argument("-f", "--file", action="store_true", help="the pattern names a motif file")
    query.add_argument("-c", "--conj", action="store_true", help="patterns joined by ':' must all match")
    query.add_argument("-a", "--augment", action="store_true", help="skip path-rich parts")
    query.add_argument("-g", "--gapped", action="store_true", help="use gapped k-mers")
    query.add_argument("-o", "--output", help="folder for the matches instead of standard output")
    query.add_argument("index")
    query.add_argument("pattern", help="'-' reads one word from standard input")

    inspect = commands.add_parser("inspect", help="describe an index")
    inspect.add_argument("index")

    for name, text in (("convert", "PROSITE pattern to regex"), ("rev_translate", "peptide to codon regex")):
        tool = commands.add_parser(name, help=text)
        tool.add_argument("-i", "--input_pattern", required=True)

    split = commands.add_parser("split", help="cut a sequence file into parts")
    split.add_argument("--n-parts", type=int, help="parts of equal size; with --part-size: the first so many")
    split.add_argument("--part-size", type=int)
    split.add_argument("--measure", choices=["all", "seq", "count"], default="all")
    split.add_argument("--line-length", type=int, default=100)
    split.add_argument("--eol", choices=["unix", "dos", "mac"], default="unix")
    split.add_argument("--out-dir", required=True)
    split.add_argument("--part-num-prefix", default=".part-", help="between a file's name and the part's number")
    split.add_argument("--nopad", action="store_true", help="do not pad part numbers to equal width")
    split.add_argument("files", nargs="+")
    return top


def _show(lines: DataFrame) -> None:
    for row in lines.toLocalIterator():
        print(row["value"])


def _query(spark: SparkSession, args: argparse.Namespace) -> None:
    index = S.load_index(spark, args.index)
    pattern = sys.stdin.read().split()[0] if args.pattern == "-" else args.pattern
    options = {"augment": args.augment, "dgrams": args.gapped}
    begin, figures = time.perf_counter(), None
    if args.draw:
        with open(args.draw, "w") as out:
            out.write(S.pattern_dot(index, pattern, **options))
    if args.file:
        found = S.search_many(index, fasta.read_motifs(spark, pattern), **options)
        lines = fasta.match_lines(found)
    elif args.conj:
        lines = fasta.conjunction_lines(S.search_all_of(index, pattern.split(":"), **options))
    else:
        found = None
        if args.verbose and args.output:
            found, figures = S.search_observed(index, pattern, **options)
        elif args.verbose:  # lines that are printed one by one do not report what was counted
            count = S.candidate_bins(index, pattern, **options).count()
            print(f"candidate_bins: {count}", file=sys.stderr)
        lines = fasta.match_lines(S.search(index, pattern, **options) if found is None else found)
    if args.output:
        writer = lines.write.partitionBy("motif_id") if "motif_id" in lines.columns else lines.write
        writer.text(args.output)
    else:
        _show(lines)
    if args.verbose:
        for name, value in (figures() if figures else {}).items():
            print(f"{name}: {value}", file=sys.stderr)
        print(f"Query time: {time.perf_counter() - begin:.3f}", file=sys.stderr)


def _split(spark: SparkSession, args: argparse.Namespace) -> None:
    if not (args.n_parts or args.part_size):
        raise SystemExit("split needs --n-parts, --part-size or both")
    eol = {"unix": "\n", "dos": "\r\n", "mac": "\r"}[args.eol]
    for path in args.files:
        records = SP.with_order(fasta.read_fasta(spark, [path]))
        header = F.concat_ws(" ", "name", F.when(F.col("comment") != "", F.col("comment")))
        size = SP.record_size(header, F.col("seq"), args.measure, args.line_length, eol)
        if args.part_size:
            parts = SP.split_part_size(records, args.part_size, "ord", size, args.n_parts)
        else:
            parts = SP.split_n_parts(records, args.n_parts, "ord", size)
        base, dot, extension = path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".gz").rpartition(".")
        fasta.write_fasta_files(
            parts, args.out_dir, base or extension, "ord", prefix=args.part_num_prefix, pad=not args.nopad,
            extension=dot + extension if base else "", line_length=args.line_length, eol=eol,
        )


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("seqsieve").getOrCreate()
    if args.command == "index":
        records = fasta.read_fasta(spark, args.files)
        index = S.build_index(
            records,
            k=args.ksize,
            molecule="na" if args.nucleic_acid else "aa",
            reduction=args.reduce,
            layout="bloom" if args.ibf else "exact",
            fpr=args.fpr,
            hash_count=args.hash_count,
            path=args.output,
        )
        meta = index.meta
        print(f"Indexed {meta['n_indexed']} sequences across {meta['n_bins']} bins.")
        if short := meta["n_records"] - meta["n_indexed"]:
            print(f"{short} sequences are shorter than k and not indexed.", file=sys.stderr)
    elif args.command == "track":
        S.add_dgrams(S.load_index(spark, args.index), args.lower, args.upper)
    elif args.command == "query":
        _query(spark, args)
    elif args.command == "inspect":
        index = S.load_index(spark, args.index)
        for name, value in S.inspect(index).first().asDict().items():
            print(f"{name}: {value}")
        print("bins:")
        for row in index.bins.select("bin").toLocalIterator():
            print(f"\t- {row['bin']}")
    elif args.command == "split":
        _split(spark, args)
    else:
        convert = M.prosite_to_regex if args.command == "convert" else M.codon_regex
        _show(spark.range(1).select(convert(F.lit(args.input_pattern)).alias("value")))


if __name__ == "__main__":
    main()
