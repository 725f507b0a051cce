"""

Sequences are derived from ``documents`` (one record per document, its letters that
are amino-acid codes); bins are sources, or single documents where pruning matters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import seqsieve as S
from seqsieve.functions import alphabet as A
from seqsieve.functions import motifs as M
from seqsieve.operators import kmers as K
from seqsieve.operators import split as SP
from seqsieve.operators.index import MotifIndex, bloom_bits
from seqsieve.operators.slices import joined
from seqsieve.session import scratch_folder
from seqsieve.sources import fasta
from seqsieve.sources.corpus import document_records, letters

try:  # the corpus operators may be absent, or a library that only they need
    import corpus_pipeline
    from seqsieve.llm import registry as corpus
except ImportError:
    corpus = None

_indexes: dict = {}


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _records(spark: SparkSession, sf: str, molecule: str = "aa", fine: bool = False) -> DataFrame:
    bin = F.format_string("doc%08d", "doc_id") if fine else None
    return document_records(_documents(spark, sf), molecule, bin)


def _letters(spark: SparkSession, sf: str) -> DataFrame:
    """Records of all letters of a document, not only those of the twenty amino acids."""
    name = F.col("doc_id").cast("string").alias("name")
    return _documents(spark, sf).select(F.col("source").alias("bin"), name, letters(F.col("text")).alias("seq"))


def _index(spark: SparkSession, sf: str, fine: bool = False, **options) -> MotifIndex:
    """An index over the documents, built once per session and set of options."""
    key = (spark.sparkContext.applicationId, sf, fine, *sorted(options.items()))
    if key not in _indexes:
        records = _records(spark, sf, options.get("molecule", "aa"), fine)
        _indexes[key] = S.build_index(records, **options)
    return _indexes[key]


def _peptides(spark: SparkSession, sf: str, fine: bool = False) -> MotifIndex:
    return _index(spark, sf, fine, k=4)


def _words(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct words of all documents that spell a peptide."""
    upper = F.upper(F.regexp_replace("text", r"[^A-Za-z\x20\x09-\x0D]", ""))
    return (
        _documents(spark, sf)
        .select(F.explode(F.split(upper, r"[\x20\x09-\x0D]+")).alias("word"))
        .where(F.col("word").rlike(f"^[{A.AMINO_ACIDS}]+$"))
        .distinct()
    )


# pattern -> the same in the SQL engine's dialect, where it differs
PATTERNS = {
    "rx_literal": "THER",
    "rx_alt": "TH(A|E)R",
    "rx_class": "LY[AEG]N",
    "rx_range": "LY[A-G]N",
    "rx_negclass": "TH[^EA]R",
    "rx_dot": "AN.DT",
    "rx_optional": "RE(S|T)?L{2}",
    "rx_star": "TRA*TE",
    "rx_plus": "NE+DLY",
    "rx_exact": "(RE){2}S",
    "rx_minmax": "N.{1,3}DHA",
    "rx_group": "AN(D|T)TH(ER|AN)",
    "rx_loop_group": "T(HE)+RT",
    "rx_wide_gap": "L.{2}[LIVM]D",
    "search_longest_gap": "C.{0,80}H",
    "rx_deep_class": "[LIVM]{3}D",
}
# one branch asks for no k-mer, the other for many that no document holds
RICH_OR_SHORT = (
    "HEN|KWV[ACDEFGHIKLMNPQRSTVWY]{2}VWK[ACDEFGHIKLMNPQRSTVWY]{1,2}WVK(N|S)"
)
# an id that is another motif's pattern, next to a motif that needs another way of matching
MIXED = {"THER": "THER", "NDTH": "(A|NA)+NDTH", "m3": "AN(D|T)TH"}
RICH = "T[ADEFGHIKLMNPQRSTVWY]{2}RE.{1,2}HE(N|S)"
BATCH = {
    "m1": "TH(A|E)R",
    "m2": "LY[AEG]N",
    "m3": "AN(D|T)TH",
    "m4": "N.{1,3}DHA",
    "m5": "W.{2}[LIVM]D",
    "m6": "HE",
}
ALL_OF = ["THER", "LY[AEG]N", "RE(S|T)?L"]


def entry(spark: SparkSession) -> DataFrame:
    """Build an index of the small documents table and search it for one motif."""
    return S.search(_peptides(spark, "/root/testdata/sf0.001"), "TH(A|E)R")


def _pattern_query(pattern: str):
    return lambda spark, sf: S.search(_peptides(spark, sf), pattern)


def _postings(index: MotifIndex) -> DataFrame:
    return (
        index.table("postings")
        .join(index.bins.select("block", "lane", "bin"), "block")
        .where(K.has_lane("mask", "lane"))
        .select("kmer", "bin")
    )


def _nucleotide(spark: SparkSession, sf: str) -> DataFrame:
    return S.search(_index(spark, sf, molecule="na", k=6), "AC(GA)+T")


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf).join(
        _records(spark, sf).select(F.col("name").cast("bigint").alias("doc_id"), "name", "seq"), "doc_id"
    ).select("doc_id", "name", "seq")


def _batch_of_words(spark: SparkSession, sf: str) -> DataFrame:
    """Matches of a batch made of all words of the documents that have a k-mer."""
    index = _peptides(spark, sf, fine=True)
    words = _words(spark, sf).where(F.length("word") >= index.k).select(F.col("word").alias("id"), F.col("word").alias("motif"))
    return S.search_many(index, words).groupBy("motif_id").agg(F.count("*").alias("n"))


def _profile_words(spark: SparkSession, sf: str) -> DataFrame:
    """Windows like the words of a length: a profile per length, its weights the numbers of words."""
    words = _words(spark, sf).where("length(word) >= 4").withColumn("profile_id", F.length("word").cast("string"))
    letters = words.select("profile_id", F.posexplode(F.split("word", "(?<=.)(?=.)")).alias("position", "residue"))
    cells = letters.groupBy("profile_id", "position", "residue").agg(F.count("*").alias("weight"))
    best = cells.groupBy("profile_id", "position").agg(F.max("weight").alias("best"))
    least = best.groupBy("profile_id").agg((F.sum("best") * F.lit(0.75)).alias("threshold"))
    found = S.search_profiles(_peptides(spark, sf, fine=True), cells, least)
    return found.withColumn("score", F.col("score").cast("bigint"))


def _joined_sources(spark: SparkSession, sf: str) -> DataFrame:
    """All documents of a language as one record: long texts, which are stored and searched in pieces."""
    docs = _records(spark, sf).join(_documents(spark, sf).select(F.col("doc_id").cast("string").alias("name"), "lang"), "name")
    lang = F.coalesce("lang", F.lit(""))
    parts = docs.select(lang.alias("bin"), lang.alias("name"), F.col("name").cast("bigint").alias("n"), "seq")
    key = (spark.sparkContext.applicationId, sf, "joined")
    if key not in _indexes:
        _indexes[key] = S.build_index(joined(parts, "n"), k=4)
    return S.search(_indexes[key], "(T|TH|THE)R?N").groupBy("bin", "match").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


def _search_stats(spark: SparkSession, sf: str) -> DataFrame:
    """What one search counted inside its own job."""
    found, figures = S.search_observed(_peptides(spark, sf, fine=True), "LY[AEG]N")
    found.write.format("noop").mode("overwrite").save()
    counted = figures()
    return spark.createDataFrame([(counted["candidate_bins"], counted["records_matched"], counted["matches"])],
                                 "candidate_bins bigint, records_matched bigint, matches bigint")


def _parts_named(spark: SparkSession, sf: str) -> DataFrame:
    """Names and contents of the files a splitter writes."""
    parts = SP.split_n_parts(_sized(spark, sf), 12, "doc_id", SP.record_size(F.col("name"), F.col("seq")))
    folder = scratch_folder(spark)
    fasta.write_fasta_files(parts, folder, "docs", "doc_id")
    files = spark.read.text(folder, wholetext=True)
    name = F.regexp_extract("_metadata.file_path", "[^/]+$", 0)
    return files.select(name.alias("file"), F.length("value").cast("bigint").alias("size"), F.md5(F.col("value").cast("binary")).alias("content"))


def _index_appended(spark: SparkSession, sf: str) -> DataFrame:
    """Matches in an index that was built of some documents and grew by the others."""
    docs = _documents(spark, sf)
    index = S.build_index(document_records(docs.where("doc_id % 3 = 0")), k=4)
    for rest in (1, 2):
        index = S.append(index, document_records(docs.where(F.col("doc_id") % 3 == rest)))
    return S.search(index, "LY[AEG]N")


def _motif_file(spark: SparkSession, sf: str) -> DataFrame:
    """A batch that is read from a file: a motif for every letter that a word begins with."""
    lines = _words(spark, sf).select(F.substring("word", 1, 1).alias("letter")).distinct()
    folder = scratch_folder(spark)
    lines.select(F.concat("letter", F.lit("\t"), "letter", F.lit("[AE]RT"))).write.text(folder)
    found = S.search_many(_peptides(spark, sf), fasta.read_motifs(spark, folder))
    return found.groupBy("motif_id", "bin").agg(F.count("*").alias("n"))


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Records of files that a manifest lists."""
    records = _sized(spark, sf).withColumn("comment", F.concat(F.lit("document "), "name"))
    parts = SP.split_n_parts(records, 3, "doc_id", SP.record_size(F.col("name"), F.col("seq")))
    folder = scratch_folder(spark)
    paths = fasta.write_fasta_files(parts, folder, "docs", "doc_id")
    spark.createDataFrame([(p,) for p in paths], "path string").coalesce(1).write.text(f"{folder}-all.lst")
    return fasta.read_fasta(spark, [f"{folder}-all.lst"]).select("name", "comment", "seq")


def _one_bin(spark: SparkSession, sf: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, "one bin")
    if key not in _indexes:
        _indexes[key] = S.build_index(_records(spark, sf).withColumn("bin", F.lit("all")), k=4)
    return S.search(_indexes[key], "LY[AEG]N")


def _short_motifs() -> dict[str, str]:
    """1,000 motifs that demand no k-mer of four: each is looked for in every record."""
    ends = ["", "[AE]", "[^A]", ".", "R?", "(S|T)?", "N{2}", "[LIVM]{1,2}", "$", "D+"]
    stems = [a + b for a in "ACDEFGHIKL" for b in "AEINORSTLH"]
    return {f"{stem}{end}": f"{stem}{end}" for stem in stems for end in ends}


def _unfiltered_batch(spark: SparkSession, sf: str) -> DataFrame:
    found = S.search_many(_peptides(spark, sf, fine=True), _short_motifs())
    return found.groupBy("motif_id").agg(F.count("*").alias("n"), F.countDistinct("name").alias("records"))


def _dgrams(spark: SparkSession, sf: str) -> MotifIndex:
    return _index(spark, sf, k=4, dgram_gaps=(1, 3))


def _dgram_postings(spark: SparkSession, sf: str) -> DataFrame:
    index = _dgrams(spark, sf)
    return (
        index.table(index.meta["dgram_table"])
        .groupBy("code")
        .agg(F.sum(F.bit_count("mask")).cast("bigint").alias("n_bins"))
    )


def _bloom(spark: SparkSession, sf: str) -> MotifIndex:
    return _index(spark, sf, fine=True, k=4, layout="bloom")


def _bloom_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Bins that the Bloom layout proposes and that do hold the k-mers: all of these."""
    exact = S.candidate_bins(_peptides(spark, sf, fine=True), "LY[AEG]N")
    return S.candidate_bins(_bloom(spark, sf), "LY[AEG]N").join(exact, "bin")


def _bloom_false_share(spark: SparkSession, sf: str) -> DataFrame:
    """Whether at most the agreed share of the bins without a k-mer is proposed."""
    index = _bloom(spark, sf)
    exact = S.candidate_bins(_peptides(spark, sf, fine=True), "LYEN").withColumn("held", F.lit(1))
    found = S.candidate_bins(index, "LYEN").withColumn("found", F.lit(1))
    bins = index.bins.select("bin").join(exact, "bin", "left").join(found, "bin", "left").where("held IS NULL")
    return bins.agg((F.count("found") <= index.meta["fpr"] * F.count("*")).alias("within_rate"))


def _prosite(spark: SparkSession, sf: str) -> DataFrame:
    letter = [F.substr(F.col("word"), F.lit(i) % F.length("word") + 1, F.lit(1)) for i in range(5)]
    spelled = F.array_join(F.split("word", ""), "-")
    pattern = F.concat(
        F.lit("<"), letter[0], F.lit("-x-["), letter[1], letter[2], F.lit("]-{"), letter[3],
        F.lit("}-"), letter[4], F.lit("(2,3)-x(2)-{"), letter[0], F.lit("}(2)-"), spelled,
        F.lit("-["), letter[0], F.lit(">]."),
    )
    return _words(spark, sf).select("word", pattern.alias("prosite")).select(
        "word", "prosite", M.prosite_to_regex(F.col("prosite")).alias("regex")
    )


def _fasta_round_trip(reader):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        records = _sized(spark, sf).withColumn("comment", F.concat(F.lit("document "), "name"))
        parts = SP.split_n_parts(records, 4, "doc_id", SP.record_size(F.col("name"), F.col("seq")))
        folder = scratch_folder(spark)
        fasta.write_fasta_parts(parts, folder, "doc_id")
        return reader(spark, folder).select("name", "comment", "seq")

    return run


def _index_of_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Matches in an index whose bins are the parts that the splitter wrote."""
    parts = SP.split_n_parts(_sized(spark, sf), 4, "doc_id", SP.record_size(F.col("name"), F.col("seq")))
    folder = scratch_folder(spark)
    fasta.write_fasta_parts(parts, folder, "doc_id")
    records = fasta.read_fasta(spark, [f"{folder}/part=*"])
    named = records.withColumn("bin", F.regexp_extract("bin", "part=[0-9]+$", 0))
    return S.search(S.build_index(named, k=4), "LY[AEG]N").drop("rec_id")


def _read_parts(spark: SparkSession, folder: str) -> DataFrame:
    # parts are written as .txt files, so they are named by a glob here
    return fasta.read_fasta(spark, [f"{folder}/part=*/*.txt"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "records_aa": lambda s, d: _records(s, d),
        "records_na": lambda s, d: _records(s, d, "na"),
        "reduce_murphy": lambda s, d: _letters(s, d).select(
            "name", A.reduce_alphabet(F.col("seq"), "murphy").alias("seq")
        ),
        "reduce_li": lambda s, d: _letters(s, d).select(
            "name", A.reduce_alphabet(F.col("seq"), "li").alias("seq")
        ),
        "reverse_complement": lambda s, d: _letters(s, d).select(
            "name", A.reverse_complement(F.col("seq")).alias("seq")
        ),
        "kmers_aa": lambda s, d: K.kmers(_records(s, d), 4).groupBy("bin", "kmer").agg(
            F.count("*").alias("n")
        ),
        "kmers_na_canonical": lambda s, d: K.kmers(_records(s, d, "na"), 5, "na")
        .groupBy("bin", "kmer")
        .agg(F.count("*").alias("n")),
        "kmers_reduced": lambda s, d: K.kmers(_records(s, d), 5, "aa", "murphy")
        .groupBy("kmer")
        .agg(F.count("*").alias("n")),
        "kmer_codes_aa": lambda s, d: K.kmers(_letters(s, d), 4)
        .select("kmer")
        .distinct()
        .select("kmer", A.peptide_code(F.col("kmer")).alias("code")),
        "kmer_codes_na": lambda s, d: K.kmers(_records(s, d, "na"), 5, "na")
        .select("kmer")
        .distinct()
        .select("kmer", A.nucleotide_code(F.col("kmer")).alias("code")),
        "kmers_decoded": lambda s, d: K.kmers(_letters(s, d), 4)
        .select("kmer")
        .distinct()
        .select("kmer", A.peptide_from_code(A.peptide_code(F.col("kmer")), 4).alias("decoded")),
        "kmer_postings": lambda s, d: _postings(_peptides(s, d)),
        "short_records": lambda s, d: _peptides(s, d, fine=True).bins.select("bin", "n_records", "n_indexed"),
        "dgram_codes": lambda s, d: K.dgram_windows(_records(s, d), 1, 2, [])
        .select("gap", A.dgram_code(F.col("gap"), F.col("residues")).alias("code"))
        .groupBy("gap")
        .agg(F.count("*").alias("n"), F.countDistinct("code").alias("n_codes"), F.sum("code").alias("total")),
        "dgram_postings": _dgram_postings,
        "index_stats": lambda s, d: S.inspect(_peptides(s, d)).na.fill(0),  # no Bloom figures
        "bloom_bits": lambda s, d: _peptides(s, d).bins.select(
            "bin", "n_kmers", bloom_bits(F.col("n_kmers"), 0.05).alias("bits")
        ),
        "search_bloom": lambda s, d: S.search(
            _index(s, d, fine=True, k=4, layout="bloom"), "LY[AEG]N"
        ),
        "search_bloom_na": lambda s, d: S.search(_index(s, d, molecule="na", k=6, layout="bloom"), "AC(GA)+T"),
        "search_bloom_murphy": lambda s, d: S.search(
            _index(s, d, k=5, reduction="murphy", layout="bloom"), "AN[DE]THE"
        ),
        "bloom_candidates": _bloom_candidates,
        "bloom_false_share": _bloom_false_share,
        "search_rich_or_short": lambda s, d: S.search(_peptides(s, d, fine=True), RICH_OR_SHORT),
        "search_many_mixed": lambda s, d: S.search_many(_peptides(s, d, fine=True), MIXED),
        "search_longest_wide": lambda s, d: S.search(_peptides(s, d), "M.{1,2500}K"),
        "rx_anchor_start": lambda s, d: S.search(_peptides(s, d), "^[A-M]+"),
        "rx_anchor_end": lambda s, d: S.search(_peptides(s, d), "E(R|S|T)$"),
        "search_fine_bins": lambda s, d: S.search(_peptides(s, d, fine=True), "N.{1,3}DHA"),
        "search_unindexed": lambda s, d: S.scan(_records(s, d), "AN(D|T)TH"),
        "candidate_bins_literal": lambda s, d: S.candidate_bins(_peptides(s, d, fine=True), "ANDTHER"),
        "candidate_bins_alt": lambda s, d: S.candidate_bins(
            _peptides(s, d, fine=True), "TRE(TH|AN)E[RS]"
        ),
        "candidate_bins_loop": lambda s, d: S.candidate_bins(_peptides(s, d, fine=True), "THE(RE)?NT"),
        "candidate_counts": lambda s, d: S.candidate_bins_many(
            _peptides(s, d, fine=True), {"a": "ANDTHER", "b": "THENT", "c": "THE"}
        )
        .groupBy("motif_id")
        .agg(F.count("*").alias("bins")),
        "candidate_bins_short": lambda s, d: S.candidate_bins(_peptides(s, d, fine=True), "TH(E|ERE)"),
        "candidate_bins_reduced": lambda s, d: S.candidate_bins(
            _index(s, d, fine=True, k=5, reduction="murphy"), "THEANDER"
        ),
        "candidate_bins_dgram": lambda s, d: S.candidate_bins(
            _index(s, d, fine=True, k=3, dgram_gaps=(1, 3)), "AND.{2}THE", augment=True, dgrams=True
        ),
        "search_augmented": lambda s, d: S.search(_peptides(s, d), RICH, augment=True),
        "search_augmented_dgram": lambda s, d: S.search(_dgrams(s, d), RICH, augment=True, dgrams=True),
        "search_na": _nucleotide,
        "search_na_reverse": lambda s, d: _nucleotide(s, d).where("strand = '-'"),
        "search_na_first": lambda s, d: S.search(_index(s, d, molecule="na", k=6), "(AC|ACG)TA(C|CA)"),
        "search_murphy": lambda s, d: S.search(_index(s, d, k=5, reduction="murphy"), "AN[DE]THE"),
        "search_li": lambda s, d: S.search(_index(s, d, k=5, reduction="li"), "ANDTH[DE]R"),
        "search_murphy_original": lambda s, d: S.search(
            _index(s, d, k=5, reduction="murphy"), "AN[DE]THE", original=True
        ),
        "search_joined_sources": _joined_sources,
        "search_longest_bounded": lambda s, d: S.search(_peptides(s, d), "(T|TH|THE)R?N"),
        "search_longest_choice": lambda s, d: S.search(_peptides(s, d), "T|TH|THE|THER"),
        "search_longest_unbounded": lambda s, d: S.search(_peptides(s, d), "(A|AN)+D"),
        "search_longest_walked": lambda s, d: S.search(_peptides(s, d), "(A|NA)+ND"),
        "search_many": lambda s, d: S.search_many(_peptides(s, d), BATCH),
        "search_batch_of_words": _batch_of_words,
        "search_profiles": _profile_words,
        "search_unfiltered_batch": _unfiltered_batch,
        "match_counts": lambda s, d: S.search_many(_peptides(s, d), BATCH)
        .groupBy("motif_id", "bin")
        .agg(F.count("*").alias("matches"), F.countDistinct("name").alias("records")),
        "search_all_of": lambda s, d: S.search_all_of(_peptides(s, d, fine=True), ALL_OF).select(
            "bin", "name", F.array_join("motifs", ":").alias("motifs")
        ),
        "match_lines": lambda s, d: fasta.match_lines(S.search(_peptides(s, d), "LY[AEG]N")),
        "match_lines_na": lambda s, d: fasta.match_lines(_nucleotide(s, d)),
        "conjunction_lines": lambda s, d: fasta.conjunction_lines(
            S.search_all_of(_peptides(s, d), ALL_OF)
        ),
        "prosite_to_regex": _prosite,
        "class_alternatives": lambda s, d: _words(s, d).select(
            "word",
            M.class_to_alternatives(F.concat(F.lit("["), "word", F.lit("]"))).alias("one_of"),
            M.class_to_alternatives(F.concat(F.lit("[^"), "word", F.lit("]"))).alias("none_of"),
        ),
        "codon_regex": lambda s, d: _words(s, d).select(
            "word", M.codon_regex(F.col("word")).alias("regex")
        ),
        "codon_combinations": lambda s, d: _words(s, d).select(
            "word", M.codon_combinations(F.col("word")).alias("combinations")
        ),
        "random_match_score": lambda s, d: _words(s, d).select(
            "word", M.random_match_score(F.length("word"), 6, 1024, 2).alias("score")
        ),
        "record_sizes": lambda s, d: _records(s, d).select(
            "name", SP.record_size(F.col("name"), F.col("seq")).alias("size")
        ),
        "split_n_parts": lambda s, d: SP.split_n_parts(
            _sized(s, d), 7, "doc_id", SP.record_size(F.col("name"), F.col("seq"))
        ).select("doc_id", "part"),
        "split_n_parts_residues": lambda s, d: SP.split_n_parts(
            _sized(s, d), 150, "doc_id", SP.record_size(None, F.col("seq"), "seq")
        ).select("doc_id", "part"),
        "split_part_size": lambda s, d: SP.split_part_size(
            _sized(s, d), 20_000, "doc_id", SP.record_size(F.col("name"), F.col("seq"))
        ).select("doc_id", "part"),
        "split_part_count": lambda s, d: SP.split_part_size(
            _sized(s, d), 64, "doc_id", SP.record_size(None, F.col("seq"), "count")
        ).select("doc_id", "part"),
        "split_sparse_numbers": lambda s, d: SP.split_part_size(
            _sized(s, d).withColumn("ord", F.col("doc_id") * 1_000_003 + 17), 20_000, "ord",
            SP.record_size(F.col("name"), F.col("seq")),
        ).select("doc_id", "part"),
        "split_giant_record": lambda s, d: SP.split_part_size(
            _sized(s, d), 20_000, "doc_id",
            F.when(F.col("doc_id") == 5, 10_000_000).otherwise(SP.record_size(F.col("name"), F.col("seq"))),
        ).select("doc_id", "part"),
        "split_first_parts": lambda s, d: SP.split_part_size(
            _sized(s, d), 20_000, "doc_id", SP.record_size(F.col("name"), F.col("seq")), max_parts=3
        ).select("doc_id", "part"),
        "index_of_parts": _index_of_parts,
        "search_stats": _search_stats,
        "motif_file": _motif_file,
        "manifest_records": _manifest,
        "search_one_bin": _one_bin,
        "search_loaded_index": lambda s, d: S.search(S.load_index(s, _peptides(s, d).path), "LY[AEG]N"),
        "search_no_candidates": lambda s, d: S.search(_peptides(s, d, fine=True), "WWWWWWWW"),
        "fasta_parts_named": _parts_named,
        "index_appended": _index_appended,
        "fasta_round_trip": _fasta_round_trip(_read_parts),
    }
    for name, pattern in PATTERNS.items():
        out[name] = _pattern_query(pattern)
    if corpus:
        out |= corpus.queries()
        out["pipeline"] = corpus_pipeline.run
    return out


# --------------------------------------------------------------------- SQL side
_AA = (
    "regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')),"
    " '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g')"
)
_LETTERS = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"
_SHARED = "translate({}, 'BJOUZ', 'DLXXE')"  # letters without a residue code of their own
_NA = f"translate({_AA}, 'ACDEFGHIKLMNPQRSTVWY', 'ACGTACGTACGTACGTACGT')"
_MURPHY = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCBBFGHIIKIIBKPBKSSCIFSFB')"
_LI = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCBBFGHIJKJJHKPBKAACIFAFB')"
_DOC_BIN = "printf('doc%08d', doc_id)"


def _rec(seq: str = _AA, bin: str = "source") -> str:
    return f"(SELECT {bin} AS bin, CAST(doc_id AS VARCHAR) AS name, {seq} AS seq FROM documents)"


def _kmers_sql(k: int, rec: str) -> str:
    return (
        f"(SELECT bin, substring(seq, i, {k}) AS kmer FROM (SELECT bin, seq,"
        f" unnest(range(1, length(seq) - {k} + 2)) AS i FROM {rec} WHERE length(seq) >= {k}))"
    )


def _canonical_sql(rec: str, k: int) -> str:
    code = "translate({}, 'ACTG', '0123')"
    back = "reverse(translate(kmer, 'ACGT', 'TGCA'))"
    return (
        f"(SELECT bin, translate(least({code.format('kmer')}, {code.format(back)}), '0123', 'ACTG')"
        f" AS kmer FROM {_kmers_sql(k, rec)})"
    )


def _matches_sql(rx: str, rec: str | None = None, extra: str = "") -> str:
    """Non-overlapping matches with coordinates; ``extra`` are further columns of ``rec``."""
    more = f"{extra}, " if extra else ""
    return (
        f"SELECT bin, name, {more}mm[i] AS match,"
        " CAST(lead + prior AS INTEGER) AS start,"
        ' CAST(lead + prior + length(mm[i]) AS INTEGER) AS "end" FROM (SELECT *,'
        " list_sum(list_transform(pp[1:i], lambda x: length(x))) AS lead,"
        " coalesce(list_sum(list_transform(mm[1:i-1], lambda x: length(x))), 0) AS prior"
        f" FROM (SELECT bin, name, {more}mm, pp, unnest(range(1, len(mm) + 1)) AS i FROM ("
        f"SELECT bin, name, {more}regexp_extract_all(seq, '{rx}') AS mm,"
        f" string_split_regex(seq, '{rx}') AS pp FROM {rec or _rec()}"
        f" WHERE regexp_matches(seq, '{rx}'))))"
    )


def _strands_sql() -> str:
    back = f"reverse(translate({_NA}, 'ACGT', 'TGCA'))"
    return (
        f"(SELECT bin, name, '+' AS strand, seq FROM {_rec(_NA)}"
        f" UNION ALL SELECT bin, name, '-' AS strand, seq FROM {_rec(back)})"
    )


def _candidates_sql(strings: list[str], k: int, seq: str = _AA) -> str:
    """Bins holding every k-mer of at least one of the listed strings."""
    wanted = ", ".join(
        f"({n}, '{kmer}')"
        for n, text in enumerate(strings)
        for kmer in sorted({text[i : i + k] for i in range(len(text) - k + 1)})
    )
    return (
        f"WITH wanted(s, kmer) AS (VALUES {wanted}), needed AS (SELECT s, count(*) AS n FROM wanted"
        f" GROUP BY s), held AS (SELECT DISTINCT bin, kmer FROM {_kmers_sql(k, _rec(seq, _DOC_BIN))}),"
        " full_sets AS (SELECT h.bin, w.s FROM held h JOIN wanted w USING (kmer) JOIN needed n USING (s)"
        " GROUP BY h.bin, w.s, n.n HAVING count(*) = n.n) SELECT DISTINCT bin FROM full_sets"
    )


_WORDS = (
    "(SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(upper(regexp_replace(text,"
    r" '[^A-Za-z\x20\x09-\x0D]', '', 'g')), '[\x20\x09-\x0D]+')) AS word FROM documents)"
    " WHERE regexp_full_match(word, '[ACDEFGHIKLMNPQRSTVWY]+'))"
)
#: How many codons code for each amino acid.
_CODONS = {
    "A": 4.0, "C": 2.0, "D": 2.0, "E": 2.0, "F": 2.0, "G": 4.0, "H": 2.0, "I": 3.0, "K": 2.0, "L": 6.0,
    "M": 1.0, "N": 2.0, "P": 4.0, "Q": 2.0, "R": 6.0, "S": 6.0, "T": 4.0, "V": 4.0, "W": 1.0, "Y": 2.0,
}


def _word_map_sql(values: dict) -> str:
    """The residues of ``word``, each replaced by its value."""
    cases = " ".join(f"WHEN '{a}' THEN {v!r}" for a, v in values.items())
    return f"list_transform(string_split(word, ''), lambda x: CASE x {cases} END)"


_SIZE = "length(seq) + length(name) + 1 + (1 + CAST(ceil(length(seq) / 100.0) AS BIGINT))"


def _split_sql(size: str, step: str) -> str:
    """Fold over the records in order; ``step`` says whether a record opens a part."""
    return (
        "WITH RECURSIVE sized AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n,"
        f" CAST({size} AS BIGINT) AS size FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) AS name,"
        f" {_AA} AS seq FROM documents)), total AS (SELECT sum(size) AS total FROM sized),"
        " fold AS (SELECT doc_id, n, 1::BIGINT AS part, size AS written, size AS here FROM sized WHERE n = 1"
        " UNION ALL SELECT doc_id, n, part + opens, written + size,"
        " CASE WHEN opens = 1 THEN size ELSE here + size END FROM (SELECT s.doc_id, s.n, f.part, f.written,"
        f" f.here, s.size, CASE WHEN {step} THEN 1 ELSE 0 END AS opens FROM fold f"
        " JOIN sized s ON s.n = f.n + 1 CROSS JOIN total t))"
        " SELECT doc_id, CAST(part AS BIGINT) AS part FROM fold"
    )


def _n_parts_sql(size: str, parts: int) -> str:
    end = (
        f"(CAST(floor(CAST(t.total AS DOUBLE) / {parts} * f.part) AS BIGINT)"
        " + CASE WHEN f.part > 1 THEN 1 ELSE 0 END)"
    )
    return _split_sql(
        size,
        f"f.here > 0 AND f.written + s.size > {end}"
        f" AND f.written + s.size - {end} > {end} - f.written",
    )


def _lines_sql(matches: str, strand: bool = False) -> str:
    place = "start || ',' || \"end\""
    if strand:
        place = f"CASE WHEN strand = '-' THEN 'REVERSE STRAND HIT' ELSE {place} END"
    return f"SELECT bin || chr(9) || '>' || name || chr(9) || match || chr(9) || {place} AS value FROM ({matches})"


def _all_of_sql(columns: str, bin: str) -> str:
    tests = " AND ".join(f"regexp_matches(seq, '{p}')" for p in ALL_OF)
    return f"SELECT {columns} FROM {_rec(bin=bin)} WHERE {tests}"


def _batch_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{i}' AS motif_id, * FROM ({_matches_sql(p)})" for i, p in BATCH.items()
    )


def _profiles_sql() -> str:
    return (
        f"WITH words AS (SELECT word, length(word) AS size FROM {_WORDS} WHERE length(word) >= 4),"
        " cells AS (SELECT size, p, substring(word, p, 1) AS residue, count(*) AS weight FROM"
        " (SELECT word, size, unnest(range(1, size + 1)) AS p FROM words) GROUP BY ALL),"
        " least AS (SELECT size, 0.75 * sum(best) AS threshold FROM (SELECT size, p, max(weight) AS best FROM cells"
        " GROUP BY size, p) GROUP BY size),"
        " coded AS (SELECT CAST(size AS INTEGER) AS size, CAST(p AS INTEGER) AS p, ascii(residue) AS r, weight FROM cells),"
        " places AS (SELECT doc_id, q, ascii(seq[q]) AS r FROM (SELECT doc_id, seq, CAST(unnest(range(1, length(seq) + 1)) AS INTEGER) AS q"
        f" FROM (SELECT doc_id, {_AA} AS seq FROM documents))),"
        " scored AS (SELECT doc_id, size, q - p + 1 AS i, sum(weight) AS score FROM places JOIN coded USING (r)"
        " WHERE q >= p GROUP BY doc_id, size, q - p + 1 HAVING count(*) = size)"
        " SELECT CAST(size AS VARCHAR) AS profile_id, bin, name, CAST(i - 1 AS INTEGER) AS start,"
        ' CAST(i - 1 + size AS INTEGER) AS "end", substring(seq, i, size) AS match, CAST(score AS BIGINT) AS score'
        " FROM scored JOIN least USING (size) JOIN (SELECT CAST(name AS BIGINT) AS doc_id, * FROM"
        f" {_rec(bin=_DOC_BIN)}) USING (doc_id) WHERE score >= threshold"
    )


def _unfiltered_sql() -> str:
    rows = ", ".join(f"('{i}', '{p.replace('(', '(?:')}')" for i, p in _short_motifs().items())
    return (
        f"SELECT motif_id, CAST(sum(len(regexp_extract_all(seq, rx))) AS BIGINT) AS n, count(DISTINCT name) AS records"
        f" FROM (VALUES {rows}) AS m(motif_id, rx) JOIN {_rec()} ON regexp_matches(seq, rx) GROUP BY motif_id"
    )


def _dgram_windows_sql(low: int, high: int) -> str:
    """Gapped k-mers from the residue codes behind every position."""
    ahead = ", ".join(f"lead(c, {j}) OVER w AS c{j}" for j in range(1, high + 6))
    parts = []
    for gap in range(low, high + 1):
        at = ["c", "c1", "c2", *(f"c{gap + j}" for j in (3, 4, 5))]
        code = " + ".join(f"{c} * {20 ** (5 - n)}" for n, c in enumerate(at))
        valid = " AND ".join(f"{c} >= 0" for c in at)
        parts.append(f"SELECT bin, {gap} AS gap, {gap * 20**6} + {code} AS code FROM windows WHERE {valid}")
    return (
        "(WITH letters AS (SELECT bin, name, unnest(string_split(seq, '')) AS letter,"
        f" unnest(range(1, length(seq) + 1)) AS i FROM {_rec()} WHERE seq != ''),"
        f" coded AS (SELECT bin, name, i, strpos('{A.AMINO_ACIDS}', letter) - 1 AS c FROM letters),"
        f" windows AS (SELECT bin, c, {ahead} FROM coded WINDOW w AS (PARTITION BY name ORDER BY i))"
        f" {' UNION ALL '.join(parts)})"
    )


def oracle_sql() -> dict[str, str]:
    aa4, na5 = _kmers_sql(4, _rec()), _canonical_sql(_rec(_NA), 5)

    def codes(letters: str, k: int, base: int, kmer: str = "kmer") -> str:
        return " + ".join(
            f"CAST(strpos('{letters}', substring({kmer}, {i + 1}, 1)) - 1 AS BIGINT) * {base ** (k - 1 - i)}"
            for i in range(k)
        )

    word = [f"substring(word, {i} % length(word) + 1, 1)" for i in range(5)]
    prosite = (
        f"'<' || {word[0]} || '-x-[' || {word[1]} || {word[2]} || ']-{{' || {word[3]} || '}}-' || {word[4]}"
        f" || '(2,3)-x(2)-{{' || {word[0]} || '}}(2)-' || array_to_string(string_split(word, ''), '-')"
        f" || '-[' || {word[0]} || '>].'"
    )
    converted = (
        f"'^' || {word[0]} || '.[' || {word[1]} || {word[2]} || '][' ||"
        f" replace('ACDEFGHIKLMNPQRSTVWY', {word[3]}, '') || ']' || {word[4]}"
        f" || '{{2,3}}.{{2}}[^' || {word[0]} || ']{{2}}' || word || '([' || {word[0]} || ']|$)'"
    )
    na_rx = "AC(?:GA)+T"
    out = {
        "records_aa": f"SELECT * FROM {_rec()}",
        "records_na": f"SELECT * FROM {_rec(_NA)}",
        "reduce_murphy": f"SELECT name, {_MURPHY.format('seq')} AS seq FROM {_rec(_LETTERS)}",
        "reduce_li": f"SELECT name, {_LI.format('seq')} AS seq FROM {_rec(_LETTERS)}",
        "reverse_complement": "SELECT name, reverse(translate(seq, 'ABCDGHKMRTUVY', 'TVGHCDMKYAABR')) AS seq"
        f" FROM {_rec(_LETTERS)}",
        "kmers_aa": f"SELECT bin, kmer, count(*) AS n FROM {aa4} GROUP BY bin, kmer",
        "kmers_na_canonical": f"SELECT bin, kmer, count(*) AS n FROM {na5} GROUP BY bin, kmer",
        "kmers_reduced": "SELECT kmer, count(*) AS n FROM "
        f"{_kmers_sql(5, _rec(_MURPHY.format(_AA)))} GROUP BY kmer",
        "kmer_codes_aa": f"SELECT kmer, {codes('ACDEFGHIKLMNPQRSTVWYX', 4, 32, _SHARED.format('kmer'))} AS code"
        f" FROM (SELECT DISTINCT kmer FROM {_kmers_sql(4, _rec(_LETTERS))})",
        "kmer_codes_na": f"SELECT kmer, {codes('ACTG', 5, 4)} AS code FROM (SELECT DISTINCT kmer FROM {na5})",
        "kmers_decoded": f"SELECT DISTINCT kmer, {_SHARED.format('kmer')} AS decoded FROM {_kmers_sql(4, _rec(_LETTERS))}",
        "kmer_postings": f"SELECT DISTINCT kmer, bin FROM {aa4}",
        "short_records": "SELECT bin, count(*) AS n_records, count(*) FILTER (length(seq) >= 4) AS n_indexed"
        f" FROM {_rec(bin=_DOC_BIN)} GROUP BY bin",
        "dgram_codes": "SELECT CAST(gap AS INTEGER) AS gap, count(*) AS n, count(DISTINCT code) AS n_codes,"
        f" CAST(sum(code) AS BIGINT) AS total FROM {_dgram_windows_sql(1, 2)} GROUP BY gap",
        "dgram_postings": f"SELECT code, count(DISTINCT bin) AS n_bins FROM {_dgram_windows_sql(1, 3)} GROUP BY code",
        "index_stats": "SELECT 'EXACT' AS index_type, count(*) AS bin_count,"
        " CAST(0 AS BIGINT) AS bin_bits, 0 AS hash_count, CAST(0 AS DOUBLE) AS fpr, 4 AS k, 'aa' AS molecule, 'NONE' AS reduction,"
        " CAST(sum(r) AS BIGINT) AS n_records, CAST(sum(x) AS BIGINT) AS n_indexed,"
        " CAST(sum(n) AS BIGINT) AS n_kmers FROM (SELECT bin, count(*) AS r,"
        " count(*) FILTER (length(seq) >= 4) AS x, sum(greatest(length(seq) - 3, 0)) AS n"
        f" FROM {_rec()} GROUP BY bin)",
        "bloom_bits": "SELECT bin, n_kmers, CAST(ceil(n_kmers * -ln(0.05) / pow(ln(2), 2)) AS BIGINT) AS bits"
        " FROM (SELECT bin, CAST(sum(greatest(length(seq) - 3, 0)) AS BIGINT) AS n_kmers"
        f" FROM {_rec()} GROUP BY bin)",
        "search_bloom": _matches_sql("LY[AEG]N", _rec(bin=_DOC_BIN)),
        "search_bloom_na": _matches_sql(na_rx, _strands_sql(), "strand"),
        "search_bloom_murphy": _matches_sql("ABBSHB", _rec(_MURPHY.format(_AA))),
        "bloom_candidates": _candidates_sql(["LYAN", "LYEN", "LYGN"], 4),
        "bloom_false_share": "SELECT true AS within_rate",
        "search_rich_or_short": _matches_sql(RICH_OR_SHORT.replace("(", "(?:"), _rec(bin=_DOC_BIN)),
        "search_many_mixed": " UNION ALL ".join(
            f"SELECT '{i}' AS motif_id, * FROM ({_matches_sql(p.replace('(', '(?:'), _rec(bin=_DOC_BIN))})"
            for i, p in MIXED.items()
        ),
        # the engine's repetitions end at 1,000
        "search_longest_wide": _matches_sql("M.{1,1000}.{0,1000}.{0,500}K"),
        "rx_anchor_start": "SELECT bin, name, m AS match, 0 AS start, CAST(length(m) AS INTEGER) AS \"end\""
        f" FROM (SELECT bin, name, regexp_extract(seq, '^[A-M]+') AS m FROM {_rec()}) WHERE m != ''",
        "rx_anchor_end": "SELECT bin, name, right(seq, 2) AS match, CAST(length(seq) - 2 AS INTEGER) AS start,"
        f" CAST(length(seq) AS INTEGER) AS \"end\" FROM {_rec()} WHERE regexp_matches(seq, 'E[RST]$')",
        "search_fine_bins": _matches_sql("N.{1,3}DHA", _rec(bin=_DOC_BIN)),
        "search_unindexed": _matches_sql("AN(?:D|T)TH"),
        "candidate_bins_literal": _candidates_sql(["ANDTHER"], 4),
        "candidate_bins_alt": _candidates_sql(
            [f"TRE{m}E{e}" for m in ("TH", "AN") for e in "RS"], 4
        ),
        "candidate_bins_loop": _candidates_sql(["THENT", "THERENT"], 4),
        "candidate_counts": " UNION ALL ".join(
            f"SELECT '{i}' AS motif_id, count(*) AS bins FROM ({text})"
            for i, text in {
                "a": _candidates_sql(["ANDTHER"], 4),
                "b": _candidates_sql(["THENT"], 4),
                "c": f"SELECT DISTINCT bin FROM {_rec(bin=_DOC_BIN)}",
            }.items()
        ),
        "candidate_bins_short": f"SELECT DISTINCT bin FROM {_rec(bin=_DOC_BIN)}",
        "candidate_bins_reduced": _candidates_sql(["SHBABBBK"], 5, _MURPHY.format(_AA)),
        "candidate_bins_dgram": "WITH g AS (SELECT bin FROM (SELECT doc_id, bin, seq FROM"
        f" (SELECT doc_id, {_DOC_BIN} AS bin, {_AA} AS seq FROM documents)) WHERE"
        " regexp_matches(seq, 'AND.{2}THE')) SELECT DISTINCT bin FROM g",
        "search_augmented": _matches_sql(RICH.replace("(", "(?:")),
        "search_augmented_dgram": _matches_sql(RICH.replace("(", "(?:")),
        "search_na": _matches_sql(na_rx, _strands_sql(), "strand"),
        "search_na_reverse": f"SELECT * FROM ({_matches_sql(na_rx, _strands_sql(), 'strand')}) WHERE strand = '-'",
        "search_na_first": _matches_sql("(?:AC|ACG)TA(?:C|CA)", _strands_sql(), "strand"),
        "search_murphy": _matches_sql("ABBSHB", _rec(_MURPHY.format(_AA))),
        "search_li": _matches_sql("AHBAHBK", _rec(_LI.format(_AA))),
        "search_murphy_original": "SELECT m.*, substring(r.seq, m.start + 1, m.\"end\" - m.start) AS original FROM"
        f" ({_matches_sql('ABBSHB', _rec(_MURPHY.format(_AA)))}) m JOIN {_rec()} r USING (name)",
        "search_joined_sources": "WITH joined AS (SELECT bin, string_agg(seq, '' ORDER BY doc_id) AS seq FROM (SELECT doc_id,"
        f" coalesce(lang, '') AS bin, {_AA} AS seq FROM documents) GROUP BY bin), found AS (SELECT bin,"
        " regexp_extract_all(seq, 'THERN|THEN|THRN|THN|TRN|TN') AS mm,"
        " string_split_regex(seq, 'THERN|THEN|THRN|THN|TRN|TN') AS pp FROM joined), listed AS (SELECT bin, unnest(mm) AS match,"
        " unnest(pp[1:len(mm)]) AS piece, unnest(range(1, len(mm) + 1)) AS i FROM found), placed AS (SELECT bin, match,"
        " sum(length(piece) + length(match)) OVER (PARTITION BY bin ORDER BY i) - length(match) AS start FROM listed)"
        " SELECT bin, match, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts FROM placed GROUP BY bin, match",
        "search_longest_bounded": _matches_sql("THERN|THEN|THRN|THN|TRN|TN"),
        "search_longest_choice": _matches_sql("THER|THE|TH|T"),
        "search_longest_unbounded": _matches_sql("(?:AN?)+D"),
        "search_longest_walked": _matches_sql("(?:A|NA)+ND"),
        "search_many": _batch_sql(),
        "search_profiles": _profiles_sql(),
        "search_batch_of_words": f"WITH words AS (SELECT word FROM {_WORDS} WHERE length(word) >= 4),"
        f" recs AS (SELECT name, seq FROM {_rec()}),"
        " starts AS (SELECT DISTINCT name, substring(seq, i, 4) AS kmer FROM (SELECT name, seq,"
        " unnest(range(1, length(seq) - 2)) AS i FROM recs WHERE length(seq) >= 4)),"
        " pairs AS (SELECT word, name FROM words JOIN starts ON substring(word, 1, 4) = kmer)"
        " SELECT word AS motif_id, CAST(sum((length(seq) - length(replace(seq, word, ''))) // length(word)) AS BIGINT) AS n"
        " FROM pairs JOIN recs USING (name) WHERE contains(seq, word) GROUP BY word",
        "search_unfiltered_batch": _unfiltered_sql(),
        "match_counts": "SELECT motif_id, bin, count(*) AS matches, count(DISTINCT name) AS records"
        f" FROM ({_batch_sql()}) GROUP BY motif_id, bin",
        "search_all_of": _all_of_sql(f"bin, name, '{':'.join(ALL_OF)}' AS motifs", _DOC_BIN),
        "match_lines": _lines_sql(_matches_sql("LY[AEG]N")),
        "match_lines_na": _lines_sql(_matches_sql(na_rx, _strands_sql(), "strand"), strand=True),
        "conjunction_lines": _all_of_sql(
            f"bin || chr(9) || '>' || name || chr(9) || 'N --> {' --> '.join(ALL_OF)} --> C' AS value", "source"
        ),
        "prosite_to_regex": f"SELECT word, {prosite} AS prosite, {converted} AS regex FROM {_WORDS}",
        "class_alternatives": "SELECT word,"
        " '(' || array_to_string(list_sort(list_distinct(string_split(word, ''))), '|') || ')' AS one_of,"
        " '(' || coalesce(array_to_string(list_filter(string_split('ACDEFGHIKLMNPQRSTVWY', ''),"
        f" lambda x: NOT list_contains(string_split(word, ''), x)), '|'), '') || ')' AS none_of FROM {_WORDS}",
        "codon_regex": f"SELECT word, array_to_string({_word_map_sql(M.CODON_PATTERNS)}, '') AS regex FROM {_WORDS}",
        "codon_combinations": "SELECT word, list_product("
        f"{_word_map_sql(_CODONS)}) AS combinations FROM {_WORDS}",
        "random_match_score": "SELECT word, list_reduce(range(6, length(word) + 1), lambda r, p:"
        " CASE WHEN p = 6 THEN 0.25 ELSE r * 2 * 0.25 + 2 * 1024 * pow(0.25, p) END, CAST(0.25 AS DOUBLE))"
        f" AS score FROM {_WORDS}",
        "record_sizes": f"SELECT name, CAST({_SIZE} AS BIGINT) AS size FROM {_rec()}",
        "split_n_parts": _n_parts_sql(_SIZE, 7),
        "split_n_parts_residues": _n_parts_sql("length(seq)", 150),
        "split_part_size": _split_sql(_SIZE, "f.here > 0 AND f.here + s.size > 20000"),
        "split_part_count": _split_sql("1", "f.here > 0 AND f.here + s.size > 64"),
        "split_sparse_numbers": _split_sql(_SIZE, "f.here > 0 AND f.here + s.size > 20000"),
        "split_giant_record": _split_sql(
            f"CASE WHEN doc_id = 5 THEN 10000000 ELSE {_SIZE} END", "f.here > 0 AND f.here + s.size > 20000"
        ),
        "split_first_parts": "SELECT * FROM ("
        f"{_split_sql(_SIZE, 'f.here > 0 AND f.here + s.size > 20000')}) WHERE part <= 3",
        "index_of_parts": _matches_sql(
            "LY[AEG]N",
            f"(SELECT 'part=' || p.part AS bin, r.name, r.seq FROM ({_n_parts_sql(_SIZE, 4)}) p"
            f" JOIN {_rec()} r ON r.name = CAST(p.doc_id AS VARCHAR))",
        ),
        "index_appended": _matches_sql("LY[AEG]N"),
        "motif_file": "SELECT letter AS motif_id, bin, CAST(sum(len(regexp_extract_all(seq, letter || '[AE]RT'))) AS BIGINT) AS n"
        f" FROM (SELECT DISTINCT substring(word, 1, 1) AS letter FROM {_WORDS}) JOIN {_rec()} ON regexp_matches(seq, letter || '[AE]RT')"
        " GROUP BY letter, bin",
        "manifest_records": f"SELECT name, 'document ' || name AS comment, seq FROM {_rec()}",
        "search_one_bin": _matches_sql("LY[AEG]N", _rec(bin="'all'")),
        "search_loaded_index": _matches_sql("LY[AEG]N"),
        "search_no_candidates": _matches_sql("WWWWWWWW", _rec(bin=_DOC_BIN)),
        "search_stats": "SELECT (SELECT count(*) FROM ("
        f"{_candidates_sql(['LYAN', 'LYEN', 'LYGN'], 4)})) AS candidate_bins, count(DISTINCT name) AS records_matched,"
        f" count(*) AS matches FROM ({_matches_sql('LY[AEG]N')})",
        "fasta_parts_named": "SELECT 'docs.part-' || lpad(CAST(part AS VARCHAR), 2, '0') || '.fasta' AS file,"
        " length(content) AS size, md5(content) AS content FROM (SELECT part, string_agg('>' || name || chr(10) ||"
        " regexp_replace(regexp_replace(seq, '(.{100})', '\\1' || chr(10), 'g'), '\\n$', '') || chr(10), '' ORDER BY p.doc_id) AS content"
        f" FROM ({_n_parts_sql(_SIZE, 12)}) p JOIN {_rec()} r ON r.name = CAST(p.doc_id AS VARCHAR) GROUP BY part)",
        "fasta_round_trip": f"SELECT name, 'document ' || name AS comment, seq FROM {_rec()}",
    }
    for name, pattern in PATTERNS.items():
        out[name] = _matches_sql(pattern.replace("(", "(?:"))
    if corpus:
        out |= corpus.oracle_sql()
    return out
