import gzip

import pytest
from pyspark.sql import functions as F

import seqsieve as S
from seqsieve.__main__ import main
from seqsieve.functions import alphabet as A
from seqsieve.functions import motifs as M
from seqsieve.operators.split import with_order
from seqsieve.sources import fasta


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first one\nACGT\nAC\n\nGT\n>s2\nGG\r\nTT\r\n>s3\n")
    with gzip.open(tmp_path / "b.fasta.gz", "wt") as out:
        out.write(">z1\tzipped > here\nTTTT")
    (tmp_path / "all.lst").write_text(f"{tmp_path}/a.fa\n\n{tmp_path}/b.fasta.gz\n")
    return tmp_path


EXPECTED = [
    ("a.fa", "s1", "first one", "ACGTACGT"),
    ("a.fa", "s2", "", "GGTT"),
    ("a.fa", "s3", "", ""),
    ("b.fasta.gz", "z1", "zipped > here", "TTTT"),
]


def content(df):
    return sorted((r.bin.rsplit("/", 1)[-1], r.name, r.comment, r.seq) for r in df.collect())


def test_fasta_and_manifest(spark, files):
    paths = [str(files / "a.fa"), str(files / "b.fasta.gz")]
    assert content(fasta.read_fasta(spark, paths)) == EXPECTED
    assert content(fasta.read_fasta(spark, [str(files / "all.lst")])) == EXPECTED
    with pytest.raises(ValueError):
        fasta.read_fasta(spark, [str(files / "a.txt")])
    with pytest.raises(ValueError):
        fasta.read_fasta(spark, [])


def test_records_across_file_splits(spark, tmp_path):
    lines = [f">r{i} c{i}\n" + "ACGT\n" * (i % 7) for i in range(3000)]
    (tmp_path / "big.fa").write_text("".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        records = fasta.read_fasta(spark, [str(tmp_path / "big.fa")])
        assert records.rdd.getNumPartitions() > 5
        ordered = with_order(records).orderBy("ord").select("ord", "name", "comment", "seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in ordered] == [
        (i, f"r{i}", f"c{i}", "ACGT" * (i % 7)) for i in range(3000)
    ]


def test_fastx_rules(spark, files):
    (files / "q.fq").write_text(
        "junk\nmore junk >q1 lead\nAC\nGT\n+q1\n@>+!\n@q2\nTT\n+\n+@\n>q3 fasta\nGG\n@q4\nA\n+\n"
    )
    paths = [str(files / n) for n in ("a.fa", "b.fasta.gz", "q.fq")]
    found = content(fasta.read_fastx(spark, paths))
    assert found == EXPECTED + [
        ("q.fq", "q1", "lead", "ACGT"),
        ("q.fq", "q2", "", "TT"),
        ("q.fq", "q3", "fasta", "GG"),
    ]  # q4 has a truncated quality, which ends the file


def test_motif_batches(spark, tmp_path):
    (tmp_path / "m.tsv").write_text('a\tAC+G\n\nno pattern\nb\t"GT\textra\nc\t\na\tTTT\n')
    found = fasta.read_motifs(spark, str(tmp_path / "m.tsv"))
    assert sorted(map(tuple, found.collect())) == [("a", "AC+G"), ("a", "TTT"), ("b", '"GT')]


def test_alphabets(spark):
    df = spark.createDataFrame([("ACDEFGHIKLMNPQRSTVWYXBJOUZ",)], "s string")

    def value(col):
        return df.select(col.alias("v")).first().v

    assert value(A.reduce_alphabet(F.col("s"), "murphy")) == "ACBBFGHIKIIBPBKSSIFFSBIKCB"
    assert value(A.reduce_alphabet(F.col("s"), "li")) == "ACBBFGHIKJJHPBKAAIFFABJKCB"
    assert value(A.reverse_complement(F.lit("ACGTUNRYKMBVDHSWacgtu"))) == "aacgtWSDHBVKMRYNAACGT"
    assert value(A.nucleotide_code(F.lit("ACTG"))) == 0b00011011
    assert value(A.peptide_code(F.lit("AY1X"))) == (19 << 10) + 20
    assert A.dgram_text_code("ACD", 3, "EFG") == 3 * 20**6 + (
        0 * 20**5 + 1 * 20**4 + 2 * 20**3 + 3 * 20**2 + 4 * 20 + 5
    )
    kmers = ["ACCG", "CGGT", "AAAA", "TTTT", "UUCC", "GGAA", "acgt", "RYKM"]
    both = spark.createDataFrame([(k,) for k in kmers], "k string")
    rows = both.select("k", A.canonical_kmer(F.col("k")).alias("c")).collect()
    assert all(r.c == A.canonical_text(r.k) for r in rows)
    assert rows[0].c == rows[1].c and rows[2].c == rows[3].c and rows[4].c == rows[5].c


def test_motif_notations(spark):
    cases = {
        "L-M-A-[EQ]-G-L-Y-N": "LMA[EQ]GLYN",
        "<M-x-C(2)-x(2,4)-{P}(3)-K>": "^M.C{2}.{2,4}[^P]{3}K$",
        "{ACD}-x": "[EFGHIKLMNPQRSTVWY].",
        "F-[IVFY]-G-[LM]-M-[G>].": "F[IVFY]G[LM]M([G]|$)",
        "[<AC](2)-{W}(1,3)>.": "(^|[AC]){2}[^W]{1,3}$",
        "A--C": None,
        "A-[B": None,
    }
    df = spark.createDataFrame(list(cases), "string").toDF("p")
    got = {r.p: r.x for r in df.select("p", M.prosite_to_regex(F.col("p")).alias("x")).collect()}
    assert got == cases
    row = spark.range(1).select(
        M.codon_regex(F.lit("MK")).alias("a"),
        M.codon_regex(F.lit("M1")).alias("b"),
        M.codon_combinations(F.lit("RKI")).alias("c"),
        M.random_match_score(F.lit(3), 2, 10, 5).alias("d"),
        M.random_match_score(F.lit(2), 2, 10, 5).alias("e"),
    ).first()
    assert (row.a, row.b, row.c) == ("ATGAA(A|G)", None, 36.0)
    base = 10 / 16
    assert (row.d, row.e) == (base * 5 * base + 5 * 10 / 64, base)


def test_command_line(spark, files, capsys):
    for name, rows in {
        "f1.fa": ">Snippet1.1\nAACCGG\n>Snippet1.2\nAACGG\n",
        "f2.fa": ">Snippet2.1\nAACCTT\n>Snippet2.2\nTTCCAA\n",
    }.items():
        (files / name).write_text(rows)
    idx = str(files / "idx")
    main(["index", "-n", "-k", "3", idx, str(files / "f1.fa"), str(files / "f2.fa")])
    assert "Indexed 4 sequences across 2 bins." in capsys.readouterr().out
    main(["query", idx, "AC+G", "-d", str(files / "g.gv")])
    lines = sorted(capsys.readouterr().out.splitlines())
    assert [line.split("\t")[1:] for line in lines] == [
        [">Snippet1.1", "ACCG", "1,5"],
        [">Snippet1.2", "ACG", "1,4"],
    ]
    assert (files / "g.gv").read_text().startswith("digraph")
    main(["query", "-c", idx, "AAC:GG"])
    assert "N --> AAC --> GG --> C" in capsys.readouterr().out
    (files / "m.tsv").write_text("one\tAC+G\ntwo\tTT\n")
    main(["query", "-v", "-f", "-o", str(files / "out"), idx, str(files / "m.tsv")])
    saved = spark.read.text(str(files / "out"))
    assert {r.motif_id for r in saved.collect()} == {"one", "two"}
    main(["inspect", idx])
    assert "bin_count: 2" in capsys.readouterr().out
    main(["convert", "-i", "A-x"])
    main(["rev_translate", "-i", "MW"])
    assert capsys.readouterr().out.split() == ["A.", "ATGTGG"]
    main(["split", "--n-parts", "2", "--out-dir", str(files / "parts"), str(files / "f1.fa")])
    written = {p.name: p.read_text() for p in (files / "parts").iterdir() if not p.name.startswith(".")}
    assert written == {"f1.part-1.fa": ">Snippet1.1\nAACCGG\n", "f1.part-2.fa": ">Snippet1.2\nAACGG\n"}
    main(["query", "-v", idx, "AC+G"])
    assert "candidate_bins: 1" in capsys.readouterr().err
    main(["query", "-v", "-o", str(files / "found"), idx, "AC+G"])
    figures = dict(line.split(": ") for line in capsys.readouterr().err.splitlines() if ": " in line and " " not in line.split(": ")[0])
    assert figures["candidate_bins"] == "1" and figures["matches"] == "2" and figures["records_matched"] == "2"


@pytest.mark.parametrize("pad, eol", [(True, "\n"), (False, "\r\n")])
def test_part_files(spark, tmp_path, pad, eol):
    rows = [(i, i % 11 + 1, f"n{i}", "c" if i % 2 else "", "ACDEF" * (i % 7)) for i in range(60)]
    parts = spark.createDataFrame(rows, "ord int, part int, name string, comment string, seq string").repartition(5)
    paths = fasta.write_fasta_files(parts, str(tmp_path / "p"), "x", "ord", prefix="_", pad=pad, extension=".fa", line_length=10, eol=eol)
    assert [p.rsplit("/", 1)[-1] for p in paths] == [f"x_{n:02d}.fa" if pad else f"x_{n}.fa" for n in range(1, 12)]
    for number, path in enumerate(paths, 1):
        want = ""
        for _, part, name, comment, seq in rows:
            if part == number:
                lines = [seq[i : i + 10] for i in range(0, len(seq), 10)] or [""]
                want += eol.join([f">{name} {comment}".rstrip(), *lines]) + eol
        assert open(path, newline="").read() == want
    assert not [p for p in (tmp_path / "p").iterdir() if p.name.startswith("_writing")]
    with pytest.raises(OSError):  # a part that is there already is not replaced
        fasta.write_fasta_files(parts, str(tmp_path / "p"), "x", "ord", prefix="_", pad=pad, extension=".fa")


def test_what_a_search_counts(spark):
    data = [(f"b{i}", f"r{i}", "ACDEACD" if i % 4 == 0 else "KKKLLL") for i in range(200)]
    index = S.build_index(spark.createDataFrame(data, "bin string, name string, seq string"), k=3)
    found, figures = S.search_observed(index, "ACD")
    assert found.count() == 100
    seen = figures()
    assert seen["candidate_bins"] == seen["records_matched"] == 50 and seen["matches"] == 100 and 50 <= seen["records_read"] <= 200
    for pattern, bins, matches in (("WWW", 0, 0), ("K+", 200, 150)):
        found, figures = S.search_observed(index, pattern)
        assert found.count() == matches
        assert (figures()["candidate_bins"], figures()["matches"]) == (bins, matches)


def test_searching_only_candidate_files(spark, files):
    for i, seq in enumerate(["MKLVAC", "ACDEFG", "MKLVAC"]):
        (files / f"p{i}.fa").write_text(f">r{i}\n{seq}\n")
    paths = [str(files / f"p{i}.fa") for i in range(3)]
    index = S.build_index(fasta.read_fasta(spark, paths), k=3, store_records=False)
    found = S.search_files(index, "LV[AC]").select("name", "match", "start", "end")
    assert sorted(map(tuple, found.collect())) == [("r0", "LVA", 2, 5), ("r2", "LVA", 2, 5)]
    files_read = {f.rsplit("/", 1)[-1] for f in S.search_files(index, "CDE").inputFiles()}
    assert files_read == {"p1.fa"}
    assert S.search_files(index, "WWW").count() == 0
