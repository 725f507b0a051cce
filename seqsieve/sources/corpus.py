"""Records derived from a table of documents, for running motifs over text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqsieve.functions.alphabet import AMINO_ACIDS


def letters(text: Column) -> Column:
    """All letters A-Z of a text, upper-cased: ambiguity codes are among them."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


def amino_text(text: Column) -> Column:
    """The letters of a text that are amino-acid codes, upper-cased."""
    return F.regexp_replace(letters(text), f"[^{AMINO_ACIDS}]", "")


def nucleotide_text(text: Column) -> Column:
    """The same letters folded onto the four bases, in alphabetical rotation."""
    bases = ("ACGT" * 5)[: len(AMINO_ACIDS)]
    return F.translate(amino_text(text), AMINO_ACIDS, bases)


def document_records(
    documents: DataFrame, molecule: str = "aa", bin: Column | None = None
) -> DataFrame:
    """Records (bin, name, seq) of ``documents``; the bin is ``source`` unless given."""
    seq = amino_text(F.col("text")) if molecule == "aa" else nucleotide_text(F.col("text"))
    return documents.select(
        (F.col("source") if bin is None else bin).alias("bin"),
        F.col("doc_id").cast("string").alias("name"),
        seq.alias("seq"),
    )
