"""Residue alphabets as column expressions (everything here stays JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: they decide results and must be exactly these -------------
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"

# letter -> representative letter of the two ten-letter reduced alphabets
MURPHY = {
    "A": "A", "B": "B", "C": "C", "D": "B", "E": "B", "F": "F", "G": "G",
    "H": "H", "I": "I", "J": "I", "K": "K", "L": "I", "M": "I", "N": "B",
    "O": "K", "P": "P", "Q": "B", "R": "K", "S": "S", "T": "S", "U": "C",
    "V": "I", "W": "F", "X": "S", "Y": "F", "Z": "B",
}
LI = {
    "A": "A", "B": "B", "C": "C", "D": "B", "E": "B", "F": "F", "G": "G",
    "H": "H", "I": "I", "J": "J", "K": "K", "L": "J", "M": "J", "N": "H",
    "O": "K", "P": "P", "Q": "B", "R": "K", "S": "A", "T": "A", "U": "C",
    "V": "I", "W": "F", "X": "A", "Y": "F", "Z": "B",
}

# nucleotide complement with the IUPAC ambiguity codes
COMPLEMENT = {
    "A": "T", "B": "V", "C": "G", "D": "H", "G": "C", "H": "D", "K": "M",
    "M": "K", "R": "Y", "T": "A", "U": "A", "V": "B", "Y": "R",
}

# residue codes: 2 bits per base, 5 bits per amino acid
BASE_CODES = {"A": 0, "C": 1, "T": 2, "G": 3, "U": 2, "N": 3}
PEPTIDE_CODES = {
    "A": 0, "C": 1, "D": 2, "E": 3, "F": 4, "G": 5, "H": 6, "I": 7, "K": 8,
    "L": 9, "M": 10, "N": 11, "P": 12, "Q": 13, "R": 14, "S": 15, "T": 16,
    "V": 17, "W": 18, "Y": 19, "X": 20, "B": 2, "J": 9, "O": 20, "U": 20,
    "Z": 3,
}
# -----------------------------------------------------------------------------

REDUCTIONS = {"murphy": MURPHY, "li": LI}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def _with_lower(table: dict[str, str]) -> dict[str, str]:
    return table | {a.lower(): b.lower() for a, b in table.items()}


def _translate(col: Column, table: dict[str, str]) -> Column:
    return F.translate(col, "".join(table), "".join(table.values()))


def reduce_alphabet(seq: Column, reduction: str | None) -> Column:
    """Replace every residue by the representative of its class."""
    return _translate(seq, REDUCTIONS[reduction]) if reduction else seq


def reverse_complement(seq: Column) -> Column:
    """Reverse complement of a whole record; letter case is kept."""
    return F.reverse(_translate(seq, _with_lower(COMPLEMENT)))


def _code_ordered(seq: Column) -> Column:
    # Swapping G and T makes plain string order equal to the order of the 2-bit codes.
    return F.translate(seq, "GT", "TG")


def both_strands(seq: Column) -> tuple[Column, Column]:
    """Forward and reverse-complement text whose windows compare in code order.

    U is read as T first, so that complementing is its own inverse.
    """
    dna = F.translate(seq, "Uu", "Tt")
    return _code_ordered(dna), _code_ordered(reverse_complement(dna))


def from_code_order(kmer: Column) -> Column:
    return _code_ordered(kmer)


def canonical_kmer(kmer: Column) -> Column:
    """The smaller of a nucleotide k-mer and its reverse complement."""
    forward, backward = both_strands(kmer)
    return from_code_order(F.least(forward, backward))


def canonical_text(kmer: str) -> str:
    """The same rule for one k-mer of a pattern, on the driver."""
    swap = str.maketrans("GT", "TG")
    dna = kmer.translate(str.maketrans("Uu", "Tt"))
    back = dna.translate(str.maketrans(_with_lower(COMPLEMENT)))[::-1]
    return min(dna.translate(swap), back.translate(swap)).translate(swap)


def nucleotide_code(kmer: Column) -> Column:
    """Two bits per base as a BIGINT (k <= 31)."""
    digits = _translate(F.upper(kmer), {a: str(c) for a, c in BASE_CODES.items()})
    return F.conv(digits, 4, 10).cast("bigint")


def peptide_code(kmer: Column) -> Column:
    """Five bits per residue as a BIGINT (k <= 12); letters without a code count as A."""
    known = F.regexp_replace(kmer, "[^A-Z]", "A")
    digits = _translate(known, {a: _DIGITS[c] for a, c in PEPTIDE_CODES.items()})
    return F.conv(digits, 32, 10).cast("bigint")


def nucleotide_from_code(code: Column, k: int) -> Column:
    """The k-mer of a nucleotide code."""
    return F.translate(F.lpad(F.conv(code, 10, 4), k, "0"), "0123", "ACTG")


def peptide_from_code(code: Column, k: int) -> Column:
    """The k-mer of a peptide code; letters that share a code come back as the first."""
    letters = AMINO_ACIDS + "X"
    return F.translate(F.lpad(F.conv(code, 10, 32), k, "0"), _DIGITS[: len(letters)], letters)


def amino_digits(seq: Column) -> Column:
    """Base-20 digit per amino acid, ``~`` for everything else."""
    table = {a: _DIGITS[i] for i, a in enumerate(AMINO_ACIDS)}
    return _translate(F.regexp_replace(seq, f"[^{AMINO_ACIDS}]", "~"), table)


def dgram_code(gap: Column, residues: Column) -> Column:
    """Code of three residues, a gap and three residues; ``residues`` holds the six digits."""
    return gap.cast("bigint") * F.lit(20**6) + F.conv(residues, 20, 10).cast("bigint")


def dgram_text_code(left: str, gap: int, right: str) -> int | None:
    """The same code for one d-gram of a pattern; None when a residue is not an amino acid."""
    code = gap
    for residue in left + right:
        if residue not in AMINO_ACIDS:
            return None
        code = code * 20 + AMINO_ACIDS.index(residue)
    return code
