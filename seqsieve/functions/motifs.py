"""Converting motif notations, as column expressions and for single strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqsieve.functions.alphabet import AMINO_ACIDS, BASE_CODES
from seqsieve.plans.pattern import count_strings, parse

# --- fixed values ------------------------------------------------------------
# codons of every amino acid as a pattern
CODON_PATTERNS = {
    "A": "GC(A|C|G|T)",
    "C": "TG(T|C)",
    "D": "GA(T|C)",
    "E": "GA(A|G)",
    "F": "TT(C|T)",
    "G": "GG(A|C|G|T)",
    "H": "CA(T|C)",
    "I": "AT(A|C|T)",
    "K": "AA(A|G)",
    "L": "(CT(A|C|G|T)|TT(A|G))",
    "M": "ATG",
    "N": "AA(C|T)",
    "P": "CC(A|C|G|T)",
    "Q": "CA(G|A)",
    "R": "(AG(G|A)|CG(A|C|G|T))",
    "S": "(TC(A|C|G|T)|AG(C|T))",
    "T": "AC(A|C|G|T)",
    "V": "GT(A|C|G|T)",
    "W": "TGG",
    "Y": "TA(T|C)",
}
# -----------------------------------------------------------------------------


#: One element of a PROSITE pattern: start, what may stand there, repetition, end.
_ELEMENT = r"^(<?)(x|[A-Za-z]|\[[A-Za-z<>]+\]|\{[A-Za-z<>]+\})(?:\(([0-9]+(?:,[0-9]+)?)\))?(>?)$"


def prosite_to_regex(pattern: Column) -> Column:
    """PROSITE notation to a motif pattern; NULL if an element is malformed.

    Elements are joined by ``-``: ``x`` is any residue, ``[..]`` one of, ``{..}`` none of,
    ``(n)`` and ``(m,n)`` repetitions, ``<`` and ``>`` the ends of the sequence, also as a
    member of ``[..]``; a final period ends the pattern. An excluded set without a
    repetition is written out as the other amino acids, in alphabetical order.
    """

    def part(token: Column, group: int) -> Column:
        return F.regexp_extract(token, _ELEMENT, group)

    def choice(core: Column) -> Column:
        """``[..]``; an end among its members becomes an alternative of its own."""
        letters = F.translate(core, "[]<>", "")
        members = F.when(F.length(letters) > 0, F.concat(F.lit("["), letters, F.lit("]")))
        ends = [F.when(F.contains(core, F.lit(mark)), F.lit(anchor)) for mark, anchor in (("<", "^"), (">", "$"))]
        several = F.concat(F.lit("("), F.concat_ws("|", ends[0], members, ends[1]), F.lit(")"))
        return F.when(core.rlike("[<>]"), several).otherwise(members)

    def element(token: Column) -> Column:
        core, times = part(token, 2), part(token, 3)
        barred = F.translate(core, "{}", "")
        others = F.call_function("translate", F.lit(AMINO_ACIDS), barred, F.lit(""))
        none_of = F.when(times == "", F.concat(F.lit("["), others, F.lit("]"))).otherwise(
            F.concat(F.lit("[^"), barred, F.lit("]"))
        )
        residue = (
            F.when(core == "x", ".")
            .when(F.startswith(core, F.lit("[")), choice(core))
            .when(F.startswith(core, F.lit("{")), none_of)
            .otherwise(core)
        )
        repeated = F.when(times == "", "").otherwise(F.concat(F.lit("{"), times, F.lit("}")))
        start, end = (F.when(part(token, g) != "", a).otherwise("") for g, a in ((1, "^"), (4, "$")))
        return F.when(token.rlike(_ELEMENT), F.concat(start, residue, repeated, end))

    elements = F.transform(F.split(F.regexp_replace(F.trim(pattern), r"\.$", ""), "-"), element)
    return F.when(~F.exists(elements, lambda e: e.isNull()), F.array_join(elements, ""))


def class_to_alternatives(residues: Column) -> Column:
    """A residue class as a group of alternatives, in alphabetical order: ``[^...]`` are
    the amino acids that it does not name. NULL for anything but a class."""
    named = F.array_sort(F.array_distinct(F.split(F.translate(residues, "[^]", ""), "")))
    others = F.array_except(F.array(*map(F.lit, AMINO_ACIDS)), named)
    chosen = F.when(F.startswith(residues, F.lit("[^")), others).otherwise(named)
    return F.when(residues.rlike(r"^\[\^?[A-Z]+\]$"), F.concat(F.lit("("), F.array_join(chosen, "|"), F.lit(")")))


def codon_regex(peptide: Column) -> Column:
    """Pattern of all nucleotide sequences coding for a peptide; NULL for other letters."""
    table = _table(CODON_PATTERNS)
    codons = F.transform(F.split(peptide, ""), lambda aa: table[aa])
    return F.when(_is_peptide(peptide), F.array_join(codons, ""))


def codon_combinations(peptide: Column) -> Column:
    """Number of nucleotide sequences coding for a peptide; NULL for other letters."""
    strings = {aa: count_strings(parse(codons), len(BASE_CODES)) for aa, codons in CODON_PATTERNS.items()}
    table = _table({aa: float(n) for aa, n in strings.items()})
    factors = F.transform(F.split(peptide, ""), lambda aa: table[aa])
    product = F.aggregate(factors, F.lit(1.0), lambda acc, n: acc * n)
    return F.when(_is_peptide(peptide), product)


def _is_peptide(text: Column) -> Column:
    return text.rlike(f"^[{AMINO_ACIDS}]+$")


def _table(values: dict) -> Column:
    return F.create_map(*[F.lit(v) for item in values.items() for v in item])


def random_match_score(length: Column, k: int, bins: int, multiplier: int) -> Column:
    """Expected random k-mer matches of a nucleotide query over ``bins`` bins.

    Starts at ``bins / 4**k``; every longer prefix scales the score by ``multiplier``
    times that value and adds ``multiplier * bins / 4**prefix``.
    """
    base = F.lit(bins * 0.25**k)

    def grow(score: Column, prefix: Column) -> Column:
        return score * multiplier * base + multiplier * bins * F.pow(F.lit(0.25), prefix)

    longer = F.when(length > k, F.sequence(F.lit(k + 1), length)).otherwise(
        F.array().cast("array<int>")
    )
    return F.aggregate(longer, base, grow)
