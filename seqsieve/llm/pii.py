"""Personal data: fixed patterns, and terms that give protected entities away.

E-mail addresses, IP addresses, card and phone numbers are found by pattern and checked.
They are also the protected entities of an information-theoretic sanitisation: it counts in
how many of all documents an entity occurs (``n_e``), a term (``n_t``), and both (``n_et``,
the term outside the matches). The share of the entity's information that the term discloses
is their pointwise mutual information over the entity's own information,
``log(N n_et / (n_e n_t)) / log(N / n_e)``. Terms that disclose REMOVE of any entity or more
are removed, those from GENERALISE on are generalised, wherever they occur. A name in the one
text that holds an address discloses all of it; so does one that comes in copies with it.

No pair is left out by a least count, a length or a distance. From ``n_et <= n_e`` follows that
a term can only reach the threshold with ``n_t <= n_e^g N^(1-g)`` (g: GENERALISE); pairs beyond
that are dropped before the shuffle where the term is one of the COMMON most frequent. Entities
that lie in the same documents have the same shares and count once, so a list of addresses that
no other document has is one entity to its document's terms.

All of it is DataFrame expressions. A start inside a run that already failed is never
tried again, and no repetition recurses, so long texts take linear time.

Cases: null text is empty; texts are read whole, positions are code points; exact copies
and repeated rows are documents of their own, and every one is cleaned; a single document discloses
nothing, as all of its terms are in all documents; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqsieve.llm.common import join_few, most_frequent, text_hash, written

_LOCAL = "[A-Za-z0-9._%+-]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

#: By kind: what a text must hold for the pattern to be tried, and the pattern. They match
#: what the plain ones would; lookbehinds and possessive repetitions only save work.
PATTERNS = {
    "email": ("@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (None, r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
KINDS = [*PATTERNS, "generalised", "removed"]
GENERALISE, REMOVE = 0.8, 0.9
#: Terms (of COMMON_LETTERS at most) whose counts are broadcast, the most frequent ones.
COMMON, COMMON_LETTERS = 50_000, 64
#: Hashes of disclosing terms that are broadcast, at most.
BUCKETS = 1 << 20
#: Cards are redacted after the kinds that may hold their digits.
REDACTED = ["email", "phone", "card", "ip"]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def added(total: Column, at: Column) -> Column:
        digit = F.substr(digits, -at, F.lit(1)).cast("int")
        doubled = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(at % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), added) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return _let(_digits(match), lambda d: F.length(d).between(12, 19) & _luhn(d))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _running_sum(values: Column) -> Column:
    """Prefix sums in log2(n) rounds of shift-and-add."""

    def add(sums: Column, shift: Column) -> Column:
        moved = F.concat(F.array_repeat(F.lit(0), shift), F.slice(sums, F.lit(1), F.size(sums) - shift))
        return F.zip_with(sums, moved, lambda a, b: a + b)

    powers = F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.expr("1") * F.pow(F.lit(2), i).cast("int")), lambda s: s < F.size(values))
    return F.aggregate(powers, values, add)


def _parts(text: Column, pattern: Column) -> Column:
    return F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))


def _spans(text: Column, pattern: Column, kind: str) -> Column:
    """All matches with their places; ``text`` holds one at least."""

    def placed(x: Column) -> Column:
        found, between = x["found"], x["between"]
        widths = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda a, b: F.length(a) + F.length(b))

        def one(i: Column, ends: Column) -> Column:
            match = F.get(found, i)
            return F.struct(
                (F.get(ends, i) - F.length(match)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"),
                F.get(ends, i).alias("end"), match.alias("match"),
            )

        return _let(_running_sum(widths), lambda ends: F.transform(F.sequence(F.lit(0), F.size(found) - 1), lambda i: one(i, ends)))

    return _let(_parts(text, pattern), placed)


SPAN = "array<struct<start:int,rank:int,end:int,match:string>>"


def _checked(kind: str) -> Callable[[Column], Column]:
    return lambda span: _valid(kind, span["match"])


def _of_kind(rank: int) -> Callable[[Column], Column]:
    return lambda span: span["rank"] == rank


def _tried(text: Column, kind: str) -> Column:
    """Whether a text holds a match at all."""
    needed, pattern = PATTERNS[kind]
    found = text.rlike(pattern)
    return F.contains(text, F.lit(needed)) & found if needed else found


def base_spans(text: Column) -> Column:
    """Checked matches of all four patterns."""
    none = F.array().cast(SPAN)
    parts = []
    for kind, (_, pattern) in PATTERNS.items():
        valid = F.filter(_spans(text, F.lit(pattern), kind), _checked(kind))
        parts.append(F.when(_tried(text, kind), valid.cast(SPAN)).otherwise(none))
    return F.concat(*parts)


def _replaced(text: Column, pattern: Column, tag: str, valid: Callable[[Column], Column]) -> Column:
    def joined(x: Column) -> Column:
        tags = F.transform(x["found"], lambda m: F.when(valid(m), tag).otherwise(m))
        return F.array_join(F.zip_with(x["between"], F.concat(tags, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")

    return _let(_parts(text, pattern), joined)


def _without_base(text: Column, tag: Callable[[str], str]) -> Column:
    """``text`` with checked matches replaced by the tag of their kind."""
    def clean(kind: str) -> Callable[[Column], Column]:
        replaced = lambda t: _replaced(t, F.lit(PATTERNS[kind][1]), tag(kind), partial(_valid, kind))
        return lambda t: F.when(_tried(t, kind), replaced(t)).otherwise(t)

    for kind in REDACTED:
        text = _let(text, clean(kind))
    return text


def _terms(text: Column) -> Column:
    words = F.split(F.lower(text), r"[^\p{L}]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select("doc_id", text.alias("text"), text_hash(text).alias("row_hash"))


def find_base(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash and base spans of every row; entities (hashed) and terms beside them of rows with any."""
    spans = F.transform(base_spans(F.col("text")), lambda s: F.struct(s["start"], s["rank"], s["end"], F.xxhash64(F.lower(s["match"])).alias("entity")))
    found = _texts(docs).select("doc_id", "row_hash", "text", spans.alias("spans"))
    entities = F.array_distinct(F.transform("spans", lambda s: s["entity"]))
    beside = F.when(F.size("spans") > 0, _terms(_without_base(F.col("text"), lambda kind: " ")))
    plain = F.transform("spans", lambda s: F.struct(s["start"], s["rank"], s["end"]))
    return found.select("doc_id", "row_hash", plain.alias("spans"), entities.alias("entities"), beside.alias("terms"))


def _words(texts: DataFrame) -> DataFrame:
    """(doc_id, row_hash, term): every text's distinct terms."""
    return texts.select("doc_id", "row_hash", F.explode(_terms(F.col("text"))).alias("term"))


def _entity_sets(held: DataFrame) -> DataFrame:
    """row and sets (array of n_e and two sums that tell sets of documents apart) of rows with entities.

    Entities that many rows hold are not the key of a shuffle.
    """
    places = held.select("row", F.explode("entities").alias("entity"))
    sums = [F.count("*").alias("n_e"), F.bit_xor(F.xxhash64("row")).alias("a"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("b")]
    sets = written(places.groupBy("entity").agg(*sums)).select("entity", F.struct("n_e", "a", "b").alias("set"), "n_e")
    both = join_few(places, sets, ["entity"], rows="n_e")
    return both.groupBy("row").agg(F.collect_set("set").alias("sets"))


def revealing_terms(docs: DataFrame, base: DataFrame) -> DataFrame:
    """term and kind (generalised or removed) of the terms that disclose an entity; ``base`` is written."""
    total = base.count()
    held = base.where(F.size("entities") > 0)
    if total < 2 or held.isEmpty():
        return base.select(F.lit("").alias("term"), F.lit("").alias("kind")).limit(0)
    held = written(held.select(F.monotonically_increasing_id().alias("row"), "entities", "terms"))
    counts = written(_words(_texts(docs)).groupBy("term").agg(F.count("*").alias("n_t")))
    short = counts.where(F.length("term") <= COMMON_LETTERS).select("term", F.col("n_t").alias("n"))
    # with a margin for rounding; what passes here is judged by its share
    reach = lambda n_e: F.pow(n_e, F.lit(GENERALISE)) * F.lit(float(total) ** (1 - GENERALISE) * 1.000001)
    rows = held.select("row", "terms").join(_entity_sets(held), "row")
    largest = F.array_max(F.transform("sets", lambda s: s["n_e"]))
    beside = rows.select("sets", reach(largest).alias("reach"), F.explode("terms").alias("term"))
    beside = beside.join(F.broadcast(most_frequent(short, COMMON)), "term", "left")
    able = lambda most: F.col("n").isNull() | (F.col("n") <= most)
    pairs = beside.where(able(F.col("reach"))).select("term", "n", F.explode("sets").alias("set")).where(able(reach(F.col("set.n_e"))))
    pairs = pairs.groupBy("term", "set").agg(F.count("*").alias("n_et"))
    own = F.log2(F.lit(float(total)) / F.col("set.n_e"))
    shared = F.log2(F.lit(float(total)) * F.col("n_et") / (F.col("set.n_e") * F.col("n_t")))
    share = F.when(own > 0, shared / own).otherwise(0.0)
    rated = pairs.join(counts, "term").groupBy("term").agg(F.max(share).alias("share")).where(F.col("share") >= GENERALISE)
    return written(rated.select("term", F.when(F.col("share") >= REMOVE, "removed").otherwise("generalised").alias("kind")))


def _term_pattern(terms: Column) -> Column:
    """Any of the terms as a whole word, outside the tags of redaction; alternatives by first letter."""
    ordered = F.sort_array(terms)
    begun = lambda c: F.transform(F.filter(ordered, lambda t: F.left(t, F.lit(1)) == c), lambda t: F.substr(t, F.lit(2)))
    heads = F.array_distinct(F.transform(ordered, lambda t: F.left(t, F.lit(1))))
    branches = F.transform(heads, lambda c: F.concat(c, F.lit("(?:"), F.array_join(begun(c), "|"), F.lit(")")))
    tags = rf"(?<!\[(?=(?:{'|'.join([*REDACTED, 'term'])})\]))"
    return F.concat(F.lit(rf"(?iu)(?<!\p{{L}}){tags}(?:"), F.array_join(branches, "|"), F.lit(r")(?!\p{L})"))


def _with_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, row_hash, generalised, removed (arrays, null if none) of texts that hold such terms."""
    # up to BUCKETS terms their hashes are told apart, more are folded: what passes is joined either way
    key = F.xxhash64("term") if terms.count() <= BUCKETS else F.pmod(F.xxhash64("term"), F.lit(BUCKETS))
    passing = F.broadcast(terms.select(key.alias("key")).distinct())
    found = _words(_texts(docs)).withColumn("key", key).join(passing, "key", "left_semi").drop("key").join(terms, "term")
    lists = [F.collect_set(F.when(F.col("kind") == k, F.col("term"))).alias(k) for k in ("generalised", "removed")]
    held = found.groupBy("doc_id", "row_hash").agg(*lists)
    return held.select("doc_id", "row_hash", *[F.when(F.size(k) > 0, F.col(k)).alias(k) for k in ("generalised", "removed")])


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["row_hash"] == b["row_hash"])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of start, rank, end) and spans (the same with those of terms) of every row."""
    base = written(find_base(docs))
    terms = revealing_terms(docs, base)
    plain = lambda s: F.struct(s["start"], s["rank"], s["end"])
    spans = base.select("doc_id", "row_hash", F.array_sort("spans").alias("base"))
    if terms.isEmpty():
        return spans.select("doc_id", "base", F.col("base").alias("spans"))
    held, texts = _with_terms(docs, terms), _texts(docs)
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    more = [
        F.coalesce(F.transform(_spans(F.col("text"), _term_pattern(F.col(k)), k), plain), none) for k in ("generalised", "removed")
    ]
    places = texts.join(held, _same_row(texts, held)).select(texts["doc_id"], texts["row_hash"], F.concat(*more).alias("more")).dropDuplicates(["doc_id", "row_hash"])
    joined = spans.join(places, _same_row(spans, places), "left").select(spans["doc_id"], "base", "more")
    return joined.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind and the spans as text, of what ``find`` returns."""
    kinds = F.array(*map(F.lit, KINDS))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")
    counts = [F.size(F.filter("base", _of_kind(i))).cast("bigint").alias(f"n_{k}") for i, k in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with base matches as ``[kind]``, generalised terms as ``[term]``, removed ones gone.

    Texts without any are returned as they are, null ones as null.
    """
    terms = revealing_terms(docs, written(find_base(docs)))
    text = F.col("text")
    names = list(docs.columns)
    if not terms.isEmpty():
        held = _with_terms(docs, terms).select(
            F.col("doc_id").alias("_held_id"), F.col("row_hash").alias("_held_hash"),
            F.col("generalised").alias("_generalised"), F.col("removed").alias("_removed"),
        )
        match = docs["doc_id"].eqNullSafe(F.col("_held_id")) & (text_hash(docs["text"]) == F.col("_held_hash"))
        docs = docs.join(held, match, "left").select(*[docs[c] for c in names], "_generalised", "_removed")
    for kind in REDACTED:
        pattern = PATTERNS[kind][1]
        clean = _replaced(text, F.lit(pattern), f"[{kind}]", partial(_valid, kind))
        docs = docs.withColumn("text", F.when(_tried(text, kind), clean).otherwise(text))
    if not terms.isEmpty():
        for column, tag in (("_removed", ""), ("_generalised", "[term]")):
            clean = _replaced(text, _term_pattern(F.col(column)), tag, lambda m: F.lit(True))
            docs = docs.withColumn("text", F.when(F.col(column).isNotNull(), clean).otherwise(text))
    return docs.select(*names)
