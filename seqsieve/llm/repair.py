"""Cheapest repair of conversations, by dynamic programming over a grammar of their symbols.

Every row of a conversation is one symbol: its role's initial and its first fault. A piece of a
conversation is a string of symbols; the pieces of a batch are compressed together by Re-Pair
(the most frequent neighbours become a rule, again and again), and every rule has one min-plus
transfer matrix between the states of the wanted role order: the least cost and, as a rope that
shares its parts, the least audit of that cost. A rule's matrix is the product of its two sides,
computed once and shared by all conversations of the batch in which the rule occurs.

Rows get their place by a range partitioning on conversation and turn, not by sorting a group, so
one long conversation lies in many tasks. It is cut into pieces of at most PIECE rows; their
matrices are multiplied in rounds of FAN_IN. Only the digest of the repaired text reads a
conversation in one task, as SHA-256 reads its input in order; it streams the rows.

Equal-cost audits of one stretch between the same states never begin with one another (the longer
one would have more insertions after the same edits, which cost more), so the least of two is
also the least with anything behind it, and ropes may be compared before they are joined.

Cases: a null conversation is one conversation; a null role or text is one space; null turns come
first; rows equal in turn are ordered by role, the text's first 64 characters and its
digest, and repeated rows stay and are duplicates
after the first; a conversation without rows keeps its place with zeros, an empty audit and the
digest of nothing; an empty table gives an empty result; further columns are ignored. Long texts
are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from seqsieve.llm.common import join_few, on_workers, written

PIECE = 4096
FAN_IN = 64
BATCH = 200_000  # symbols compressed together

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a. The wanted order is (s?(ua)+)?.
STATES = 4
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
ROLES = "suao"  # o: any other initial
FAULTS = "kbdt"  # none, blank, duplicate, truncated
SYMBOLS = [r + f for r in ROLES for f in FAULTS]
#: A symbol as one letter, so that a piece is a string.
LETTERS = "ABCDEFGHIJKLMNOP"


# ------------------------------------------------------------------------- ropes
class Rope:
    """A string as a leaf or a pair of ropes, with its length and a hash that tells equal ones."""

    __slots__ = ("text", "left", "right", "size", "hash")
    MOD = (1 << 61) - 1
    BASE = 911_382_323_123_457

    def __init__(self, text: str | None = None, left: Rope | None = None, right: Rope | None = None) -> None:
        self.text, self.left, self.right = text, left, right
        if text is not None:
            self.size, value = len(text), 0
            for char in text:
                value = (value * self.BASE + ord(char)) % self.MOD
            self.hash = value
        else:
            self.size = left.size + right.size
            self.hash = (left.hash * pow(self.BASE, right.size, self.MOD) + right.hash) % self.MOD

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            rope = todo.pop()
            if rope.text is None:
                todo += [rope.right, rope.left]
            else:
                out.append(rope.text)
        return "".join(out)


EMPTY = Rope("")


def joined(left: Rope, right: Rope) -> Rope:
    if not left.size:
        return right
    return Rope(left=left, right=right) if right.size else left


def less(a: Rope, b: Rope) -> bool:
    """Whether a comes before b; equal stretches are passed by their hashes."""
    first, second = [a], [b]
    while first and second:
        x, y = first.pop(), second.pop()
        if x is y or (x.size == y.size and x.hash == y.hash):
            continue
        if x.text is None and (y.text is not None or x.size >= y.size):
            first += [x.right, x.left]
            second.append(y)
        elif y.text is None:
            second += [y.right, y.left]
            first.append(x)
        else:
            n = min(x.size, y.size)
            if x.text[:n] != y.text[:n]:
                return x.text[:n] < y.text[:n]
            if x.size > n:
                first.append(Rope(x.text[n:]))
            if y.size > n:
                second.append(Rope(y.text[n:]))
    return bool(second) and not first


# ----------------------------------------------------------------------- matrices
# A matrix is {(from, to): (cost, rope)}; pairs that no edits lead through are absent.


def better(new: tuple, old: tuple | None) -> bool:
    return old is None or new[0] < old[0] or (new[0] == old[0] and less(new[1], old[1]))


def product(a: dict, b: dict) -> dict:
    out: dict = {}
    after: dict[int, list] = {}
    for (source, target), entry in b.items():
        after.setdefault(source, []).append((target, entry))
    for (source, middle), (cost, rope) in a.items():
        for target, (more, rest) in after.get(middle, ()):
            old = out.get((source, target))
            if old is None or cost + more <= old[0]:
                new = (cost + more, joined(rope, rest))
                if better(new, old):
                    out[source, target] = new
    return out


def insertions() -> dict:
    """Any number of inserted rows (longer runs than needed only cost more)."""
    one = {(s, t): (INSERT, Rope("I")) for (s, role), t in NEXT.items() if role in "ua"}
    out = {(s, s): (0, EMPTY) for s in range(STATES)}
    for _ in range(2):
        for key, entry in product(out, one).items():
            if better(entry, out.get(key)):
                out[key] = entry
    return out


def row_matrix(role: str, fault: str) -> dict:
    """Edits of one row."""
    out = {(s, s): (DELETE, Rope("D")) for s in range(STATES)}
    if fault in "bd":
        return out
    extra = TRUNCATED if fault == "t" else 0
    for (source, wanted), target in NEXT.items():
        options = [(KEEP, "K")] if wanted == role else []
        options += [(REROLE, "R")] if wanted in "ua" and wanted != role else []
        for cost, edit in options:
            new = (cost + extra, Rope(edit))
            if better(new, out.get((source, target))):
                out[source, target] = new
    return out


INSERTED = insertions()
TERMINALS = {letter: product(INSERTED, row_matrix(*symbol)) for letter, symbol in zip(LETTERS, SYMBOLS, strict=True)}


# ------------------------------------------------------------------------ Re-Pair
def compressed(strings: list[str]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Rules (pairs of symbols, numbered from the number of letters on) and the strings in them.

    While some pair of neighbours occurs twice, the most frequent one becomes a rule; frequent
    pairs that share no symbol with a chosen one are replaced in the same round.
    """
    gap = -1
    pieces = [np.frombuffer(s.encode(), np.uint8).astype(np.int64) - ord(LETTERS[0]) for s in strings]
    text = np.concatenate([np.append(p, gap) for p in pieces]) if pieces else np.zeros(0, np.int64)
    rules: list[tuple[int, int]] = []
    while len(text) > 1:
        limit = len(LETTERS) + len(rules)
        inside = (text[:-1] != gap) & (text[1:] != gap)
        pairs, counts = np.unique(text[:-1][inside] * limit + text[1:][inside], return_counts=True)
        frequent = np.flatnonzero(counts > 1)
        frequent = frequent[np.argsort(-counts[frequent], kind="stable")]
        used: set[int] = set()
        fresh: dict[int, int] = {}
        for at in frequent.tolist():
            left, right = divmod(int(pairs[at]), limit)
            if left in used or right in used:
                continue
            used |= {left, right}
            fresh[int(pairs[at])] = len(LETTERS) + len(rules)
            rules.append((left, right))
        if not fresh:
            break
        code = np.where(inside, text[:-1] * limit + text[1:], -1)
        keys = np.array(sorted(fresh))
        place = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
        hit = keys[place] == code
        # of overlapping occurrences (only of a pair of equal symbols) every second one counts
        at = np.flatnonzero(hit)
        run = np.arange(len(at)) - np.maximum.accumulate(np.where(np.diff(at, prepend=-2) == 1, 0, np.arange(len(at))))
        at = at[run % 2 == 0]
        text = text.copy()
        text[at] = np.array([fresh[k] for k in keys.tolist()])[place[at]]
        text = np.delete(text, at + 1)
    out, current = [], []
    for symbol in text.tolist():
        if symbol == gap:
            out.append(current)
            current = []
        else:
            current.append(symbol)
    return rules, out


def solve(strings: list[str]) -> list[dict]:
    """The transfer matrix of each string, without insertions behind its last row."""
    rules, sequences = compressed(strings)
    matrices = [TERMINALS[letter] for letter in LETTERS]
    for left, right in rules:  # bottom-up: a rule's sides come before it
        matrices.append(product(matrices[left], matrices[right]))
    out = []
    for sequence in sequences:
        # halving keeps the ropes flat
        parts = [matrices[s] for s in sequence]
        while len(parts) > 1:
            parts = [product(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        out.append(parts[0] if parts else {(s, s): (0, EMPTY) for s in range(STATES)})
    return out


def answer(matrix: dict) -> tuple[int, str]:
    """Least cost and its least audit from the start to an end of the wanted order."""
    best = None
    for (source, target), entry in product(matrix, INSERTED).items():
        if source == 0 and target in FINAL and better(entry, best):
            best = entry
    return best[0], str(best[1])


# --------------------------------------------------------------------------- Spark
_NOT_BLANK = r"[^\x20\x09-\x0D]"


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage; nulls of role and text are a space."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    plain = rows.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("kind")
    )
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return plain.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def placed_rows(rows: DataFrame) -> DataFrame:
    """Rows with ``at``, which rises in the order of the conversation, and what faults need."""
    digest = F.unhex(F.sha2("text", 256))
    # a row number of the scan splits even rows that are equal throughout
    keyed = rows.select("*", digest.alias("digest"), F.monotonically_increasing_id().alias("nth"))
    order = ["conv_id", "turn", "role", F.substring("text", 1, 64), "digest", "nth"]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*+\z", 1)
    return written(ordered.select(
        "conv_id", "turn", "role", "text", "digest", F.monotonically_increasing_id().alias("at"),
        (~F.col("text").rlike(_NOT_BLANK)).alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"),
    ))


def _symbols(rows: DataFrame) -> DataFrame:
    """conv_id, at and the letter of every row."""
    said = ["conv_id", "role", "digest"]
    slim = rows.select(*said, "at", "blank", "truncated")
    first = slim.groupBy(*said).agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    slim = join_few(slim, first, said, "left", rows="n")
    fault = F.when(F.col("blank"), 1).when(F.col("at") > F.col("first"), 2).when(F.col("truncated"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return slim.select("conv_id", "at", F.char(role * len(FAULTS) + fault + ord(LETTERS[0])).alias("letter"))


_MATRIX = "costs array<bigint>, audits array<string>"
_PIECES = f"conv_id {{}}, piece bigint, rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, cost bigint, audit string, {_MATRIX}"


def _entries(matrix: dict) -> tuple[list, list]:
    """A matrix as lists by from and to; absent pairs are null."""
    keys = [(s, t) for s in range(STATES) for t in range(STATES)]
    costs = [matrix[k][0] if k in matrix else None for k in keys]
    return costs, [str(matrix[k][1]) if k in matrix else None for k in keys]


def _matrix_of(costs: list, audits: list) -> dict:
    return {
        divmod(i, STATES): (cost, Rope(audit)) for i, (cost, audit) in enumerate(zip(costs, audits, strict=True)) if cost is not None
    }


def _illegal(pair: str) -> bool:
    return pair not in ("su", "ua", "au")


def _summary(letters: str) -> tuple:
    symbols = [SYMBOLS[ord(c) - ord(LETTERS[0])] for c in letters]
    roles, faults = "".join(s[0] for s in symbols), "".join(s[1] for s in symbols)
    illegal = sum(_illegal(roles[i : i + 2]) for i in range(len(roles) - 1))
    return len(roles), *[faults.count(f) for f in "bdt"], illegal, roles[0], roles[-1]


def _solved(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pieces, texts = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size + len(texts[end]) <= BATCH:
                    size += len(texts[end])
                    end += 1
                different = sorted(set(texts[at:end]))
                found = {t: (*_summary(t), *answer(m), *_entries(m)) for t, m in zip(different, solve(different), strict=True)}
                rows = [(p, *found[t]) for p, t in zip(pieces[at:end], texts[at:end], strict=True)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at), *columns], schema=schema)
                at = end

    return run


def _merged(schema: pa.Schema):
    """The pieces of one group, in order, as one piece."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
        total = dict(rows[0])
        matrices = [_matrix_of(r["costs"], r["audits"]) for r in rows]
        while len(matrices) > 1:
            matrices = [product(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
        for row in rows[1:]:
            for name in ("rows", "blank", "duplicate", "truncated", "illegal"):
                total[name] += row[name]
            total["illegal"] += _illegal(total["tail"] + row["head"])
            total["tail"] = row["tail"]
        total["cost"], total["audit"] = answer(matrices[0])
        total["costs"], total["audits"] = _entries(matrices[0])
        return pa.Table.from_pylist([total], schema=schema)

    return run


def _arrow(schema: str, conv_type: pa.DataType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.schema([(name, conv_type if name == "conv_id" else kinds[kind]) for name, kind in fields])


def _whole(symbols: DataFrame) -> DataFrame:
    """One row of counts and matrix per conversation that has rows."""
    kind = symbols.schema["conv_id"].dataType
    schema = _PIECES.format(kind.simpleString())
    arrow = _arrow(schema, to_arrow_type(kind))
    piece = F.shiftright("at", PIECE.bit_length() - 1).alias("piece")
    strings = symbols.groupBy("conv_id", piece).agg(F.sort_array(F.collect_list(F.struct("at", "letter"))).alias("rows"))
    strings = strings.select("conv_id", "piece", F.array_join(F.transform("rows", lambda r: r["letter"]), "").alias("letters"))
    pieces = written(strings.mapInArrow(_solved(arrow), schema))
    # pieces are numbered anew, without holes: a sort of one row per PIECE rows of text
    ordered = Window.partitionBy("conv_id").orderBy("piece")
    every = Window.partitionBy("conv_id")
    marked = pieces.withColumn("_of", F.count("*").over(every)).withColumn("_number", F.row_number().over(ordered) - 1)
    done, open_ = marked.where("_of = 1").drop("_of", "_number"), marked.where("_of > 1")
    if open_.isEmpty():
        return done
    open_ = written(open_.withColumn("piece", F.col("_number").cast("bigint")).drop("_of", "_number"))
    while True:
        group = F.floor(F.col("piece") / FAN_IN).alias("group")
        merged = open_.withColumn("group", group).groupBy("conv_id", "group").applyInArrow(
            lambda t: _merged(arrow)(t.drop_columns(["group"])), schema
        )
        open_ = written(merged.withColumn("piece", F.floor(F.col("piece") / FAN_IN).cast("bigint")))
        if open_.where("piece > 0").isEmpty():
            return done.unionByName(open_)


def _digests(schema: pa.Schema):
    """SHA-256 of each conversation's repaired rows, which come in order behind its audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list = []

        def closed() -> list[tuple]:
            return [(open_[0], open_[1].finish())] if open_ else []

        for batch in batches:
            out = []
            for conv, audit, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if audit is not None:
                    out += closed()
                    open_ = [conv, _Repaired(audit)]
                else:
                    open_[1].add(role, text)
            yield _digest_rows(out, schema)
        yield _digest_rows(closed(), schema)

    return run


def _digest_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], schema.types[i]) for i in range(2)], schema=schema
    )


class _Repaired:
    """Carries out an audit row by row; the state tells which role is due."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.first = audit, 0, 0, True
        self.hash = hashlib.sha256()

    def put(self, role: str, text: str) -> None:
        self.hash.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
        self.first = False
        self.state = NEXT[self.state, role[0]]

    def due(self) -> str:
        return "assistant" if self.state == 2 else "user"

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.put(self.due(), "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.put(role if edit == "K" else self.due(), text)

    def finish(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def repair(conversations: DataFrame) -> DataFrame:
    """One row of faults, cost, audit and digest per conversation of the table."""
    on_workers(conversations.sparkSession)
    conversations = conversations.select("conv_id", "turn", "role", "text")
    rows = placed_rows(damage(conversations))
    whole = _whole(_symbols(rows))
    kind = conversations.schema["conv_id"].dataType

    faults = whole.select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    audits = faults.select("conv_id", "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(-1).cast("bigint").alias("at"))
    said = rows.select("conv_id", F.lit(None).cast("string").alias("audit"), "role", "text", "at")
    stream = audits.unionByName(said).repartition("conv_id").sortWithinPartitions("conv_id", "at").drop("at")
    digests = stream.mapInArrow(
        _digests(pa.schema([("conv_id", to_arrow_type(kind)), ("repaired_sha256", pa.string())])), f"conv_id {kind.simpleString()}, repaired_sha256 string"
    )
    turns = rows.select("conv_id", "turn").distinct().groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps")
    )
    every = conversations.select("conv_id").distinct()
    for part in (turns, faults, digests):
        part = part.withColumnRenamed("conv_id", "_same")
        every = every.join(part, every["conv_id"].eqNullSafe(part["_same"]), "left").drop("_same")
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return every.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
