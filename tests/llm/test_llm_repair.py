import hashlib
import heapq
import random
import zlib

import pytest

from seqsieve.llm import repair as R

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACES = " \t\n\x0b\x0c\r"
NOTHING = hashlib.sha256().hexdigest()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """Least cost and audit by uniform-cost search over (place, state), whole strings compared."""
    todo, done = [(0, "", 0, 0)], set()
    while todo:
        cost, audit, at, state = heapq.heappop(todo)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in (0, 3):
            return cost, audit
        for wanted, role in (("u", "user"), ("a", "assistant")):
            if (state, wanted) in R.NEXT:
                heapq.heappush(todo, (cost + 5, audit + "I", at, R.NEXT[state, wanted]))
        if at < len(rows):
            role, fault = rows[at]
            heapq.heappush(todo, (cost + 2, audit + "D", at + 1, state))
            if fault not in "bd":
                more = cost + (5 if fault == "t" else 0)
                if (state, role[:1]) in R.NEXT:
                    heapq.heappush(todo, (more, audit + "K", at + 1, R.NEXT[state, role[:1]]))
                for wanted in "ua":
                    if (state, wanted) in R.NEXT:
                        heapq.heappush(todo, (more + 1, audit + "R", at + 1, R.NEXT[state, wanted]))


def carried_out(rows, audit):
    out, at, state = [], 0, 0
    for edit in audit:
        due = "assistant" if state == 2 else "user"
        if edit == "I":
            said = (due, "")
        else:
            said = (rows[at][0] if edit == "K" else due, rows[at][1])
            at += 1
            if edit == "D":
                continue
        state = R.NEXT[state, said[0][0]]
        out.append(said)
    return out


def plain(rows):
    out = []
    for conv in dict.fromkeys(r[0] for r in rows):
        mine = [r[1:] for r in damaged(rows) if r[0] == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in mine:
            end = text.rstrip(SPACES)
            faults.append("b" if not end else "d" if (role, text) in seen else "k" if end[-1] in ".!?" else "t")
            seen.add((role, text))
        turns = {t for t, *_ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        roles = [role[:1] for _, role, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        cost, audit = cheapest([(m[1], f) for m, f in zip(mine, faults)])
        repaired = "\n".join(f"{role}:{text}" for role, text in carried_out([m[1:] for m in mine], audit))
        out.append((conv, gaps, *[faults.count(f) for f in "bdt"], illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=repr)


def talk(rng, conv, n):
    said = ["Fine.", "what", "Yes! ", "", " \n", "no?", "Ünder the roof.\n", "x" * 70 + ".", "x" * 70 + "y."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    return [(conv, rng.choice([t, t, t, t + 1, None]), rng.choice(roles), rng.choice([*said, f"line {t}.", None])) for t in range(n)]


@pytest.mark.parametrize("seed", range(40))
def test_costs_and_audits_of_random_strings(seed):
    rng = random.Random(seed)
    strings = ["".join(rng.choice(R.LETTERS) for _ in range(rng.randrange(1, 30))) for _ in range(12)]
    strings += [rng.choice(R.LETTERS) * 9, "ABAB" * 6]
    for text, matrix in zip(strings, R.solve(strings)):
        symbols = [R.SYMBOLS[ord(c) - 65] for c in text]
        assert R.answer(matrix) == cheapest([(r, f) for r, f in symbols]), text


def test_grammar_spells_the_strings():
    rng = random.Random(1)
    strings = ["".join(rng.choice("ABC") for _ in range(rng.randrange(0, 60))) for _ in range(30)] + ["A" * 33]
    rules, sequences = R.compressed(strings)

    def spelled(symbol):
        return chr(65 + symbol) if symbol < 16 else "".join(map(spelled, rules[symbol - 16]))

    assert ["".join(map(spelled, s)) for s in sequences] == strings
    assert rules and sum(map(len, sequences)) < sum(map(len, strings)) / 2


def test_ropes_compare_like_strings():
    rng = random.Random(2)
    for _ in range(300):
        texts = ["".join(rng.choice("DK") for _ in range(rng.randrange(9))) for _ in range(2)]
        ropes = []
        for text in texts:
            parts = [R.Rope(text[i : i + 2]) for i in range(0, len(text), 2)] or [R.EMPTY]
            while len(parts) > 1:
                at = rng.randrange(len(parts) - 1)
                parts[at : at + 2] = [R.joined(parts[at], parts[at + 1])]
            ropes.append(parts[0])
        assert R.less(*ropes) == (texts[0] < texts[1]) and list(map(str, ropes)) == texts


def test_random_conversations(spark):
    rng = random.Random(3)
    rows = [row for conv in range(60) for row in talk(rng, conv, rng.randrange(1, 12))]
    rows += talk(rng, None, 6) + rows[:8]
    extra = [(*r, "x", 1, "y") for r in rows]
    df = spark.createDataFrame(extra, SCHEMA + ", piece string, at int, audit string")
    assert found(R.repair(df)) == plain(rows)


def test_long_conversation_in_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 16)
    monkeypatch.setattr(R, "FAN_IN", 3)
    rng = random.Random(4)
    rows = talk(rng, 7, 700) + talk(rng, 8, 5) + [(9, i, ("user", "assistant")[i % 2], "Once more.") for i in range(300)]
    assert found(R.repair(spark.createDataFrame(rows, SCHEMA).repartition(5))) == plain(rows)


def test_edges(spark):
    gone = next(t for t in range(200) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    rows = [(1, gone, "user", "a."), (2, None, None, None), (3, 5, "user", "long word " * 200_000 + "."), (3, 6, "assistant", "b.")]
    rows += [(4, 9, "user", "same.")] * 50
    got = found(R.repair(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows)
    assert (1, 0, 0, 0, 0, 0, 0, "", NOTHING) in got
    assert R.repair(spark.createDataFrame([], SCHEMA)).collect() == []
