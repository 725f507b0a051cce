import random
import re
from itertools import permutations

from seqsieve.llm import audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failures(rows):
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = set()
        failed |= {"A"} if len(words) < 200 else set()
        failed |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        failed |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        failed |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        failed |= {"E"} if i is not None and i > least[text] else set()
        out.append(failed)
    return out


def plain(rows, labels):
    failed = failures(rows)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = []
    for part in {r[2] or "" for r in rows}:
        here = [(r, f) for r, f in zip(rows, failed) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        found = []
        for order in permutations("ABCDE"):
            left = here
            for step, name in enumerate(order, 1):
                gone = [r for r, f in left if name in f]
                failing = sum(name in f for _, f in here)
                left = [(r, f) for r, f in left if name not in f]
                shapley[name] += len(gone)
                found.append([
                    part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(f == {name} for _, f in here),
                    sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone), name,
                ])
        out += [(*row[:-1], shapley[row[-1]]) for row in found]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def sample(seed, n=120):
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        words = [f"w{rng.randrange(rng.choice([5, 2000]))}" for _ in range(rng.choice([3, 199, 200, 250]))]
        words[0] = rng.choice(["plain", "A" * 40, "x|y", ""])
        texts.append(" ".join(words))
    rows = [(i, rng.choice([t, texts[0], None, ""]), rng.choice(["de", "en", None, ""]), "s") for i, t in enumerate(texts)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, n, 2)]
    return rows, labels


def test_all_orders(spark, table):
    rows, labels = sample(1)
    rows += rows[:5] + [(None, rows[0][1], "en", "s"), (None, None, None, None)]
    labels += [(0, 1, 1), (None, 1, 1)]
    marked = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert got(audit.interactions(table(rows, clashing=True), marked)) == plain(rows, labels)


def test_hot_text_and_long_text(spark, table):
    rows = [(i, "the same text", "en", "s") for i in range(60)] + [(100, "Long text|" * 60_000, "en", "s")]
    marked = spark.createDataFrame([(3, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert got(audit.interactions(table(rows), marked)) == plain(rows, [(3, 1, 0)])


def test_empty_tables(spark, table):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit.interactions(table([(1, "a", "en", "s")]).limit(0), none).collect() == []
    assert got(audit.interactions(table([(1, "a", "en", "s")]), none)) == plain([(1, "a", "en", "s")], [])


def test_clean_rows_alone(spark, table):
    text = " ".join(f"w{i}" for i in range(300))
    assert all(r.kept == 1 and r.removed == 0 for r in audit.interactions(table([(1, text, "en", "s")]), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect())
