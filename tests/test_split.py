import random

import pytest
from pyspark.sql import functions as F

from seqsieve.operators import split as SP


def n_parts_by_hand(sizes, n_parts):
    """Sequential rule: open a part when overshooting its end exceeds undershooting it."""
    total, part, written, here, out = sum(sizes), 1, 0, 0, []
    end = int(total / n_parts)
    for i, size in enumerate(sizes):
        after = written + size
        if i and here and after > end and after - end > end - written:
            part, here = part + 1, 0
            end = int(total / n_parts * part) + 1
        here, written = here + size, after
        out.append(part)
    return out


def part_size_by_hand(sizes, limit):
    part, here, out = 1, 0, []
    for size in sizes:
        if here and here + size > limit:
            part, here = part + 1, 0
        here += size
        out.append(part)
    return out


def sizes_frame(spark, sizes):
    rows = [(i, s) for i, s in enumerate(sizes)]
    return spark.createDataFrame(rows, "ord bigint, size bigint").repartition(3)


def parts(df):
    return [r["part"] for r in df.orderBy("ord").collect()]


@pytest.mark.parametrize("seed", range(6))
def test_splits_follow_the_sequential_rules(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(SP, "CHUNK", rng.choice([3, 10, 1000]))
    sizes = [rng.choice([0, 0, 1, 2, 5, 9, 200]) for _ in range(rng.choice([1, 40, 90]))]
    sizes[rng.randrange(len(sizes))] = 7
    df = sizes_frame(spark, sizes)
    n = rng.choice([1, 2, 5, 30, 200])
    assert parts(SP.split_n_parts(df, n, "ord", F.col("size"))) == n_parts_by_hand(sizes, n)
    limit = rng.choice([1, 5, 20, 300])
    got = parts(SP.split_part_size(df, limit, "ord", F.col("size")))
    assert got == part_size_by_hand(sizes, limit)


def test_record_sizes(spark):
    df = spark.createDataFrame([("ab c", "A" * 250), ("x", "")], "name string, seq string")

    def size(*args, **kw):
        return [r[0] for r in df.select(SP.record_size(F.col("name"), F.col("seq"), *args, **kw)).collect()]

    assert size() == [4 + 1 + 250 + 1 + 3, 1 + 1 + 1]
    assert size("seq") == [250, 0]
    assert size("count") == [1, 1]
    assert size("all", 0, "\r\n") == [4 + 1 + 250 + 4, 1 + 1 + 4]
    with pytest.raises(ValueError):
        size("bytes")
