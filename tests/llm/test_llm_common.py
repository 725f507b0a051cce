import os

from pyspark.sql import functions as F

from seqsieve.llm.common import forget, most_frequent, written


def test_most_frequent_keeps_to_the_limit(spark):
    counts = spark.createDataFrame([(f"w{i}", n) for i, n in enumerate([1] * 50 + [2] * 20 + [3] * 10 + [900, 1000, 5000])], "word string, n bigint")
    for limit, kept in ((0, 0), (2, 2), (3, 3), (12, 3), (13, 13), (40, 33), (83, 83)):
        assert most_frequent(counts, limit).count() == kept
    assert most_frequent(counts.limit(0), 5).collect() == []
    assert most_frequent(counts, 13).agg(F.min("n")).head()[0] == 3


def test_written_tables_go_when_forgotten(spark):
    table = written(spark.range(5))
    path = table._scratch.removeprefix("file:")
    assert table.count() == 5 and os.path.isdir(path)
    forget(table)
    assert not os.path.exists(path)
