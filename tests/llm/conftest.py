import random

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Further columns, named like what operators use inside.
CLASHING = ["n", "size", "rows", "row_hash", "cid", "token", "pos", "count", "copies", "target", "spans", "ids", "rare", "score", "row_id", "word", "found", "kind", "size"]


@pytest.fixture(scope="session")
def table(spark):
    """A documents table from (doc_id, text, lang, source) rows, with clashing columns on request."""

    def make(rows, clashing=False):
        df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], COLUMNS)
        if clashing:
            extra = spark.createDataFrame(
                [(*r, len(r[1] or ""), *["x"] * len(CLASHING)) for r in rows],
                COLUMNS + "".join(f", {c} string" if i < len(CLASHING) - 1 else ", zz string" for i, c in enumerate(CLASHING)),
            )
            df = extra.withColumnRenamed("zz", "SIZE2")
        return df

    return make


@pytest.fixture(scope="session")
def words():
    """A text of random words of a small vocabulary."""

    def make(seed, n, vocabulary=400):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))

    return make
