import random

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def prose():
    """Random words of a fixed vocabulary; equal seeds give equal texts."""
    def make(seed, n):
        rng = random.Random(seed)
        return [rng.choice("ae io un st ver lan dor mi").strip() + rng.choice(["ta", "ne", "lo", "shi", "ra"]) * rng.randint(1, 3)
                + str(rng.randint(0, 400)) for _ in range(n)]
    return make


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text) as a table of documents, with columns whose names the operators use inside."""
    def make(rows, partitions=3):
        full = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
        table = spark.createDataFrame(full, DOCUMENTS).repartition(partitions)
        return table.selectExpr("*", "1 AS cls", "'x' AS ids", "2 AS term", "3 AS score", "'y' AS spans", "4 AS _text", "5 AS code")
    return make
