import random

import pytest


@pytest.fixture
def words():
    """Invented words from a seeded generator."""
    rng = random.Random(7)
    return lambda n: ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture
def docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"

    def make(rows):
        full = [(i, t, "en", "src0", len(t) if t is not None else None) if len(r) == 2 else r for r in rows for i, t in [r[:2]]]
        return spark.createDataFrame(full, schema)

    return make
