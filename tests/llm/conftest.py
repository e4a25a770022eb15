import random

import pytest

EXTRA = "lang string, source string, n_chars long, score double, size long, label int"


@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture
def docs_of(spark):
    """Documents from (id, text) or (id, text, source) rows, with columns whose names clash with the operators' own."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 0.5, 7, 1) for r in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, {EXTRA}").repartition(3)

    return make
