import random

import pytest
from pyspark.sql import Row

DOCS = "doc_id long, text string, lang string, source string, extra string, size long, n long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, lang, source]), with columns whose names operators use themselves."""

    def make(rows):
        full = [(*r, *("en", "s")[len(r) - 2 :], "x", 5, 6) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def texts():
    """Random texts over few words, with passages in common, copies, and the awkward cases."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)] + ["É", "ß—x", "A", "a"]
    passage = [" ".join(rng.choices(words, k=n)) for n in (8, 25, 60)]
    rows = [(0, None), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, "one"), (4, "one"), (5, "One\u00a0x"), (6, "w1 " * 300)]
    for k in range(7, 60):
        parts = [" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(rng.randrange(1, 4))]
        parts.insert(rng.randrange(len(parts) + 1), rng.choice(passage))
        rows.append((k, rng.choice(["\n", "  ", " "]).join(parts)))
    rows += [(60, rows[20][1]), (61, rows[20][1].upper()), (62, rows[21][1] + " tail"), (63, "x" * 5000), (64, " ".join(f"long{k % 700}" for k in range(20_000)))]
    return rows


@pytest.fixture(scope="session")
def row():
    return Row
