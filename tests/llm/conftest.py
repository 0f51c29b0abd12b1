from __future__ import annotations

import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=""):
    """Documents from (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0",
             None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


@pytest.fixture(scope="session")
def words():
    rnd = random.Random(5)
    return ["".join(rnd.choice("abcdefghijklmnoprstu") for _ in range(rnd.randint(2, 9))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_rows(words):
    """Null and empty texts, a very long one, ties, repeated rows and a null id."""
    rnd = random.Random(6)
    base = " ".join(rnd.choice(words) for _ in range(80))
    return [(1, None), (2, ""), (3, base), (4, base), (5, base), (6, base + " " + base), (7, " \n\t "), (7, " \n\t "),
            (8, "\n".join(rnd.choice(words) + " " + rnd.choice(words) + " tail of a line" for _ in range(3000))),
            (9, "é" * 40 + "\n" + "é" * 40), (None, base), (3, base)]
