from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, vertex string, rep string"


@pytest.fixture(scope="session")
def prose():
    """Deterministic invented words."""
    rng = random.Random(7)
    return lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Nulls, empty and long texts, repeated rows and ids, and columns whose names the operators use themselves."""
    base, other = prose(120), prose(120)
    near = " ".join(w if i != 60 else "changed" for i, w in enumerate(base.split()))
    rows = [(1, base), (2, near), (3, other), (4, None), (5, ""), (6, "   \n\t "), (7, "two words"), (8, "Two  WORDS"), (9, base),
            (9, base), (10, None), (None, base), (None, None), (11, prose(20_000)), (12, "x" * 50_000), (13, "one " * 300),
            (14, f"{prose(40)} {base} {prose(40)}"), (15, "\n".join([other] * 3))]
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i != 3 else None, len(t or ""), 5, "v", "r") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
