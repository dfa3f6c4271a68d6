from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture
def docs(spark):
    """A documents table with extra columns, from (doc_id, text) pairs."""

    def build(pairs):
        rows = [(i, t, "en", None, None if t is None else len(t)) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS)

    return build


def prose(n: int, seed: int) -> str:
    """n invented words, always the same for the same seed."""
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioubcdfgklmnprst") for _ in range(rng.randint(2, 8))) for _ in range(n))
