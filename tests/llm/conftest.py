"""Small tables with the odd cases every operator must take."""

from __future__ import annotations

import pytest

VERY_LONG = "the quick brown fox jumps over the lazy dog " * 4000
ODD_TEXTS = [None, "", " \n\t ", "a", "one two three", "Hello, wörld! 漢字 it's 3.5 kg", VERY_LONG, "<|endoftext|>tail", "same text here for two rows", "same text here for two rows", "12 34 !!", "x" * 3000]


@pytest.fixture(scope="session")
def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, a null and a repeated id, and columns named like results."""
    rows = [(i, t, "en", 0.5, "row") for i, t in enumerate(ODD_TEXTS)] + [(None, "no id at all", None, None, None), (3, "a", "en", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, row string").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
