import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=None):
    words = words or [a + b + c for a in ("th", "an", "re", "st", "on", "er") for b in ("a", "e", "i", "o") for c in ("n", "r", "s", "t", "l")]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows, odd characters."""
    rng = random.Random(1)
    long = "\n".join(prose(rng, 40) for _ in range(1500))
    texts = [None, "", "   ", "\n\n", "one", "a\x00b \t c", "Zürich ΣΑΣ İstanbul 中文 🙂 ▁x▁", "x<|endoftext|>y it's", " lead\r\n  two  ", long, "same text here " * 30, "same text here " * 30, prose(rng, 200), prose(rng, 60)]
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, len(t) if t else None) for i, t in enumerate(texts)]
    return [*rows, rows[12], rows[12], (None, "no id at all " * 20, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(odd):
    """Columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    names = ("n", "set", "token", "node", "block", "score", "y", "part", "a", "b", "at", "keeper", "words", "line", "version", "n_tokens", "n_lines", "n_dropped", "held_out", "component_id", "w", "k", "text_", "order", "bucket", "whole", "rest", "key", "id", "domain", "tokens", "supply", "quota", "_domain", "_tokens", "_copies", "_whole", "_rest", "_leaf_lang", "leaf_lang", "whole_", "out", "tie", "_drop_id", "_drop_at", "drop_id", "drop_at", "_mark", "_copy", "_v", "_id", "_version", "_removed", "_one", "bucket_", "fit", "edge", "x", "places", "chunks")
    return odd.select("*", *[F.lit("clash").alias(n) for n in names])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
