import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and very long texts, odd white space, repeated rows, near copies, benchmark passages, secrets."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeéßü", k=rng.randint(1, 9))) for _ in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(5, 120))).capitalize() + "." for _ in range(30)]
    passage = " ".join(rng.choices(words, k=60))
    line = "This Line Stands In Many Documents, word for word."
    texts = [None, "", " ", "\n", "\n\n \t", "x", "Ünïcödé ß " * 3, "\x1c a\x0bb\x0cc  d\r\ne", "no-space" * 4000, "ab " * 20_000, "a\x00b " * 3]
    texts += base + base[:6] + [b.replace(" ", " x ", 1) for b in base[:6]]
    texts += [f"{b}\n{line}\n{passage}" for b in base[:5]] + [f"{line.upper()}  \n{b}" for b in base[5:9]]
    texts += [f"{b} password = 'hunter22xyz9' AKIA{'A1B2' * 4} {'0a1b2c3d' * 5}" for b in base[9:12]] + ["<|endoftext|> a<|endoftext|>", "123 456,789 don't WE'LL", "😀😀 é" * 5]
    return texts


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    """As documents, with a null id and a column that clashes with operators' own."""
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(odd_texts)] + [(None, "no id here", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit("mine").alias(c) for c in ("n_lines", "ids", "n_tokens", "fp", "score", "key", "row", "x", "media", "component_id")])
