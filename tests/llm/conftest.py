import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, shard string, component_id string"


@pytest.fixture(scope="session")
def odd_texts():
    random.seed(3)
    syllables = ["the", "on", "an", "tion", "é", "ß", "Re", "x", "ing"]
    word = lambda: "".join(random.choices(syllables, k=random.randrange(1, 4)))
    prose = [" ".join(word() for _ in range(random.randrange(1, 120))) for _ in range(12)]
    return [None, "", " ", "\n\t  \n", "a", "  two  blanks ", "it's I'LL don't 'S", "<|endoftext|>x <|endoftext|> <|startoftext|>", "日本語　テスト x", "🎉🎉 party",
            "é ẞ Σας İ", "\x1c\x1d\x85 z\xa0q", "1234567 8 9a", "a" * 30_000, "ab " * 9_000, "\U000e0001 ՘ ֋", *prose, *prose[:3]]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [(i, t, None, "s", None, "x", "y", "z") for i, t in enumerate(odd_texts)]
    rows += [rows[4], rows[4], (None, "no id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
