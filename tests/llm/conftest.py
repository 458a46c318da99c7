from __future__ import annotations

import pyarrow.parquet as pq
import pytest
from conftest import SMALL

#: Null, empty, blank, one word, a very long word, repeated text, other scripts, odd white space.
ODD_TEXTS = [
    None, "", " ", "\n\t", "a", "A", "the", "one two", "one two", "x" * 5000, "word " * 3000, "Ünï cödé ß ﬁ 𝒳 中文 字",
    "a\x00b\x1cc\x85d e", "  lead and trail  ", "▁▁ mark ▁", "<s> </s> <unk> <|endoftext|>", "don't I'LL it's", "12 345 6.7",
    "tie tie tie", "tie tie tie", "é é ́x", "!!! ??? ***", "\r\nline one\r\nline two\r\n",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward texts with null and repeated ids, and columns whose names the operators use themselves."""
    rows = [(i, t, "l", "s", 1, "x", [1]) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id", None, None, None, None, None), (3, ODD_TEXTS[3], "l", "s", 1, "x", [1])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, pieces array<int>").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def small():
    """The documents of the smallest tables as rows."""
    return pq.read_table(f"{SMALL}/documents.parquet").to_pylist()


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
