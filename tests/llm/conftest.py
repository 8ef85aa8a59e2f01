from __future__ import annotations

import itertools

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(texts):
    return [(i, t, "en" if i % 2 else None, f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture
def write(spark, tmp_path):
    """Writes texts (or whole rows) as a documents table, with labels; returns the folder."""
    number = itertools.count()

    def make(texts, schema=SCHEMA, labels=()):
        d = f"{tmp_path}/sf{next(number)}"
        data = list(texts)
        if schema == SCHEMA and not (data and isinstance(data[0], tuple)):
            data = rows(data)
        spark.createDataFrame(data, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        return d

    return make


LONG = " ".join(f"word{i % 7919}" for i in range(60_000))
#: Nulls, empty and blank texts, repeats, ties, other scripts, no white space, and a long text.
ODD = [None, "", "  \n\t ", "a", "a", "a ", "same text here for all of us now", "same  text here for all of us now", "ñandú 😀 世界", "x" * 30_000, LONG, "\x00 nul ퟿", "▁ mark ▁▁", None]


@pytest.fixture
def odd():
    return ODD
