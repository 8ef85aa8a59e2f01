"""Token counts by a tokenizer file, where bytes won't do."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=4)
def _tokenizer(path: str):  # noqa: ANN202
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their names in a text are ordinary text
    return t


def tokenizer_count(text: Column | str, path: str) -> Column:
    """Tokens of ``text`` by the tokenizer in the file at ``path`` on every worker; null: 0."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _tokenizer(path)
        for texts in batches:
            yield pd.Series([len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)], dtype="int64")

    return count(F.col(text) if isinstance(text, str) else text)
