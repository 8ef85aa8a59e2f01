"""Pieces that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from tessera.functions.storage import kept

#: The white space that all operators of this subpackage know: space and \t \n \v \f \r.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: A word, for Java's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here."""
    return kept(df, what)


def on_files(docs: DataFrame, what: str) -> DataFrame:
    """``docs`` as a plain read of Parquet files, whose rows have places (file and row in
    it): itself if it is one already, else written and read again."""
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        with suppress(AnalysisException):  # files of other formats, or no files
            docs.select(*places(docs).values())
            return docs
    return stored(docs, what)


def places(docs: DataFrame) -> dict[str, Column]:
    """The file and the row in it of each row of a plain read of Parquet files."""
    hidden = docs.metadataColumn("_metadata")
    return {"__tessera_file": hidden["file_path"], "__tessera_row": hidden["row_index"]}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def squeezed(text: Column) -> Column:
    """``text`` without any white space; byte-level replacements, no regular expression."""
    for c in SPACE_CHARS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def n_words(text: Column) -> Column:
    """Number of words of ``text`` (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of at most ``rows`` rows and, but for single rows, ``size``
    bytes of strings, so that a worker holds few texts as Python objects; at the end the
    worker gives back what Arrow kept."""
    for b in batches:
        wide = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
                wide += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(wide), 0
        while at < b.num_rows:
            full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            to = min(max(full, at + 1), at + rows, b.num_rows)
            yield b.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[bool, str, pa.RecordBatch]]:
    """The rows of equal ``column``, which come together: whether they are the first of their
    key, the key, and as many of its rows as a batch holds."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b[column]
        cuts = (np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)) + 1).tolist()
        for at, to in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            key = keys[at].as_py()
            yield key != last, key, b.slice(at, to - at)
            last = key


def batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """``rows`` in batches of at most ``most`` rows and, but for single rows, ``size`` characters."""
    held, wide = [], 0
    for row in rows:
        held.append(row)
        wide += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= most or wide >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, wide = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str, cells: int = 1024) -> DataFrame:
    """Adds ``name``: a gapless rank from 0 of each row within its ``keys``.

    A key may hold any share of the rows: rows of a key are dealt by a hash of
    ``order`` over ``cells`` cells, ranked inside each cell by ``order``, and moved up
    by the number of rows in the cells before. Only the counts of cells (at most
    ``cells`` a key) meet in one task; ``order`` must tell rows apart for the rank to
    be deterministic. Keys must not be null.
    """
    cell, start = "__cell", "__start"
    dealt = df.withColumn(cell, F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    counts = dealt.groupBy(*keys, cell).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(cell).alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(start))
    numbered = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*keys, cell).orderBy(*order)) - 1)
    on = [numbered[k] == starts[f"__k{i}"] for i, k in enumerate(keys)] + [numbered[cell] == starts["__c"]]
    return numbered.join(starts, on).withColumn(name, (F.col(name) + F.col(start)).cast("long")).select(*df.columns, name)
