"""Ingestion: chunks, segments, batches, and what changed.

Chunking a text is sequential, so texts are cut in Arrow batches of Python, each text
alone; everything that compares tables is a join.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import DEFAULTS


def _whole(data: bytes, at: int, up: bool = False) -> int:
    """The next place at or before (``up``: behind) ``at`` where a character begins."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1 if up else -1
    return at


def chunk_ranges(data: bytes, target: int = DEFAULTS.chunk_bytes, overlap: int = DEFAULTS.chunk_overlap) -> list[tuple[int, int]]:
    """Byte ranges of about ``target`` bytes that overlap by ``overlap``.

    A range ends behind its last blank line, or else before its last heading, if that
    lies behind the end of the range before; else at the target.
    """
    out, start, done = [], 0, 0
    while start < len(data):
        end = _whole(data, min(start + target, len(data)))
        for mark, width in ((b"\n#", 1), (b"\n\n", 2)):  # the paragraph has the last word
            if end < len(data):
                at = data.rfind(mark, start, end)
                if at >= start and at + width > done:
                    end = at + width
        if end <= done:
            end = _whole(data, done + 1, up=True)
        out.append((start, end))
        if end == len(data):
            break
        start = min(_whole(data, end if end - start <= overlap else end - overlap, up=True), end)
        done = end
    return out


def _exploded(df: DataFrame, cut: Callable[[str], list[tuple]], key: str, text: str, kinds: str, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *r) for k, t in zip(pdf[key], pdf[text], strict=True) for r in cut(t or "")]
            yield pd.DataFrame(rows, columns=[key, *names])

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {kinds}")


def chunked(df: DataFrame, key: str, text: str, target: int = DEFAULTS.chunk_bytes, overlap: int = DEFAULTS.chunk_overlap) -> DataFrame:
    """Chunks of each text: ordinal, byte range, lines and content."""

    def cut(t: str) -> list[tuple]:
        data = t.encode()
        return [(i, s, e, 1 + data.count(b"\n", 0, s), 1 + data.count(b"\n", 0, e), data[s:e].decode("utf-8", "replace")) for i, (s, e) in enumerate(chunk_ranges(data, target, overlap))]

    return _exploded(df, cut, key, text, "ordinal long, start long, end long, start_line long, end_line long, content string", ["ordinal", "start", "end", "start_line", "end_line", "content"])


def segment_ranges(data: bytes, budget: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of at most ``budget`` bytes: each ends behind a blank line, a newline or white
    space in its second half if there is one, and overlaps the next by up to ``overlap``
    bytes, a quarter of the budget at most."""
    if len(data) <= budget:
        return [(0, len(data))]
    overlap = min(overlap, budget // 4)
    out, start = [], 0
    while True:
        most = _whole(data, min(start + budget, len(data)))
        if most <= start:
            raise ValueError(f"a budget of {budget} bytes holds no character")
        end, half = most, start + (most - start) // 2
        if most < len(data):
            part = data[start:most]
            for pattern in (rb"\n\n|\r\n\r\n", rb"\n", rb"[ \t\n\r\f\v]"):
                behind = [start + m.end() for m in re.finditer(pattern, part) if start + m.end() >= half]
                if behind:
                    end = behind[-1]
                    break
        out.append((start, end))
        if end == len(data):
            return out
        back = _whole(data, end - overlap, up=True)
        start = back if back > start else _whole(data, start + 1, up=True)


def segmented(chunks: DataFrame, key: str, budget: int, overlap: int = 0, text: str = "content") -> DataFrame:
    """Parts of chunks over ``budget``: part, parts, byte range in the chunk, content."""

    def cut(t: str) -> list[tuple]:
        data = t.encode()
        ranges = segment_ranges(data, budget, overlap)
        return [(i, len(ranges), s, e, data[s:e].decode("utf-8", "replace")) for i, (s, e) in enumerate(ranges)]

    return _exploded(chunks, cut, key, text, "part long, parts long, start long, end long, content string", ["part", "parts", "start", "end", "content"])


def segmentation_id(budget: int | None, overlap: int, version: int = 1) -> str:
    """Names a policy, so that a change of its limits is seen."""
    import hashlib

    return f"{version}:{hashlib.sha256(f'{budget}|{overlap}'.encode()).hexdigest()[:16]}"


def segmentation_names(budget: Column, overlap: Column, version: int = 1) -> Column:
    """``segmentation_id`` of columns."""
    return F.concat(F.lit(f"{version}:"), F.left(F.sha2(F.concat_ws("|", F.coalesce(budget.cast("string"), F.lit("None")), overlap.cast("string")), 256), F.lit(16)))


def batch_plan(sizes: list[int], most_items: int, most_tokens: int | None) -> list[list[int]]:
    """Indexes in batches, in order, none over either limit; raises for an item over it."""
    out: list[list[int]] = []
    tokens = 0
    for i, n in enumerate(sizes):
        if most_tokens is not None and n > most_tokens:
            raise ValueError(f"an item of {n} tokens needs smaller input")
        if not out or len(out[-1]) == max(most_items, 1) or (most_tokens is not None and tokens + n > most_tokens):
            out.append([])
            tokens = 0
        out[-1].append(i)
        tokens += n
    return out


def batched(chunks: DataFrame, document: str, ordinal: str, tokens: str, most_items: int, most_tokens: int) -> DataFrame:
    """The batch of each chunk of a document, by greedy filling in order; -1 for a chunk that
    needs smaller input. Documents are batched alone, in order, over sorted partitions."""

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, batch, items, used = None, 0, 0, 0
        for pdf in batches:
            out = []
            for d, n in zip(pdf[document], pdf[tokens], strict=True):
                if d != now:
                    now, batch, items, used = d, 0, 0, 0
                if n > most_tokens:
                    out.append(-1)
                    continue
                if items and (items == most_items or used + n > most_tokens):
                    batch, items, used = batch + 1, 0, 0
                items, used = items + 1, used + n
                out.append(batch)
            yield pdf.assign(batch=out)

    rows = chunks.select(document, ordinal, tokens)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(document).sortWithinPartitions(document, ordinal).mapInPandas(plan, f"{kinds}, batch long")


def changes(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Each chunk's status between two states (columns chunk_id, content_hash): added,
    modified, unchanged or removed; ids survive, and only added and modified are to be
    embedded."""
    a = old.select(*keys, F.col("content_hash").alias("__old"), F.col("chunk_id").alias("__id"))
    b = new.select(*keys, F.col("content_hash").alias("__new"), F.col("chunk_id").alias("__fresh"))
    status = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") == F.col("__new"), "unchanged").otherwise("modified")
    both = a.join(b, list(keys), "full").withColumn("status", status)
    return both.select(*keys, F.coalesce("__id", "__fresh").alias("chunk_id"), "status", F.col("status").isin("added", "modified").alias("embed"))


def removed(stored: DataFrame, scanned: DataFrame, failed: DataFrame, key: str = "path") -> DataFrame:
    """Stored documents that a scan no longer sees; those it could not read are kept."""
    return stored.join(scanned.select(key), key, "left_anti").join(failed.select(key), key, "left_anti")


def unchanged_documents(scanned: DataFrame, stored: DataFrame, spaces: DataFrame, analyzer: str, segmentation: str) -> DataFrame:
    """Documents that need no work: content, analyzer, segmentation, vectors and graph all fit.
    Filtering by it comes before any Python runs."""
    s = stored.select("path", F.col("content_hash").alias("__h"), "analyzer_version", "segmentation_id", "graph_state")
    j = scanned.join(s, "path").join(spaces.select("path", "compatible"), "path", "left")
    ok = (F.col("content_hash") == F.col("__h")) & (F.col("analyzer_version") == analyzer) & (F.col("segmentation_id") == segmentation) & F.coalesce("compatible", F.lit(True)) & (F.col("graph_state") == "current")
    return j.filter(ok).select("path")


def bad_vectors(vectors: DataFrame, dimension: int) -> DataFrame:
    """(chunk_id, problem) of vectors that must not be stored."""
    from tessera.functions.columns import is_finite_vector

    problem = F.when(F.col("vector").isNull() | (F.size("vector") == 0), "empty").when(F.size("vector") != dimension, "dimension").when(~is_finite_vector("vector"), "not_finite")
    return vectors.select("chunk_id", problem.alias("problem")).filter("problem IS NOT NULL")


def disambiguated(chunks: DataFrame, document: str = "document_id", key: str = "stable_key") -> DataFrame:
    """Repeated keys of a document get a hash of their content, and a number where even
    that repeats."""
    from pyspark.sql.window import Window

    w, x = Window.partitionBy(document, key), Window.partitionBy(document, key, "__hash")
    r = chunks.withColumn("__hash", F.substring(F.sha2("content", 256), 1, 10)).withColumn("__n", F.count("*").over(w)).withColumn("__m", F.row_number().over(x.orderBy("start")))
    unique = F.when(F.col("__n") == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("#"), F.col("__hash"), F.when(F.col("__m") > 1, F.concat(F.lit("~"), F.col("__m"))).otherwise("")))
    return r.withColumn(key, unique).drop("__hash", "__n", "__m")
