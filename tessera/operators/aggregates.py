"""Counts, coverage and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of each table, in one union of partial counts."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def grouped_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows"))


def embedding_compatibility(chunks: DataFrame, vectors: DataFrame, model: str, dimension: int) -> DataFrame:
    """Chunks, those with a vector, compatible ones, and how many spaces are in use."""
    v = vectors.select("chunk_id", "model", "dimension", F.lit(True).alias("__has"))
    ok = (F.col("model") == model) & (F.col("dimension") == dimension)
    return chunks.select("chunk_id").join(v, "chunk_id", "left").agg(
        F.count("*").alias("chunks"), F.count("__has").alias("embedded"), F.count(F.when(ok, 1)).alias("compatible"),
        F.countDistinct(F.when(F.col("__has"), F.struct("model", "dimension"))).alias("spaces"), F.max("dimension").cast("long").alias("largest"),
    )


def language_totals(nodes: DataFrame, edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Nodes, edges and unresolved facts of each language."""
    kinds = {"nodes": nodes, "edges": edges, "unresolved": unresolved}
    every = reduce(DataFrame.unionByName, [df.select("language", F.lit(k).alias("kind")) for k, df in kinds.items()])
    return every.groupBy("language").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds])


def readiness(scanned: DataFrame, documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per language: files seen, indexed, and what a rebuild would cost."""
    per = chunks.select("document_id", "chunk_id").join(vectors.select("chunk_id", F.lit(1).alias("__v")), "chunk_id", "left").groupBy("document_id").agg(F.count("*").alias("chunks"), F.count("__v").alias("embeddings"))
    d = documents.select("document_id", F.lit(1).alias("__d")).join(per, "document_id", "left")
    return scanned.select("document_id", "language").join(d, "document_id", "left").groupBy("language").agg(
        F.count("*").alias("files"), F.count("__d").alias("indexed"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("embeddings"), F.lit(0)).alias("embeddings")
    )


def outcomes_by_subject(results: DataFrame, *keys: str) -> DataFrame:
    """Terminal outcome of each key: every subject has passes or failures, never both."""
    s = results.groupBy(*keys, "subject").agg(F.bool_or("passed").alias("p"), F.bool_or(~F.col("passed")).alias("f"))
    whole = s.groupBy(*keys).agg(F.bool_or("p").alias("any_passed"), F.bool_or("f").alias("any_failed"), F.bool_or(F.col("p") & F.col("f")).alias("conflicting"))
    outcome = F.when(F.col("conflicting"), "conflicting").when(F.col("any_passed") & F.col("any_failed"), "partial_success").when(F.col("any_passed"), "success").otherwise("failure")
    return whole.withColumn("outcome", outcome)


def test_counts(cases: DataFrame, *keys: str) -> DataFrame:
    """Discovered, executed, and each status of the cases."""
    idle = ("skipped", "todo", "pending")
    statuses = ("passed", "assertion_failed", "errored", "expected_failed", "unexpected_successful", *idle)
    return cases.groupBy(*keys).agg(F.count("*").alias("discovered"), F.count(F.when(~F.col("status").isin(*idle), 1)).alias("executed"), *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in statuses])


def latency(df: DataFrame, value: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("samples"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("largest"))


def nearest_rank(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """p50 and p95 by nearest rank, the value at ceil(p * n): an aggregate that counts equal
    values before rows move, so no key is sorted in one task."""
    at = lambda p, name: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(name)
    return df.groupBy(*keys).agg(at(0.5, "p50"), at(0.95, "p95"))


def retrieval_metrics(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Per case: recall, precision and reciprocal rank of the first ``k`` results.

    Results: case_id, item, rank from 1; expected: case_id, item.
    """
    hits = results.filter(F.col("rank") <= k).join(expected.withColumn("__hit", F.lit(1)), ["case_id", "item"], "left").groupBy("case_id").agg(F.count("*").alias("n"), F.count("__hit").alias("hits"), F.min(F.when(F.col("__hit") == 1, F.col("rank"))).alias("first"))
    wanted = expected.groupBy("case_id").agg(F.countDistinct("item").alias("wanted"))
    return wanted.join(hits, "case_id", "left").select(
        "case_id", (F.coalesce("hits", F.lit(0)) / F.col("wanted")).alias("recall"), F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0)).alias("precision"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank")
    )


def packet_metrics(items: DataFrame, packets: DataFrame) -> DataFrame:
    """Per packet: share of the budget used, of tokens that repeat covered bytes, and of
    items whose path is current."""
    from tessera.operators.intervals import covered

    bytes_ = covered(items.select("case_id", "source_id", "start", "end"), "case_id", "source_id").groupBy("case_id").agg((1 - F.sum("covered") / F.sum("total")).alias("duplicate_ratio"))
    i = items.groupBy("case_id").agg(F.sum("tokens").alias("tokens"), F.avg(F.col("is_current").cast("double")).alias("current_ratio"))
    return packets.join(i, "case_id", "left").join(bytes_, "case_id", "left").select("case_id", (F.coalesce("tokens", F.lit(0)) / F.col("token_budget")).alias("utilization"), F.coalesce("duplicate_ratio", F.lit(0.0)).alias("duplicate_ratio"), F.coalesce("current_ratio", F.lit(0.0)).alias("current_ratio"))


def implementation_coverage(expected: DataFrame, changes: DataFrame) -> DataFrame:
    """Per case: expected (path, symbol) pairs that a change implements, and those that
    its text only mentions.

    Texts don't meet symbols pair by pair: each different text of a case gives its substrings
    of the lengths that the case's symbols have, and these meet the symbols by equality.
    """
    wanted = expected.select("case_id", "path", "symbol").distinct()
    exact = changes.select("case_id", "path", "symbol").distinct().withColumn("__exact", F.lit(True))
    symbols = wanted.select("case_id", "symbol").filter("symbol IS NOT NULL").distinct()
    lengths = symbols.groupBy("case_id").agg(F.collect_set(F.char_length("symbol")).alias("__lengths"))
    at = changes.select("case_id", "text").filter("text IS NOT NULL").distinct().join(lengths, "case_id")
    at = at.select("case_id", "text", F.explode("__lengths").alias("__n")).filter(F.col("__n") <= F.char_length("text"))
    parts = at.select("case_id", "text", "__n", F.explode(F.sequence(F.lit(1), F.char_length("text") - F.col("__n") + 1)).alias("__at"))
    held = parts.select("case_id", F.substring("text", F.col("__at"), F.col("__n")).alias("symbol")).distinct()
    said = symbols.join(held, ["case_id", "symbol"]).withColumn("__said", F.lit(True))
    return wanted.join(exact, ["case_id", "path", "symbol"], "left").join(said, ["case_id", "symbol"], "left").groupBy("case_id").agg(F.count("*").alias("expected"), F.count("__exact").alias("implemented"), F.count(F.when(F.col("__exact").isNull() & F.col("__said"), 1)).alias("mentioned_only"))
