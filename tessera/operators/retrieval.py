"""Semantic, lexical and hybrid retrieval.

Scores are computed on ids and vectors or terms only; contents join after the top k.
The sides that are broadcast are one row of corpus statistics and one query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.config import DEFAULTS, Retrieval
from tessera.functions.columns import cosine, query_terms, terms
from tessera.sources.lexical_index import PARTS, LexicalIndex, of_terms

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def clamped(limit: int, most: int = DEFAULTS.retrieval.most) -> int:
    return max(0, min(limit, most))


def semantic_topk(vectors: DataFrame, query: DataFrame, limit: int, key: str = "chunk_id") -> DataFrame:
    """The ``limit`` vectors nearest to the one row of ``query`` (column vector): exact cosine.

    Vectors of another length and zero vectors have no score and are left out.
    """
    one = query.select(F.col("vector").alias("__query")).limit(1)
    scored = vectors.select(key, "vector").crossJoin(F.broadcast(one)).select(key, cosine("vector", "__query").alias("score"))
    return scored.filter(F.col("score").isNotNull()).orderBy(F.desc("score"), key).limit(clamped(limit))


def _idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def _bm25(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def lexical_scores(docs: DataFrame, query: str, key: str, *columns: str) -> DataFrame:
    """(key, score) of the texts that hold all terms of the query: BM25 over the whole table.

    Statistics come from all rows, matching ones or not. Only counts of the query's
    terms leave the scan, so nothing is exploded and one row is broadcast.
    """
    wanted = list(dict.fromkeys(query_terms(query)))
    if not wanted:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    tokens = F.concat(*[terms(F.coalesce(F.col(c), F.lit(""))) for c in columns])
    counted = docs.select(key, tokens.alias("t")).select(
        key, F.size("t").alias("dl"), *[F.size(F.filter("t", lambda x: x == F.lit(wanted[i]))).alias(f"tf{i}") for i in range(len(wanted))]
    )
    dfs = [F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(wanted))]
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *dfs)
    every = F.lit(True)
    score = F.lit(0.0)
    for i in range(len(wanted)):
        every = every & (F.col(f"tf{i}") > 0)
        score = score + _idf(F.col("n"), F.col(f"df{i}")) * _bm25(F.col(f"tf{i}"), F.col("dl"), F.col("avgdl"))
    return counted.filter(every).crossJoin(F.broadcast(stats)).select(key, F.greatest(score, F.lit(0.0)).alias("score"))


def lexical_topk(docs: DataFrame, query: str, limit: int, key: str, *columns: str) -> DataFrame:
    return lexical_scores(docs, query, key, *columns).orderBy(F.desc("score"), key).limit(clamped(limit))


def indexed_scores(index: LexicalIndex, query: str) -> DataFrame:
    """``lexical_scores`` from a kept index: only postings of the query's terms are read."""
    wanted = list(dict.fromkeys(query_terms(query)))
    df = index.df(wanted) if wanted else {}
    if not wanted or len(df) < len(wanted):
        return index.postings().select(F.col("key").alias(index.key), F.lit(0.0).alias("score")).limit(0)
    idf = F.lit(0.0)
    for t in wanted:
        idf = F.when(F.col("term") == t, _idf(F.lit(index.n), F.lit(df[t]))).otherwise(idf)
    part = idf * _bm25(F.col("tf"), F.col("dl"), F.lit(index.avgdl))
    hits = of_terms(index.postings(), wanted).groupBy("key").agg(F.sum(part).alias("score"), F.count("*").alias("n")).filter(F.col("n") == len(wanted))
    return hits.select(F.col("key").alias(index.key), F.greatest("score", F.lit(0.0)).alias("score"))


def indexed_topk(index: LexicalIndex, query: str, limit: int) -> DataFrame:
    return indexed_scores(index, query).orderBy(F.desc("score"), index.key).limit(clamped(limit))


def indexed_many(index: LexicalIndex, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, key, score, rank) for a table of queries (query_id, text), over a kept index.

    Texts must hold all terms of a query, so those with its rarest term are its candidates,
    and only they look the other terms up: a word that most texts hold brings none. A query
    with a term that no text holds has no rows.
    """
    wanted = queries.select("query_id", F.array_distinct(terms("text")).alias("t")).select("query_id", F.size("t").alias("n_terms"), F.explode("t").alias("term"))
    wanted = wanted.withColumn("part", (F.crc32(F.col("term").cast("binary")) % PARTS).cast("int")).join(index.terms(), ["part", "term"])
    rarest = wanted.groupBy("query_id").agg(F.min(F.struct("df", "term", "part")).alias("r"), F.count("*").alias("known"), F.first("n_terms").alias("n_terms")).filter("known = n_terms")
    postings = index.postings()
    candidates = postings.join(rarest.select("query_id", "r.term", "r.part"), ["part", "term"]).select("query_id", "key")
    asked = candidates.join(wanted, "query_id")
    # summed as decimals, which no order of additions changes: texts that are equal tie
    part = (_idf(F.lit(index.n), F.col("df")) * _bm25(F.col("tf"), F.col("dl"), F.lit(index.avgdl))).cast("decimal(28,17)")
    scored = postings.join(asked, ["part", "term", "key"]).groupBy("query_id", "key").agg(F.sum(part).cast("double").alias("score"), F.count("*").alias("matched"), F.first("n_terms").alias("n_terms")).filter("matched = n_terms")
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "key")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= clamped(limit))
    return ranked.select("query_id", F.col("key").alias(index.key), "score", "rank")


def minmax(df: DataFrame, column: str, out: str) -> DataFrame:
    """Scores of one arm spread over 0..1; if all are equal they are 1."""
    ends = df.agg(F.min(column).alias("__low"), F.max(column).alias("__high"))
    spread = F.when(F.col("__high") == F.col("__low"), 1.0).otherwise((F.col(column) - F.col("__low")) / (F.col("__high") - F.col("__low")))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, spread).drop("__low", "__high")


def fused(semantic: DataFrame, lexical: DataFrame, structural: DataFrame | None, key: str, w: Retrieval = DEFAULTS.retrieval) -> DataFrame:
    """Union of the arms' candidates, with hybrid = weighted sum over the whole weight.

    Semantic and lexical scores (column score) are spread by ``minmax`` over their own
    candidates, structural ones are taken as they are; a missing arm counts 0. The
    structural weight counts only if that arm is given.
    """
    a = minmax(semantic, "score", "semantic").select(key, "semantic")
    b = minmax(lexical, "score", "lexical").select(key, "lexical")
    both = a.join(b, key, "full")
    total = w.semantic + w.lexical
    part = F.coalesce("semantic", F.lit(0.0)) * w.semantic + F.coalesce("lexical", F.lit(0.0)) * w.lexical
    if structural is None:
        return both.withColumn("structural", F.lit(None).cast("double")).withColumn("hybrid", part / total)
    c = structural.groupBy(key).agg(F.max("score").alias("structural"))
    return both.join(c, key, "full").withColumn("hybrid", (part + F.coalesce("structural", F.lit(0.0)) * w.structural) / (total + w.structural))


def reserved(ranked: DataFrame, key: str, limit: int, score: str = "hybrid", evidence: str = "structural") -> DataFrame:
    """Top ``limit`` of at most a few hundred candidates; if none of them has structural
    evidence, the last place goes to the best candidate that has."""
    order = Window.orderBy(F.desc(score), key)
    few = ranked.orderBy(F.desc(score), key)
    placed = few.withColumn("__rank", F.row_number().over(order))
    has = F.col(evidence).isNotNull()
    whole = Window.partitionBy()
    best = F.min(F.when(has, F.col("__rank"))).over(whole)
    swap = best > limit
    keep = F.when(F.coalesce(swap, F.lit(False)), (F.col("__rank") < limit) | (F.col("__rank") == best)).otherwise(F.col("__rank") <= limit)
    return placed.withColumn("__keep", keep).filter("__keep").drop("__keep", "__rank").orderBy(F.desc(score), key)


def hybrid_search(chunks: DataFrame | LexicalIndex, vectors: DataFrame, query_vector: DataFrame, query: str, limit: int, structural: DataFrame | None = None, w: Retrieval = DEFAULTS.retrieval) -> DataFrame:
    """Both arms with ``overfetch`` times the limit, fused, with the structural place kept.
    The lexical arm reads a kept index, or tokenises a table without one."""
    wide = clamped(limit * w.overfetch)
    a = semantic_topk(vectors, query_vector, wide)
    b = indexed_topk(chunks, query, wide) if isinstance(chunks, LexicalIndex) else lexical_topk(chunks, query, wide, "chunk_id", "content")
    out = fused(a, b, structural, "chunk_id", w)
    if structural is None:
        return out.orderBy(F.desc("hybrid"), "chunk_id").limit(clamped(limit))
    return reserved(out, "chunk_id", clamped(limit))


def item(chunks: DataFrame, chunk_id: object) -> DataFrame:
    return chunks.filter(F.col("chunk_id") == F.lit(chunk_id))


def fitting(query: Column, input_tokens: int, batch_tokens: int | None = None) -> Column:
    """Whether ``query_fits`` takes a query."""
    return F.octet_length(query) <= min(x for x in (input_tokens, batch_tokens) if x is not None)


def query_fits(query: str, input_tokens: int, batch_tokens: int | None = None) -> None:
    """Raises if a query's tokens (bytes) exceed what one embedding call may take."""
    n = len(query.encode())
    if n > input_tokens or (batch_tokens is not None and n > batch_tokens):
        raise ValueError(f"query has {n} tokens, more than an input or a batch may have")
