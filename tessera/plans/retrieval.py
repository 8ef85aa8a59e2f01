"""Queries of the retrieval operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import MARKED, PLAIN, terms
from tessera.functions.storage import kept
from tessera.operators import retrieval as R
from tessera.plans import assembly as A
from tessera.sources import lexical_index as L
from tessera.sources import tables as T

QUERY = "the of and"
MEMORY_QUERY = "de la"


def _query_vector(spark: SparkSession, d: str) -> DataFrame:
    return T.vectors(spark, d).filter("chunk_id = 0").select("vector")


def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.semantic_topk(T.vectors(spark, d), _query_vector(spark, d), 10).select("chunk_id", F.round("score", 4).alias("score"))


def _index(spark: SparkSession, d: str) -> L.LexicalIndex:
    return L.of(T.chunks(spark, d), "chunk_id", "content")


def lexical_bm25(spark: SparkSession, d: str) -> DataFrame:
    return R.indexed_topk(_index(spark, d), QUERY, 20).select("chunk_id", F.round("score", 6).alias("score"))


def lexical_match_and(spark: SparkSession, d: str) -> DataFrame:
    return R.indexed_scores(_index(spark, d), QUERY).select("chunk_id")


def lexical_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same scores from the texts themselves, without an index."""
    return R.lexical_scores(T.chunks(spark, d), QUERY, "chunk_id", "content").select("chunk_id", F.round("score", 6).alias("score"))


def lexical_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.chunks(spark, d).select("chunk_id", F.size(terms("content")).cast("long").alias("tokens"))


def lexical_queries(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item as a query: texts that hold all of its words."""
    q = T.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.indexed_many(_index(spark, d), q, 5).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def memory_search_rank(spark: SparkSession, d: str) -> DataFrame:
    return R.indexed_topk(L.of(T.memories(spark, d).select("memory_id", "content"), "memory_id", "content"), MEMORY_QUERY, 20).select("memory_id", F.round("score", 6).alias("score"))


def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    out = R.hybrid_search(_index(spark, d), T.vectors(spark, d), _query_vector(spark, d), QUERY, 8)
    return out.select("chunk_id", *[F.round(c, 6).alias(c) for c in ("semantic", "lexical", "hybrid")])


def hybrid_missing_arm(spark: SparkSession, d: str) -> DataFrame:
    """A query that no text matches: the semantic arm alone, over the whole weight."""
    out = R.hybrid_search(_index(spark, d), T.vectors(spark, d), _query_vector(spark, d), "zzzz qqqq", 8)
    return out.select("chunk_id", *[F.round(c, 6).alias(c) for c in ("semantic", "lexical", "hybrid")])


def structural_arm(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and documents are laid out over twenty files."""
    number = F.substring("node_id", 2, 20).cast("long")
    nodes = T.graph_nodes(spark, d).select("node_id", "node_type", "name", (number % 20).alias("document_id"), (number * 7 % 50 * 10).alias("start"), (number * 7 % 50 * 10 + 30).alias("end"))
    chunks = T.chunks(spark, d).select((F.col("chunk_id") % 20).alias("document_id"), "chunk_id", (F.floor(F.col("chunk_id") / 20) * 12).alias("start"), (F.floor(F.col("chunk_id") / 20) * 12 + 20).alias("end"))
    edges = kept(T.graph_edges(spark, d), "edges")
    found = A.structural_retrieval(nodes, edges, chunks, nodes.filter("node_id = 'p7'").select("node_id"), "callers", [])
    return found.select("chunk_id", F.round("score", 6).alias("score"), "node_id")


def hybrid_structural(spark: SparkSession, d: str) -> DataFrame:
    """The structural arm brings chunks beside the callers of a part: one takes the last place."""
    arm = structural_arm(spark, d).select("chunk_id", "score")
    out = R.hybrid_search(_index(spark, d), T.vectors(spark, d), _query_vector(spark, d), QUERY, 8, arm)
    return out.select("chunk_id", *[F.round(c, 6).alias(c) for c in ("semantic", "lexical", "structural", "hybrid")])


def score_minmax(spark: SparkSession, d: str) -> DataFrame:
    return R.minmax(T.table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "norm").select("c_custkey", F.round("norm", 6).alias("norm"))


def get_item(spark: SparkSession, d: str) -> DataFrame:
    return R.item(T.chunks(spark, d), 7).select("chunk_id", "path", "language", "content")


_TERMS = f"regexp_extract_all(translate(lower({{}}), '{MARKED}', '{PLAIN}'), '[\\p{{{{L}}}}\\p{{{{N}}}}_:]+')"


def _terms(x: str) -> str:
    return _TERMS.format(x)


def _lexical(table: str, key: str, query: str) -> str:
    wanted = query.split()
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(wanted))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(wanted)))
    part = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(wanted)))
    every = " AND ".join(f"tf{i} > 0" for i in range(len(wanted)))
    return f"""t AS (SELECT {key}, {_terms("text")} AS t FROM {table}), c AS (SELECT {key}, len(t) AS dl, {tf} FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM c),
lex AS (SELECT {key}, greatest({part}, 0) AS score FROM c, s WHERE {every})"""


_DOCS = "(SELECT doc_id AS chunk_id, text FROM documents)"
_SEM = """q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
sem AS (SELECT vec_id AS chunk_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT v FROM q)::DOUBLE[]) AS score FROM embeddings)"""


def _hybrid(lexical: str, structural: str | None = None) -> str:
    total = "0.8" if structural is None else "1.0"
    arm = "" if structural is None else f", st AS ({structural})"
    join = "" if structural is None else " FULL JOIN st USING (chunk_id)"
    extra = "" if structural is None else " + coalesce(structural, 0) * 0.2"
    return f"""WITH {_SEM}, {lexical},
a0 AS (SELECT * FROM sem ORDER BY score DESC, chunk_id LIMIT 24), b0 AS (SELECT * FROM lex ORDER BY score DESC, chunk_id LIMIT 24),
a AS (SELECT chunk_id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS semantic FROM a0),
b AS (SELECT chunk_id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS lexical FROM b0){arm},
f AS (SELECT *, (coalesce(semantic, 0) * 0.55 + coalesce(lexical, 0) * 0.25{extra}) / {total} AS hybrid FROM a FULL JOIN b USING (chunk_id){join})"""


_ROUNDED = "round(semantic, 6) AS semantic, round(lexical, 6) AS lexical, round(hybrid, 6) AS hybrid"
_ARM0 = """ec AS (SELECT 's' || l_suppkey AS f, 'calls|s' || l_suppkey || '|p7' AS id, 0.9 - max(l_discount) AS w, l_suppkey AS k FROM lineitem WHERE l_partkey = 7 GROUP BY l_suppkey),
en AS (SELECT *, row_number() OVER (ORDER BY id) AS ord FROM ec QUALIFY ord <= 15),
ch AS (SELECT doc_id AS chunk_id, doc_id % 20 AS d, doc_id // 20 * 12 AS s, doc_id // 20 * 12 + 20 AS e FROM documents),
nn AS (SELECT f, ord, w, chunk_id, row_number() OVER (PARTITION BY f ORDER BY (k * 7 % 50 * 10 < e AND s < k * 7 % 50 * 10 + 30) DESC, abs(s - k * 7 % 50 * 10), e - s, s, chunk_id) AS rank FROM en JOIN ch ON k % 20 = d QUALIFY rank <= 4),
n2 AS (SELECT * FROM nn ORDER BY ord, rank LIMIT 32),
arm AS (SELECT chunk_id, round(max(w), 6)::DOUBLE AS score, arg_max(f, w) AS node_id FROM n2 GROUP BY chunk_id)"""
_ARM = f"WITH {_ARM0} SELECT chunk_id, score AS structural FROM arm"

QUERIES = {f.__name__: f for f in (semantic_topk, lexical_bm25, lexical_scan, lexical_match_and, lexical_token_counts, lexical_queries, memory_search_rank, hybrid_fusion, hybrid_missing_arm, structural_arm, hybrid_structural, score_minmax, get_item)}
SQL = {
    "semantic_topk": f"WITH {_SEM} SELECT chunk_id, round(score, 4) AS score FROM sem ORDER BY sem.score DESC, chunk_id LIMIT 10",
    "lexical_bm25": f"WITH {_lexical(_DOCS, 'chunk_id', QUERY)} SELECT chunk_id, round(score, 6) AS score FROM lex ORDER BY lex.score DESC, chunk_id LIMIT 20",
    "lexical_scan": f"WITH {_lexical(_DOCS, 'chunk_id', QUERY)} SELECT chunk_id, round(score, 6) AS score FROM lex",
    "lexical_match_and": f"WITH {_lexical(_DOCS, 'chunk_id', QUERY)} SELECT chunk_id FROM lex",
    "lexical_token_counts": f"SELECT doc_id AS chunk_id, len({_terms('text')})::BIGINT AS tokens FROM documents",
    "lexical_queries": f"""WITH d AS (SELECT doc_id AS chunk_id, {_terms("text")} AS t FROM documents),
q AS (SELECT item_id AS query_id, list_distinct({_terms("text")}) AS t FROM benchmark),
w AS (SELECT query_id, len(t) AS n_terms, unnest(t) AS term FROM q),
p AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM d) GROUP BY ALL),
l AS (SELECT chunk_id, len(t) AS dl FROM d), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
r AS (SELECT query_id, chunk_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
      FROM w JOIN p USING (term) JOIN f USING (term) JOIN l USING (chunk_id), s GROUP BY query_id, chunk_id, n_terms HAVING count(*) = n_terms),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM r)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM k WHERE rank <= 5""",
    "memory_search_rank": f"WITH {_lexical('(SELECT conv_id * 1000 + turn AS memory_id, text FROM conversations)', 'memory_id', MEMORY_QUERY)} SELECT memory_id, round(score, 6) AS score FROM lex ORDER BY lex.score DESC, memory_id LIMIT 20",
    "hybrid_fusion": f"{_hybrid(_lexical(_DOCS, 'chunk_id', QUERY))} SELECT chunk_id, {_ROUNDED} FROM f ORDER BY f.hybrid DESC, chunk_id LIMIT 8",
    "hybrid_missing_arm": f"{_hybrid(_lexical(_DOCS, 'chunk_id', 'zzzz qqqq'))} SELECT chunk_id, {_ROUNDED} FROM f ORDER BY f.hybrid DESC, chunk_id LIMIT 8",
    "hybrid_structural": f"""{_hybrid(_lexical(_DOCS, "chunk_id", QUERY), _ARM)},
k AS (SELECT *, row_number() OVER (ORDER BY hybrid DESC, chunk_id) AS r FROM f), e AS (SELECT min(r) AS best FROM k WHERE structural IS NOT NULL)
SELECT chunk_id, {_ROUNDED}, structural::DOUBLE AS structural FROM k, e WHERE CASE WHEN best > 8 THEN r < 8 OR r = best ELSE r <= 8 END""",
    "structural_arm": f"WITH {_ARM0} SELECT * FROM arm",
    "score_minmax": "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS norm FROM customer",
    "get_item": "SELECT doc_id AS chunk_id, source || '/' || doc_id AS path, lang AS language, text AS content FROM documents WHERE doc_id = 7",
}
