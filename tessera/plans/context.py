"""Queries of context assembly and ingestion, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import context as K
from tessera.operators import ingest as N
from tessera.sources import tables as T
from tessera.sources import workspace as W


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Line items as candidates: an order is a request, a part is a source. Lines are dealt by
    request as they are read, which is what merging, ranking and filling need as well."""
    l = T.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_discount", "l_tax", "l_quantity").repartition("l_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("code", "document", "memory", "event", "task_state"))), (F.col("l_suppkey") % 5 + 1).cast("int"))
    fresh = F.element_at(F.array(*map(F.lit, ("current", "recent", "historical"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    reason = F.element_at(F.array(*map(F.lit, ("caller", "neighbor", "pinned", "semantic_match", "active_task_reference", "lexical_match"))), (F.col("l_partkey") % 6 + 1).cast("int"))
    return l.select(
        F.col("l_orderkey").alias("request"), kind.alias("source_type"), (F.col("l_partkey") % 4).alias("source_id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount") * 10).alias("semantic"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_tax") * 10).alias("lexical"),
        (F.col("l_tax") * 5).alias("task"), F.lit(0.25).alias("working_set"), (F.col("l_quantity") / 50).alias("recency"), F.array(reason).alias("reasons"), (F.col("l_partkey") % 6 < 2).alias("structural_evidence"), fresh.alias("freshness"),
        F.repeat(F.lit("x"), (F.col("l_quantity") + 1).cast("int")).alias("content"), F.concat(F.lit("p"), F.col("l_partkey") % 4).alias("path"),
    )


def candidate_merge_rank(spark: SparkSession, d: str) -> DataFrame:
    r = K.ranked(K.merged(_candidates(spark, d), "request"))
    return r.select("request", "source_type", "source_id", F.round("semantic", 6).alias("semantic"), F.round("recency", 6).alias("recency"), F.array_join("reasons", ",").alias("reasons"), "freshness", F.round("final", 6).alias("final"))


def required_reservation(spark: SparkSession, d: str) -> DataFrame:
    return K.bounded(K.ranked(K.merged(_candidates(spark, d), "request")), "request", limit=3).select("request", "source_type", "source_id")


def packet_greedy(spark: SparkSession, d: str) -> DataFrame:
    pool = K.bounded(K.ranked(K.merged(_candidates(spark, d), "request")), "request", limit=50)
    return K.packets(pool, "request", 100).select("request", "rank", "source_type", "source_id", "tokens", "truncated")


def packet_explanation(spark: SparkSession, d: str) -> DataFrame:
    pool = K.bounded(K.ranked(K.merged(_candidates(spark, d), "request")), "request", limit=50)
    return K.packets(pool, "request", 100, beside=("reasons", "final")).select("request", "rank", "source_type", "source_id", F.array_join("reasons", ",").alias("reasons"), F.round("final", 6).alias("final"))


def resume_selection(spark: SparkSession, d: str) -> DataFrame:
    o = T.tasks(spark, d)
    s = o.select("owner", (F.col("task_id") % 7).alias("session_id"), F.col("created_at").alias("started_at"), F.when(F.col("task_id") % 5 != 0, F.col("created_at")).alias("ended_at"))
    t = o.select("owner", "task_id", (F.col("task_id") % 7).alias("session_id"), "status", "created_at")
    c = o.filter("task_id % 3 = 0").select("owner", F.col("task_id").alias("checkpoint_id"), (F.col("task_id") % 7).alias("session_id"), F.when(F.col("task_id") % 2 == 0, F.col("task_id")).alias("task_id"), "created_at")
    return K.resumed(s, t, c, "owner").select("owner", "session_rule", "task_id", "task_rule", "checkpoint_id")


def hydration_audit(spark: SparkSession, d: str) -> DataFrame:
    l = T.table(spark, d, "lineitem")
    p = l.filter("l_linenumber < 4").select(F.col("l_orderkey").alias("request"), F.lit("code").alias("source_type"), F.col("l_partkey").alias("source_id"))
    w = l.filter("l_linenumber > 2").select(F.col("l_orderkey").alias("request"), F.lit("code").alias("source_type"), F.col("l_partkey").alias("source_id"), F.when(F.col("l_quantity") > 25, F.col("l_returnflag")).otherwise(" ").alias("reason"))
    return K.hydrated(p, w, "request").select("request", "source_id", "in_packet", "allowed", "audit")


def experience_append(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders")
    hits = o.select((F.col("o_custkey") % 100).alias("request"), F.col("o_orderkey").alias("experience_id"), F.col("o_orderkey").alias("rank"), F.lit("active").alias("lifecycle"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'verified_passed' WHEN 'O' THEN 'verified_failed' ELSE 'missing' END").alias("verification"), F.lit("strong").alias("strength"), F.repeat("o_orderpriority", 10).alias("summary"))
    members = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("experience_id"), (F.col("l_partkey") % 400).alias("event_id")).distinct()
    return K.with_experiences(hits, hits, members, "request").select("request", "experience_id", "tokens")


def experience_degradation(spark: SparkSession, d: str) -> DataFrame:
    """Customers as requests, some without history, and their orders as hits whose events, lines
    by part, several orders tell."""
    c, o = T.table(spark, d, "customer"), T.table(spark, d, "orders")
    k = F.col("c_custkey")
    requests = c.select(k.alias("request"), (k % 10 != 1).alias("requested"), (k % 10 != 2).alias("enabled"), (k % 10 != 3).alias("available"))
    hits = o.select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("experience_id"), F.col("o_orderkey").alias("rank"), F.when(F.col("o_orderkey") % 4 == 0, "refuted").otherwise("active").alias("lifecycle"), F.lit("verified_passed").alias("verification"), F.lit("strong").alias("strength"), F.repeat("o_orderpriority", (F.col("o_custkey") % 9).cast("int")).alias("summary"))
    members = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("experience_id"), (F.col("l_partkey") % 3).alias("event_id")).distinct()
    return K.history_explained(requests, hits, members, "request", 60)


def context_preparation(spark: SparkSession, d: str) -> DataFrame:
    """Lines as requests that name customers as sessions and orders as tasks."""
    c, o, l = (T.table(spark, d, n) for n in ("customer", "orders", "lineitem"))
    sessions = c.filter("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("session_id"), (F.col("c_custkey") % 3).alias("workspace_id"), F.when(F.col("c_custkey") % 5 == 0, "2024").alias("ended_at"))
    status = F.when(F.col("o_orderstatus") == "O", "active").otherwise("completed")
    tasks = o.filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("task_id"), (F.col("o_custkey") % 3).alias("workspace_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("session_id"), status.alias("status"))
    session = F.when(F.col("l_linenumber") == 4, F.col("o_custkey") + 3).otherwise(F.col("o_custkey"))
    r = l.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("request"), (F.col("o_custkey") % 3 + F.when(F.col("l_linenumber") == 5, 1).otherwise(0)).alias("workspace_id"), session.alias("session_id"), F.col("l_orderkey").alias("task_id"),
        F.when(F.col("l_linenumber") == 2, " ").otherwise(F.col("l_returnflag")).alias("query"), F.when(F.col("l_linenumber") == 3, 0).otherwise(100).alias("token_budget"),
    )
    return K.preparable(r, sessions, tasks)


def incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = T.table(spark, d, "documents")
    row = lambda df, h: df.select(F.col("source").alias("document_id"), F.col("doc_id").alias("stable_key"), F.col("doc_id").alias("chunk_id"), h.alias("content_hash"))
    old = row(docs.filter("doc_id % 10 <> 0"), F.sha2("text", 256))
    new = row(docs.filter("doc_id % 10 <> 1"), F.when(F.col("doc_id") % 10 == 2, "edited").otherwise(F.sha2("text", 256)))
    return N.changes(old, new, "document_id", "stable_key").select("stable_key", "status", "embed")


def removed_documents(spark: SparkSession, d: str) -> DataFrame:
    c = T.chunks(spark, d).select("path", "chunk_id")
    return N.removed(c, c.filter("chunk_id % 4 <> 0"), c.filter("chunk_id % 8 = 0")).select("path")


def noop_documents(spark: SparkSession, d: str) -> DataFrame:
    c = T.chunks(spark, d).select("path", F.col("chunk_id").alias("id"), F.md5("content").alias("content_hash"))
    stored = c.select("path", F.when(F.col("id") % 7 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("id") % 11 == 0, "1").otherwise("2").alias("analyzer_version"), F.lit("s").alias("segmentation_id"), F.when(F.col("id") % 13 == 0, "error").otherwise("current").alias("graph_state"))
    spaces = c.filter("id % 2 = 0").select("path", (F.col("id") % 6 != 0).alias("compatible"))
    return N.unchanged_documents(c.select("path", "content_hash"), stored, spaces, "2", "s")


def chunk_generic(spark: SparkSession, d: str) -> DataFrame:
    """Raw pages in overlapping chunks."""
    return N.chunked(T.table(spark, d, "pages"), "page_id", "html").select("page_id", "ordinal", "start", "end", F.sha2("content", 256).alias("content_hash"))


def segment_chunks(spark: SparkSession, d: str) -> DataFrame:
    return N.segmented(T.table(spark, d, "documents").withColumnRenamed("text", "content"), "doc_id", 2000, 100).select("doc_id", "part", "parts", "start", "end")


def embedding_batches(spark: SparkSession, d: str) -> DataFrame:
    docs = T.table(spark, d, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("tokens"))
    return N.batched(docs, "source", "doc_id", "tokens", 16, 20000).select("doc_id", "batch")


def vector_violations(spark: SparkSession, d: str) -> DataFrame:
    v = T.vectors(spark, d).select("chunk_id", F.when(F.col("chunk_id") % 10 == 0, F.slice("vector", 1, 3)).when(F.col("chunk_id") % 10 == 1, F.array().cast("array<float>")).when(F.col("chunk_id") % 10 == 2, F.transform("vector", lambda x: x * float("nan"))).otherwise(F.col("vector")).alias("vector"))
    return N.bad_vectors(v, 64)


def disambiguated_keys(spark: SparkSession, d: str) -> DataFrame:
    c = T.table(spark, d, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("start"), F.col("lang").alias("stable_key"), F.col("text").alias("content"))
    return N.disambiguated(c).select("start", "stable_key")


def language_filter_hash(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of a workspace: those that its patterns take, by language."""
    ext = F.element_at(F.array(*map(F.lit, ("rs", "py", "md", "TS", "go", "jsx", "cs"))), (F.col("doc_id") % 7 + 1).cast("int"))
    path = F.concat(F.lit("src/"), "source", F.lit("/f"), F.col("doc_id"), F.lit("."), ext)
    t = T.table(spark, d, "documents").withColumn("path", path)
    t = t.filter((F.octet_length("text") <= W.MOST_BYTES) & W.selected(F.col("path"), ["*.rs", "*.py", "*.md", "*.TS", "src/*/*.go"], ["src3/", "!src/src3/*.py"]))
    return t.select("doc_id", W.language_of(F.col("path"), ("rust", "python", "typescript")).alias("language"), F.sha2("text", 256).alias("content_hash"))


_CAND = """c AS (SELECT l_orderkey AS request, ['code', 'document', 'memory', 'event', 'task_state'][l_suppkey % 5 + 1] AS source_type, l_partkey % 4 AS source_id, CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 10 END AS semantic, CASE WHEN l_linenumber % 3 = 0 THEN l_tax * 10 END AS lexical, l_tax * 5 AS task, l_quantity / 50 AS recency,
['caller', 'neighbor', 'pinned', 'semantic_match', 'active_task_reference', 'lexical_match'][l_partkey % 6 + 1] AS reason, l_partkey % 6 < 2 AS ev, 3 - l_linenumber % 3 AS fp FROM lineitem),
m AS (SELECT request, source_type, source_id, max(semantic) AS semantic, max(lexical) AS lexical, max(task) AS task, max(recency) AS recency, list_sort(list_distinct(list(reason))) AS reasons, bool_or(ev) AS ev, max(fp) AS fp FROM c GROUP BY ALL),
r AS (SELECT *, (0.24 * least(coalesce(semantic, 0), 1) + 0.16 * least(coalesce(lexical, 0), 1) + 0.14 * least(task, 1) + 0.14 * 0.25 + 0.10 * least(recency, 1) + 0.08 * CASE source_type WHEN 'code' THEN 1 WHEN 'document' THEN 1 WHEN 'memory' THEN 0.9 WHEN 'event' THEN 0.8 ELSE 0.95 END
+ 0.08 * CASE fp WHEN 3 THEN 1 WHEN 2 THEN 0.5 ELSE 0.25 END + 0.06 * CASE WHEN list_contains(reasons, 'caller') THEN 1 WHEN list_contains(reasons, 'neighbor') THEN 0.8 ELSE 0 END) / 1.0 AS final, CASE WHEN list_contains(reasons, 'active_task_reference') THEN 0 WHEN list_contains(reasons, 'pinned') THEN 2 ELSE 255 END AS req FROM m)"""

QUERIES = {
    f.__name__: f
    for f in (
        candidate_merge_rank, required_reservation, packet_greedy, packet_explanation, resume_selection, hydration_audit, experience_append, experience_degradation, context_preparation, incremental_diff, removed_documents, noop_documents,
        chunk_generic, segment_chunks, embedding_batches, vector_violations, disambiguated_keys, language_filter_hash,
    )
}
SQL = {
    "candidate_merge_rank": f"WITH {_CAND} SELECT request, source_type, source_id, round(semantic, 6) AS semantic, round(recency, 6) AS recency, array_to_string(reasons, ',') AS reasons, ['historical', 'recent', 'current'][fp] AS freshness, round(final, 6) AS final FROM r",
    "required_reservation": f"""WITH {_CAND}, n AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY req, round(final, 9) DESC, task DESC, coalesce(semantic, 0) DESC, coalesce(lexical, 0) DESC, fp DESC, recency DESC, source_type, source_id) AS n FROM r),
w AS (SELECT request, bool_or(ev AND n <= 3) AS has, min(n) FILTER (ev AND n > 3) AS spare, max(n) FILTER (n <= 3 AND req = 255) AS last FROM n GROUP BY 1)
SELECT request, source_type, source_id FROM n JOIN w USING (request) WHERE CASE WHEN NOT has AND spare IS NOT NULL AND last IS NOT NULL THEN (n <= 3 AND n <> last) OR n = spare ELSE n <= 3 END""",
    "resume_selection": """WITH s AS (SELECT o_custkey AS owner, arg_max(o_orderkey % 7, (o_orderkey % 5 = 0, o_orderdate, o_orderkey % 7)) AS sid, max((o_orderkey % 5 = 0)::INT) = 1 AS act FROM orders GROUP BY 1),
t0 AS (SELECT o.*, s.*, o_orderkey % 7 = sid AS own FROM orders o JOIN s ON o_custkey = owner WHERE o_orderstatus <> 'F'), t AS (SELECT owner, arg_max(o_orderkey, (own, o_orderstatus = 'O', o_orderdate, o_orderkey)) AS task_id, arg_max(CASE WHEN own THEN 'session_' ELSE 'workspace_' END || CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'incomplete' END, (own, o_orderstatus = 'O', o_orderdate, o_orderkey)) AS task_rule FROM t0 GROUP BY owner),
b AS (SELECT s.owner, sid, act, task_id, task_rule FROM s LEFT JOIN t ON s.owner = t.owner), c AS (SELECT owner, arg_max(o_orderkey, (CASE WHEN o_orderkey % 2 = 0 AND o_orderkey = task_id THEN 2 WHEN o_orderkey % 2 <> 0 AND o_orderkey % 7 = sid THEN 1 ELSE 0 END, o_orderdate, o_orderkey)) AS checkpoint_id FROM orders JOIN b ON o_custkey = owner WHERE o_orderkey % 3 = 0 GROUP BY owner)
SELECT b.owner, CASE WHEN act THEN 'latest_active' ELSE 'latest_ended' END AS session_rule, task_id, task_rule, checkpoint_id FROM b LEFT JOIN c ON b.owner = c.owner""",
    "hydration_audit": "WITH p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber < 4), w AS (SELECT l_orderkey AS request, l_partkey AS source_id, (l_orderkey, l_partkey) IN (SELECT (l_orderkey, l_partkey) FROM p) AS in_packet, l_quantity > 25 AS has FROM lineitem WHERE l_linenumber > 2) SELECT request, source_id, in_packet, in_packet OR has AS allowed, NOT in_packet AND has AS audit FROM w",
    "experience_append": """WITH h AS (SELECT o_custkey % 100 AS request, o_orderkey AS id, 10 * length(o_orderpriority) AS tokens FROM orders WHERE o_orderstatus IN ('F', 'O')), m AS (SELECT DISTINCT l_orderkey AS id, l_partkey % 400 AS e FROM lineitem),
f AS (SELECT request, e, min(id) AS id FROM h JOIN m USING (id) GROUP BY ALL), own AS (SELECT request, id, count(*) AS k FROM f GROUP BY ALL), z AS (SELECT id, count(*) AS k FROM m GROUP BY 1),
a AS (SELECT h.*, sum(tokens) OVER (PARTITION BY request ORDER BY id ROWS UNBOUNDED PRECEDING) AS total FROM h JOIN own USING (request, id) JOIN z USING (id) WHERE own.k = z.k) SELECT request, id AS experience_id, tokens FROM a WHERE total <= 768""",
    "experience_degradation": """WITH r AS (SELECT c_custkey AS request, c_custkey % 10 AS x FROM customer), h AS (SELECT o_custkey AS request, o_orderkey AS id, length(o_orderpriority) * (o_custkey % 9) AS tokens FROM orders JOIN r ON o_custkey = request WHERE o_orderkey % 4 <> 0 AND x NOT IN (1, 2, 3)),
m AS (SELECT DISTINCT l_orderkey AS id, l_partkey % 3 AS e FROM lineitem), f AS (SELECT request, e, min(id) AS id FROM h JOIN m USING (id) GROUP BY ALL), own AS (SELECT request, id, count(*) AS k FROM f GROUP BY ALL), z AS (SELECT id, count(*) AS k FROM m GROUP BY 1),
a AS (SELECT h.*, sum(tokens) OVER (PARTITION BY request ORDER BY id ROWS UNBOUNDED PRECEDING) AS total FROM h JOIN own USING (request, id) JOIN z USING (id) WHERE own.k = z.k),
n AS (SELECT request, x, (SELECT count(*) FROM h WHERE h.request = r.request) AS c, (SELECT count(*) FROM a WHERE a.request = r.request) AS u, (SELECT count(*) FROM a WHERE a.request = r.request AND total <= 60) AS s FROM r)
SELECT request, c AS candidates, s AS selected, c - u AS deduplicated, u - s AS over_budget, CASE WHEN x = 1 THEN 'not_requested' WHEN x = 2 THEN 'disabled' WHEN x = 3 THEN 'search_unavailable' WHEN c = 0 THEN 'no_eligible_result' WHEN s > 0 THEN NULL WHEN c > u THEN 'deduplicated' ELSE 'budget_exhausted' END AS degradation FROM n""",
    "context_preparation": """WITH q AS (SELECT l_orderkey * 8 + l_linenumber AS request, l_linenumber AS n, o_custkey AS cu, CASE WHEN l_linenumber = 4 THEN o_custkey + 3 ELSE o_custkey END AS s, l_orderkey AS t, o_orderstatus = 'O' AS active FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT request, CASE WHEN n = 2 THEN 'empty_query' WHEN n = 3 THEN 'no_budget' WHEN s % 9 = 0 OR s NOT IN (SELECT c_custkey FROM customer) THEN 'session_not_found' WHEN t % 7 = 0 THEN 'task_not_found' WHEN n = 5 OR (t % 2 = 0 AND s <> cu) THEN 'provenance_mismatch' WHEN s % 5 = 0 THEN 'session_ended' WHEN NOT active THEN 'task_not_active' ELSE 'prepared' END AS outcome FROM q""",
    "incremental_diff": "SELECT doc_id AS stable_key, CASE doc_id % 10 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' WHEN 2 THEN 'modified' ELSE 'unchanged' END AS status, doc_id % 10 IN (0, 2) AS embed FROM documents",
    "removed_documents": "SELECT source || '/' || doc_id AS path FROM documents WHERE doc_id % 4 = 0 AND doc_id % 8 <> 0",
    "noop_documents": "SELECT source || '/' || doc_id AS path FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id % 6 <> 0",
    "embedding_batches": """WITH RECURSIVE r AS (SELECT source, doc_id, strlen(text) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
f(source, doc_id, n, batch, items, used, own) AS (SELECT source, doc_id, n, 0, (t <= 20000)::INT, CASE WHEN t <= 20000 THEN t ELSE 0 END, CASE WHEN t > 20000 THEN -1 ELSE 0 END FROM r WHERE n = 1
UNION ALL SELECT r.source, r.doc_id, r.n, CASE WHEN t <= 20000 AND items > 0 AND (items = 16 OR used + t > 20000) THEN batch + 1 ELSE batch END, CASE WHEN t > 20000 THEN items WHEN items > 0 AND (items = 16 OR used + t > 20000) THEN 1 ELSE items + 1 END,
CASE WHEN t > 20000 THEN used WHEN items > 0 AND (items = 16 OR used + t > 20000) THEN t ELSE used + t END, CASE WHEN t > 20000 THEN -1 WHEN items > 0 AND (items = 16 OR used + t > 20000) THEN batch + 1 ELSE batch END FROM f JOIN r ON r.source = f.source AND r.n = f.n + 1)
SELECT doc_id, own::BIGINT AS batch FROM f""",
    "vector_violations": "SELECT vec_id AS chunk_id, CASE vec_id % 10 WHEN 0 THEN 'dimension' WHEN 1 THEN 'empty' ELSE 'not_finite' END AS problem FROM embeddings WHERE vec_id % 10 <= 2",
    "disambiguated_keys": """WITH c AS (SELECT source, doc_id, lang, sha256(text)[1:10] AS h FROM documents), n AS (SELECT *, count(*) OVER (PARTITION BY source, lang) AS n, row_number() OVER (PARTITION BY source, lang, h ORDER BY doc_id) AS m FROM c)
SELECT doc_id AS start, CASE WHEN n = 1 THEN lang ELSE lang || '#' || h || CASE WHEN m > 1 THEN '~' || m ELSE '' END END AS stable_key FROM n""",
    "language_filter_hash": """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' WHEN 3 THEN 'typescript' ELSE 'generic' END AS language, sha256(text) AS content_hash FROM documents
WHERE strlen(text) <= 1048576 AND ((doc_id % 7 <= 4 AND source <> 'src3') OR (doc_id % 7 = 1 AND source = 'src3'))""",
}
