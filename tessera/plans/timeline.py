"""Queries of the filters, sessions, orders and ranges, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import filters as P
from tessera.operators import intervals as I
from tessera.operators import temporal as O
from tessera.sources import tables as T

NOW = "2024-01-31 00:00:00"


def _now():
    return F.to_timestamp(F.lit(NOW))


def optional_bounds(spark: SparkSession, d: str) -> DataFrame:
    e = P.bounded(T.events(spark, d), "created_at", after="2024-01-10 00:00:00", before=None)
    return P.bounded(e, "value", before=50.0).select("event_id", "event_type")


def scope_prefix_filter(spark: SparkSession, d: str) -> DataFrame:
    return P.scoped(T.chunks(spark, d), ["src1", "src12"], ["EN", "fr"]).select("chunk_id", "path")


def recency_decay(spark: SparkSession, d: str) -> DataFrame:
    return T.events(spark, d).select("event_id", F.round(C.recency(O.age_hours(_now(), "created_at")), 6).alias("recency"))


def freshness_order(spark: SparkSession, d: str) -> DataFrame:
    hours = O.age_hours(_now(), "created_at")
    f = O.freshness(hours, 168.0)
    return T.events(spark, d).select("event_id", f.alias("freshness"), C.freshness_priority(f).cast("long").alias("priority"), F.round(C.freshness_weight(f), 4).alias("weight"))


def activity_time(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d).withColumn("modified_at", F.when(F.col("value") > 100, F.col("created_at") + F.expr("INTERVAL 1 DAY")))
    return e.select("event_id", P.activity_time().cast("timestamp_ntz").alias("active_at"))


def temporal_union(spark: SparkSession, d: str) -> DataFrame:
    """Six kinds of sources in one candidate schema, then freshness and recency order."""
    cols = ["source_type", "source_id", "created_at", "modified_at", "is_superseded"]
    none = F.lit(None).cast("timestamp")
    m, e, t = T.memories(spark, d), T.events(spark, d), T.tasks(spark, d)
    parts = [
        T.chunks(spark, d).select(F.lit("code").alias("source_type"), F.concat(F.lit("c"), F.col("chunk_id")).alias("source_id"), (_now() - F.expr("INTERVAL 1 HOUR") * F.col("chunk_id").cast("int")).alias("created_at"), none.alias("modified_at"), F.lit(False).alias("is_superseded")),
        T.table(spark, d, "pages").select(F.lit("document").alias("source_type"), F.concat(F.lit("d"), F.col("page_id")).alias("source_id"), (_now() - F.expr("INTERVAL 7 HOUR") * F.col("page_id").cast("int")).alias("created_at"), none.alias("modified_at"), F.lit(False).alias("is_superseded")),
        m.select(F.lit("memory").alias("source_type"), F.concat(F.lit("m"), F.col("memory_id")).alias("source_id"), "created_at", none.alias("modified_at"), (F.col("trust") == "rejected").alias("is_superseded")),
        e.select(F.lit("event").alias("source_type"), F.concat(F.lit("e"), F.col("event_id")).alias("source_id"), "created_at", none.alias("modified_at"), F.lit(False).alias("is_superseded")),
        t.select(F.lit("task_state").alias("source_type"), F.concat(F.lit("t"), F.col("task_id")).alias("source_id"), "created_at", none.alias("modified_at"), F.lit(False).alias("is_superseded")),
        O.sessions(e, "6 HOURS").select(F.lit("session_state").alias("source_type"), F.concat(F.lit("s"), F.col("session_id")).alias("source_id"), F.col("started_at").alias("created_at"), F.col("ended_at").alias("modified_at"), F.lit(False).alias("is_superseded")),
    ]
    every = parts[0].select(cols)
    for x in parts[1:]:
        every = every.unionByName(x.select(cols))
    return O.temporal_retrieval(every, _now(), 100).select("source_type", "source_id", "freshness", F.round("recency", 6).alias("recency"))


def session_list(spark: SparkSession, d: str) -> DataFrame:
    return O.sessions(T.events(spark, d), "6 HOURS").select("owner", "session_id", F.col("started_at").cast("timestamp_ntz").alias("started_at"), F.col("ended_at").cast("timestamp_ntz").alias("ended_at"), "n_events")


def previous_session_asof(spark: SparkSession, d: str) -> DataFrame:
    return O.previous_session(O.sessions(T.events(spark, d), "6 HOURS")).select("session_id", "previous_id")


def session_range_join(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d)
    return O.events_in_sessions(e, O.sessions(e, "6 HOURS"), _now()).select("event_id", "session_id")


def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return O.latest(T.tasks(spark, d).select("owner", "task_id", "status", "created_at"), ["owner"], "created_at", "task_id").select("owner", "task_id", "status")


def latest_active(spark: SparkSession, d: str) -> DataFrame:
    t = P.bounded(T.tasks(spark, d), "created_at").filter("status = 'active'")
    return O.latest(t.select("owner", "task_id", "created_at"), ["owner"], "created_at", "task_id").select("owner", "task_id")


def recent_events(spark: SparkSession, d: str) -> DataFrame:
    return O.recent(T.events(spark, d), 25, "created_at", "event_id").select("event_id", "event_type")


def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return O.page(T.events(spark, d), "created_at", "event_id", 20, ("2024-01-15 00:00:00", 0)).select("event_id", "has_more")


def recent_change_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d)
    k = F.get_json_object("payload", "$.k")
    ch = e.select(F.concat(F.lit(".\\src\\"), k).alias("path"), F.col("event_type").alias("kind"), F.when(F.col("value") > 20, F.col("owner")).alias("session_id"), "created_at")
    out = O.change_rollup(ch, 7)
    return out.select("path", "changes", "in_session", "unscoped", F.array_join("kinds", ",").alias("kinds"), F.col("first_at").cast("timestamp_ntz").alias("first_at"), F.col("last_at").cast("timestamp_ntz").alias("last_at"))


def change_document_presence(spark: SparkSession, d: str) -> DataFrame:
    """Paths of recent changes, and whether a document has that path now."""
    e = T.events(spark, d).select(F.concat_ws("/", F.concat(F.lit("src"), F.col("owner") % 20), F.get_json_object("payload", "$.k")).alias("path")).distinct()
    c = T.chunks(spark, d).select(F.col("path").alias("p")).distinct()
    return e.join(c, e["path"] == c["p"], "left").select("path", F.col("p").isNotNull().alias("currently_present"))


def sibling_lag_lead(spark: SparkSession, d: str) -> DataFrame:
    c = T.memories(spark, d).select(F.col("memory_id").alias("chunk_id"), "conv_id", "turn")
    return O.siblings(c, ["conv_id"], "turn", "chunk_id").select("chunk_id", "previous_id", "next_id", "ordinal")


def memory_rank_score(spark: SparkSession, d: str) -> DataFrame:
    return O.rank_score(T.memories(spark, d), ["conv_id"], F.desc("turn")).select("memory_id", F.round("score", 6).alias("score"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as ranges, equal ones more than once."""
    l = T.table(spark, d, "lineitem")
    start = (F.col("l_partkey") % 500) * 10
    return l.select(F.col("l_orderkey").alias("document_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), start.alias("start"), (start + F.col("l_quantity").cast("long") * 20 + 1).alias("end"), "l_linenumber")


def _parted(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    return spans.filter("l_linenumber <= 2").withColumnRenamed("id", "node_id"), spans.filter("l_linenumber > 2").withColumnRenamed("id", "chunk_id")


def _spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _parted(_lines(spark, d).distinct())


def interval_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    return I.overlaps(*_spans(spark, d), width=512).select("document_id", "node_id", "chunk_id")


def nearest_chunks(spark: SparkSession, d: str) -> DataFrame:
    return I.nearest_chunks(*_parted(_lines(spark, d)), 2).select("node_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


def nearest_enclosing(spark: SparkSession, d: str) -> DataFrame:
    return I.smallest_enclosing(_lines(spark, d).select("document_id", F.col("id").alias("chunk_id"), "start", "end"))


def interval_union(spark: SparkSession, d: str) -> DataFrame:
    n, c = _spans(spark, d)
    every = n.withColumnRenamed("node_id", "chunk_id").unionByName(c)
    return I.covered(every, "document_id").select("document_id", "covered", "total", F.round(1 - F.col("covered") / F.col("total"), 6).alias("duplicate_ratio"))


def segment_overlap(spark: SparkSession, d: str) -> DataFrame:
    n, c = _spans(spark, d)
    slim = lambda x: x.select("document_id", F.lit("s").alias("source"), "start", "end")
    return I.overlap_ratio(slim(n), slim(c), "document_id").select("document_id", F.round("ratio", 6).alias("ratio"))


_HOURS = f"greatest(epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts), 0) / 3.6e9"
_SESSIONS = """e0 AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e1 AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e0),
ses AS (SELECT user_id AS owner, n, arg_min(event_id, (ts, event_id)) AS session_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_events FROM e1 GROUP BY user_id, n)"""
_SPANS = """sp AS (SELECT DISTINCT l_orderkey AS document_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, (l_partkey % 500) * 10 AS s, (l_partkey % 500) * 10 + l_quantity::BIGINT * 20 + 1 AS e, l_linenumber FROM lineitem),
n AS (SELECT * FROM sp WHERE l_linenumber <= 2), c AS (SELECT * FROM sp WHERE l_linenumber > 2)"""

QUERIES = {
    f.__name__: f
    for f in (
        optional_bounds, scope_prefix_filter, recency_decay, freshness_order, activity_time, temporal_union, session_list, previous_session_asof, session_range_join, latest_per_key, latest_active,
        recent_events, keyset_page, recent_change_rollup, change_document_presence, sibling_lag_lead, memory_rank_score, interval_overlap_join, nearest_chunks, nearest_enclosing, interval_union, segment_overlap,
    )
}
SQL = {
    "optional_bounds": "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND value <= 50",
    "scope_prefix_filter": "SELECT doc_id AS chunk_id, source || '/' || doc_id AS path FROM documents WHERE source IN ('src1', 'src12') AND lower(lang) IN ('en', 'fr')",
    "recency_decay": f"SELECT event_id, round(pow(0.5, {_HOURS} / 72), 6) AS recency FROM events",
    "freshness_order": f"""WITH f AS (SELECT event_id, CASE WHEN {_HOURS} <= 24 THEN 'current' WHEN {_HOURS} <= 168 THEN 'recent' ELSE 'historical' END AS freshness FROM events)
SELECT *, CASE freshness WHEN 'current' THEN 3 WHEN 'recent' THEN 2 ELSE 1 END::BIGINT AS priority, CASE freshness WHEN 'current' THEN 1.0 WHEN 'recent' THEN 0.5 ELSE 0.25 END::DOUBLE AS weight FROM f""",
    "activity_time": "SELECT event_id, CASE WHEN value > 100 THEN ts + INTERVAL 1 DAY ELSE ts END AS active_at FROM events",
    "temporal_union": f"""WITH {_SESSIONS}, tr AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
u AS (SELECT 'code' AS source_type, 'c' || doc_id AS source_id, TIMESTAMP '{NOW}' - doc_id * INTERVAL 1 HOUR AS ts FROM documents
UNION ALL SELECT 'document', 'd' || page_id, TIMESTAMP '{NOW}' - page_id * INTERVAL 7 HOUR FROM pages
UNION ALL SELECT 'memory', 'm' || (conv_id * 1000 + turn), TIMESTAMP '2024-01-01' + conv_id * INTERVAL 1 HOUR + turn * INTERVAL 1 MINUTE FROM conversations LEFT JOIN tr ON conv_id = doc_id WHERE coalesce(toxic, 0) <> 1
UNION ALL SELECT 'event', 'e' || event_id, ts FROM events
UNION ALL SELECT 'task_state', 't' || o_orderkey, o_orderdate FROM orders
UNION ALL SELECT 'session_state', 's' || session_id, ended_at FROM ses),
f AS (SELECT *, pow(0.5, {_HOURS} / 72) AS r, CASE WHEN {_HOURS} <= 24 THEN 3 WHEN {_HOURS} <= 72 THEN 2 ELSE 1 END AS p FROM u)
SELECT source_type, source_id, CASE p WHEN 3 THEN 'current' WHEN 2 THEN 'recent' ELSE 'historical' END AS freshness, round(r, 6) AS recency FROM f ORDER BY p DESC, r DESC, source_type, source_id LIMIT 100""",
    "session_list": f"WITH {_SESSIONS} SELECT owner, session_id, started_at, ended_at, n_events FROM ses",
    "previous_session_asof": f"WITH {_SESSIONS} SELECT session_id, lag(session_id) OVER (PARTITION BY owner ORDER BY started_at, session_id) AS previous_id FROM ses",
    "session_range_join": f"WITH {_SESSIONS} SELECT event_id, session_id FROM events JOIN ses ON user_id = owner AND ts BETWEEN started_at AND ended_at",
    "latest_per_key": "SELECT o_custkey AS owner, o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'active' ELSE 'blocked' END AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "latest_active": "SELECT o_custkey AS owner, o_orderkey AS task_id FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "recent_events": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 25",
    "keyset_page": "WITH p AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-15', 0)) SELECT event_id, (SELECT max(n) FROM p) > 20 AS has_more FROM p WHERE n <= 20",
    "recent_change_rollup": "SELECT 'src/' || (props->>'$.k') AS path, count(*) AS changes, count(*) FILTER (value > 20 AND user_id = 7) AS in_session, count(*) FILTER (NOT value > 20) AS unscoped, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1",
    "change_document_presence": "WITH p AS (SELECT DISTINCT 'src' || (user_id % 20) || '/' || (props->>'$.k') AS path FROM events) SELECT path, path IN (SELECT source || '/' || doc_id FROM documents) AS currently_present FROM p",
    "sibling_lag_lead": "SELECT conv_id * 1000 + turn AS chunk_id, lag(conv_id * 1000 + turn) OVER w AS previous_id, lead(conv_id * 1000 + turn) OVER w AS next_id, row_number() OVER w - 1 AS ordinal FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "memory_rank_score": "SELECT conv_id * 1000 + turn AS memory_id, round((count(*) OVER (PARTITION BY conv_id) - row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) + 1) / count(*) OVER (PARTITION BY conv_id), 6) AS score FROM conversations",
    "interval_overlap_join": f"WITH {_SPANS} SELECT n.document_id, n.id AS node_id, c.id AS chunk_id FROM n JOIN c ON n.document_id = c.document_id AND n.s < c.e AND c.s < n.e",
    "nearest_chunks": f"""WITH {_SPANS}, r AS (SELECT n.id AS node_id, c.id AS chunk_id, row_number() OVER (PARTITION BY n.id ORDER BY (n.s < c.e AND c.s < n.e) DESC, abs(c.s - n.s), c.e - c.s, c.s, c.id) AS rank FROM n JOIN c USING (document_id))
SELECT * FROM r WHERE rank <= 2""",
    "nearest_enclosing": f"WITH {_SPANS} SELECT a.id AS chunk_id, arg_min(b.id, (b.e - b.s, b.s, b.id)) AS enclosing_id FROM sp a JOIN sp b USING (document_id) WHERE b.s <= a.s AND b.e >= a.e AND b.e - b.s > a.e - a.s GROUP BY 1",
    "interval_union": f"""WITH {_SPANS}, k AS (SELECT *, max(e) OVER (PARTITION BY document_id ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM sp),
t AS (SELECT document_id, sum(greatest(e - greatest(s, coalesce(b, s)), 0))::BIGINT AS covered, sum(e - s)::BIGINT AS total FROM k GROUP BY 1) SELECT *, round(1 - covered / total, 6) AS duplicate_ratio FROM t""",
    "segment_overlap": f"""WITH {_SPANS}, x AS (SELECT document_id, sum(e - s) AS n1 FROM n GROUP BY 1), y AS (SELECT document_id, sum(e - s) AS n2 FROM c GROUP BY 1),
b AS (SELECT document_id, sum(greatest(least(n.e, c.e) - greatest(n.s, c.s), 0)) AS k FROM n JOIN c USING (document_id) GROUP BY 1)
SELECT document_id, round(coalesce(k, 0) / least(n1, n2), 6) AS ratio FROM x JOIN y USING (document_id) LEFT JOIN b USING (document_id)""",
}
