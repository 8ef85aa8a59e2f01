"""Queries of the change streams over recorded events, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.storage import shared_path
from tessera.sources import files as L
from tessera.sources import sinks as S
from tessera.sources import tables as T
from tessera.streaming import changes as H
from tessera.streaming import journal as J
from tessera.streaming import working_set as K


def _signals(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d)
    return e.select(F.concat(F.lit("src/"), F.col("owner")).alias("path"), "event_type", F.col("created_at").alias("ts"))


def debounce_session(spark: SparkSession, d: str) -> DataFrame:
    out = H.debounced(_signals(spark, d), "6 hours")
    return out.select("path", F.col("started_at").cast("timestamp_ntz").alias("started_at"), "event_type", "signals")


def debounce_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same by a stream that takes the whole table at once, in update mode."""
    schema = T.table(spark, d, "events").schema
    path = f"{d}/events.parquet"
    raw = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    signals = raw.select(F.concat(F.lit("src/"), F.col("user_id")).alias("path"), "event_type", T.utc("ts").alias("ts"))
    out, checkpoint = shared_path(spark, "debounced"), shared_path(spark, "debounce")
    H.run_available(H.debounced(signals, "6 hours", "40 days"), H.by_batch(out), checkpoint, "complete")
    done = spark.read.parquet(out)
    return done.filter(F.col("batch") == done.agg(F.max("batch")).first()[0]).select("path", F.col("started_at").cast("timestamp_ntz").alias("started_at"), "event_type", "signals")


def signal_routing(spark: SparkSession, d: str) -> DataFrame:
    docs = T.table(spark, d, "customer").select(F.concat(F.lit("src/"), F.col("c_custkey") * 3).alias("path"))
    return H.routed(_signals(spark, d).select("path").distinct(), docs)


def idempotent_delivery(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events")
    requests = e.select(F.col("user_id").alias("request_key"), (F.col("event_id") % 2).cast("string").alias("content"), F.col("event_id").alias("seq"))
    receipts = T.table(spark, d, "customer").filter("c_custkey < 40").select(F.col("c_custkey").alias("request_key"), F.lit("0").alias("content"))
    return S.delivered(requests, receipts, ["request_key"], "content").select("seq", "result")


def ingress_sequence(spark: SparkSession, d: str) -> DataFrame:
    return S.sequenced(T.table(spark, d, "events").select("event_id", "ts"), 100, "ts", "event_id").select("event_id", "ingress_seq")


def document_upsert(spark: SparkSession, d: str) -> DataFrame:
    docs = T.table(spark, d, "documents").select("doc_id", "lang")
    new = docs.filter("doc_id % 3 = 0").withColumn("lang", F.lit("xx"))
    return S.upserted(docs.filter("doc_id % 2 = 0"), new, ["doc_id"], docs.filter("doc_id % 10 = 4"))


def deregistration_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows that would go with a workspace: here, with a source of documents."""
    docs = T.table(spark, d, "documents").select("doc_id", F.col("source").alias("workspace_id"))
    labels = T.table(spark, d, "labels").join(docs, "doc_id")
    return S.workspace_counts({"documents": docs, "labels": labels}, "src1")


def signal_backlog(spark: SparkSession, d: str) -> DataFrame:
    """A journal of the events, a hundred a file, taken in three runs of one stream: a few
    files, then all but three, which may be too many, then the rest."""
    root, out, checkpoint = (shared_path(spark, x) for x in ("journal", "planned", "journal-offsets"))
    e = T.table(spark, d, "events").select(F.floor(F.col("event_id") / 100).alias("n"), "event_id", F.concat(F.lit("src/"), "user_id").alias("path"), "event_type", T.utc("ts").alias("ts"))
    line = F.to_json(F.struct("path", "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts")))
    files = e.groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"), F.count("*").alias("k"))
    files = files.select("n", F.concat(F.format_string("%012d-%d.jsonl", F.col("n") + 1, F.col("k"))).alias("path"), "text")
    last = files.agg(F.max("n")).first()[0]
    for some in (F.col("n") < 5, (F.col("n") >= 5) & (F.col("n") <= last - 3), (F.col("n") >= 5) & (F.col("n") > last - 3)):
        L.written(files.filter(some), root).count()
        H.run_available(J.signals(spark, root), lambda rows, batch: H.by_batch(out)(J.planned(rows), batch), checkpoint)
    return spark.read.parquet(out).select(F.col("batch").cast("long").alias("batch"), "action", "path", "event_type", "signals")


def working_set_stream(spark: SparkSession, d: str) -> DataFrame:
    """Working sets kept as state by session, over the whole table at once: entries that have
    decayed when their session goes on are gone, and start anew."""
    schema, path = T.table(spark, d, "events").schema, f"{d}/events.parquet"
    raw = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    a = raw.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("source_id"), T.utc("ts").alias("created_at"))
    out, checkpoint = shared_path(spark, "working-sets"), shared_path(spark, "working-set")
    with K.state_store(spark):
        H.run_available(K.working_sets(a), H.by_batch(out), checkpoint, "update")
    return spark.read.parquet(out).select("session_id", "source_id", F.round("score", 6).alias("score"))


_FIRST = "SELECT *, first_value(event_id % 2) OVER (PARTITION BY user_id ORDER BY event_id) AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events"
_DEBOUNCE = """WITH e0 AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e1 AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e0)
SELECT 'src/' || user_id AS path, min(ts) AS started_at, arg_max(event_type, ts) AS event_type, count(*) AS signals FROM e1 GROUP BY user_id, n"""

_BACKLOG = """e AS (SELECT event_id // 100 AS n, *, max(event_id // 100) OVER () AS last FROM events),
r AS (SELECT *, CASE WHEN n < 5 THEN 0 WHEN n <= last - 3 THEN 1 ELSE 2 END AS run FROM e), c AS (SELECT run, count(*) AS signals, row_number() OVER (ORDER BY run) - 1 AS batch FROM r GROUP BY run)"""
#: Activations one after another; p is when the session last went on before an entry's next one.
_KEPT = """WITH RECURSIVE e AS (SELECT user_id, event_type, ts, lag(ts) OVER s AS p, max(ts) OVER (PARTITION BY user_id) AS ended, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events WINDOW s AS (PARTITION BY user_id ORDER BY ts, event_type, event_id)),
f(user_id, event_type, n, ts, ended, score) AS (SELECT user_id, event_type, n, ts, ended, 0.35::DOUBLE FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.event_type, e.n, e.ts, e.ended, least(1.0, CASE WHEN f.score * pow(0.5, (epoch_us(e.p) - epoch_us(f.ts)) / 6e7 / 90) < 0.01 THEN 0 ELSE f.score * pow(0.5, (epoch_us(e.ts) - epoch_us(f.ts)) / 6e7 / 90) END + 0.35) FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.n = f.n + 1),
g AS (SELECT user_id, event_type, arg_max(score, n) AS score, max(ts) AS ts, any_value(ended) AS ended FROM f GROUP BY ALL)
SELECT user_id AS session_id, event_type AS source_id, round(score, 6) AS score FROM g WHERE score * pow(0.5, (epoch_us(ended) - epoch_us(ts)) / 6e7 / 90) >= 0.01"""

QUERIES = {f.__name__: f for f in (debounce_session, signal_backlog, working_set_stream, debounce_stream, signal_routing, idempotent_delivery, ingress_sequence, document_upsert, deregistration_counts)}
SQL = {
    "debounce_session": _DEBOUNCE,
    "debounce_stream": _DEBOUNCE,
    "signal_backlog": f"""WITH {_BACKLOG} SELECT batch, 'rescan' AS action, NULL::VARCHAR AS path, NULL::VARCHAR AS event_type, signals FROM c WHERE signals > 1024
UNION ALL SELECT batch, 'reconcile', 'src/' || user_id, arg_max(event_type, (ts, n, event_type)), count(*) FROM r JOIN c USING (run) WHERE signals <= 1024 GROUP BY batch, user_id""",
    "working_set_stream": _KEPT,
    "signal_routing": "SELECT path, CASE WHEN path IN (SELECT 'src/' || (c_custkey * 3) FROM customer) THEN 'reconcile' ELSE 'rescan' END AS action FROM (SELECT DISTINCT 'src/' || user_id AS path FROM events)",
    "idempotent_delivery": f"SELECT event_id AS seq, CASE WHEN event_id % 2 <> CASE WHEN user_id < 40 THEN 0 ELSE f END THEN 'conflict' WHEN user_id < 40 OR n > 1 THEN 'replayed' ELSE 'new' END AS result FROM ({_FIRST})",
    "ingress_sequence": "SELECT event_id, 100 + row_number() OVER (ORDER BY ts, event_id) AS ingress_seq FROM events",
    "document_upsert": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id % 3 = 0 OR (doc_id % 2 = 0 AND doc_id % 10 <> 4)",
    "deregistration_counts": "SELECT 'documents' AS name, count(*) AS rows FROM documents WHERE source = 'src1' UNION ALL SELECT 'labels', count(*) FROM labels JOIN documents USING (doc_id) WHERE source = 'src1'",
}
