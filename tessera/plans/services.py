"""Queries of whole flows and of the operators that stand behind them, and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import columns as C
from tessera.functions.metrics import Counters
from tessera.functions.storage import kept, shared_path
from tessera.operators import experience as X
from tessera.operators import filters as P
from tessera.operators import graph as G
from tessera.operators import ingest as N
from tessera.operators import memory as M
from tessera.operators import temporal as O
from tessera.plans import assembly as A
from tessera.sources import embedding as E
from tessera.sources import sinks as S
from tessera.sources import tables as T
from tessera.streaming import changes as H


def reindex_flow(spark: SparkSession, d: str) -> DataFrame:
    """A second scan of a store: some files are new, changed, unreadable or gone."""
    state, actions = _reindexed(spark, d)
    now = S.read(spark, state, "documents").select("path", F.col("content_hash").alias("stored_hash"), "size")
    return actions.join(now, "path", "left").select("path", "action", "stored_hash", "size")


def process_counters(spark: SparkSession, d: str) -> DataFrame:
    """What both scans of ``reindex_flow`` counted as they ran."""
    counters = Counters()
    _reindexed(spark, d, counters)
    return counters.table(spark)


def _reindexed(spark: SparkSession, d: str, counters: Counters | None = None) -> tuple[dict, DataFrame]:
    store, docs = shared_path(spark, "store"), T.table(spark, d, "documents").withColumn("path", F.concat_ws("/", "source", "doc_id"))
    hashed = docs.select("path", F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"), "doc_id")
    work = lambda row: {"size": len(row["content"])}

    def failing(row: dict) -> dict:
        if int(row["path"].rsplit("/", 1)[1]) % 11 == 3:
            raise ValueError("unreadable")
        return work(row)

    first = hashed.filter("doc_id % 10 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("content_hash")))
    A.reindexed(spark, store, first, first.select("path"), work, "size long", 0, counters)
    second = hashed.filter("doc_id % 13 <> 5")
    return A.reindexed(spark, store, second, second.select("path"), failing, "size long", 1, counters)


def _arms(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Orders as evidence for their customers' requests."""
    o = T.table(spark, d, "orders")
    fresh = F.element_at(F.array(*map(F.lit, ("current", "recent", "historical"))), (F.col("o_orderkey") % 3 + 1).cast("int"))

    def arm(kind: str, source, score=None, reason: str | None = None) -> DataFrame:  # noqa: ANN001
        extra = [score.alias("score")] if score is not None else []
        return o.select(
            F.col("o_custkey").alias("request"), F.lit(kind).alias("source_type"), source.cast("long").alias("source_id"), F.lit("").alias("content"), F.concat(F.lit("src"), source.cast("long") % 4, F.lit("/a")).alias("path"),
            F.lit("Rust").alias("language"), fresh.alias("freshness"), (F.col("o_orderkey") % 10 / 10).alias("recency"), *extra, *([F.lit(reason).alias("reason")] if reason else []),
        )

    k = F.col("o_orderkey")
    return {
        "temporal": arm("task_state", k), "semantic": arm("code", k % 50, k % 7 / 7), "lexical": arm("code", k % 40, k % 6 / 6), "memories": arm("memory", k % 30, k % 5 / 5), "working_set": arm("event", k % 20, k % 4 / 4),
        "pins": arm("code", F.col("o_custkey") % 50), "task": arm("task_state", k), "session": arm("session_state", F.col("o_custkey")), "structural": arm("code", k % 50 + 50, reason="caller"),
    }


def candidate_pool(spark: SparkSession, d: str) -> DataFrame:
    pool = A.candidate_pool(_arms(spark, d), "request", ["src0", "src2", "src3"], ["rust"])
    return pool.select("request", "source_type", "source_id", F.array_join("reasons", ",").alias("reasons"), "freshness", F.round("final", 6).alias("final"))


def assembled_context(spark: SparkSession, d: str) -> DataFrame:
    """Whole packets keep their budget; contents are the length of their numbers."""
    arms = {n: df.withColumn("content", F.repeat(F.lit("x"), (F.col("source_id") % 30 + 1).cast("int"))) for n, df in _arms(spark, d).items()}
    parts = [df for n, df in arms.items() if n in ("semantic", "memories")]
    cols = ["request", "source_type", "source_id", "content", "path", "freshness", "recency"]
    every = [p.select(*cols, F.col("score").alias("semantic"), *[F.lit(None).cast("double").alias(s) for s in ("lexical", "task", "working_set")], F.array(F.lit("semantic_match")).alias("reasons"), F.lit(False).alias("structural_evidence")) for p in parts]
    packet, _ = A.assembled(every[0].unionByName(every[1]), "request", 40)
    return packet.groupBy("request").agg((F.sum("tokens") <= 40).alias("within"), (F.min("tokens") > 0).alias("filled"))


def resume_context(spark: SparkSession, d: str) -> DataFrame:
    o = T.tasks(spark, d)
    s = o.select("owner", (F.col("task_id") % 7).alias("session_id"), F.col("created_at").alias("started_at"), F.when(F.col("task_id") % 5 != 0, F.col("created_at")).alias("ended_at"))
    t = o.select("owner", "task_id", (F.col("task_id") % 7).alias("session_id"), "status", "created_at")
    c = o.filter("task_id % 3 = 0").select("owner", F.col("task_id").alias("checkpoint_id"), (F.col("task_id") % 7).alias("session_id"), F.when(F.col("task_id") % 2 == 0, F.col("task_id")).alias("task_id"), "created_at")
    m = T.memories(spark, d).select(F.col("conv_id").alias("owner"), "memory_id", "created_at")
    e = T.events(spark, d).select("owner", "event_id", (F.col("event_id") % 7).alias("session_id"), "created_at", F.when(F.col("event_type") != "click", F.get_json_object("payload", "$.k")).alias("path"))
    return A.resume_context(s, t, c, m, e, "owner", (2, 3, 2))


def structural_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks of files of fifty, each under that of a third of its number."""
    i = F.col("doc_id") % 50
    c = T.table(spark, d, "documents").select(F.floor(F.col("doc_id") / 50).alias("document_id"), F.col("doc_id").alias("chunk_id"), F.concat(F.lit("k"), i).alias("stable_key"), F.when(i > 2, F.concat(F.lit("k"), F.floor(i / 3))).alias("parent_key"), (i * 10).alias("start"), (i * 10 + 205 - i * 4).alias("end"))
    return O.expanded(c).select("chunk_id", "relation", "related_id", F.col("place").cast("long").alias("place"))


def assessment_review(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders")
    kind = F.element_at(F.array(*map(F.lit, ("confirmed", "superseded", "refuted", "superseded", "odd"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    r = o.select(
        F.floor(F.col("o_orderkey") / 2).alias("request_key"), F.col("o_orderkey").alias("experience_id"), kind.alias("kind"), F.when(F.col("o_orderkey") % 5 == 1, F.col("o_custkey")).when(F.col("o_orderkey") % 5 == 2, F.col("o_custkey") * (F.col("o_orderkey") % 2)).alias("replacement_id"), F.lit("why").alias("reason"), F.col("o_orderkey").alias("seq")
    )
    r = r.withColumn("replacement_id", F.when(F.col("replacement_id") == 0, None).otherwise(F.col("replacement_id")))
    return X.assessed(r, o.select(F.col("o_orderkey").alias("experience_id")), spark.createDataFrame([], "request_key long, content string")).select("seq", "result")


def memory_record(spark: SparkSession, d: str) -> DataFrame:
    c = T.table(spark, d, "conversations")
    r = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("memory_id"), F.when(F.col("turn") == 3, " ").otherwise(F.col("text")).alias("content"), F.when(F.col("turn") == 2, "odd").otherwise(F.lit("fact")).alias("kind"), F.when(F.col("turn") > 0, F.col("conv_id")).alias("session_id"))
    return M.recorded(r, T.table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("session_id"))).select("memory_id", "result")


def checkpoints_created(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders")
    c = o.select(F.col("o_orderkey").alias("checkpoint_id"), F.col("o_custkey").alias("session_id"), T.utc("o_orderdate").alias("created_at"))
    decisions = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("checkpoint_id"), (F.col("l_partkey") % 100).alias("memory_id"))
    m = T.table(spark, d, "part").select(F.col("p_partkey").alias("memory_id"), F.lit("decision").alias("kind"), F.when(F.col("p_partkey") % 9 == 0, "unreviewed").otherwise("trusted").alias("trust"))
    return M.checkpoints_created(c, decisions, m).select("checkpoint_id", "result")


def checkpoint_latest(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("checkpoint_id"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")).alias("session_id"), T.utc("o_orderdate").alias("created_at"))
    return M.latest_checkpoint(o, "session_id")


def pins(spark: SparkSession, d: str) -> DataFrame:
    """Pins of suppliers, one more of the first, and one less."""
    p = T.table(spark, d, "supplier").select((F.col("s_suppkey") % 5).alias("session_id"), F.col("s_suppkey").alias("source_id")).filter("source_id <= 40")
    return M.unpin(M.pin(M.pin(p, 1, 999), 1, 999), 2, 2).select("session_id", "source_id")


def trust_reviews(spark: SparkSession, d: str) -> DataFrame:
    m = T.memories(spark, d).withColumn("origin", F.when(F.col("turn") % 3 == 0, "imported").otherwise("own"))
    first = m.select("memory_id", F.lit("unreviewed").alias("previous"), F.lit("trusted").alias("trust"), F.lit(1).alias("seq"))
    second = m.filter("conv_id % 2 = 0").select("memory_id", F.lit("trusted").alias("previous"), F.lit("rejected").alias("trust"), F.lit(2).alias("seq"))
    return M.reviewed(m, first.unionByName(second))


def episode_requests(spark: SparkSession, d: str) -> DataFrame:
    """Orders join their customers' episodes one by one; one that expects another version is
    refused, and so are all that count on it."""
    o = T.table(spark, d, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    r = o.select(F.col("o_custkey").alias("episode_id"), F.col("o_orderkey").cast("string").alias("request_key"), F.lit("add").alias("action"), F.when(F.col("o_orderkey") % 5 == 0, -1).otherwise(n - 1).cast("long").alias("expected_version"), F.array("o_orderkey").alias("event_ids"), F.col("o_orderkey").alias("seq"))
    e = o.select(F.col("o_custkey").alias("episode_id")).distinct().select("episode_id", F.lit(0).cast("long").alias("version"), F.lit("open").alias("status"))
    return X.mutated(e, r).select("episode_id", "request_key", "result", "version", "members")


def newline_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "documents").select("doc_id", C.newline_count("text").cast("long").alias("newlines"), C.token_count("text").cast("long").alias("tokens"))


def truncated_texts(spark: SparkSession, d: str) -> DataFrame:
    """A prefix of whole characters within 101 bytes: the feature itself."""
    return T.table(spark, d, "documents").select("doc_id", C.truncated("text", 101).alias("head"))


def json_flags(spark: SparkSession, d: str) -> DataFrame:
    payload = F.expr("CASE event_id % 4 WHEN 0 THEN '{\"a\":{\"ok\":true}}' WHEN 1 THEN '{\"a\":{\"ok\":false}}' WHEN 2 THEN '{\"a\":{}}' END")
    return T.table(spark, d, "events").select("event_id", C.json_flag(payload, "$.a.ok").alias("flag"))


def normalized_paths(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" .\\src//"), F.col("p_brand"), F.when(F.col("p_partkey") % 3 == 0, "/x/..").otherwise("/."), F.lit("/f"), F.col("p_partkey"))
    return T.table(spark, d, "part").select("p_partkey", C.normalized_path(raw).alias("path"))


def structural_token_lists(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "part").select("p_partkey", F.array_join(C.structural_tokens(F.concat_ws(" ", F.lit("what calls"), "p_name", F.lit("in src/"), "p_brand", F.lit("of a"))), "|").alias("tokens"))


def graph_freshness(spark: SparkSession, d: str) -> DataFrame:
    c = T.table(spark, d, "customer")
    docs = c.select(F.col("c_custkey").alias("document_id"), F.lit("2").alias("analyzer_version"))
    states = lambda n: c.select(F.col("c_custkey").alias("document_id"), F.lit("current").alias("state"), F.lit(None).cast("string").alias("last_error"), F.when(F.col("c_custkey") == n, "1").otherwise("2").alias("state_version"))
    rows = [("fresh", G.fresh(docs, states(-1), 3, 3)), ("old_revision", G.fresh(docs, states(-1), 4, 3, allow_stale=True)), ("old_analyzer", G.fresh(docs, states(5), 3, 3, allow_stale=True)), ("missing", G.fresh(docs, states(-1).filter("document_id <> 7"), 3, 3, allow_stale=True))]
    return spark.createDataFrame(rows, "name string, fresh boolean")


def replaced_documents(spark: SparkSession, d: str) -> DataFrame:
    l = T.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    new = l.filter("l_orderkey % 3 = 0 AND l_linenumber = 1").withColumn("l_partkey", F.col("l_partkey") + 1)
    return S.replaced(l, new, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


def imported_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events")
    runs = e.select(F.col("user_id").alias("request_key"), F.col("event_type").alias("digest"), F.lit("p").alias("producer"), F.lit("1").alias("producer_version"), F.col("event_id").alias("run_id"), F.col("event_id").alias("seq"))
    known = e.filter("event_id % 4 = 0").select(F.lit("p").alias("producer"), F.lit("1").alias("producer_version"), F.col("event_id").alias("run_id"))
    return S.imported(runs, spark.createDataFrame([], "request_key long, digest string"), known).select("seq", "result")


def snapshot_publish(spark: SparkSession, d: str) -> DataFrame:
    """Two publications; the second replaces one table and leaves the other."""
    store = shared_path(spark, "snapshots")
    docs, labels = T.table(spark, d, "documents").select("doc_id", "lang"), T.table(spark, d, "labels").select("doc_id", "quality")
    S.publish(spark, store, {"documents": docs, "labels": labels}, 0)
    S.publish(spark, store, {"documents": docs.filter("doc_id % 2 = 0")}, 1)
    rows = lambda state: [(n, state["revision"], S.read(spark, state, n).count()) for n in sorted(state["tables"])]
    return spark.createDataFrame(S.consistently(spark, store, rows), "name string, revision long, rows long")


def scope_rules(spark: SparkSession, d: str) -> DataFrame:
    """Sources and languages of documents, written as scopes of eight kinds: as what each is taken."""
    k, src, lang = F.col("doc_id") % 8, F.col("source"), F.col("lang")
    scope = (
        F.when(k == 0, F.concat(F.lit(" "), src, F.lit("/"), lang, F.lit("/ "))).when(k == 1, src).when(k == 2, F.concat(F.lit("/"), src)).when(k == 3, F.concat(src, F.lit("/../"), lang))
        .when(k == 4, F.concat(src, F.lit("//"), lang)).when(k == 5, "").when(k == 6, F.concat(src, F.lit("\\"), lang)).otherwise(F.repeat(src, 200))
    )
    return T.table(spark, d, "documents").select("doc_id", F.coalesce(P.normalized_scope(scope), F.lit("refused")).alias("taken"))


def task_filter(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("task_id"))
    return P.same_task(o, None).select("o_orderkey").unionByName(P.same_task(o, 8).select("o_orderkey"))


def trusted_memories(spark: SparkSession, d: str) -> DataFrame:
    return P.trusted(T.memories(spark, d)).select("memory_id")


def recent_window(spark: SparkSession, d: str) -> DataFrame:
    start = P.window_start(datetime(2024, 1, 31), hours=12, days=3)
    P.valid_range(start, datetime(2024, 1, 31))
    return P.bounded(T.events(spark, d), "created_at", after=start).select("event_id")


def exists_probe(spark: SparkSession, d: str) -> DataFrame:
    c = T.table(spark, d, "customer")
    return P.exists(c, F.col("c_custkey") == 5).select(F.lit("there").alias("name"), "found").unionByName(P.exists(c, F.col("c_custkey") < 0).select(F.lit("absent").alias("name"), "found"))


def session_scope(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d).select("event_id", F.when(F.col("event_type") == "click", "code").otherwise("event").alias("source_type"), F.col("owner").alias("session_id"), (F.col("event_id") % 5 == 0).alias("is_superseded"))
    return P.of_types(P.current_only(P.in_session(e, 7)), ["code", "event"]).select("event_id")


def overflow_batches(spark: SparkSession, d: str) -> DataFrame:
    e = T.events(spark, d).select(F.lit("all").alias("path"), "event_type", F.col("created_at").alias("ts"))
    hours = e.groupBy(F.date_trunc("hour", "ts").alias("started_at")).agg(F.count("*").alias("signals"))
    return H.overflowed(hours, 15).select(F.col("started_at").cast("timestamp_ntz").alias("started_at"), "signals", "rescan")


def isolated_rows(spark: SparkSession, d: str) -> DataFrame:
    def work(row: dict) -> dict:
        if row["c_custkey"] % 10 == 0:
            raise ValueError(f"bad {row['c_custkey']}")
        return {"c_custkey": row["c_custkey"], "twice": row["c_custkey"] * 2}

    out = H.isolated(T.table(spark, d, "customer").select("c_custkey"), work, "c_custkey long, twice long")
    return out.select("twice", "status", "error")


def activation_updates(spark: SparkSession, d: str) -> DataFrame:
    """The stream takes the whole table at once: the scores that the fold gives."""
    schema, path = T.table(spark, d, "events").schema, f"{d}/events.parquet"
    raw = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    a = raw.select(F.col("user_id").alias("session_id"), F.col("event_type").alias("source_id"), T.utc("ts").alias("created_at"))
    out, checkpoint = shared_path(spark, "activations"), shared_path(spark, "activation")
    H.run_available(H.activation_stream(a), H.by_batch(out), checkpoint, "update")
    return spark.read.parquet(out).select("session_id", "source_id", F.round("score", 6).alias("score"))


def vector_codec(spark: SparkSession, d: str) -> DataFrame:
    v = T.vectors(spark, d).withColumn("data", E.packed_vectors(F.col("vector")))
    return v.select("chunk_id", F.length("data").cast("long").alias("bytes"), (E.unpacked_vectors(F.col("data")) == F.col("vector").cast("array<float>")).alias("same"))


def segmentation_names(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and numbers of parts as limits of policies."""
    return T.table(spark, d, "part").select("p_partkey", N.segmentation_names(F.col("p_size") * 10, F.col("p_partkey") % 7).alias("id"))


def adaptive_segments(spark: SparkSession, d: str) -> DataFrame:
    """An endpoint that takes 700 bytes: every text ends up in parts that it takes, and whole."""
    docs = T.table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    parts = A.adaptively_segmented(docs, "doc_id", 2800, lambda s: s.filter(F.octet_length("content") <= 700))
    return parts.groupBy("doc_id").agg(F.max("end").alias("covered"), F.min("start").alias("first"), (F.max(F.octet_length("content")) <= 700).alias("fits"))


def workspace_totals(spark: SparkSession, d: str) -> DataFrame:
    docs = T.table(spark, d, "documents").select("doc_id", F.col("source").alias("workspace_id"))
    tables = {"documents": docs, "labels": T.table(spark, d, "labels").join(docs, "doc_id"), "embeddings": T.table(spark, d, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id")), "none": docs.filter("doc_id < 0")}
    plan = S.deregistration(tables, "src2", 1000.0)
    reasons = [S.stale_reason(plan, tables, "src2", 1299.0), S.stale_reason(plan, tables, "src2", 1300.0), S.stale_reason(plan, tables, "src1", 1000.0), S.stale_reason(plan, tables | {"labels": tables["labels"].limit(0)}, "src2", 1000.0)]
    counts = S.workspace_counts(tables, "src2")
    return counts.unionByName(spark.createDataFrame([(f"{i}:{r or 'holds'}", 0) for i, r in enumerate(reasons)], "name string, rows long"))


_POOL = """o AS (SELECT o_custkey AS request, o_orderkey AS k, o_custkey AS cu, o_orderkey % 10 / 10 AS recency, 3 - o_orderkey % 3 AS fp FROM orders),
a AS (SELECT request, 'task_state' AS source_type, k AS source_id, NULL::DOUBLE AS semantic, NULL::DOUBLE AS lexical, NULL::DOUBLE AS task, NULL::DOUBLE AS ws, recency, fp, 'recent_activity' AS reason, false AS ev FROM o
UNION ALL SELECT request, 'code', k % 50, k % 7 / 7, NULL, NULL, NULL, recency, fp, 'semantic_match', false FROM o UNION ALL SELECT request, 'code', k % 40, NULL, k % 6 / 6, NULL, NULL, recency, fp, 'lexical_match', false FROM o
UNION ALL SELECT request, 'memory', k % 30, NULL, k % 5 / 5, NULL, NULL, recency, fp, 'memory_match', false FROM o UNION ALL SELECT request, 'event', k % 20, NULL, NULL, NULL, k % 4 / 4, recency, fp, 'active_working_set', false FROM o
UNION ALL SELECT request, 'code', cu % 50, NULL, NULL, NULL, 1, recency, fp, 'pinned', false FROM o UNION ALL SELECT request, 'task_state', k, NULL, NULL, 1, NULL, recency, fp, 'active_task_reference', false FROM o
UNION ALL SELECT request, 'session_state', cu, NULL, NULL, 0.8, NULL, recency, fp, 'resume_state', false FROM o UNION ALL SELECT request, 'code', k % 50 + 50, NULL, NULL, NULL, NULL, recency, fp, 'caller', true FROM o),
m AS (SELECT request, source_type, source_id, max(semantic) AS semantic, max(lexical) AS lexical, max(task) AS task, max(ws) AS ws, max(recency) AS recency, list_sort(list_distinct(list(reason))) AS reasons, bool_or(ev) AS ev, max(fp) AS fp FROM a WHERE source_type <> 'code' OR source_id % 4 <> 1 GROUP BY ALL),
r AS (SELECT *, 0.24 * coalesce(semantic, 0) + 0.16 * coalesce(lexical, 0) + 0.14 * coalesce(task, 0) + 0.14 * coalesce(ws, 0) + 0.10 * recency + 0.08 * CASE source_type WHEN 'code' THEN 1 WHEN 'memory' THEN 0.9 WHEN 'event' THEN 0.8 ELSE 0.95 END + 0.08 * CASE fp WHEN 3 THEN 1 WHEN 2 THEN 0.5 ELSE 0.25 END
+ 0.06 * CASE WHEN list_contains(reasons, 'caller') THEN 1 ELSE 0 END AS final, CASE WHEN list_contains(reasons, 'active_task_reference') THEN 0 WHEN list_contains(reasons, 'pinned') THEN 2 ELSE 255 END AS req FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY req, round(final, 9) DESC, coalesce(ws, 0) DESC, coalesce(task, 0) DESC, coalesce(semantic, 0) DESC, coalesce(lexical, 0) DESC, fp DESC, recency DESC, source_type, source_id) AS n FROM r),
w AS (SELECT request, bool_or(ev AND n <= 50) AS has, min(n) FILTER (ev AND n > 50) AS spare, max(n) FILTER (n <= 50 AND req = 255) AS last FROM n GROUP BY 1)"""
_RESUME = """s AS (SELECT o_custkey AS owner, arg_max(o_orderkey % 7, (o_orderkey % 5 = 0, o_orderdate, o_orderkey % 7)) AS sid FROM orders GROUP BY 1),
t0 AS (SELECT o.*, s.*, o_orderkey % 7 = sid AS own FROM orders o JOIN s ON o_custkey = owner WHERE o_orderstatus <> 'F'), t AS (SELECT owner, arg_max(o_orderkey, (own, o_orderstatus = 'O', o_orderdate, o_orderkey)) AS task_id FROM t0 GROUP BY owner),
b AS (SELECT s.owner, sid, task_id FROM s LEFT JOIN t ON s.owner = t.owner), c AS (SELECT owner, arg_max(o_orderkey, (CASE WHEN o_orderkey % 2 = 0 AND o_orderkey = task_id THEN 2 WHEN o_orderkey % 2 <> 0 AND o_orderkey % 7 = sid THEN 1 ELSE 0 END, o_orderdate, o_orderkey)) AS checkpoint_id FROM orders JOIN b ON o_custkey = owner WHERE o_orderkey % 3 = 0 GROUP BY owner),
pos AS (SELECT b.owner, coalesce(checkpoint_id % 7, sid) AS sid FROM b LEFT JOIN c ON b.owner = c.owner),
mm AS (SELECT conv_id AS owner, conv_id * 1000 + turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations WHERE conv_id IN (SELECT owner FROM pos)),
ev AS (SELECT owner, event_id, ts, CASE WHEN event_type <> 'click' THEN props->>'$.k' END AS path, row_number() OVER (PARTITION BY owner ORDER BY ts DESC, event_id) AS rank FROM events JOIN pos ON user_id = owner AND event_id % 7 = sid QUALIFY rank <= 3),
pa AS (SELECT owner, path, row_number() OVER (PARTITION BY owner ORDER BY max(ts) DESC, path) AS rank FROM ev WHERE path IS NOT NULL GROUP BY owner, path)"""
_EXPANDED = """c AS (SELECT doc_id // 50 AS d, doc_id AS id, doc_id % 50 AS i, CASE WHEN doc_id % 50 > 2 THEN doc_id % 50 // 3 END AS p, doc_id % 50 * 10 AS s, doc_id % 50 * 10 + 205 - doc_id % 50 * 4 AS e FROM documents),
en AS (SELECT a.id, arg_min(b.id, (b.e - b.s, b.s, b.id)) AS around FROM c a JOIN c b USING (d) WHERE b.s <= a.s AND b.e >= a.e AND b.e - b.s > a.e - a.s GROUP BY 1),
l AS (SELECT c.*, lag(id) OVER w AS prev, lead(id) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY d, p ORDER BY s, id)),
x AS (SELECT l.*, coalesce((SELECT min(q.id) FROM c q WHERE q.d = l.d AND q.i = l.p), around) AS box, (SELECT min(q.id) FROM c q WHERE q.d = l.d AND q.p = l.i) AS child FROM l LEFT JOIN en USING (id)),
y AS (SELECT x.*, (SELECT min(q.id) FROM c q WHERE q.d = x.d AND q.p IS NOT DISTINCT FROM x.p AND q.id <> x.id AND q.id IS DISTINCT FROM x.prev AND q.id IS DISTINCT FROM x.nxt AND q.id IS DISTINCT FROM x.box) AS other FROM x),
z AS (SELECT id, list_filter([{'r': 'container', 'o': box}, {'r': 'neighbor', 'o': prev}, {'r': 'neighbor', 'o': nxt}, {'r': 'related', 'o': coalesce(child, other)}], lambda v: v.o IS NOT NULL) AS l FROM y)"""

QUERIES = {
    f.__name__: f
    for f in (
        reindex_flow, process_counters, candidate_pool, assembled_context, resume_context, structural_expansion, assessment_review, memory_record, checkpoints_created, checkpoint_latest, pins, trust_reviews, episode_requests, newline_counts, truncated_texts, json_flags,
        normalized_paths, structural_token_lists, graph_freshness, replaced_documents, imported_evidence, snapshot_publish, scope_rules, task_filter, trusted_memories, recent_window, exists_probe, session_scope, overflow_batches, isolated_rows,
        activation_updates, vector_codec, segmentation_names, adaptive_segments, workspace_totals,
    )
}
_REINDEX = """b AS (SELECT doc_id, source || '/' || doc_id AS path, sha256(text) AS h, length(text) AS n, doc_id % 10 <> 0 AS was, doc_id % 13 <> 5 AS now, doc_id % 7 = 0 AS old, doc_id % 11 = 3 AS bad FROM documents),
a AS (SELECT *, CASE WHEN NOT now THEN 'removed' WHEN was AND NOT old THEN 'unchanged' WHEN bad THEN 'failed' WHEN was THEN 'modified' ELSE 'added' END AS action FROM b WHERE now OR was)"""
SQL = {
    "reindex_flow": f"""WITH {_REINDEX} SELECT path, action, CASE WHEN action = 'removed' OR (action = 'failed' AND NOT was) THEN NULL WHEN action = 'failed' THEN 'old' ELSE h END AS stored_hash, CASE WHEN action = 'removed' OR (action = 'failed' AND NOT was) THEN NULL ELSE n END AS size FROM a""",
    "process_counters": f"""WITH {_REINDEX}, n AS (SELECT count(*) FILTER (was) AS w, count(*) FILTER (action IN ('added', 'modified', 'failed')) AS r, count(*) FILTER (action = 'failed') AS f, count(*) FILTER (action = 'added') AS a, count(*) FILTER (action = 'modified') AS m,
count(*) FILTER (action = 'unchanged') AS u, count(*) FILTER (action = 'removed') AS x FROM (SELECT * FROM b LEFT JOIN (SELECT doc_id, action FROM a) USING (doc_id)))
SELECT unnest(['work', 'work', 'work', 'store', 'actions', 'actions', 'actions', 'actions', 'actions']) AS stage, unnest(['read', 'failed', 'done', 'written', 'added', 'modified', 'unchanged', 'failed', 'removed']) AS metric, unnest([w + r, f, w + r - f, w + r - f, w + a, m, u, f, x]) AS value FROM n""",
    "candidate_pool": f"WITH {_POOL} SELECT request, source_type, source_id, array_to_string(reasons, ',') AS reasons, ['historical', 'recent', 'current'][fp] AS freshness, round(final, 6) AS final FROM n JOIN w USING (request) WHERE CASE WHEN NOT has AND spare IS NOT NULL AND last IS NOT NULL THEN (n <= 50 AND n <> last) OR n = spare ELSE n <= 50 END",
    "assembled_context": "SELECT DISTINCT o_custkey AS request, true AS within, true AS filled FROM orders",
    "resume_context": f"WITH {_RESUME} SELECT owner, 'memory' AS part, id::VARCHAR AS id, rank FROM mm WHERE rank <= 2 UNION ALL SELECT owner, 'event', event_id::VARCHAR, rank FROM ev UNION ALL SELECT owner, 'path', path, rank FROM pa WHERE rank <= 2",
    "structural_expansion": f"WITH {_EXPANDED} SELECT id AS chunk_id, v.r AS relation, v.o AS related_id, place - 1 AS place FROM (SELECT id, unnest(l) AS v, unnest(range(1, len(l) + 1)) AS place FROM z)",
    "assessment_review": """WITH r AS (SELECT o_orderkey AS k, o_orderkey // 2 AS q, ['confirmed', 'superseded', 'refuted', 'superseded', 'odd'][o_orderkey % 5 + 1] AS kind, nullif(CASE o_orderkey % 5 WHEN 1 THEN o_custkey WHEN 2 THEN o_custkey * (o_orderkey % 2) END, 0) AS p FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY k) AS n FROM r)
SELECT k AS seq, CASE WHEN n > 1 THEN 'conflict' WHEN kind = 'odd' OR (kind = 'superseded') <> (p IS NOT NULL) OR p IS NOT DISTINCT FROM k THEN 'invalid' WHEN p IS NOT NULL AND p NOT IN (SELECT o_orderkey FROM orders) THEN 'not_found' ELSE 'applied' END AS result FROM f""",
    "memory_record": "SELECT conv_id * 1000 + turn AS memory_id, CASE WHEN turn IN (2, 3) OR trim(coalesce(text, '')) = '' OR strlen(text) > 65536 THEN 'invalid' WHEN turn > 0 AND conv_id NOT IN (SELECT c_custkey * 2 FROM customer) THEN 'unknown_session' ELSE 'recorded' END AS result FROM conversations",
    "checkpoints_created": "SELECT o_orderkey AS checkpoint_id, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND (l_partkey % 100 NOT IN (SELECT p_partkey FROM part) OR l_partkey % 100 % 9 = 0)) THEN 'missing_decision' ELSE 'created' END AS result FROM orders",
    "checkpoint_latest": "SELECT o_custkey AS session_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS checkpoint_id FROM orders WHERE o_custkey % 4 <> 0 GROUP BY 1",
    "pins": "SELECT DISTINCT s_suppkey % 5 AS session_id, s_suppkey AS source_id FROM supplier WHERE s_suppkey <= 40 AND s_suppkey <> 2 UNION ALL SELECT 1, 999",
    "trust_reviews": """WITH tr AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id), m AS (SELECT conv_id, turn, conv_id * 1000 + turn AS memory_id, CASE WHEN t = 1 THEN 'rejected' WHEN q = 1 THEN 'trusted' ELSE 'unreviewed' END AS trust FROM conversations LEFT JOIN tr ON conv_id = doc_id),
a AS (SELECT *, turn % 3 = 0 AND trust = 'unreviewed' AS x FROM m), b AS (SELECT *, turn % 3 = 0 AND conv_id % 2 = 0 AND (x OR trust = 'trusted') AS y FROM a)
SELECT memory_id, CASE WHEN y THEN 'rejected' WHEN x THEN 'trusted' ELSE trust END AS trust, (x::INT + y::INT)::BIGINT AS reviews FROM b""",
    "episode_requests": """WITH n AS (SELECT o_custkey AS e, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS v, o_orderkey % 5 = 0 AS bad FROM orders),
f AS (SELECT *, coalesce(min(v) FILTER (bad) OVER (PARTITION BY e), 1000000) AS stop FROM n)
SELECT e AS episode_id, k::VARCHAR AS request_key, CASE WHEN v < stop THEN 'applied' ELSE 'conflict' END AS result, least(v + 1, stop) AS version, least(v + 1, stop) AS members FROM f""",
    "newline_counts": "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS newlines, strlen(text) AS tokens FROM documents",
    "truncated_texts": "SELECT doc_id, (SELECT max(left(text, n)) FROM range(0, 102) r(n) WHERE strlen(left(text, n)) <= 101) AS head FROM documents",
    "json_flags": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM events",
    "normalized_paths": "SELECT p_partkey, 'src/' || p_brand || '/f' || p_partkey AS path FROM part",
    "structural_token_lists": f"""WITH t AS (SELECT p_partkey, regexp_extract_all('what calls ' || p_name || ' in src/ ' || p_brand || ' of a', '[\\p{{L}}\\p{{N}}_:./\\\\]+') AS t FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(list_filter(t, lambda x: strlen(x) > 1 AND lower(x) NOT IN {C.STOP_WORDS}), lambda x: rtrim(x, '/')))), '|') AS tokens FROM t""",
    "graph_freshness": "SELECT * FROM (VALUES ('fresh', true), ('old_revision', false), ('old_analyzer', NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = 5)), ('missing', NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = 7))) AS t(name, fresh)",
    "replaced_documents": """WITH l AS (SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem), n AS (SELECT l_orderkey, l_partkey + 1 AS l_partkey FROM l WHERE l_orderkey % 3 = 0 AND l_linenumber = 1), u AS (SELECT l_orderkey, l_partkey FROM l WHERE l_orderkey NOT IN (SELECT l_orderkey FROM n) UNION ALL SELECT * FROM n)
SELECT l_orderkey, count(*) AS n, sum(l_partkey)::BIGINT AS parts FROM u GROUP BY 1""",
    "imported_evidence": "WITH f AS (SELECT *, first_value(event_type) OVER w AS first, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id AS seq, CASE WHEN event_type <> first THEN 'conflict' WHEN n > 1 THEN 'replayed' WHEN event_id % 4 = 0 THEN 'conflict' ELSE 'new' END AS result FROM f",
    "snapshot_publish": "SELECT 'documents' AS name, 2::BIGINT AS revision, count(*) AS rows FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'labels', 2, count(*) FROM labels",
    "scope_rules": "SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN source || '/' || lang WHEN 1 THEN source ELSE 'refused' END AS taken FROM documents",
    "task_filter": "SELECT o_orderkey FROM orders WHERE o_custkey % 2 <> 0 OR o_custkey = 8",
    "trusted_memories": "WITH tr AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id) SELECT conv_id * 1000 + turn AS memory_id FROM conversations JOIN tr ON conv_id = doc_id WHERE q = 1 AND t IS DISTINCT FROM 1",
    "recent_window": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-27 12:00:00'",
    "exists_probe": "SELECT 'there' AS name, count(*) > 0 AS found FROM customer WHERE c_custkey = 5 UNION ALL SELECT 'absent', false",
    "session_scope": "SELECT event_id FROM events WHERE event_id % 5 <> 0 AND (event_type = 'click' OR user_id = 7)",
    "overflow_batches": "SELECT date_trunc('hour', ts) AS started_at, count(*) AS signals, count(*) > 15 AS rescan FROM events GROUP BY 1",
    "isolated_rows": "SELECT CASE WHEN c_custkey % 10 <> 0 THEN c_custkey * 2 END AS twice, CASE WHEN c_custkey % 10 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN c_custkey % 10 = 0 THEN 'bad ' || c_custkey END AS error FROM customer",
    "vector_codec": "SELECT vec_id AS chunk_id, 4 * len(embedding) AS bytes, true AS same FROM embeddings",
    "segmentation_names": "SELECT p_partkey, '1:' || left(sha256((p_size * 10) || '|' || (p_partkey % 7)), 16) AS id FROM part",
    "adaptive_segments": "SELECT doc_id, strlen(text) AS covered, 0::BIGINT AS first, true AS fits FROM documents",
    "workspace_totals": """SELECT 'documents' AS name, count(*) AS rows FROM documents WHERE source = 'src2' UNION ALL SELECT 'labels', count(*) FROM labels JOIN documents USING (doc_id) WHERE source = 'src2' UNION ALL SELECT 'embeddings', count(*) FROM embeddings JOIN documents ON vec_id = doc_id WHERE source = 'src2'
UNION ALL SELECT 'none', 0 UNION ALL SELECT * FROM (VALUES ('0:holds', 0), ('1:expired', 0), ('2:workspace_mismatch', 0)) AS t(name, rows) UNION ALL SELECT CASE WHEN EXISTS (SELECT 1 FROM labels JOIN documents USING (doc_id) WHERE source = 'src2') THEN '3:state_changed' ELSE '3:holds' END, 0""",
}
#: The fold of activations, one after another: the same for the table and for the stream.
_FOLD = """WITH RECURSIVE e AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
f(user_id, event_type, n, ts, score) AS (SELECT user_id, event_type, n, ts, 0.35::DOUBLE FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.event_type, e.n, e.ts, least(1.0, f.score * pow(0.5, (epoch_us(e.ts) - epoch_us(f.ts)) / 6e7 / 90) + 0.35) FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.n = f.n + 1)
SELECT user_id AS session_id, event_type AS source_id, round(arg_max(score, n), 6) AS score FROM f GROUP BY ALL"""
SQL["activation_updates"] = _FOLD
