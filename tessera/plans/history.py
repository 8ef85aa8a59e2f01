"""Queries of counts, memories, evidence and experience, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import aggregates as A
from tessera.operators import evidence as V
from tessera.operators import experience as X
from tessera.operators import memory as M
from tessera.operators import temporal as O
from tessera.sources import tables as T

NOW = "2024-01-31 00:00:00"


def instrumentation_counts(spark: SparkSession, d: str) -> DataFrame:
    names = ("documents", "embeddings", "conversations", "events", "orders", "labels", "pages")
    return A.table_counts({n: T.table(spark, d, n) for n in names})


def chunks_by_language(spark: SparkSession, d: str) -> DataFrame:
    return A.grouped_counts(T.chunks(spark, d), "language", "source")


def embedding_compat(spark: SparkSession, d: str) -> DataFrame:
    return A.embedding_compatibility(T.chunks(spark, d), T.vectors(spark, d), "default", 64)


def language_totals(spark: SparkSession, d: str) -> DataFrame:
    nodes = T.graph_nodes(spark, d).select("node_id", "language")
    edges = T.graph_edges(spark, d).join(nodes.withColumnRenamed("node_id", "from_node"), "from_node")
    return A.language_totals(nodes, edges, edges.filter("confidence < 0.85"))


def readiness_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = T.chunks(spark, d)
    return A.readiness(c, c.filter("document_id % 5 <> 0").select("document_id"), c.filter("document_id % 5 <> 0"), T.vectors(spark, d))


def verification_outcome(spark: SparkSession, d: str) -> DataFrame:
    l = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_suppkey").alias("subject"), (F.col("l_returnflag") != "R").alias("passed"))
    return A.outcomes_by_subject(l, "run").select("run", "any_passed", "any_failed", "outcome")


def test_count_rollup(spark: SparkSession, d: str) -> DataFrame:
    l = T.table(spark, d, "lineitem")
    status = F.element_at(F.array(*map(F.lit, ("passed", "passed", "passed", "skipped", "assertion_failed", "errored"))), (F.col("l_partkey") % 6 + 1).cast("int"))
    return A.test_counts(l.select(F.col("l_orderkey").alias("run"), status.alias("status")), "run")


def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    r = A.latency(T.events(spark, d), "value", "event_type")
    return r.select("event_type", "samples", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), "largest")


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return A.nearest_rank(T.events(spark, d), "value", "event_type")


def eval_recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a language ranked by length, against those of good quality."""
    docs = T.table(spark, d, "documents").select(F.col("lang").alias("case_id"), F.col("doc_id").alias("item"), "n_chars")
    expected = docs.join(T.table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("item")).distinct(), "item").select("case_id", "item")
    from pyspark.sql.window import Window

    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("n_chars"), "item")))
    out = A.retrieval_metrics(ranked, expected, 10)
    return out.select("case_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "reciprocal_rank")])


def packet_evaluation(spark: SparkSession, d: str) -> DataFrame:
    l = T.table(spark, d, "lineitem")
    start = (F.col("l_partkey") % 50) * 10
    items = l.select(F.col("l_orderkey").alias("case_id"), (F.col("l_suppkey") % 3).alias("source_id"), start.alias("start"), (start + 100).alias("end"), F.lit(100).alias("tokens"), (F.col("l_linestatus") == "O").alias("is_current"))
    out = A.packet_metrics(items, T.table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.lit(800).alias("token_budget")))
    return out.select("case_id", *[F.round(c, 6).alias(c) for c in ("utilization", "duplicate_ratio", "current_ratio")])


def implementation_coverage(spark: SparkSession, d: str) -> DataFrame:
    p = T.table(spark, d, "part").select((F.col("p_partkey") % 40).alias("case_id"), F.col("p_brand").alias("path"), F.element_at(F.split("p_name", " "), 1).alias("symbol"), F.col("p_name").alias("text"), "p_partkey")
    return A.implementation_coverage(p.filter("p_partkey % 2 = 0").select("case_id", "path", "symbol"), p.filter("p_partkey % 4 >= 1"))


def superseded_flag(spark: SparkSession, d: str) -> DataFrame:
    m = T.memories(spark, d)
    s = m.filter("turn % 3 = 1").select((F.col("memory_id") - 1).alias("superseded"))
    return M.flagged(m, s).select("memory_id", "is_superseded")


def token_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    return M.token_overlap(T.memories(spark, d), "conv_id").select("older", "newer", F.round("ratio", 6).alias("ratio"))


def consolidation_proposals(spark: SparkSession, d: str) -> DataFrame:
    m = T.memories(spark, d)
    overlap = M.token_overlap(m, "conv_id", least=0.5)
    sources = overlap.select("older", "newer", F.when((F.col("older") + F.col("newer")) % 2 == 0, 0.9).otherwise(0.1).alias("source_ratio"))
    return M.proposals(overlap, sources, m.select("memory_id", "trust")).select("older", "newer", F.round("ratio", 6).alias("ratio"), "supersede")


def claim_contradictions(spark: SparkSession, d: str) -> DataFrame:
    m = T.memories(spark, d).select(F.col("conv_id").alias("claim_key"), "memory_id", F.col("kind").alias("claim_value"))
    return M.contradictions(m)


def trust_states(spark: SparkSession, d: str) -> DataFrame:
    return T.memories(spark, d).select("memory_id", "trust")


def working_set_decay(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose score was set by one activation, as they stand a day later."""
    e = T.events(spark, d).filter("created_at >= '2024-01-30'")
    entries = O.latest(e.select(F.col("owner").alias("session_id"), F.col("event_type").alias("source_id"), F.col("created_at").alias("last_at"), "event_id", F.lit(1.0).alias("score")), ["session_id", "source_id"], "last_at", "event_id")
    pins = e.filter("event_type = 'error'").select(F.col("owner").alias("session_id"), F.col("event_type").alias("source_id"))
    return M.working_set(entries, F.to_timestamp(F.lit(NOW)), pins).select("session_id", "source_id", "pinned", F.round("current", 6).alias("current"), F.col("rank").cast("long").alias("rank"))


def working_set_fold(spark: SparkSession, d: str) -> DataFrame:
    a = T.events(spark, d).select(F.col("owner").alias("session_id"), F.col("event_type").alias("source_id"), "created_at", "event_id")
    return M.activate(a).select("session_id", "source_id", F.round("score", 6).alias("score"))


def evidence_decode(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events")
    payload = F.expr("""CASE event_id % 6 WHEN 0 THEN '{"path":"a.py","kind":"edit"}' WHEN 1 THEN '{"path":"a.py","extra":1}' WHEN 2 THEN '{"kind":"edit"}' WHEN 3 THEN 'nonsense' WHEN 4 THEN '{"path":"b"}' ELSE '{"accepted":true}' END""")
    rows = e.select("event_id", F.expr("CASE WHEN event_id % 7 = 0 THEN 'test' WHEN event_id % 6 = 5 THEN 'acceptance' ELSE 'change' END").alias("event_type"), F.expr("CASE WHEN event_id % 6 = 5 THEN 'user_acceptance' WHEN event_id % 11 = 0 THEN 'unheard' ELSE 'source_change' END").alias("contract"), F.lit(1).alias("version"), payload.alias("payload"))
    return V.decoded(rows).select("event_id", "status")


def eligibility_issues(spark: SparkSession, d: str) -> DataFrame:
    c = test_count_rollup(spark, d)
    runs = c.withColumn("exit_code", F.when(F.col("assertion_failed") + F.col("errored") > 0, 1).otherwise(0)).withColumn("bail", F.col("run") % 10 == 0)
    return V.eligibility(runs).select("run", "status", F.array_join("issues", ",").alias("issues"))


def scope_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    l = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.concat_ws("::", "l_suppkey", "l_returnflag").alias("identity"))
    return V.scope_fingerprint(l, "run")


def compiler_signatures(spark: SparkSession, d: str) -> DataFrame:
    p = T.table(spark, d, "part")
    one = F.struct(F.when(F.col("p_partkey") % 3 == 0, "warning").otherwise("error").alias("level"), F.when(F.col("p_partkey") % 5 == 0, "E0308").when(F.col("p_partkey") % 5 == 1, "oops").otherwise("E0425").alias("code"), F.when(F.col("p_partkey") % 2 == 0, F.replace("p_brand", F.lit("#"), F.lit("."))).alias("expected_type"), F.lit("i32").alias("actual_type"), F.when(F.col("p_partkey") % 7 == 0, "../x.rs").otherwise("src/x.rs").alias("path"))
    rows = p.select(F.col("p_partkey").alias("report_id"), (F.col("p_partkey") % 11).alias("exit_code"), F.struct(F.lit("package").alias("kind"), F.lit("core").alias("value")).alias("subject"), F.array(one).alias("diagnostics"))
    return V.compiler_failure(rows).select("report_id", "status", F.coalesce(F.get(F.map_keys("components"), F.lit(0)), F.lit("")).alias("first_component"))


def failure_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Reports of tests, runs and registered tools, from orders: why each has no signature, or
    what it is made of; and how many keys there are for as many different makings."""
    o = T.table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    subject = F.struct(F.when(k % 17 == 0, "file").otherwise("package").alias("kind"), F.when(k % 13 == 0, "a/b").otherwise("core").alias("value"))
    name = F.when(c % 3 == 0, F.concat(F.lit("tests::t"), (c % 50).cast("string"))).when(c % 3 == 1, "bad name!")
    failure = F.struct(name.alias("test_name"), F.when(k % 2 == 0, "assert_eq").alias("assertion_class"))
    failures = F.when(k % 4 == 0, F.array().cast("array<struct<test_name:string,assertion_class:string>>")).when(k % 4 == 3, F.array(failure, failure)).otherwise(F.array(failure))
    tests = V.test_failure(o.select(k.alias("report_id"), (k % 5).alias("exit_code"), subject.alias("subject"), failures.alias("failures")))
    case = lambda status, i: F.struct(status.alias("status"), F.array(F.lit("suite"), F.concat(F.lit("s"), (c % 7).cast("string"))).alias("namespace"), F.lit(f"case{i}").alias("name"), F.lit("AssertionError").alias("error_class"))
    failed = lambda ok: F.when(ok, "assertion_failed").otherwise("passed")
    plain = {"profile_id": "p", "profile_version": "1", "runner_id": "r", "runner_version": "1", "project_root": "", "import_root": "", "selection_kind": "file", "selection_value": "x", "test_file": "t.py"}
    runs = V.test_run_failure(o.select(k.alias("run_id"), F.when(k % 3 == 0, "eligible_passed").otherwise("eligible_failed").alias("status"), F.array(case(failed(k % 5 < 3), 0), case(failed(k % 5 == 2), 1)).alias("cases"), *[F.lit(v).alias(n) for n, v in plain.items()]))
    rules = spark.createDataFrame([("lint", "1", f"v{i}", "1", "lint", "check", ["package"]) for i in range(2)], "rule_id string, rule_version string, verifier_id string, verifier_version string, required_tool string, required_operation string, allowed_subject_kinds array<string>")
    tools = V.registered_tool_failure(
        o.select(k.alias("report_id"), F.concat(F.lit("v"), (c % 3).cast("string")).alias("verifier_id"), F.lit("1").alias("verifier_version"), F.when(k % 7 == 0, "other").otherwise("lint").alias("tool"), F.lit("check").alias("operation"), F.when(k % 5 == 0, "exited_zero").otherwise("exited_nonzero").alias("process_outcome"), F.lit("failed").alias("reported_result"), subject.alias("subject")),
        rules,
    )
    made = F.array_join(F.transform(F.array_sort(F.map_entries("components")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    every = [df.select(F.lit(n).alias("kind"), "report_id", "status", made.alias("made"), "key") for n, df in (("test", tests), ("run", runs), ("tool", tools))]
    every = reduce(DataFrame.unionByName, every)
    keys = every.filter("key IS NOT NULL").groupBy(F.concat(F.lit("keys of "), "kind").alias("kind")).agg(F.countDistinct("key").alias("report_id"), F.when(F.countDistinct("key") == F.countDistinct("made"), "one each").otherwise("not one each").alias("status"), F.lit(None).cast("string").alias("made"))
    return every.drop("key").unionByName(keys)


def episode_fold(spark: SparkSession, d: str) -> DataFrame:
    """Sessions as episodes: errors fail, purchases pass, clicks are changes."""
    e = T.events(spark, d)
    s = O.events_in_sessions(e, O.sessions(e, "6 HOURS"), F.to_timestamp(F.lit(NOW)))
    rows = s.select(
        F.col("session_id").alias("episode_id"), F.col("event_id").alias("ordinal"), F.when(F.col("event_type") == "click", "change").when(F.col("event_type").isin("error", "purchase"), "verification").otherwise("other").alias("kind"),
        (F.col("event_type") == "purchase").alias("passed"), F.lit("s").alias("scope"), F.lit("f").alias("failure"), F.lit("x").alias("subject"), F.lit(False).alias("accepted"), (F.col("value") > 50).alias("source_change"), (F.col("session_id") % 5 != 0).alias("closed"),
    )
    return X.consolidated(rows)


def _experiences(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders")
    e = o.select(
        F.col("o_orderkey").alias("experience_id"), T.utc("o_orderdate").alias("created_at"), F.concat(F.lit("k"), F.col("o_custkey") % 50).alias("failure_key"), F.concat(F.lit("src/"), F.col("o_custkey") % 20).alias("path"),
        F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("bucket"), (F.col("o_custkey") % 5).cast("string")).alias("components"), F.array(F.concat(F.lit("src/"), F.col("o_orderkey") % 20)).alias("snapshot_paths"), F.array(F.concat(F.lit("n"), F.col("o_orderkey") % 30)).alias("snapshot_nodes"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failure' ELSE 'partial_success' END").alias("outcome"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'verified_passed' WHEN 'O' THEN 'verified_failed' ELSE 'conflicting' END").alias("verification"), F.expr("CASE WHEN o_orderkey % 4 = 0 THEN 'strong' ELSE 'moderate' END").alias("strength"),
    )
    a = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("experience_id"), F.expr("CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 'disputed' WHEN l_returnflag = 'A' AND l_quantity > 48 THEN 'refuted' WHEN l_quantity = 1 THEN 'superseded' ELSE 'confirmed' END").alias("assessment"))
    return X.lifecycle(e, a)


def lifecycle_fold(spark: SparkSession, d: str) -> DataFrame:
    return _experiences(spark, d).select("experience_id", "lifecycle")


def experience_score(spark: SparkSession, d: str) -> DataFrame:
    return X.search(_experiences(spark, d), 20, failure_key="k7", path="src/7")


def experience_components(spark: SparkSession, d: str) -> DataFrame:
    return X.search(_experiences(spark, d), 20, components={"priority": "1-URGENT", "bucket": "3"}, strengths=("strong",))


def experience_recent(spark: SparkSession, d: str) -> DataFrame:
    return X.search(_experiences(spark, d), 15, outcomes=("success",))


def historical_references(spark: SparkSession, d: str) -> DataFrame:
    c = T.chunks(spark, d)
    docs = c.select("path", F.md5("content").alias("content_hash"), F.col("document_id").alias("revision"))
    snaps = T.table(spark, d, "documents").select(F.col("doc_id").alias("experience_id"), F.concat_ws("/", "source", F.when(F.col("doc_id") % 5 == 0, "gone").otherwise(F.col("doc_id").cast("string"))).alias("path"), F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.md5("text")).alias("content_hash"), (F.col("doc_id") - F.col("doc_id") % 2).alias("revision"), F.concat(F.lit("part:"), F.col("doc_id") * 3).alias("stable_key"))
    nodes = T.table(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("stable_key"))
    return X.references(snaps, docs, nodes)


def dispute_frontier(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders")
    e = o.select(F.col("o_orderkey").alias("experience_id"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey") * 3).alias("accepted_seq"))
    l = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("experience_id"), F.col("l_partkey").alias("event_id"))
    i = T.table(spark, d, "events").select("event_id", F.col("event_id").alias("seq"))
    return X.disputes(e, l, i)


def record_violations(spark: SparkSession, d: str) -> DataFrame:
    e = _experiences(spark, d).select("experience_id", F.when(F.col("experience_id") % 50 == 0, "odd").otherwise(F.col("outcome")).alias("outcome"), "verification", "strength", F.when(F.col("experience_id") % 40 == 0, " ").otherwise("ok").alias("summary"), F.sha2(F.col("path"), 256).alias("fingerprint"), F.when(F.col("experience_id") % 30 == 0, "short").otherwise(F.sha2(F.col("path"), 256)).alias("proposal_hash"), (F.col("experience_id") % 20).alias("attempts"))
    return X.violations(e)


def failure_summaries(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "conversations").select("conv_id", "turn", C.compacted("text", 120).alias("summary"))


def content_dedup_hash(spark: SparkSession, d: str) -> DataFrame:
    h = T.table(spark, d, "documents").select("doc_id", C.content_hash("text").alias("content_hash"))
    return h.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


_STATUS = "['passed', 'passed', 'passed', 'skipped', 'assertion_failed', 'errored'][l_partkey % 6 + 1]"
_COUNTS = f"""c AS (SELECT l_orderkey AS run, {_STATUS} AS s FROM lineitem), t AS (SELECT run, count(*) AS discovered, count(*) FILTER (s <> 'skipped') AS executed, count(*) FILTER (s = 'passed') AS passed, count(*) FILTER (s = 'assertion_failed') AS assertion_failed, count(*) FILTER (s = 'errored') AS errored,
0::BIGINT AS expected_failed, 0::BIGINT AS unexpected_successful, count(*) FILTER (s = 'skipped') AS skipped, 0::BIGINT AS todo, 0::BIGINT AS pending FROM c GROUP BY run)"""
_TERMS = f"regexp_extract_all(translate(lower(text), '{C.MARKED}', '{C.PLAIN}'), '[\\p{{L}}\\p{{N}}_:]+')"
_OVERLAP = f"""m AS (SELECT conv_id, turn, conv_id * 1000 + turn AS id, unnest({_TERMS}) AS term FROM conversations), f AS (SELECT conv_id, id, term, count(*) AS tf FROM m GROUP BY ALL), n AS (SELECT id, sum(tf) AS n FROM f GROUP BY id),
o AS (SELECT a.id AS older, b.id AS newer, sum(least(a.tf, b.tf)) AS k FROM f a JOIN f b ON a.conv_id = b.conv_id AND a.term = b.term AND a.id < b.id GROUP BY ALL),
r AS (SELECT older, newer, k / least(x.n, y.n) AS ratio FROM o JOIN n x ON x.id = older JOIN n y ON y.id = newer)"""
_TRUST = "tr AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id), mt AS (SELECT conv_id * 1000 + turn AS memory_id, CASE WHEN t = 1 THEN 'rejected' WHEN q = 1 THEN 'trusted' ELSE 'unreviewed' END AS trust FROM conversations LEFT JOIN tr ON conv_id = doc_id)"
_EXP = """a AS (SELECT l_orderkey AS id, max(CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 1 WHEN l_returnflag = 'A' AND l_quantity > 48 THEN 2 WHEN l_quantity = 1 THEN 3 ELSE 0 END) AS w FROM lineitem GROUP BY 1),
e AS (SELECT o_orderkey AS id, o_orderdate AS tm, o_custkey % 50 AS k, o_custkey % 20 AS p, o_orderkey % 20 AS sp, o_orderpriority AS prio, o_custkey % 5 AS bucket, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 1 ELSE 2 END AS oc, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS v, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS st, coalesce(w, 0) AS w FROM orders LEFT JOIN a ON o_orderkey = a.id)"""

QUERIES = {
    f.__name__: f
    for f in (
        instrumentation_counts, chunks_by_language, embedding_compat, language_totals, readiness_rollup, verification_outcome, test_count_rollup, latency_summary, latency_percentiles, eval_recall_mrr, packet_evaluation,
        implementation_coverage, superseded_flag, token_overlap_pairs, consolidation_proposals, claim_contradictions, trust_states, working_set_decay, working_set_fold, evidence_decode, eligibility_issues, scope_fingerprints,
        compiler_signatures, failure_signatures, episode_fold, lifecycle_fold, experience_score, experience_components, experience_recent, historical_references, dispute_frontier, record_violations, failure_summaries, content_dedup_hash,
    )
}
_V = "CASE o_orderstatus WHEN 'F' THEN 'verified_passed' WHEN 'O' THEN 'verified_failed' ELSE 'conflicting' END"
SQL = {
    "failure_signatures": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 17 = 0 THEN 'file' ELSE 'package' END AS sk, o_orderkey % 13 = 0 AS bad, CASE WHEN o_custkey % 3 = 0 THEN 'tests::t' || (o_custkey % 50) END AS tn FROM orders),
t AS (SELECT 'test' AS kind, k AS report_id, CASE WHEN k % 5 = 0 THEN 'not_a_failure' WHEN k % 4 IN (0, 3) THEN 'ambiguous_test_failures' WHEN bad THEN 'invalid_verification_subject' WHEN tn IS NULL AND k % 2 <> 0 THEN 'missing_test_identity' ELSE 'compatible_only' END AS status,
CASE WHEN k % 2 = 0 THEN 'assertion_class=assert_eq;' ELSE '' END || 'subject_kind=' || sk || ';subject_value=core' || coalesce(';test_name=' || tn, '') AS made FROM o),
u AS (SELECT 'run' AS kind, k AS report_id, CASE WHEN k % 3 = 0 THEN 'ineligible_test_run_failure' WHEN k % 5 IN (0, 1) THEN 'compatible_only' ELSE 'ambiguous_test_run_failure' END AS status,
'case_name=case0;case_namespace=2:5:suite2:s' || (c % 7) || ';error_class=AssertionError;import_root=;profile_id=p;profile_version=1;project_root=;runner_id=r;runner_version=1;selection_kind=file;selection_value=x' AS made FROM o),
v AS (SELECT 'tool' AS kind, k AS report_id, CASE WHEN k % 5 = 0 THEN 'not_a_failure' WHEN c % 3 = 2 THEN 'unregistered_verifier_rule' WHEN k % 7 = 0 THEN 'verifier_rule_mismatch' WHEN bad THEN 'invalid_verification_subject' WHEN sk = 'file' THEN 'verifier_subject_not_allowed' ELSE 'compatible_only' END AS status,
'exit_class=nonzero;rule_id=lint;rule_version=1;subject_kind=package;subject_value=core' AS made FROM o),
w AS (SELECT * FROM t UNION ALL SELECT * FROM u UNION ALL SELECT * FROM v), x AS (SELECT kind, report_id, status, CASE WHEN status = 'compatible_only' THEN made END AS made FROM w)
SELECT * FROM x UNION ALL SELECT 'keys of ' || kind, count(DISTINCT made), 'one each', NULL FROM x WHERE made IS NOT NULL GROUP BY kind""",
    "instrumentation_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in ("documents", "embeddings", "conversations", "events", "orders", "labels", "pages")),
    "chunks_by_language": "SELECT lang AS language, source, count(*) AS rows FROM documents GROUP BY ALL",
    "embedding_compat": "SELECT count(*) AS chunks, count(vec_id) AS embedded, count(*) FILTER (len(embedding) = 64) AS compatible, count(DISTINCT len(embedding)) AS spaces, max(len(embedding)) AS largest FROM documents LEFT JOIN embeddings ON doc_id = vec_id",
    "language_totals": """WITH n AS (SELECT 'r' || r_regionkey AS id, 'rust' AS language FROM region UNION ALL SELECT 'n' || n_nationkey, 'rust' FROM nation UNION ALL SELECT 'c' || c_custkey, 'python' FROM customer UNION ALL SELECT 's' || s_suppkey, 'python' FROM supplier UNION ALL SELECT 'p' || p_partkey, 'go' FROM part),
e AS (SELECT 'rust' AS language, 1.0 AS w FROM nation UNION ALL SELECT 'rust', 1.0 FROM supplier UNION ALL SELECT 'python', 0.8 FROM customer UNION ALL SELECT 'python', 0.9 - max(l_discount) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey, l_partkey)
SELECT language, count(*) FILTER (k = 0) AS nodes, count(*) FILTER (k = 1) AS edges, count(*) FILTER (k = 1 AND w < 0.85) AS unresolved FROM (SELECT language, 0 AS k, 1.0 AS w FROM n UNION ALL SELECT language, 1, w FROM e) GROUP BY language""",
    "readiness_rollup": "SELECT lang AS language, count(*) AS files, count(*) FILTER (doc_id % 5 <> 0) AS indexed, count(*) FILTER (doc_id % 5 <> 0) AS chunks, count(vec_id) FILTER (doc_id % 5 <> 0) AS embeddings FROM documents LEFT JOIN embeddings ON doc_id = vec_id GROUP BY lang",
    "verification_outcome": "WITH s AS (SELECT l_orderkey AS run, l_suppkey, bool_or(l_returnflag <> 'R') AS p, bool_or(l_returnflag = 'R') AS f FROM lineitem GROUP BY ALL), w AS (SELECT run, bool_or(p) AS any_passed, bool_or(f) AS any_failed, bool_or(p AND f) AS c FROM s GROUP BY run) SELECT run, any_passed, any_failed, CASE WHEN c THEN 'conflicting' WHEN any_passed AND any_failed THEN 'partial_success' WHEN any_passed THEN 'success' ELSE 'failure' END AS outcome FROM w",
    "test_count_rollup": f"WITH {_COUNTS} SELECT * FROM t",
    "latency_summary": "SELECT event_type, count(*) AS samples, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, max(value) AS largest FROM events GROUP BY 1",
    "latency_percentiles": "SELECT event_type, list_sort(list(value))[ceil(count(*) * 0.5)::INT] AS p50, list_sort(list(value))[ceil(count(*) * 0.95)::INT] AS p95 FROM events GROUP BY 1",
    "eval_recall_mrr": """WITH g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), d AS (SELECT lang, doc_id, doc_id IN (SELECT doc_id FROM g) AS hit, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents)
SELECT lang AS case_id, round(count(*) FILTER (hit AND r <= 10) / count(*) FILTER (hit), 6) AS recall, round(count(*) FILTER (hit AND r <= 10) / count(*) FILTER (r <= 10), 6) AS precision, round(coalesce(1 / min(r) FILTER (hit AND r <= 10), 0), 6) AS reciprocal_rank FROM d GROUP BY lang HAVING count(*) FILTER (hit) > 0""",
    "packet_evaluation": """WITH i AS (SELECT l_orderkey AS c, l_suppkey % 3 AS s, (l_partkey % 50) * 10 AS a, l_linestatus = 'O' AS cur FROM lineitem), k AS (SELECT *, max(a + 100) OVER (PARTITION BY c, s ORDER BY a, l_n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT *, row_number() OVER () AS l_n FROM i)),
g AS (SELECT c, sum(a + 100 - greatest(a, CASE WHEN b IS NULL THEN a ELSE least(b, a + 100) END)) AS cov, sum(100) AS tot, avg(cur::INT) AS cr FROM k GROUP BY c)
SELECT o_orderkey AS case_id, round(coalesce(tot, 0) / 800, 6) AS utilization, round(coalesce(1 - cov / tot, 0), 6) AS duplicate_ratio, round(coalesce(cr, 0), 6) AS current_ratio FROM orders LEFT JOIN g ON o_orderkey = c""",
    "implementation_coverage": """WITH p AS (SELECT p_partkey % 40 AS case_id, p_brand AS path, split_part(p_name, ' ', 1) AS symbol, p_name AS text, p_partkey FROM part), x AS (SELECT DISTINCT case_id, path, symbol FROM p WHERE p_partkey % 2 = 0), c AS (SELECT * FROM p WHERE p_partkey % 4 >= 1),
j AS (SELECT x.*, EXISTS (SELECT 1 FROM c WHERE c.case_id = x.case_id AND c.path = x.path AND c.symbol = x.symbol) AS exact, EXISTS (SELECT 1 FROM c WHERE c.case_id = x.case_id AND contains(c.text, x.symbol)) AS said FROM x)
SELECT case_id, count(*) AS expected, count(*) FILTER (exact) AS implemented, count(*) FILTER (NOT exact AND said) AS mentioned_only FROM j GROUP BY 1""",
    "superseded_flag": "SELECT conv_id * 1000 + turn AS memory_id, (conv_id, turn + 1) IN (SELECT (conv_id, turn) FROM conversations WHERE turn % 3 = 1) AS is_superseded FROM conversations",
    "token_overlap_pairs": f"WITH {_OVERLAP} SELECT older, newer, round(ratio, 6) AS ratio FROM r",
    "consolidation_proposals": f"WITH {_OVERLAP}, {_TRUST} SELECT older, newer, round(ratio, 6) AS ratio, x.trust = 'trusted' AND y.trust = 'trusted' AS supersede FROM r JOIN mt x ON x.memory_id = older JOIN mt y ON y.memory_id = newer WHERE ratio >= 0.8 OR ((older + newer) % 2 = 0 AND ratio >= 0.5)",
    "claim_contradictions": "SELECT a.conv_id AS claim_key, (SELECT count(DISTINCT role) FROM conversations c WHERE c.conv_id = a.conv_id) AS values, (SELECT count(*) FROM conversations c WHERE c.conv_id = a.conv_id) AS memories, count(*) AS pairs FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn AND a.role <> b.role GROUP BY a.conv_id",
    "trust_states": f"WITH {_TRUST} SELECT memory_id, trust FROM mt",
    "working_set_decay": f"""WITH l AS (SELECT user_id AS session_id, event_type AS source_id, max(ts) AS t FROM events WHERE ts >= TIMESTAMP '2024-01-30' GROUP BY ALL), c AS (SELECT session_id, source_id, source_id = 'error' AS pinned, pow(0.5, greatest(epoch_us(TIMESTAMP '{NOW}') - epoch_us(t), 0) / 6e7 / 90) AS current, t FROM l)
SELECT session_id, source_id, pinned, round(current, 6) AS current, row_number() OVER (PARTITION BY session_id ORDER BY pinned DESC, current DESC, t DESC, source_id) AS rank FROM c WHERE pinned OR c.current >= 0.01""",
    "evidence_decode": """SELECT event_id, CASE WHEN event_id % 6 <> 5 AND event_id % 11 = 0 THEN 'unsupported_contract' WHEN event_id % 7 = 0 THEN 'wrong_event_type' ELSE ['decoded', 'unknown_field', 'missing_field', 'invalid_json', 'decoded', 'decoded'][event_id % 6 + 1] END AS status FROM events""",
    "eligibility_issues": f"""WITH {_COUNTS}, i AS (SELECT *, list_filter([CASE WHEN executed = 0 THEN 'empty_test_run' END, CASE WHEN skipped > 0 THEN 'skipped_tests' END, CASE WHEN errored > 0 THEN 'test_execution_errors' END, CASE WHEN run % 10 = 0 THEN 'bail_execution_unsupported' END, CASE WHEN assertion_failed > 1 THEN 'multiple_test_failures' END,
CASE WHEN NOT ((assertion_failed + errored = 0 AND passed = executed) OR (assertion_failed + errored > 0 AND assertion_failed = 1)) THEN 'unsupported_test_outcome' END], lambda x: x IS NOT NULL) AS l FROM t)
SELECT run, CASE WHEN len(l) > 0 THEN 'ineligible' WHEN assertion_failed + errored = 0 THEN 'eligible_passed' ELSE 'eligible_failed' END AS status, coalesce(array_to_string(l, ','), '') AS issues FROM i""",
    "compiler_signatures": """WITH r AS (SELECT p_partkey AS k FROM part) SELECT k AS report_id, s AS status, CASE WHEN s IN ('exact', 'compatible_only') THEN 'diagnostic_code' ELSE '' END AS first_component FROM (SELECT k, CASE WHEN k % 11 = 0 THEN 'not_a_failure' WHEN k % 3 = 0 THEN 'ambiguous_compiler_diagnostics' WHEN k % 5 = 1 THEN 'missing_structured_diagnostic_code' WHEN k % 7 = 0 THEN 'unsafe_diagnostic_path'
WHEN k % 5 = 0 AND k % 2 <> 0 THEN 'missing_type_distinction' WHEN k % 5 = 0 THEN 'exact' ELSE 'compatible_only' END AS s FROM r)""",
    "lifecycle_fold": f"WITH {_EXP} SELECT id AS experience_id, ['active', 'disputed', 'refuted', 'superseded'][w + 1] AS lifecycle FROM e",
    "experience_score": f"""WITH {_EXP}, x AS (SELECT id FROM e WHERE k = 7 ORDER BY tm DESC, id DESC LIMIT 200), y AS (SELECT id FROM e WHERE p = 7 OR sp = 7 ORDER BY tm DESC, id DESC LIMIT 200)
SELECT id AS experience_id, id IN (FROM x) AS exact, 0::BIGINT AS matched, (CASE WHEN id IN (FROM x) THEN 1000 ELSE 0 END + 60)::BIGINT AS total FROM e WHERE w = 0 AND id IN (FROM y) ORDER BY exact DESC, v DESC, st DESC, oc DESC, total DESC, id LIMIT 20""",
    "experience_components": f"""WITH {_EXP}, x AS (SELECT id FROM e WHERE prio = '1-URGENT' OR bucket = 3 ORDER BY tm DESC, id DESC LIMIT 200)
SELECT id AS experience_id, false AS exact, 2::BIGINT AS matched, 40::BIGINT AS total FROM e WHERE w = 0 AND st = 2 AND prio = '1-URGENT' AND bucket = 3 AND id IN (FROM x) ORDER BY v DESC, st DESC, oc DESC, id LIMIT 20""",
    "experience_recent": f"WITH {_EXP}, x AS (SELECT id FROM e ORDER BY tm DESC, id DESC LIMIT 200) SELECT id AS experience_id, false AS exact, 0::BIGINT AS matched, 0::BIGINT AS total FROM e WHERE w = 0 AND oc = 3 AND id IN (FROM x) ORDER BY v DESC, st DESC, oc DESC, id LIMIT 15",
    "historical_references": """SELECT doc_id AS experience_id, source || '/' || CASE WHEN doc_id % 5 = 0 THEN 'gone' ELSE doc_id::VARCHAR END AS path, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 3 = 0 THEN 'changed' WHEN doc_id % 2 = 0 THEN 'current' ELSE 'same_content' END AS document_status,
CASE WHEN doc_id * 3 IN (SELECT p_partkey FROM part) THEN 'current' ELSE 'missing' END AS node_status FROM documents""",
    "dispute_frontier": "SELECT o_orderkey AS experience_id, count(*) AS events FROM orders JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN events ON l_partkey = event_id WHERE o_orderkey % 9 <> 0 GROUP BY 1 HAVING count(*) = count(*) FILTER (event_id > o_custkey * 3)",
    "record_violations": f"""SELECT o_orderkey AS experience_id, unnest(list_filter([CASE WHEN o_orderkey % 50 = 0 THEN 'outcome' END, CASE WHEN o_orderkey % 40 = 0 THEN 'summary' END, CASE WHEN o_orderkey % 30 = 0 THEN 'proposal_hash' END, CASE WHEN o_orderkey % 20 = 0 THEN 'attempts' END], lambda x: x IS NOT NULL)) AS rule FROM orders""",
    "failure_summaries": "WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations) SELECT conv_id, turn, (SELECT max(left(t, n)) FROM range(0, 121) r(n) WHERE strlen(left(t, n)) <= 120) AS summary FROM c",
    "working_set_fold": """WITH RECURSIVE e AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
f(user_id, event_type, n, ts, score) AS (SELECT user_id, event_type, n, ts, 0.35::DOUBLE FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.event_type, e.n, e.ts, least(1.0, f.score * pow(0.5, (epoch_us(e.ts) - epoch_us(f.ts)) / 6e7 / 90) + 0.35) FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.n = f.n + 1)
SELECT user_id AS session_id, event_type AS source_id, round(arg_max(score, n), 6) AS score FROM f GROUP BY ALL""",
    "scope_fingerprints": "SELECT l_orderkey AS run, sha256('tessera.scope' || chr(0) || string_agg(DISTINCT l_suppkey || '::' || l_returnflag, chr(10) ORDER BY l_suppkey || '::' || l_returnflag)) AS fingerprint FROM lineitem GROUP BY 1",
    "content_dedup_hash": "SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1",
}
