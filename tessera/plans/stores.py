"""Queries of stores and of what they enforce, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.storage import kept, shared_path
from tessera.plans import assembly as A
from tessera.plans import resolution as R
from tessera.sources import sinks as N
from tessera.sources import store as S
from tessera.sources import tables as T


def store_transactions(spark: SparkSession, d: str) -> DataFrame:
    """Contents of a store at each of three revisions: all documents, then some of them changed
    and some gone beside a second table, then that table replaced."""
    folder = shared_path(spark, "transactions")
    docs = T.table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("text_hash"))
    labels = T.table(spark, d, "labels").select("doc_id", "quality")
    S.commit(spark, folder, 0, {"documents": S.Change(docs)}, {"documents": S.Keyed("doc_id", 16)})
    changed = docs.filter("doc_id % 40 = 7").withColumn("lang", F.lit("changed"))
    S.commit(spark, folder, 1, {"documents": S.Change(changed, docs.filter("doc_id % 40 = 9")), "labels": labels})
    S.commit(spark, folder, 2, {"labels": labels.filter("quality = 1")})

    def contents(revision: int) -> DataFrame:
        at = S.state(spark, folder, revision)
        parts = [S.read(spark, at, "documents").select(F.lit("documents").alias("name"), "doc_id", "lang", "text_hash")]
        if "labels" in at["tables"]:
            parts.append(S.read(spark, at, "labels").select(F.lit("labels").alias("name"), "doc_id", F.col("quality").cast("string").alias("lang"), F.lit(None).cast("string").alias("text_hash")))
        return reduce(DataFrame.unionByName, parts).withColumn("revision", F.lit(revision).cast("long"))

    return reduce(DataFrame.unionByName, map(contents, (1, 2, 3)))


def node_registry(spark: SparkSession, d: str) -> DataFrame:
    """Parts as documents, each with a file node and a symbol that other parts may have too.
    Two publications: collisions of each (part ``first``, ``second``), and what is stored."""
    folder, p = shared_path(spark, "registry"), T.table(spark, d, "part")

    def nodes(parts: DataFrame, size: str) -> DataFrame:
        names = F.array(F.concat(F.lit("file:"), F.col("p_partkey").cast("string")), F.concat(F.lit("symbol:"), "p_brand", F.lit("."), F.expr(size).cast("string")))
        return parts.select(F.col("p_partkey").alias("document_id"), F.explode(names).alias("stable_key"))

    layout = {"nodes": S.Keyed("document_id", 16, owned="stable_key")}
    _, first = S.commit(spark, folder, 0, {"nodes": S.Change(nodes(p.filter("p_partkey % 2 = 0"), "p_size"))}, layout)
    at, second = S.commit(spark, folder, 1, {"nodes": S.Change(nodes(p.filter("p_partkey % 3 = 0"), "p_size + 1"))})
    columns = lambda df, part, holder: df.select(F.lit(part).alias("part"), "stable_key", "document_id", holder.alias("holder"))
    return columns(first, "first", F.col("holder")).unionByName(columns(second, "second", F.col("holder"))).unionByName(columns(S.read(spark, at, "nodes"), "stored", F.lit(None).cast("long")))


def experience_accept(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as requests to accept what their orders propose, in two batches over one
    store: of each request its outcome, and at last the sealed records with their evidence.
    Orders and lines are dealt by episode before they get their hashes, which are long."""
    folder = shared_path(spark, "experiences")
    o, l = T.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    mark = lambda c: F.sha2(F.concat(F.lit(c), F.col("o_orderkey").cast("string")), 256)
    status = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", F.when(F.col("o_orderkey") % 2 == 0, "closed").otherwise("open")).otherwise("abandoned")
    p = o.repartition("o_orderkey").select(F.col("o_orderkey").alias("episode_id"), (F.col("o_orderkey") % 3).alias("version"), status.alias("status"), F.when(F.col("o_orderkey") % 11 == 0, "no_supported_failure").otherwise("proposal").alias("result"), (F.col("o_orderkey") % 13 != 0).alias("automatic"), mark("f").alias("fingerprint"), mark("h").alias("proposal_hash"))
    k, n = F.col("l_orderkey").cast("string"), F.col("l_linenumber")
    episode = F.when(F.col("l_partkey") % 17 == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey"))
    asked = l.withColumn("episode_id", episode).repartition("episode_id").select(
        (F.col("l_orderkey") * 8 + n).alias("seq"), "episode_id", (F.col("l_orderkey") % 3 + F.when(F.col("l_partkey") % 5 == 0, 1).otherwise(0)).alias("expected_version"),
        F.sha2(F.concat(F.when(F.col("l_partkey") % 7 == 0, "x").otherwise("f"), k), 256).alias("expected_fingerprint"), F.sha2(F.concat(F.when(F.col("l_suppkey") % 6 == 0, "x").otherwise("h"), k), 256).alias("expected_proposal_hash"), (n % 2).alias("batch"),
    )
    evidence = l.select(F.col("l_orderkey").alias("episode_id"), F.col("l_linenumber").cast("long").alias("ordinal"), F.col("l_partkey").alias("event_id"))
    parts = []
    for batch in (1, 0):
        decided = A.accepted(spark, folder, asked.filter(F.col("batch") == batch).drop("batch"), lambda: p, evidence)
        parts.append(decided.select(F.lit(f"batch {batch}").alias("part"), "seq", "outcome", F.col("episode_id").alias("episode")))
    at = S.state(spark, folder)
    sealed = S.read(spark, at, "experiences").join(S.read(spark, at, "experiences_seals"), "experience_id").join(S.read(spark, at, "experience_evidence").groupBy("experience_id").agg(F.count("*").alias("n")), "experience_id", "left")
    sealed = kept(sealed.select("episode_id", "acceptance_order", "n"), "sealed-records")
    orders = sealed.agg(F.count("*").alias("n"), F.countDistinct("acceptance_order").alias("d"), F.max("acceptance_order").alias("m")).select(F.lit("orders").alias("part"), F.col("n").alias("seq"), F.when((F.col("n") == F.col("d")) & (F.col("n") == F.col("m")), "gapless").otherwise("gaps").alias("outcome"), F.lit(None).cast("long").alias("episode"))
    parts += [sealed.select(F.lit("sealed").alias("part"), F.col("n").alias("seq"), F.lit("record").alias("outcome"), F.col("episode_id").alias("episode")), orders]
    return reduce(DataFrame.unionByName, parts)


def incremental_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Parts as documents of a node and a fact each: all of them, then some renamed, some gone,
    and outcomes that follow, those of untouched documents among them."""
    folder, p = shared_path(spark, "resolution"), T.table(spark, d, "part")
    k = F.col("p_partkey").cast("string")

    def nodes(parts: DataFrame, name: str) -> DataFrame:
        return parts.select(F.concat(F.lit("n"), k).alias("node_id"), F.concat(F.lit("part:"), k).alias("stable_key"), F.concat(F.lit("pkg."), F.expr(name), F.lit("."), k).alias("qualified_name"), F.expr(name).alias("name"), F.col("p_partkey").alias("document_id"))

    target = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('part:', p_partkey + 1) WHEN 1 THEN concat(p_brand, p_size) WHEN 2 THEN concat('pkg.', p_brand, p_size, '.', p_partkey - 1) ELSE concat('new', p_size) END")
    facts = p.select(F.concat(F.lit("f"), k).alias("fact_id"), target.alias("target"), F.col("p_partkey").alias("document_id"), F.lit("x").alias("container"))
    R.update(spark, folder, p.select(F.col("p_partkey").alias("document_id")), nodes(p, "concat(p_brand, p_size)"), facts, 16)
    changed = p.filter("p_partkey % 40 IN (3, 5, 9)")
    at = R.update(spark, folder, changed.select(F.col("p_partkey").alias("document_id")), nodes(changed.filter("p_partkey % 40 <> 9"), "concat('new', p_size)"), facts.filter("document_id % 40 IN (3, 5)"), 16)
    return S.read(spark, at, "outcomes").select("fact_id", "state", "basis", "node_id", "candidates")


def workspace_deregistered(spark: SparkSession, d: str) -> DataFrame:
    """A source of documents as a workspace that is planned to go, and goes: rows of each table
    and source that are left, and what became of each try."""
    folder = shared_path(spark, "deregistered")
    docs = T.table(spark, d, "documents").select("doc_id", F.col("source").alias("workspace_id"), F.length("text").alias("chars"))
    labels, vectors = T.table(spark, d, "labels"), T.table(spark, d, "embeddings").select("vec_id", "label")
    S.commit(spark, folder, 0, {"documents": S.Change(docs), "labels": S.Change(labels), "vectors": vectors}, {"documents": S.Keyed("doc_id", 16), "labels": S.Keyed("doc_id", 16)})
    members = {"documents": N.Member(), "labels": N.Member("doc_id", "documents", "doc_id"), "vectors": N.Member("vec_id", "documents", "doc_id")}
    stale, plan = (N.plan_deregistration(spark, folder, members, w, 1000.0) for w in ("src3", "src2"))
    S.transact(spark, folder, lambda at: {"documents": S.Change(docs.filter("workspace_id = 'src3'").withColumn("chars", F.col("chars") + 1))})
    tries = [(plan, "src1", 1000.0), (plan, "src2", 1300.0), ("other", "src2", 1000.0), (stale, "src3", 1000.0), (plan, "src2", 1299.0), (plan, "src2", 1000.0)]
    said = [(f"try {i}", N.deregister(spark, folder, members, p, w, now), 0) for i, (p, w, now) in enumerate(tries)]
    at = S.state(spark, folder)
    source = docs.select(F.col("doc_id").alias("id"), "workspace_id")
    parts = [S.read(spark, at, n).select(F.col(c).alias("id")).join(source, "id", "left").groupBy(F.lit(n).alias("name"), F.coalesce("workspace_id", F.lit("none")).alias("said")).agg(F.count("*").alias("rows")) for n, c in (("documents", "doc_id"), ("labels", "doc_id"), ("vectors", "vec_id"))]
    return reduce(DataFrame.unionByName, [spark.createDataFrame(said, "name string, said string, rows long"), *parts])


def _rounds(n: int) -> str:
    """Documents whose rivals were refused in the round before."""
    out = ""
    for i in range(1, n):
        out += f""",
c{i} AS (SELECT b.k, b.d, min(s.d) AS h FROM b JOIN s1 s ON s.k = b.k AND s.d <> b.d WHERE s.d IN (SELECT d FROM c{i - 1}) AND b.d NOT IN (SELECT d FROM r{i - 1}) GROUP BY b.k, b.d),
r{i} AS (SELECT d FROM r{i - 1} UNION SELECT d FROM c{i})"""
    return out


_REGISTRY = f"""n AS (SELECT p_partkey AS d, p_brand, p_size FROM part),
a AS (SELECT d, unnest(['file:' || d, 'symbol:' || p_brand || '.' || p_size]) AS k FROM n WHERE d % 2 = 0),
first AS (SELECT k, d, h FROM (SELECT k, d, min(d) OVER (PARTITION BY k) AS h FROM a) WHERE d <> h),
s1 AS (SELECT k, d FROM a WHERE d NOT IN (SELECT d FROM first)),
b AS (SELECT d, unnest(['file:' || d, 'symbol:' || p_brand || '.' || (p_size + 1)]) AS k FROM n WHERE d % 3 = 0),
c0 AS (SELECT b.k, b.d, coalesce(o.d, m.d) AS h FROM b JOIN (SELECT k, min(d) AS d FROM b GROUP BY k) m USING (k) LEFT JOIN (SELECT k, min(d) AS d FROM s1 WHERE d % 3 <> 0 GROUP BY k) o USING (k) WHERE b.d <> coalesce(o.d, m.d)),
r0 AS (SELECT DISTINCT d FROM c0){_rounds(9)}"""

_ACCEPT = """p AS (SELECT o_orderkey AS e, o_orderkey % 3 AS v, CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'closed' ELSE 'open' END ELSE 'abandoned' END AS s, o_orderkey % 11 = 0 AS none, o_orderkey % 13 = 0 AS review FROM orders),
q AS (SELECT l_orderkey * 8 + l_linenumber AS seq, CASE WHEN l_partkey % 17 = 0 THEN -l_orderkey ELSE l_orderkey END AS e, l_orderkey % 3 + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS ev, l_partkey % 7 = 0 AS xf, l_suppkey % 6 = 0 AS xh, 1 - l_linenumber % 2 AS b FROM lineitem),
r AS (SELECT q.*, CASE WHEN s IS NULL THEN 'episode_not_found' WHEN ev <> v THEN 'stale_episode_version' WHEN s = 'open' THEN 'episode_not_closed' WHEN none THEN 'no_supported_failure' WHEN review THEN 'review_required' WHEN xf THEN 'fingerprint_mismatch' WHEN xh THEN 'proposal_hash_mismatch' ELSE 'accepted' END AS own FROM q LEFT JOIN p USING (e)),
w AS (SELECT e, min((b, seq)) AS first FROM r WHERE own = 'accepted' GROUP BY e)"""
QUERIES = {f.__name__: f for f in (store_transactions, node_registry, experience_accept, incremental_resolution, workspace_deregistered)}
SQL = {
    "store_transactions": """WITH d AS (SELECT doc_id, lang, sha256(text) AS text_hash FROM documents), l AS (SELECT 'labels' AS name, doc_id, quality::VARCHAR AS lang, NULL::VARCHAR AS text_hash FROM labels),
e AS (SELECT 'documents' AS name, doc_id, CASE WHEN doc_id % 40 = 7 THEN 'changed' ELSE lang END AS lang, text_hash FROM d WHERE doc_id % 40 <> 9)
SELECT 'documents' AS name, doc_id, lang, text_hash, 1::BIGINT AS revision FROM d UNION ALL SELECT *, 2 FROM e UNION ALL SELECT *, 2 FROM l UNION ALL SELECT *, 3 FROM e UNION ALL SELECT *, 3 FROM l WHERE lang = '1'""",
    "node_registry": f"""WITH {_REGISTRY}
SELECT 'first' AS part, k AS stable_key, d AS document_id, h AS holder FROM first UNION ALL {" UNION ALL ".join(f"SELECT 'second', k, d, h FROM c{i}" for i in range(9))}
UNION ALL SELECT 'stored', k, d, NULL FROM s1 WHERE d % 3 <> 0 OR d IN (SELECT d FROM r8) UNION ALL SELECT 'stored', k, d, NULL FROM b WHERE d NOT IN (SELECT d FROM r8)""",
    "experience_accept": f"""WITH {_ACCEPT}
SELECT CASE b WHEN 0 THEN 'batch 1' ELSE 'batch 0' END AS part, seq, CASE WHEN first IS NULL OR (b, seq) <= first THEN own WHEN xf OR xh THEN 'already_consolidated' ELSE 'replayed' END AS outcome, e AS episode FROM r LEFT JOIN w USING (e)
UNION ALL SELECT 'sealed', (SELECT count(*) FROM lineitem WHERE l_orderkey = e), 'record', e FROM w UNION ALL SELECT 'orders', (SELECT count(*) FROM w), 'gapless', NULL""",
    "incremental_resolution": """WITH n AS (SELECT 'n' || p_partkey AS id, p_partkey AS d, 'part:' || p_partkey AS key, CASE WHEN p_partkey % 40 IN (3, 5) THEN 'new' || p_size ELSE p_brand || p_size END AS name FROM part WHERE p_partkey % 40 <> 9),
f AS (SELECT p_partkey AS d, CASE p_partkey % 4 WHEN 0 THEN 'part:' || (p_partkey + 1) WHEN 1 THEN p_brand || p_size WHEN 2 THEN 'pkg.' || p_brand || p_size || '.' || (p_partkey - 1) ELSE 'new' || p_size END AS t FROM part WHERE p_partkey % 40 <> 9),
c AS (SELECT f.d, 0 AS tier, id FROM f JOIN n ON t = key UNION ALL SELECT f.d, 3, id FROM f JOIN n ON t = 'pkg.' || name || '.' || n.d UNION ALL SELECT f.d, CASE WHEN f.d = n.d THEN 4 ELSE 5 END, id FROM f JOIN n ON t = name WHERE NOT contains(t, '.') AND NOT contains(t, '::')),
b AS (SELECT d, min(tier) AS tier FROM c GROUP BY d), g AS (SELECT d, tier, count(*) AS n, min(id) AS id FROM c JOIN b USING (d, tier) GROUP BY ALL)
SELECT 'f' || d AS fact_id, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS state, ['stable_key', 'alias', 'container', 'qualified_name', 'source_document', 'workspace_name'][tier + 1] AS basis, CASE WHEN n = 1 THEN id END AS node_id, coalesce(n, 0) AS candidates FROM f LEFT JOIN g USING (d)""",
    "workspace_deregistered": """WITH s AS (SELECT doc_id AS id, source FROM documents), u AS (SELECT 'documents' AS name, doc_id AS id FROM documents UNION ALL SELECT 'labels', doc_id FROM labels UNION ALL SELECT 'vectors', vec_id FROM embeddings)
SELECT name, coalesce(source, 'none') AS said, count(*) AS rows FROM u LEFT JOIN s USING (id) WHERE source IS DISTINCT FROM 'src2' GROUP BY ALL
UNION ALL SELECT 'try ' || i, ['workspace_mismatch', 'expired', 'unknown_plan', 'state_changed', 'done', 'already_consumed'][i + 1], 0 FROM range(6) r(i)""",
}
