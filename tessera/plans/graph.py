"""Queries of the graph operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions.storage import kept
from tessera.operators import graph as G
from tessera.sources import tables as T


def _start(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "node_id string")


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes as a store keeps them: written, not derived anew at each level."""
    return kept(T.graph_edges(spark, d), "edges"), kept(T.graph_nodes(spark, d), "nodes")


def graph_find(spark: SparkSession, d: str) -> DataFrame:
    return G.find(T.graph_nodes(spark, d), ["ASIA", "small ring", "part:3", "red widget"], 20).select("node_id", "tier", "truncated")


def graph_seeds(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame([(1, "what calls part:3 in ASIA"), (2, "EUROPE and supplier:4, region:1")], "query_id long, q string")
    tokens = q.select("query_id", F.posexplode(C.structural_tokens("q")).alias("position", "token"))
    return G.seeds(T.graph_nodes(spark, d), tokens, 8).select("query_id", "node_id", F.col("rank").cast("long").alias("rank"))


def _hop(spark: SparkSession, d: str, hop: str) -> DataFrame:
    return G.one_hop(T.graph_edges(spark, d), T.graph_nodes(spark, d), _start(spark, "s1", "n3", "p7"), hop).select("at", "next", "edge_id", F.round("confidence", 6).alias("confidence"))


def graph_callers(spark: SparkSession, d: str) -> DataFrame:
    return _hop(spark, d, "callers")


def graph_callees(spark: SparkSession, d: str) -> DataFrame:
    return _hop(spark, d, "callees")


def graph_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return G.one_hop(T.graph_edges(spark, d), T.graph_nodes(spark, d), _start(spark, "c1", "c2"), "dependencies").select("at", "next", "edge_id")


def graph_dependents(spark: SparkSession, d: str) -> DataFrame:
    return _hop(spark, d, "dependents")


def graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return _hop(spark, d, "neighbors")


def graph_bfs(spark: SparkSession, d: str) -> DataFrame:
    found = G.traverse(*_graph(spark, d), _start(spark, "r1"), "out", ("contains", "calls"), 1000, 5000, 3)
    return found.select("node_id", F.col("depth").cast("long").alias("depth"), F.array_join("path", ">").alias("path"), F.round("confidence", 6).alias("confidence"))


def graph_truncation(spark: SparkSession, d: str) -> DataFrame:
    """Whether answers under several bounds are whole, and how many nodes they have."""
    rows = []
    for seed, nodes, edges, depth in (("r1", 1000, 5000, 1), ("r1", 3, 5000, 1), ("r1", 1000, 2, 1), ("r1", 6, 5000, 1), ("n1", 1000, 5000, 1), ("n1", 2, 5000, 2), ("p1", 1, 1, 8)):
        found, truncated = G.traversed(*_graph(spark, d), _start(spark, seed), "out", ("contains", "calls"), nodes, edges, depth)
        rows.append((seed, nodes, edges, depth, found.count(), truncated))
    return spark.createDataFrame(rows, "seed string, max_nodes long, max_edges long, max_depth long, nodes long, truncated boolean")


def graph_impact(spark: SparkSession, d: str) -> DataFrame:
    found = G.impact(*_graph(spark, d), _start(spark, "p7"), 1000, 5000, 2)
    return found.select("node_id", F.col("depth").cast("long").alias("depth"), F.round("confidence", 6).alias("confidence"))


def path_score(spark: SparkSession, d: str) -> DataFrame:
    found = G.traverse(*_graph(spark, d), _start(spark, "n1", "n2"), "out", ("contains", "calls"), 1000, 5000, 2)
    return found.select("node_id", F.round(C.path_score("edge_types", "confidence"), 6).alias("score"))


def intent_classes(spark: SparkSession, d: str) -> DataFrame:
    words = F.element_at(F.array(*map(F.lit, ["what changes here", "which tests cover", "implementation of", "depends on this", "depends on", "what calls", "callees of", "find"])), (F.col("p_size") % 8 + 1).cast("int"))
    return T.table(spark, d, "part").select("p_partkey", C.intent(F.concat_ws(" ", words, "p_name")).alias("intent"))


def supersession_chain(spark: SparkSession, d: str) -> DataFrame:
    """Customers superseded by those of half their number; chains end at 0 or 1."""
    c = T.table(spark, d, "customer").filter("c_custkey > 1").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") / 2).cast("long").alias("new"))
    return G.chain_roots(c, "old", "new").select("item", "root", "hops", "cyclic")


def supersession_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Links within groups of three, some of which close a circle."""
    c = T.table(spark, d, "customer").select(F.col("c_custkey").alias("old"), F.when(F.col("c_custkey") % 3 == 2, F.col("c_custkey") - 2).otherwise(F.col("c_custkey") + 1).alias("new")).filter("old % 3 < 2 OR old % 2 = 0")
    return G.chain_roots(c, "old", "new").select("item", "cyclic")


def resolve_tiers(spark: SparkSession, d: str) -> DataFrame:
    nodes = T.graph_nodes(spark, d).select("node_id", "stable_key", F.concat_ws(".", F.lit("pkg"), "stable_key").alias("qualified_name"), "name", F.substring("node_id", 1, 2).alias("document_id"))
    p = T.table(spark, d, "part")
    target = F.expr("CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN concat('part:', p_partkey) WHEN 2 THEN concat('pkg.nation:', p_size) WHEN 3 THEN 'ASIA' ELSE concat('missing', p_partkey) END")
    facts = p.select(F.col("p_partkey").alias("fact_id"), target.alias("target"), F.lit("p3").alias("document_id"), F.lit("pkg.x").alias("container"))
    return G.resolve(facts, nodes).select("fact_id", "state", "basis", "node_id", "candidates")


def affected_set(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders")
    facts = o.select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("target"))
    old = T.table(spark, d, "nation").select(F.col("n_name").alias("term"), F.col("n_nationkey").alias("node_id"))
    terms = G.changed_terms(old, old.filter("node_id <> 3").union(spark.createDataFrame([("1-URGENT", 99)], "term string, node_id int")))
    edges = o.select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("to_node"))
    return G.affected(facts, edges, 5, terms, spark.createDataFrame([(11,), (12,)], "node_id long"))


def projection_counts(spark: SparkSession, d: str) -> DataFrame:
    doc = lambda t, c: T.table(spark, d, t).select(F.col(c).cast("long").alias("document_id"))
    return G.projection_counts(doc("customer", "c_nationkey"), doc("supplier", "s_nationkey"), doc("nation", "n_nationkey"), doc("nation", "n_regionkey"))


def edge_projection(spark: SparkSession, d: str) -> DataFrame:
    """Edges that keep their ids after half of the facts were resolved anew."""
    e = T.graph_edges(spark, d).filter("edge_type = 'contains'").withColumn("fact_id", F.col("edge_id"))
    moved = F.when(F.rlike("to_node", F.lit("[02468]$")), F.col("to_node")).otherwise("r0")
    outcomes = e.select("fact_id", F.lit("resolved").alias("state"), moved.alias("node_id"))
    return G.projected_edges(outcomes, e, e).select("fact_id", "to_node", "kept")


def repair_plan(spark: SparkSession, d: str) -> DataFrame:
    c = T.table(spark, d, "customer")
    docs = c.select(F.col("c_custkey").alias("document_id"), (F.col("c_custkey") % 11 != 0).alias("analyzer_enabled"), (F.col("c_custkey") % 13 == 0).alias("scan_failed"), F.col("c_name").alias("content_hash"), F.lit("2").alias("analyzer_version"))
    states = c.filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("document_id"), F.expr("CASE WHEN c_custkey % 17 = 0 THEN 'error' WHEN c_custkey % 19 = 0 THEN 'updating' ELSE 'current' END").alias("state"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN 'old' ELSE c_name END").alias("state_hash"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN '1' ELSE '2' END").alias("state_version"))
    manifests = c.filter("c_custkey % 4 <> 1").select(F.col("c_custkey").alias("document_id"), F.col("c_nationkey").alias("expected_nodes"), F.lit(0).alias("expected_facts"), F.lit(0).alias("expected_edges"), F.lit(0).alias("expected_unresolved"))
    counts = c.select(F.col("c_custkey").alias("document_id"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE 1 END").alias("nodes"), F.lit(0).alias("facts"), F.lit(0).alias("edges"), F.lit(0).alias("unresolved"))
    return G.repair_plan(docs, states, manifests, counts)


_NODES = """nodes AS (SELECT 'r' || r_regionkey AS node_id, 'package' AS node_type, 'package:' || r_regionkey AS stable_key, r_name AS name FROM region
UNION ALL SELECT 'n' || n_nationkey, 'module', 'module:' || n_nationkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'file', 'file:' || c_custkey, c_name FROM customer
UNION ALL SELECT 's' || s_suppkey, 'class', 'class:' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'p' || p_partkey, 'function', 'function:' || p_partkey, p_name FROM part)"""
_EDGES = """edges0 AS (SELECT 'r' || n_regionkey AS f, 'n' || n_nationkey AS t, 'contains' AS k, 1.0 AS w FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'contains', 1.0 FROM supplier
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'depends_on', 0.8 FROM customer UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey, 'calls', 0.9 - max(l_discount) FROM lineitem GROUP BY l_suppkey, l_partkey),
edges AS (SELECT *, concat_ws('|', k, f, t) AS id FROM edges0)"""


def _hop_sql(where: str, incoming: bool, start: str) -> str:
    a, b = ("t", "f") if incoming else ("f", "t")
    return f"WITH {_NODES}, {_EDGES} SELECT {a} AS at, {b} AS next, id AS edge_id, round(w, 6) AS confidence FROM edges WHERE {where} AND {a} IN ({start}) ORDER BY k, id LIMIT 100"


_S3 = "'s1', 'n3', 'p7'"
_LEVEL = """l{d} AS (SELECT t AS node, {d} AS depth, arg_min(path || '>' || t, (ord, k, id)) AS path, arg_min(least(1, c * w), (ord, k, id)) AS c, min((ord, k, id)) AS o FROM l{p}o JOIN edges ON node = f WHERE k IN ('contains', 'calls') AND t NOT IN (SELECT node FROM v{p}) GROUP BY t),
l{d}o AS (SELECT *, row_number() OVER (ORDER BY o) AS ord FROM l{d}), v{d} AS (SELECT node FROM v{p} UNION ALL SELECT node FROM l{d})"""

QUERIES = {
    f.__name__: f
    for f in (
        graph_find, graph_seeds, graph_callers, graph_callees, graph_dependencies, graph_dependents, graph_neighbors, graph_bfs, graph_truncation, graph_impact, path_score, intent_classes,
        supersession_chain, supersession_cycles, resolve_tiers, affected_set, projection_counts, edge_projection, repair_plan,
    )
}
SQL = {
    "graph_find": f"WITH {_NODES}, h AS (SELECT node_id, CASE WHEN stable_key IN ('ASIA', 'small ring', 'part:3', 'red widget') THEN 0 WHEN name IN ('ASIA', 'small ring', 'part:3', 'red widget') THEN 1 END AS tier, stable_key FROM nodes), r AS (SELECT *, row_number() OVER (ORDER BY tier, stable_key, node_id) AS n, count(*) OVER () AS total FROM h WHERE tier IS NOT NULL) SELECT node_id, tier::INT AS tier, total > 20 AS truncated FROM r WHERE n <= 20",
    "graph_seeds": f"""WITH {_NODES}, t AS (SELECT * FROM (VALUES (1, 0, 'ASIA'), (1, 1, 'part:3'), (2, 0, 'EUROPE'), (2, 1, 'region:1'), (2, 2, 'supplier:4')) AS t(query_id, position, token)),
h AS (SELECT query_id, node_id, node_type, stable_key, min(position) AS position FROM t JOIN nodes ON token IN (stable_key, name) GROUP BY ALL)
SELECT query_id::BIGINT AS query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY node_type = 'file', position, stable_key) AS rank FROM h QUALIFY rank <= 8""",
    "graph_callers": _hop_sql("k = 'calls'", True, _S3),
    "graph_callees": _hop_sql("k = 'calls'", False, _S3),
    "graph_dependencies": f"WITH {_EDGES} SELECT f AS at, t AS next, id AS edge_id FROM edges WHERE k = 'depends_on' AND f IN ('c1', 'c2')",
    "graph_dependents": _hop_sql("k = 'depends_on'", True, _S3),
    "graph_neighbors": f'''WITH {_EDGES}, b AS (SELECT f AS "at", t AS next, id AS edge_id, w, k FROM edges UNION ALL SELECT t, f, id, w, k FROM edges WHERE f <> t) SELECT "at", next, edge_id, round(w, 6) AS confidence FROM b WHERE "at" IN ({_S3}) ORDER BY k, edge_id LIMIT 100''',
    "graph_bfs": f"""WITH {_EDGES}, l0o AS (SELECT 'r1' AS node, 0 AS depth, 'r1' AS path, 1.0::DOUBLE AS c, 1::BIGINT AS ord), v0 AS (SELECT 'r1' AS node), {", ".join(_LEVEL.format(d=d, p=d - 1) for d in (1, 2, 3))},
u AS (SELECT node, depth, path, c, ord FROM l0o UNION ALL SELECT node, depth, path, c, ord FROM l1o UNION ALL SELECT node, depth, path, c, ord FROM l2o UNION ALL SELECT node, depth, path, c, ord FROM l3o)
SELECT node AS node_id, depth::BIGINT AS depth, path, round(c, 6) AS confidence FROM u QUALIFY row_number() OVER (ORDER BY u.depth, ord) <= 1000""",
    "graph_truncation": """WITH c AS (SELECT (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS n, (SELECT count(*) FROM supplier WHERE s_nationkey = 1) AS s)
SELECT unnest(['r1', 'r1', 'r1', 'r1', 'n1', 'n1', 'p1']) AS seed, unnest([1000, 3, 1000, 6, 1000, 2, 1])::BIGINT AS max_nodes, unnest([5000, 5000, 2, 5000, 5000, 5000, 1])::BIGINT AS max_edges, unnest([1, 1, 1, 1, 1, 2, 8])::BIGINT AS max_depth,
unnest([n + 1, least(n, 2) + 1, least(n, 2) + 1, least(n, 5) + 1, s + 1, least(s, 1) + 1, 1]) AS nodes, unnest([false, n > 2, n > 2, n > 5, false, s > 0, false]) AS truncated FROM c""",
    "graph_impact": f"""WITH {_EDGES}, a AS (SELECT f AS node, 1 AS depth, max(w) AS c FROM edges WHERE t = 'p7' AND k = 'calls' GROUP BY f), b AS (SELECT e.f AS node, 2 AS depth, arg_min(least(1, c * w), (a.node, e.id)) AS c FROM a JOIN edges e ON e.t = a.node WHERE e.k IN ('calls', 'depends_on') AND e.f NOT IN (SELECT node FROM a) GROUP BY e.f)
SELECT node AS node_id, depth::BIGINT AS depth, round(c, 6) AS confidence FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
    "path_score": f"""WITH {_EDGES}, l0o AS (SELECT node, 0 AS depth, node AS path, 1.0::DOUBLE AS c, ord FROM (VALUES ('n1', 1::BIGINT), ('n2', 2)) AS t(node, ord)), v0 AS (SELECT node FROM l0o), {", ".join(_LEVEL.format(d=d, p=d - 1) for d in (1, 2))},
u AS (SELECT node, depth, c, ord FROM l0o UNION ALL SELECT node, depth, c, ord FROM l1o UNION ALL SELECT node, depth, c, ord FROM l2o), r AS (SELECT * FROM u QUALIFY row_number() OVER (ORDER BY depth, ord) <= 1000)
SELECT node AS node_id, round(CASE depth WHEN 0 THEN 0 WHEN 1 THEN c * 0.6 ELSE c * 0.6 * 0.65 END, 6) AS score FROM r""",
    "intent_classes": """WITH q AS (SELECT p_partkey, lower(['what changes here', 'which tests cover', 'implementation of', 'depends on this', 'depends on', 'what calls', 'callees of', 'find'][p_size % 8 + 1] || ' ' || p_name) AS q FROM part)
SELECT p_partkey, CASE WHEN q LIKE '%could break%' OR q LIKE '%changes if%' OR q LIKE '%change if%' OR q LIKE '%what changes%' OR q LIKE '%impact%' OR q LIKE '%blast radius%' THEN 'impact' WHEN q LIKE '%implement%' THEN 'implementations' WHEN q LIKE '%test%' AND (q LIKE '%cover%' OR q LIKE '%which%') THEN 'tests'
WHEN q LIKE '%dependents%' OR q LIKE '%depends on this%' THEN 'dependents' WHEN q LIKE '%dependencies%' OR q LIKE '%depends on%' THEN 'dependencies' WHEN q LIKE '%what calls%' OR q LIKE '%callers%' OR q LIKE '%uses%' THEN 'callers' WHEN q LIKE '%callees%' OR q LIKE '%does it call%' THEN 'callees' ELSE 'general' END AS intent FROM q""",
    "supersession_chain": "WITH RECURSIVE w(item, root, hops) AS (SELECT c_custkey, c_custkey // 2, 1::BIGINT FROM customer WHERE c_custkey > 1 UNION ALL SELECT item, root // 2, hops + 1 FROM w WHERE root > 1) SELECT item, arg_max(root, hops) AS root, max(hops) AS hops, false AS cyclic FROM w GROUP BY item",
    "supersession_cycles": "WITH l AS (SELECT c_custkey AS o FROM customer WHERE c_custkey % 3 < 2 OR c_custkey % 2 = 0) SELECT o AS item, (o // 3 * 3 + 2) % 2 = 0 AND (o // 3 * 3 + 2) IN (SELECT o FROM l) AS cyclic FROM l",
    "resolve_tiers": f"""WITH {_NODES}, f AS (SELECT p_partkey AS fact_id, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN 'part:' || p_partkey WHEN 2 THEN 'pkg.nation:' || p_size WHEN 3 THEN 'ASIA' ELSE 'missing' || p_partkey END AS target FROM part),
c AS (SELECT fact_id, 0 AS tier, node_id FROM f JOIN nodes ON target = stable_key UNION ALL SELECT fact_id, 2, node_id FROM f JOIN nodes ON 'pkg.' || target = 'pkg.' || stable_key WHERE NOT contains(target, '.') AND NOT contains(target, '::')
UNION ALL SELECT fact_id, 3, node_id FROM f JOIN nodes ON target = 'pkg.' || stable_key UNION ALL SELECT fact_id, CASE WHEN left(node_id, 2) = 'p3' THEN 4 ELSE 5 END, node_id FROM f JOIN nodes ON target = name WHERE NOT contains(target, '.') AND NOT contains(target, '::')),
b AS (SELECT fact_id, min(tier) AS tier FROM c GROUP BY 1), g AS (SELECT fact_id, tier, count(DISTINCT node_id) AS n, min(node_id) AS node_id FROM c JOIN b USING (fact_id, tier) GROUP BY ALL)
SELECT fact_id, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS state, ['stable_key', 'alias', 'container', 'qualified_name', 'source_document', 'workspace_name'][tier + 1] AS basis, CASE WHEN n = 1 THEN node_id END AS node_id, coalesce(n, 0)::BIGINT AS candidates FROM f LEFT JOIN g USING (fact_id)""",
    "affected_set": "SELECT DISTINCT o_orderkey AS fact_id FROM orders WHERE o_custkey IN (5, 11, 12) OR o_orderpriority = '1-URGENT' OR o_orderpriority IN (SELECT n_name FROM nation WHERE n_nationkey = 3)",
    "projection_counts": """WITH u AS (SELECT c_nationkey AS d, 'n' AS k FROM customer UNION ALL SELECT s_nationkey, 'f' FROM supplier UNION ALL SELECT n_nationkey, 'e' FROM nation UNION ALL SELECT n_regionkey, 'u' FROM nation)
SELECT d::BIGINT AS document_id, count(*) FILTER (k = 'n') AS nodes, count(*) FILTER (k = 'f') AS facts, count(*) FILTER (k = 'e') AS edges, count(*) FILTER (k = 'u') AS unresolved FROM u GROUP BY 1""",
    "edge_projection": f"WITH {_EDGES} SELECT id AS fact_id, CASE WHEN regexp_matches(t, '[02468]$') THEN t ELSE 'r0' END AS to_node, regexp_matches(t, '[02468]$') AS kept FROM edges WHERE k = 'contains'",
    "repair_plan": """SELECT c_custkey AS document_id, CASE WHEN c_custkey % 11 = 0 THEN 'skip_disabled' WHEN c_custkey % 13 = 0 THEN 'skip_unreadable' WHEN c_custkey % 7 = 0 THEN 'analyze_missing' WHEN c_custkey % 17 = 0 THEN 'analyze_error' WHEN c_custkey % 19 = 0 THEN 'analyze_interrupted'
WHEN c_custkey % 5 = 0 THEN 'analyze_content' WHEN c_custkey % 3 = 0 THEN 'analyze_version' WHEN c_custkey % 4 = 1 THEN 'project_manifest' WHEN c_nationkey <> CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE 1 END THEN 'project_counts' ELSE 'current' END AS disposition FROM customer""",
}
