"""Queries of file scans, captures, embeddings and analyzers, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import is_finite_vector
from tessera.functions.storage import shared_path
from tessera.operators import graph as G
from tessera.operators import retrieval as R
from tessera.sources import analyzers as Y
from tessera.sources import captures as Q
from tessera.sources import embedding as E
from tessera.sources import files as L
from tessera.sources import tables as T
from tessera.sources import workspace as W


def workspace_scan(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as files of a workspace: those whose number begins with 1 are left out."""
    root = shared_path(spark, "workspace")
    items = T.table(spark, d, "benchmark").select(F.concat(F.lit("items/i"), "item_id", F.lit(".txt")).alias("path"), F.concat("text", F.lit("\n")).alias("text"))
    L.written(items, root).count()
    found = W.scan(spark, root, exclude=["items/i1*.txt"])
    return found.select(F.regexp_extract("path", r"i([0-9]+)\.", 1).cast("long").alias("item_id"), "size_bytes", "content_hash")


#: Ignore files of ``workspace_tree``, by folder.
IGNORES = {
    "": (".gitignore", "# sources that begin with 1, but not 11\nsrc1*/\n!src11/\n*.md\n/en/src2/a*.txt\n"), "en": (".gitignore", "!.d*4.md\n"), "de": (".ignore", "src3/\n!.d*.md\n"), "de/src4": (".gitignore", ".d*.md\n*7.txt\n"), "fr/src3": (".gitignore", "*\n!a*3.txt\n"),
    "es": (".ignore", "**/src5/**\n[a-c]*[13579].txt\n"),
}


def workspace_tree(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files lang/source/name, every seventh hidden, scanned under ignore files
    at several depths."""
    root = shared_path(spark, "tree")
    docs = T.table(spark, d, "documents").select(F.concat_ws("/", "lang", "source", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(".d"), "doc_id", F.lit(".md"))).otherwise(F.concat(F.lit("a"), "doc_id", F.lit(".txt")))).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    rules = spark.createDataFrame([(f"{folder}/{name}".lstrip("/"), text) for folder, (name, text) in IGNORES.items()], "path string, text string")
    L.written(docs.unionByName(rules), root).count()
    return W.scan(spark, root).filter(~F.col("path").rlike(r"(^|/)\.(git)?ignore$")).select("path", "size_bytes", "content_hash")


def test_captures(spark: SparkSession, d: str) -> DataFrame:
    """A run an order and a case a line, as a reporter writes them; then counted by status."""
    l, path = T.table(spark, d, "lineitem"), shared_path(spark, "captures")
    state = F.element_at(F.array(*map(F.lit, ("passed", "failed", "skipped", "todo", "crashed"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    case = F.struct(F.array(F.lit("suite"), F.concat(F.lit("s"), "l_suppkey")).alias("namespace"), F.concat(F.lit("p"), "l_partkey").alias("name"), state.alias("state"), F.lit(0).cast("long").alias("retry_count"))
    module = l.groupBy("l_orderkey").agg(F.collect_list(case).alias("cases"))
    bundle = F.struct(F.array(F.struct(F.concat(F.lit("f"), "l_orderkey").alias("relative_module_id"), "cases")).alias("modules"))
    module.select(F.struct(F.lit("runner").alias("id")).alias("runner"), bundle.alias("completed_run")).write.json(path)
    return Q.module_cases(spark, path, by_line=True).groupBy("status").agg(F.count("*").alias("cases"), F.countDistinct("file").alias("files"), F.countDistinct("identity").alias("identities"))


def embedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of a provider without a network: of its length, finite, and of norm 1 but for
    texts without words."""
    chunks = T.chunks(spark, d).withColumn("content", F.coalesce("content", F.lit("")))
    v = E.embedded(chunks, E.HashedWords)
    norm = F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4)
    return v.select("chunk_id", F.size("vector").cast("long").alias("dimension"), is_finite_vector("vector").alias("finite"), norm.alias("norm"))


def _code(spark: SparkSession, d: str) -> DataFrame:
    """A source file a part."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("import os\n\n\nclass C"), k, F.lit("(Base):\n    def run(self):\n        return helper(1)\n\n\ndef test_"), k, F.lit("():\n    return make()\n"))
    return T.table(spark, d, "part").select(F.concat(F.lit("src/m"), k, F.lit(".py")).alias("path"), text.alias("content"), F.lit("python").alias("language"))


def code_symbols(spark: SparkSession, d: str) -> DataFrame:
    return Y.symbols(_code(spark, d)).select("path", "qualified_name", F.col("kind").alias("kind"), "is_test")


def code_facts(spark: SparkSession, d: str) -> DataFrame:
    return Y.facts(_code(spark, d)).groupBy("path", "edge_type").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("target")), ",").alias("targets"))


def module_paths(spark: SparkSession, d: str) -> DataFrame:
    """Imports of five languages, by number of the part."""
    k, n = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    text = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    pick = lambda *options: reduce(lambda rest, i: F.when(k == i, options[i]).otherwise(rest), range(len(options)), F.lit(None).cast("string"))
    target = pick(text("a.b", n), text("..c", n), text("./u", n), text("../lib/./t", n), text("crate::m::n", n), text("fmt/p", n))
    language = pick(*map(F.lit, ("python", "python", "javascript", "typescript", "rust", "go")))
    source = pick(*map(F.lit, ("x/y.py", "x/y/z.py", "web/main.js", "web/app/v/main.ts", "src/lib.rs", "main.go")))
    return T.table(spark, d, "part").select("p_partkey", F.array_join(Y.module_paths(target, language, source), "|").alias("paths"))


def selector_rules(spark: SparkSession, d: str) -> DataFrame:
    """What selectors, bounds, query sizes and failures are taken as: suppliers are workspaces
    and orders select them; lines are bounds; texts are queries; events are failures."""
    s, o = T.table(spark, d, "supplier"), T.table(spark, d, "orders")
    key = F.col("s_suppkey")
    nation = F.concat(F.lit("/ws/"), F.col("s_nationkey").cast("string"))
    w = s.select(F.concat(F.lit("w"), key.cast("string")).alias("workspace_id"), F.when(key % 2 == 0, F.concat(F.lit("Shop"), (key % 50).cast("string"))).otherwise(F.concat(F.lit("SHOP"), key.cast("string"))).alias("name"), F.when(key % 3 == 0, nation).otherwise(F.concat(nation, F.lit("/s"), key.cast("string"), F.lit("/"))).alias("root"))
    c = F.col("o_custkey") % 20
    at = F.concat(F.lit("/ws/"), (F.col("o_orderkey") % 25).cast("string"), F.lit("/s"), c.cast("string"))
    k = F.col("o_orderkey") % 6
    selector = F.when(k == 0, F.concat(F.lit("w"), c.cast("string"))).when(k == 1, F.concat(F.lit("Shop"), (F.col("o_custkey") % 60).cast("string"))).when(k == 2, F.concat(F.lit("shoP"), c.cast("string"))).when(k == 3, F.concat(at, F.lit("/src/a.py"))).when(k == 4, F.concat(F.lit("file://"), at)).otherwise("/nowhere")
    found = W.resolved(o.select(F.col("o_orderkey").alias("request"), selector.alias("selector")), w)
    parts = [found.select(F.lit("workspace").alias("kind"), F.col("request").cast("long").alias("id"), F.coalesce("workspace_id", "outcome").alias("taken"))]
    refused = lambda ok: F.when(ok, "taken").otherwise("refused")
    parts.append(T.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_partkey").alias("n"), F.max("l_suppkey").alias("e"), F.max("l_linenumber").alias("p")).select(F.lit("bounds"), F.col("l_orderkey"), refused(G.within_bounds(F.col("n") - 500, F.col("e") * 100, F.col("p") * 2))))
    parts.append(T.table(spark, d, "documents").select(F.lit("query"), "doc_id", refused(R.fitting(F.coalesce("text", F.lit("")), 900, 700))))
    e = F.col("event_id") % 6
    status = F.when(e == 0, 413).when(e == 1, 400).when(e == 2, 504).when(e == 3, 429).otherwise(400)
    body = F.concat(F.when(e == 1, "Maximum tokens exceeded").when(e == 4, "The BATCH is too large").otherwise("odd"), F.lit(" "), "event_type")
    parts.append(T.table(spark, d, "events").select(F.lit("status"), "event_id", E.failure_class(status, body)))
    return reduce(DataFrame.union, parts)


QUERIES = {f.__name__: f for f in (workspace_scan, workspace_tree, test_captures, embedded_chunks, code_symbols, code_facts, module_paths, selector_rules)}
_CASES = "SELECT l_orderkey, 'suite::s' || l_suppkey || '::p' || l_partkey AS identity, ['passed', 'assertion_failed', 'skipped', 'todo', 'errored'][l_partkey % 5 + 1] AS status FROM lineitem"
SQL = {
    "workspace_scan": "SELECT item_id, strlen(text) + 1 AS size_bytes, sha256(text || chr(10)) AS content_hash FROM benchmark WHERE NOT starts_with(item_id::VARCHAR, '1')",
    "workspace_tree": r"""WITH f AS (SELECT lang, source, CASE WHEN doc_id % 7 = 0 THEN '.d' || doc_id || '.md' ELSE 'a' || doc_id || '.txt' END AS name, doc_id % 7 = 0 AS md, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, lang || '/' || source || '/' || name AS path, source LIKE 'src1%' AND source <> 'src11' AS closed FROM f),
t AS (SELECT *, CASE WHEN closed THEN true WHEN lang = 'de' AND source = 'src3' THEN true WHEN lang = 'de' AND md THEN false WHEN lang = 'de' AND source = 'src4' AND name LIKE '%7.txt' THEN true
WHEN lang = 'es' AND source = 'src5' THEN true WHEN lang = 'es' AND regexp_matches(name, '^a.*[13579]\.txt$') THEN true WHEN lang = 'fr' AND source = 'src3' THEN NOT regexp_matches(name, '^a.*3\.txt$')
WHEN lang = 'en' AND regexp_matches(name, '^\.d.*4\.md$') THEN false WHEN md THEN true WHEN lang = 'en' AND source = 'src2' AND NOT md THEN true ELSE false END AS ignored FROM s)
SELECT path, strlen(text) AS size_bytes, sha256(text) AS content_hash FROM t WHERE NOT ignored AND strlen(text) <= 1048576 AND NOT contains(left(text, 8192), chr(0))""",
    "test_captures": f"SELECT status, count(*) AS cases, count(DISTINCT l_orderkey) AS files, count(DISTINCT identity) AS identities FROM ({_CASES}) GROUP BY 1",
    "embedded_chunks": "SELECT doc_id AS chunk_id, 64::BIGINT AS dimension, true AS finite, CASE WHEN regexp_matches(coalesce(text, ''), '\\S') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents",
    "code_symbols": "SELECT 'src/m' || p_partkey || '.py' AS path, unnest(['C' || p_partkey, 'C' || p_partkey || '.run', 'test_' || p_partkey]) AS qualified_name, unnest(['class', 'method', 'function']) AS kind, unnest([false, false, true]) AS is_test FROM part",
    "code_facts": """WITH f AS (SELECT 'src/m' || p_partkey || '.py' AS path, unnest([{'e': 'imports', 't': 'os'}, {'e': 'depends_on', 't': 'os'}, {'e': 'contains', 't': 'python:C' || p_partkey}, {'e': 'contains', 't': 'python:C' || p_partkey || '.run'}, {'e': 'contains', 't': 'python:test_' || p_partkey},
{'e': 'extends', 't': 'Base'}, {'e': 'calls', 't': 'helper'}, {'e': 'calls', 't': 'make'}, {'e': 'tests', 't': 'make'}]) AS f FROM part) SELECT path, f.e AS edge_type, count(*) AS n, string_agg(DISTINCT f.t, ',' ORDER BY f.t) AS targets FROM f GROUP BY ALL""",
    "module_paths": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'a/b' || p_size || '.py|a/b' || p_size || '/__init__.py' WHEN 1 THEN 'x/c' || p_size || '.py|x/c' || p_size || '/__init__.py'
WHEN 2 THEN 'web/u' || p_size || '.js|web/u' || p_size || '.jsx|web/u' || p_size || '.mjs|web/u' || p_size || '/index.js' WHEN 3 THEN 'web/app/lib/t' || p_size || '.ts|web/app/lib/t' || p_size || '.tsx|web/app/lib/t' || p_size || '/index.ts|web/app/lib/t' || p_size || '.d.ts'
WHEN 4 THEN 'src/m/n' || p_size || '.rs|src/m/n' || p_size || '/mod.rs' ELSE 'fmt/p' || p_size || '.go' END AS paths FROM part""",
    "selector_rules": """WITH w AS (SELECT 'w' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'Shop' || (s_suppkey % 50) ELSE 'SHOP' || s_suppkey END AS name, '/ws/' || s_nationkey || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '/s' || s_suppkey END AS root FROM supplier),
q AS (SELECT o_orderkey AS r, CASE o_orderkey % 6 WHEN 0 THEN 'w' || (o_custkey % 20) WHEN 1 THEN 'Shop' || (o_custkey % 60) WHEN 2 THEN 'shoP' || (o_custkey % 20) WHEN 5 THEN '/nowhere' ELSE '/ws/' || (o_orderkey % 25) || '/s' || (o_custkey % 20) || CASE WHEN o_orderkey % 6 = 3 THEN '/src/a.py' ELSE '' END END AS s FROM orders),
c AS (SELECT r, 0 AS t, 0 AS deep, id FROM q JOIN w ON s = id UNION ALL SELECT r, 1, 0, id FROM q JOIN w ON s = name UNION ALL SELECT r, 2, 0, id FROM q JOIN w ON lower(s) = lower(name) UNION ALL SELECT r, 3, -length(root), min(id) FROM q JOIN w ON s = root OR starts_with(s, root || '/') GROUP BY r, root),
b AS (SELECT r, min((t, deep)) AS m FROM c GROUP BY r), g AS (SELECT r, count(*) AS n, min(id) AS id FROM c JOIN b USING (r) WHERE (t, deep) = m GROUP BY r)
SELECT 'workspace' AS kind, r::BIGINT AS id, CASE WHEN n = 1 THEN g.id WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END AS taken FROM q LEFT JOIN g USING (r)
UNION ALL SELECT 'bounds', l_orderkey, CASE WHEN max(l_partkey) - 500 BETWEEN 1 AND 1000 AND max(l_suppkey) * 100 BETWEEN 1 AND 5000 AND max(l_linenumber) * 2 BETWEEN 1 AND 8 THEN 'taken' ELSE 'refused' END FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT 'query', doc_id, CASE WHEN strlen(coalesce(text, '')) <= 700 THEN 'taken' ELSE 'refused' END FROM documents
UNION ALL SELECT 'status', event_id, CASE event_id % 6 WHEN 0 THEN 'batch_too_large' WHEN 1 THEN 'input_too_large' WHEN 2 THEN 'timeout' WHEN 3 THEN 'unavailable' WHEN 4 THEN 'batch_too_large' ELSE 'unknown' END FROM events""",
}
