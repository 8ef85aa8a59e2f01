"""Table sources: key scans, and views of plain tables as the engine's own.

Nothing is collected; every view is a projection that keeps filters and columns
pushable to the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORKSPACE = "w0"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def by_key(df: DataFrame, **keys: object) -> DataFrame:
    """Rows whose columns equal ``keys`` (None: are null)."""
    for k, v in keys.items():
        df = df.filter(F.col(k).eqNullSafe(F.lit(v)))
    return df


def utc(ts: Column | str) -> Column:
    """Timestamps without a zone are read as UTC."""
    return (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """One chunk a document."""
    d = table(spark, folder, "documents")
    return d.select(
        F.lit(WORKSPACE).alias("workspace_id"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"), "source",
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.size("embedding").alias("dimension"), "label", F.lit("default").alias("model"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The event id is the ingress order."""
    e = table(spark, folder, "events")
    return e.select(F.col("event_id").alias("ingress_seq"), "event_id", utc("ts").alias("created_at"), F.col("user_id").alias("owner"), "event_type", "value", F.col("props").alias("payload"))


def memories(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of conversations, a minute apart in each; labels give the trust."""
    c = table(spark, folder, "conversations")
    trust = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    rows = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("memory_id"), "conv_id", "turn", F.col("role").alias("kind"), F.col("text").alias("content"),
        (start + F.make_dt_interval(hours=F.col("conv_id").cast("int"), mins=F.col("turn").cast("int"))).alias("created_at"),
    )
    return rows.join(trust, rows["conv_id"] == trust["doc_id"], "left").select(
        *rows.columns, F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "trusted").otherwise("unreviewed").alias("trust")
    )


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "active").otherwise("blocked")
    return o.select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("owner"), status.alias("status"), F.col("o_orderpriority").alias("title"), utc("o_orderdate").alias("created_at"))


def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Regions, nations, customers, suppliers and parts as typed nodes."""
    t = lambda n: table(spark, folder, n)

    def node(df: DataFrame, kind: str, prefix: str, key: str, name: str, language: str) -> DataFrame:
        return df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("node_id"), F.lit(kind).alias("node_type"), F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("stable_key"), F.col(name).alias("name"), F.lit(language).alias("language"))

    parts = [
        node(t("region"), "package", "r", "r_regionkey", "r_name", "rust"), node(t("nation"), "module", "n", "n_nationkey", "n_name", "rust"),
        node(t("customer"), "file", "c", "c_custkey", "c_name", "python"), node(t("supplier"), "class", "s", "s_suppkey", "s_name", "python"),
        node(t("part"), "function", "p", "p_partkey", "p_name", "go"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    """contains down the geography, and calls from suppliers to the parts they deliver."""
    t = lambda n: table(spark, folder, n)

    def edge(df: DataFrame, kind: str, a: str, ka: str, b: str, kb: str, confidence: Column) -> DataFrame:
        x, y = F.concat(F.lit(a), F.col(ka).cast("string")), F.concat(F.lit(b), F.col(kb).cast("string"))
        return df.select(F.concat_ws("|", F.lit(kind), x, y).alias("edge_id"), x.alias("from_node"), y.alias("to_node"), F.lit(kind).alias("edge_type"), confidence.cast("double").alias("confidence"))

    supplied = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_discount").alias("d"))
    return (
        edge(t("nation"), "contains", "r", "n_regionkey", "n", "n_nationkey", F.lit(1.0))
        .unionByName(edge(t("supplier"), "contains", "n", "s_nationkey", "s", "s_suppkey", F.lit(1.0)))
        .unionByName(edge(t("customer"), "depends_on", "c", "c_custkey", "n", "c_nationkey", F.lit(0.8)))
        .unionByName(edge(supplied, "calls", "s", "l_suppkey", "p", "l_partkey", 0.9 - F.col("d")))
    )
