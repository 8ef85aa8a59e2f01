from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions.tokens import tokenizer_count
from tessera.plans import assembly, context


def test_structural_arm(spark):
    nodes = spark.createDataFrame([("a", "function", "ka", "run", 1, 0, 10), ("b", "function", "kb", "go", 1, 10, 20), ("c", "function", "kc", "stop", 2, 0, 10)], "node_id string, node_type string, stable_key string, name string, document_id long, start long, end long")
    edges = spark.createDataFrame([("1", "b", "a", "calls", 0.9), ("2", "c", "b", "calls", 1.0)], "edge_id string, from_node string, to_node string, edge_type string, confidence double")
    chunks = spark.createDataFrame([(1, 10, 0, 9), (1, 11, 9, 25), (2, 12, 0, 30)], "document_id long, chunk_id long, start long, end long")
    got = assembly.structural_retrieval(nodes, edges, chunks, nodes.filter("node_id = 'a'").select("node_id"), "callers", ["RUN"])
    assert {r["chunk_id"]: r["score"] for r in got.collect()} == {10: pytest.approx(0.9), 11: pytest.approx(0.9)}
    assert {r["node_id"] for r in assembly.structural_retrieval(nodes, edges, chunks, nodes.filter("node_id = 'a'").select("node_id"), "impact", []).collect()} == {"b", "c"}


def test_assembly(spark, sf):
    packets, history = assembly.assembled(context._candidates(spark, sf), "request", 100)
    assert history is None and packets.groupBy("request").agg(F.sum("tokens").alias("t")).filter("t > 100").isEmpty()


def test_adaptive_segments(spark):
    chunks = spark.createDataFrame([(1, "a b " * 40), (2, "short")], "chunk_id long, content string")
    out = assembly.adaptively_segmented(chunks, "chunk_id", 100, lambda s: s.filter(F.octet_length("content") <= 30))
    assert out.filter(F.octet_length("content") > 30).isEmpty() and out.filter("chunk_id = 1").count() > 5
    with pytest.raises(ValueError):
        assembly.adaptively_segmented(chunks, "chunk_id", 100, lambda s: s.limit(0), attempts=2)


def test_lease():
    now, state = [0.0], {}
    a, b = assembly.Lease(state, lambda: now[0]), assembly.Lease(state, lambda: now[0])
    assert a.acquire() and not b.acquire()
    now[0] = 121.0
    assert b.acquire() and state["interrupted"]
    with pytest.raises(RuntimeError):
        a.renew(1)
    b.finish()
    assert state["status"] == "complete" and a.acquire()


def test_tokenizer_counts(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    rows = spark.createDataFrame([("hello world",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(tokenizer_count("t", path)).collect()] == [2, 0, 0]
