"""Incremental resolution equals full resolution after any edits, and writes what they touch."""

from __future__ import annotations

import random

import pytest

from tessera.operators import graph as G
from tessera.plans import resolution as R
from tessera.sources import store as S

NODE = "node_id string, stable_key string, qualified_name string, name string, document_id long"
FACT = "fact_id string, target string, document_id long, container string"


def invented(rng, doc):
    names = ["run", "go", "stop", "Base", "x.run", "  ", "m::go"]
    nodes = [(f"n{doc}.{i}", f"k{doc}.{rng.randrange(3)}", rng.choice([None, f"m.{rng.choice(names)}", f"p{rng.randrange(3)}.go"]), rng.choice(names[:4] + [None]), doc) for i in range(rng.randrange(4))]
    facts = [(f"f{doc}.{i}", rng.choice([*names, "m.run", "p1.go", f"k{rng.randrange(8)}.1", "gone", None]), doc, rng.choice([None, "m.Base", "p0::Base"])) for i in range(rng.randrange(4))]
    return nodes, facts


def outcomes(df):
    return {(r["fact_id"], r["state"], r["basis"], r["node_id"], r["candidates"]) for r in df.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_random_edits_against_full_resolution(spark, tmp_path, seed):
    rng, folder, now = random.Random(seed), f"file://{tmp_path}/store", {}
    for step in range(4):
        docs = range(8) if step == 0 else rng.sample(range(10), 3)
        for d in docs:
            now[d] = ([], []) if step and rng.random() < 0.3 else invented(rng, d)
        make = lambda k, schema, ds: spark.createDataFrame([r for d in ds for r in now[d][k]], schema)  # noqa: B023, E731
        at = R.update(spark, folder, spark.createDataFrame([(d,) for d in docs], "document_id long"), make(0, NODE, docs), make(1, FACT, docs), 8)
        want = outcomes(G.resolve(make(1, FACT, now), make(0, NODE, now)))
        assert outcomes(S.read(spark, at, "outcomes")) == want
        assert S.read(spark, at, "nodes").count() == sum(len(n) for n, _ in now.values())
        terms = {tuple(r) for r in S.read(spark, at, "node_terms").select("term", "node_id").collect()}
        assert terms == {tuple(r) for r in R.node_terms(make(0, NODE, now)).select("term", "node_id").collect()}


def test_an_edit_of_one_document_reads_and_writes_what_it_touches(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/store"
    nodes = spark.range(300).selectExpr("concat('n', id) AS node_id", "concat('k', id) AS stable_key", "concat('q.', id) AS qualified_name", "concat('name', id) AS name", "id AS document_id")
    facts = spark.range(300).selectExpr("concat('f', id) AS fact_id", "concat('name', (id + 1) % 300) AS target", "id AS document_id", "'c' AS container")
    one = R.update(spark, folder, nodes.select("document_id"), nodes, facts, 64)
    read, real = [], S.read
    monkeypatch.setattr(S, "read", lambda s, at, name, buckets=None: (read.append((name, 64 if buckets is None else len(buckets))), real(s, at, name, buckets))[1])
    two = R.update(spark, folder, nodes.filter("document_id = 7").select("document_id"), nodes.filter("document_id = 7").selectExpr("node_id", "stable_key", "qualified_name", "'other' AS name", "document_id"), facts.filter("document_id = 7"), 64)
    assert {name for name, _ in read} == set(R.TABLES) and all(n <= 16 for _, n in read)
    changed = {t: sum(one["tables"][t]["files"][b] != two["tables"][t]["files"].get(b) for b in one["tables"][t]["files"]) for t in R.TABLES}
    assert changed["nodes"] == changed["facts"] == 1 and changed["outcomes"] == 2 and changed["node_terms"] <= 8
    got = {r["fact_id"]: r["state"] for r in real(spark, two, "outcomes").collect()}
    assert got["f6"] == "unresolved" and sum(v == "resolved" for v in got.values()) == 299


def test_deltas_leave_out_what_stays(spark):
    t = lambda *x: spark.createDataFrame(list(x), "term string, node_id string")
    got = R.deltas(t(("a", "1"), ("b", "1"), ("c", "1")), t(("a", "1"), ("b", "2"), ("d", "1")))
    assert {tuple(r) for r in got.collect()} == {("b", "1", -1), ("b", "2", 1), ("c", "1", -1), ("d", "1", 1)}
