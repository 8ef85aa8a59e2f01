"""Joins without all pairs, the kept index, and flows, against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import storage
from tessera.operators import intervals as I
from tessera.operators import memory as M
from tessera.operators import retrieval as R
from tessera.plans import assembly as A
from tessera.sources import lexical_index as L
from tessera.sources import sinks as S
from tessera.streaming import changes as H


def test_points_in_ranges(spark):
    rng = random.Random(1)
    points = [(k, i, rng.randint(-50, 5000)) for i in range(300) for k in (rng.randint(0, 2),)]
    ranges = [(rng.randint(0, 2), i, s, s + rng.choice([0, 1, 7, 300, 4000])) for i in range(200) for s in (rng.randint(-50, 5000),)]
    p, r = spark.createDataFrame(points, "k long, p long, at long"), spark.createDataFrame(ranges, "k long, r long, s long, e long")
    got = I.containing(p, F.col("at"), r, F.col("s"), F.col("e"), ["k"]).select("p", "r").collect()
    want = {(i, j) for k, i, at in points for x, j, s, e in ranges if k == x and s <= at <= e}
    assert len(got) == len(want) and {(x["p"], x["r"]) for x in got} == want


@pytest.mark.parametrize("most", [1, 3])
def test_nearest_chunks(spark, most):
    rng = random.Random(2)
    span = lambda i: (rng.randint(0, 3), i, s := rng.randint(0, 40) * 5, s + rng.choice([0, 3, 30, 200]))  # noqa: E731, F841
    nodes, chunks = [span(i) for i in range(60)], [span(i) for i in range(90)]
    schema = lambda k: f"document_id long, {k} long, start long, end long"
    n, c = spark.createDataFrame(nodes, schema("node_id")), spark.createDataFrame(chunks, schema("chunk_id"))
    got = {(r["node_id"], r["rank"]): r["chunk_id"] for r in I.nearest_chunks(n, c, most).collect()}
    pairs = n.withColumnsRenamed({"start": "node_start", "end": "node_end"}).join(c, "document_id")
    want = {(r["node_id"], r["rank"]): r["chunk_id"] for r in I.nearest(pairs, most).collect()}
    assert got == want


def test_rare_tokens_find_all_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), i, f"2024-01-{1 + i % 9:02}", " ".join(["the"] * rng.randint(0, 3) + rng.choices("abcdefgh", k=rng.randint(1, 6)))) for i in range(120)]
    m = spark.createDataFrame(rows, "scope long, memory_id long, created_at string, content string")
    every = {(r["older"], r["newer"]): round(r["ratio"], 9) for r in M.token_overlap(m, "scope").collect()}
    for least in (0.5, 0.8):
        got = {(r["older"], r["newer"]): round(r["ratio"], 9) for r in M.token_overlap(m, "scope", least=least).collect()}
        assert got == {k: v for k, v in every.items() if v >= least - 1e-9}


DOCS = [(1, "The quick fox"), (2, "the lazy dog, the dog"), (3, None), (4, "quick quick the"), (5, "été à la mer")]


def test_index_gives_the_scores_of_a_scan(spark):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    index = L.build(docs, "id", "text")
    for q in ("the", "quick the", "ete mer", "nothing", "the nothing", ""):
        scan = {r["id"]: round(r["score"], 9) for r in R.lexical_scores(docs, q, "id", "text").collect()}
        assert {r["id"]: round(r["score"], 9) for r in R.indexed_scores(index, q).collect()} == scan
        many = R.indexed_many(index, spark.createDataFrame([(7, q)], "query_id long, text string"), 10).collect()
        assert {r["id"]: round(r["score"], 9) for r in many} == {k: pytest.approx(v, abs=1e-8) for k, v in scan.items()}


def test_index_takes_changes(spark):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    changed = spark.createDataFrame([(2, "a quick cat"), (9, "new the")], "id long, text string")
    got = L.refreshed(L.build(docs, "id", "text"), changed, docs.filter("id = 4"), "text")
    want = L.build(docs.filter("id NOT IN (2, 4)").unionByName(changed), "id", "text")
    rows = lambda i: sorted(map(tuple, i.postings().select("term", "key", "tf", "dl").collect()))
    assert rows(got) == rows(want) and (got.n, got.avgdl, got.df(["the", "quick"])) == (want.n, want.avgdl, want.df(["the", "quick"]))


def test_index_of_nothing(spark):
    index = L.build(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert index.n == 0 and R.indexed_topk(index, "the", 5).collect() == []


def test_one_of_two_writers_wins(spark, tmp_path):
    store, df = f"file://{tmp_path}/store", spark.range(3)
    S.publish(spark, store, {"a": df}, 0)
    (tmp_path / "store" / "manifest" / f"{2:012}").write_text('{"revision": 1, "tables": {}}')  # the other's file is there
    with pytest.raises(RuntimeError, match="another writer"):
        S.publish(spark, store, {"a": df}, 1)


def test_repeated_keys_are_stored_once(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "x"), (2, "y"), (3, None)], "k long, v string")
    assert sorted(map(tuple, S.upserted(old, new, ["k"]).collect()), key=str) == [(1, "a"), (2, "y"), (3, None)]


def test_consistent_reads(spark, tmp_path):
    store, seen = f"file://{tmp_path}/store", []

    def work(state: dict) -> int:
        if not seen:
            S.publish(spark, store, {"a": spark.range(1)}, state["revision"])
        seen.append(state["revision"])
        return state["revision"]

    assert S.consistently(spark, store, work) == 1 and seen == [0, 1]


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        storage.shared_path(Session(), "x")


def test_changes_during_the_scan_arrive(spark, tmp_path):
    path, got = f"{tmp_path}/signals", []
    write = lambda i: spark.createDataFrame([(f"p{i}",)], "path string").write.mode("append").parquet(path)
    write(0)
    stream = H.signals(spark, path, "path string")
    found = H.armed(stream, lambda rows, _: got.extend(r["path"] for r in rows.collect()), f"{tmp_path}/checkpoint", lambda: write(1) or "scanned")
    assert found == "scanned" and sorted(got) == ["p0", "p1"]


def test_reindex_keeps_what_fails(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    scan = lambda *rows: spark.createDataFrame([(p, t, str(hash(t))) for p, t in rows], "path string, content string, content_hash string")

    def work(row: dict) -> dict:
        if row["content"] == "bad":
            raise ValueError("bad")
        return {"size": len(row["content"])}

    first = scan(("a", "x"), ("b", "y"), ("c", "bad"))
    _, actions = A.reindexed(spark, store, first, first.select("path"), work, "size long", 0)
    assert sorted(map(tuple, actions.collect())) == [("a", "added"), ("b", "added"), ("c", "failed")]
    second = scan(("a", "bad"), ("d", "zz"))
    state, actions = A.reindexed(spark, store, second, second.select("path"), work, "size long", 1)
    assert sorted(map(tuple, actions.collect())) == [("a", "failed"), ("b", "removed"), ("d", "added")]
    assert sorted((r["path"], r["size"]) for r in S.read(spark, state, "documents").collect()) == [("a", 1), ("d", 2)]


def test_vectors_are_packed_without_a_loop():
    import numpy as np
    import pyarrow as pa

    from tessera.sources.embedding import pack_vectors, unpack_vectors

    v = pa.array([[1.5, 2.0], None, [], [3.25, -1.0, 0.0]], pa.list_(pa.float64()))
    for x in (v, v.slice(1), v.slice(2, 1), v.slice(0, 0), v.slice(3)):
        packed = pack_vectors(x)
        assert packed.to_pylist() == [None if a is None else np.array(a, "<f4").tobytes() for a in x.to_pylist()]
        assert unpack_vectors(packed).to_pylist() == x.to_pylist()
        assert unpack_vectors(packed.slice(1)).to_pylist() == x.to_pylist()[1:]
    for bad in (b"abc", np.array([np.nan], "<f4").tobytes()):
        with pytest.raises(ValueError):
            unpack_vectors(pa.array([b"", bad]))
