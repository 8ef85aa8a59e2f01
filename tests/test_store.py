"""Stores: what readers see when writers die, race, and change little."""

from __future__ import annotations

import json
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.functions.metrics import Counters
from tessera.operators import graph
from tessera.operators.registry import admitted, collisions
from tessera.sources import sinks
from tessera.sources import store as S

DOCS = S.Keyed("doc", buckets=8)


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/store"


def docs(spark, ids, text="a"):
    return spark.createDataFrame([(i, f"{text}{i}") for i in ids], "doc long, text string")


def rows(spark, folder, name="docs", revision=None):
    return {(r["doc"], r["text"]) for r in S.read(spark, S.state(spark, folder, revision), name).collect()}


def test_only_changed_buckets_are_written(spark, folder):
    one, _ = S.commit(spark, folder, 0, {"docs": S.Change(docs(spark, range(100)))}, {"docs": DOCS})
    two, _ = S.commit(spark, folder, 1, {"docs": S.Change(docs(spark, [3], "b"), drop=docs(spark, [4]))})
    before, after = one["tables"]["docs"]["files"], two["tables"]["docs"]["files"]
    changed = {b for b in before if before[b] != after.get(b)}
    assert len(before) == 8 and changed == S._touched(docs(spark, [3, 4]), "doc", 8) and len(changed) <= 2
    assert rows(spark, folder) == {(i, f"{'b' if i == 3 else 'a'}{i}") for i in range(100) if i != 4}
    assert rows(spark, folder, revision=1) == {(i, f"a{i}") for i in range(100)}
    entry = json.loads(Path(f"{folder[7:]}/manifest/{2:012}").read_text())
    assert set(entry["tables"]["docs"]["files"]) == changed  # the log has what changed, no more


def test_buckets_empty_and_fill_again(spark, folder):
    S.commit(spark, folder, 0, {"docs": S.Change(docs(spark, range(5)))}, {"docs": DOCS})
    none, _ = S.commit(spark, folder, 1, {"docs": S.Change(drop=docs(spark, range(5)))})
    assert none["tables"]["docs"]["files"] == {} and rows(spark, folder) == set()
    S.commit(spark, folder, 2, {"docs": S.Change(docs(spark, [7]))})
    S.commit(spark, folder, 3, {"docs": S.Change(docs(spark, []), drop=docs(spark, []))})
    assert rows(spark, folder) == {(7, "a7")}


def test_documents_are_replaced_whole_or_by_row(spark, folder):
    chunk = lambda *x: spark.createDataFrame(list(x), "doc long, k long, text string")
    S.commit(spark, folder, 0, {"chunks": S.Change(chunk((1, 1, "a"), (1, 2, "b"), (2, 1, "c")))}, {"chunks": DOCS})
    at, _ = S.commit(spark, folder, 1, {"chunks": S.Change(chunk((1, 2, "x"), (1, 2, "w"), (1, 3, "y")), row_keys=["doc", "k"])})
    assert {tuple(r) for r in S.read(spark, at, "chunks").collect()} == {(1, 1, "a"), (1, 2, "x"), (1, 3, "y"), (2, 1, "c")}
    at, _ = S.commit(spark, folder, 2, {"chunks": S.Change(chunk((1, 9, "z"), (1, 9, "z")))})
    assert sorted(tuple(r) for r in S.read(spark, at, "chunks").collect()) == [(1, 9, "z"), (1, 9, "z"), (2, 1, "c")]


class Killed(BaseException):
    pass


@pytest.mark.parametrize("step", ["staging", "staged", "half a manifest", "whole manifest", "published", "half a checkpoint"])
def test_a_writer_dies(spark, folder, monkeypatch, step):
    monkeypatch.setattr(S, "CHECKPOINT", 2)
    S.commit(spark, folder, 0, {"docs": S.Change(docs(spark, range(10)))}, {"docs": DOCS})
    with monkeypatch.context() as m:

        def die(*a, **k):
            raise Killed

        def half(spark_, at, name, content):
            if step == "half a checkpoint" and not name.endswith(".all"):
                return real(spark_, at, name, content)
            fs, p = S._fs(spark_, f"{at}/.tmp-dead")
            stream = fs.create(p, False)
            stream.write(bytearray(b'{"revi'))
            raise Killed

        real = S.put
        if step == "staging":
            m.setattr(S, "_names", lambda s, f, real=S._names: die() if "manifest" not in f else real(s, f))
        elif step == "staged":
            m.setattr(S, "put", die)
        elif step in ("half a manifest", "half a checkpoint"):
            m.setattr(S, "put", half)
        elif step == "whole manifest":
            m.setattr(S, "_renamed", die)
        else:
            m.setattr(S, "put", lambda *a: (real(*a), die()))
        with pytest.raises(Killed):
            S.commit(spark, folder, 1, {"docs": S.Change(docs(spark, range(5), "b"))})
    came = step in ("published", "half a checkpoint")
    assert rows(spark, folder) == {(i, f"{'b' if came and i < 5 else 'a'}{i}") for i in range(10)}
    now = S.state(spark, folder)["revision"]
    assert now == 1 + came
    S.commit(spark, folder, now, {"docs": S.Change(docs(spark, [9], "c"))})  # a second writer goes on
    want = rows(spark, folder)
    assert (9, "c9") in want and len(want) == 10
    S.vacuum(spark, folder, older_than_ms=-10_000)
    assert rows(spark, folder) == want
    files = {f for t in S.state(spark, folder)["tables"].values() for f in t["files"].values()}
    there = {f"file://{p.parent}" for p in Path(f"{folder[7:]}/docs").rglob("*.parquet")}
    assert there == files and not list(Path(f"{folder[7:]}/manifest").glob(".tmp-*"))


def test_of_two_writers_one_wins_and_the_other_tries_again(spark, folder):
    S.commit(spark, folder, 0, {"docs": S.Change(docs(spark, range(4)))}, {"docs": DOCS})
    barrier, seen = threading.Barrier(2), []

    def writer(i):
        def work(at):
            seen.append(at["revision"])
            if len(seen) <= 2:
                barrier.wait()
            return {"docs": S.Change(docs(spark, [i], "new"))}

        S.transact(spark, folder, work)

    threads = [threading.Thread(target=writer, args=(i,)) for i in (10, 11)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(seen) == [1, 1, 2] and S.state(spark, folder)["revision"] == 3
    assert {(10, "new10"), (11, "new11")} < rows(spark, folder)
    with pytest.raises(S.Conflict):
        S.commit(spark, folder, 1, {"docs": S.Change(docs(spark, [1]))})


def test_checkpoints_stand_for_the_log(spark, folder, monkeypatch):
    monkeypatch.setattr(S, "CHECKPOINT", 3)
    for i in range(7):
        S.commit(spark, folder, i, {"docs": S.Change(docs(spark, [i]))}, {"docs": DOCS})
    want = rows(spark, folder)
    S.vacuum(spark, folder, older_than_ms=-10_000)
    assert sorted(p.name for p in Path(f"{folder[7:]}/manifest").iterdir() if not p.name.startswith(".")) == [f"{6:012}.all", f"{7:012}"]
    assert rows(spark, folder) == want == {(i, f"a{i}") for i in range(7)}


def test_vacuum_leaves_what_is_young_or_kept(spark, folder):
    S.commit(spark, folder, 0, {"docs": S.Change(docs(spark, range(9)))}, {"docs": DOCS})
    S.commit(spark, folder, 1, {"docs": S.Change(docs(spark, range(9), "b"))})
    assert S.vacuum(spark, folder) == []
    S.vacuum(spark, folder, keep=2, older_than_ms=-10_000)
    assert len(rows(spark, folder, revision=1)) == 9


NODES = "stable_key string, document long"


def plain(stored, batch):
    """Refused documents and why, by repetition."""
    refused, out = set(), set()
    docs = {d for _, d in batch}
    first = {k: min(d for x, d in batch if x == k) for k, _ in batch if k is not None}
    outside = {}
    for k, d in stored:
        if d not in docs and k is not None:
            outside[k] = min(d, outside.get(k, d))
    for k, d in batch:
        if k is not None and (h := outside.get(k, first[k])) != d:
            out.add((k, d, h))
    last = refused = {d for _, d, _ in out}
    while last:
        back = {}
        for k, d in stored:
            if d in last and k is not None:
                back[k] = min(d, back.get(k, d))
        more = {(k, d, back[k]) for k, d in batch if d not in refused and k in back and back[k] != d}
        out |= more
        last = {d for _, d, _ in more}
        refused = refused | last
    return out


@pytest.mark.parametrize("seed", range(3))
def test_collisions_against_plain(spark, seed):
    import random

    rng = random.Random(seed)
    stored = [(f"k{i}", rng.randrange(12)) for i in range(15)] + [(None, 1)]
    batch = [(rng.choice([f"k{rng.randrange(20)}", f"own{d}", None]), d) for d in rng.sample(range(20), 12) for _ in range(2)]
    got = admitted(spark.createDataFrame(stored, NODES), spark.createDataFrame(batch, NODES), "stable_key", "document")
    assert {tuple(r) for r in got.collect()} == plain(stored, batch)


def test_a_refused_document_keeps_what_others_wanted(spark):
    stored = spark.createDataFrame([("x", 1), ("y", 2), ("z", 9)], NODES)
    batch = spark.createDataFrame([("z", 1), ("x", 2), ("y", 3), ("w", 4)], NODES)  # 1 loses to 9, so 2 to 1, so 3 to 2
    assert collisions(stored.filter("document = 9"), batch, "stable_key", "document").count() == 1
    assert {tuple(r) for r in admitted(stored, batch, "stable_key", "document").collect()} == {("z", 1, 9), ("x", 2, 1), ("y", 3, 2)}


def test_publication_refuses_collisions_in_every_table(spark, folder):
    node = lambda *x: spark.createDataFrame(list(x), "doc long, stable_key string")
    layouts = {"nodes": S.Keyed("doc", 4, owned="stable_key"), "docs": DOCS}
    S.commit(spark, folder, 0, {"nodes": S.Change(node((1, "a"), (1, "b"), (2, "c"))), "docs": S.Change(docs(spark, [1, 2]))}, layouts)
    new = {"nodes": S.Change(node((1, "b"), (2, "c"), (2, "b"), (3, "a"), (4, "d"))), "docs": S.Change(docs(spark, [1, 2, 3, 4], "n"))}
    at, clashes = S.commit(spark, folder, 1, new)
    assert {tuple(r) for r in clashes.select("stable_key", "doc", "holder").collect()} == {("b", 2, 1)}
    assert {tuple(r) for r in S.read(spark, at, "nodes").collect()} == {(1, "b"), (2, "c"), (3, "a"), (4, "d")}
    assert rows(spark, folder) == {(1, "n1"), (2, "a2"), (3, "n3"), (4, "n4")}
    at, clashes = S.commit(spark, folder, 2, {"nodes": S.Change(node((5, "b")), drop=node((1, "")).select("doc"))})
    assert clashes.isEmpty() and S.read(spark, at, "nodes").filter(F.col("stable_key") == "b").first()["doc"] == 5


MEMBERS = {"docs": sinks.Member("source"), "notes": sinks.Member("doc", "docs", "doc"), "whole": sinks.Member("doc", "docs", "doc")}


@pytest.fixture
def workspaces(spark, folder):
    """Documents of two workspaces, one of which both have, with notes and a plain table."""
    docs_ = spark.createDataFrame([(1, "w"), (2, "w"), (2, "v"), (3, "v")], "doc long, source string")
    notes = spark.createDataFrame([(1, "a"), (2, "b"), (2, None), (3, "c"), (9, "d")], "doc long, note string")
    S.commit(spark, folder, 0, {"docs": S.Change(docs_), "notes": S.Change(notes), "whole": notes}, {"docs": DOCS, "notes": DOCS})
    return folder


def contents(spark, folder):
    at = S.state(spark, folder)
    return {n: sorted(map(str, S.read(spark, at, n).collect())) for n in MEMBERS}


def test_deregistration_goes_through_all_tables_once(spark, workspaces):
    plan = sinks.plan_deregistration(spark, workspaces, MEMBERS, "w", 0.0)
    assert sinks.deregister(spark, workspaces, MEMBERS, plan, "w", 1.0) == "done"
    left = contents(spark, workspaces)
    assert [len(left[n]) for n in MEMBERS] == [2, 2, 2] and "source='w'" not in str(left)
    assert sinks.deregister(spark, workspaces, MEMBERS, plan, "w", 1.0) == "already_consumed" and contents(spark, workspaces) == left


def test_a_deregistration_that_dies_removes_nothing(spark, workspaces, monkeypatch):
    before, plan = contents(spark, workspaces), sinks.plan_deregistration(spark, workspaces, MEMBERS, "w", 0.0)
    with monkeypatch.context() as m:
        m.setattr(S, "put", lambda *a: (_ for _ in ()).throw(Killed()))
        with pytest.raises(Killed):
            sinks.deregister(spark, workspaces, MEMBERS, plan, "w", 1.0)
    assert contents(spark, workspaces) == before
    S.commit(spark, workspaces, S.state(spark, workspaces)["revision"], {"notes": S.Change(spark.createDataFrame([(1, "edited")], "doc long, note string"))})
    assert sinks.deregister(spark, workspaces, MEMBERS, plan, "w", 1.0) == "state_changed"


def test_counters_are_taken_beside_the_work(spark, tmp_path):
    counters = Counters()
    for n in (5, 7):
        df = counters.watch(spark.range(n), "scan", rows=F.count(F.lit(1)), even=F.count(F.when(F.col("id") % 2 == 0, 1)))
        df.write.mode("overwrite").parquet(f"{tmp_path}/out")
    assert counters.totals() == {("scan", "rows"): 12, ("scan", "even"): 7}
    assert [tuple(r) for r in counters.table(spark).collect()] == [("scan", "even", 7), ("scan", "rows", 12)]


def test_a_cut_answer_says_so(spark):
    n = spark.createDataFrame([(f"n{i}", "function") for i in range(6)], "node_id string, node_type string")
    e = spark.createDataFrame([(f"e{a}{b}", f"n{a}", f"n{b}", "calls", 1.0) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3), (3, 0), (4, 9))], "edge_id string, from_node string, to_node string, edge_type string, confidence double")

    def cut(seed, nodes, edges, depth):
        found, truncated = graph.traversed(e, n, n.filter(F.col("node_id") == seed), "out", None, nodes, edges, depth)
        return found.count(), truncated

    assert cut("n0", 50, 100, 2) == (4, False) and cut("n0", 50, 100, 1) == (3, False)
    assert cut("n0", 2, 100, 2) == (2, True) and cut("n0", 3, 100, 2) == (3, True)
    assert cut("n0", 50, 1, 2) == (2, True) and cut("n0", 50, 2, 2) == (3, True) and cut("n0", 50, 2, 1) == (3, False)
    assert cut("n4", 50, 100, 2) == (1, False) and cut("n5", 50, 100, 2) == (1, False)
