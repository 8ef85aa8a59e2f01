"""Single operators on small inputs with known results."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.config import Retrieval, Settings
from tessera.functions import columns as C
from tessera.operators import context, evidence, experience, filters, graph, ingest, memory, retrieval, temporal
from tessera.sources import analyzers, captures, embedding, sinks, workspace
from tessera.streaming import changes


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# --- scalars --------------------------------------------------------------------------------


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([], [])], "a array<float>, b array<float>")
    assert [r[0] for r in rows.select(C.cosine("a", "b")).collect()] == [1.0, 0.0, None, None, None]


@pytest.mark.parametrize("path, want", [("./a//b/../c", "a/c"), ("a\\b", "a/b"), ("../x", "../x"), ("a/../../b", "../b"), ("", ""), (" /a/. ", "a")])
def test_paths(spark, path, want):
    assert value(spark, C.normalized_path(F.lit(path))) == want


@pytest.mark.parametrize("text, n", [("abc", 2), ("ñandú", 1), ("ñandú", 2), ("世界", 4), ("😀x", 3), ("😀x", 5), ("", 3)])
def test_truncation(spark, text, n):
    assert value(spark, C.truncated(F.lit(text), n)) == text.encode()[:n].decode("utf-8", "ignore")


def test_decay(spark):
    assert value(spark, C.decayed(F.lit(1.0), F.lit(90.0))) == 0.5
    assert value(spark, C.decayed(F.lit(1.0), F.lit(-5.0))) == 1.0
    assert value(spark, C.unit(F.lit(float("nan")))) == 0.0
    assert value(spark, C.final_score({k: F.lit(1.0) for k in ("semantic", "lexical", "task", "working_set", "recency", "provenance", "freshness", "structural")})) == pytest.approx(1.0)


def test_tokens_and_intents(spark):
    assert value(spark, C.structural_tokens(F.lit("What calls src\\a.rs and foo::bar?"))) == ["foo::bar", "src/a.rs"]
    assert value(spark, C.terms(F.lit("Añb_c:d, É!"))) == ["anb_c:d", "e"]
    for q, want in {"what changes if X": "impact", "which tests cover": "tests", "depends on this": "dependents", "who?": "general"}.items():
        assert value(spark, C.intent(F.lit(q))) == want


def test_settings():
    with pytest.raises(ValueError, match="retrieval weights"):
        Settings(retrieval=Retrieval(semantic=-1)).validated()


# --- retrieval ------------------------------------------------------------------------------


def test_retrieval_ranks(spark):
    """A distractor that repeats the query must not beat the meant chunk in the hybrid."""
    chunks = spark.createDataFrame([("t", "parse tokens into a tree"), ("d", "split words"), ("e", "other things")], "chunk_id string, content string")
    vectors = spark.createDataFrame([("t", [1.0, 0.1]), ("d", [0.0, 1.0]), ("e", [-1.0, 0.0])], "chunk_id string, vector array<float>")
    q = spark.createDataFrame([([1.0, 0.0],)], "vector array<float>")
    assert [r["chunk_id"] for r in retrieval.semantic_topk(vectors, q, 2).collect()] == ["t", "d"]
    assert [r["chunk_id"] for r in retrieval.lexical_topk(chunks, "Split words", 5, "chunk_id", "content").collect()] == ["d"]
    assert retrieval.lexical_topk(chunks, "?!", 5, "chunk_id", "content").count() == 0
    assert retrieval.hybrid_search(chunks, vectors, q, "split words", 1).first()["chunk_id"] == "t"
    with pytest.raises(ValueError):
        retrieval.query_fits("abc", 2)


def test_filters(spark):
    assert filters.normalized_scopes(["b/", "a", "a"]) == ["a", "b"]
    for bad in ("/x", "a/../b", "", "a\\b"):
        with pytest.raises(ValueError):
            filters.normalized_scopes([bad])
    rows = spark.createDataFrame([("a/b", "En"), ("ab", "en"), ("a", "fr")], "path string, language string")
    assert {r["path"] for r in filters.scoped(rows, ["a"], ["EN", "fr"]).collect()} == {"a/b", "a"}


def test_sessions_join_at_exactly_the_gap(spark):
    rows = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00"), (1, 2, "2024-01-01 00:10:00"), (1, 3, "2024-01-01 00:20:01")], "owner int, event_id int, t string").withColumn("created_at", F.to_timestamp("t"))
    assert sorted(r["n_events"] for r in temporal.sessions(rows, "10 MINUTES").collect()) == [1, 2]


# --- graph ----------------------------------------------------------------------------------


def model(edges, starts, direction, max_nodes, depth):
    """Breadth-first search over a queue, in plain Python."""
    near = {}
    for e, a, b, w in edges:
        if direction in ("out", "both"):
            near.setdefault(a, []).append((e, b, w))
        if direction in ("in", "both") and not (direction == "both" and a == b):
            near.setdefault(b, []).append((e, a, w))
    queue = [(s, 0, [s], 1.0) for s in sorted(starts)]
    seen, out = set(starts), list(queue)
    while queue:
        n, d, path, c = queue.pop(0)
        if d == depth:
            continue
        for e, m, w in sorted(near.get(n, [])):
            if m not in seen and len(out) < max_nodes:
                seen.add(m)
                x = (m, d + 1, [*path, m], min(1.0, c * w))
                out.append(x)
                queue.append(x)
    return [(n, d, p, round(c, 9)) for n, d, p, c in out]


@pytest.mark.parametrize("seed", range(3))
def test_traversal(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(14)]
    edges = [(f"e{i:03}", rng.choice(names), rng.choice(names), rng.choice([0.5, 0.9, 1.0])) for i in range(30)]
    e = spark.createDataFrame([(i, a, b, "calls", w) for i, a, b, w in edges], "edge_id string, from_node string, to_node string, edge_type string, confidence double")
    n = spark.createDataFrame([(x, "function", x) for x in names], "node_id string, node_type string, stable_key string")
    for direction in ("out", "in", "both"):
        got = graph.traverse(e, n, n.filter("node_id IN ('n00', 'n03')"), direction, None, 9, 500, 3).orderBy("depth", "ord").collect()
        assert [(r["node_id"], r["depth"], r["path"], round(r["confidence"], 9)) for r in got] == model(edges, ["n00", "n03"], direction, 9, 3)


def test_bounds():
    with pytest.raises(ValueError):
        graph.bounds(max_depth=9)


def test_aliases_and_containers(spark):
    nodes = spark.createDataFrame([("1", "k1", "pkg.util.run", "run", "d1"), ("2", "k2", "pkg.io.run", "run", "d2"), ("3", "k3", "lib.core.go", "go", "d3")], "node_id string, stable_key string, qualified_name string, name string, document_id string")
    facts = spark.createDataFrame([(1, "run", "d9", "pkg.io.main"), (2, "run", "d1", None), (3, "run", "d9", None), (4, "c.go", "d9", None), (5, "nope", "d9", None), (6, " k3 ", "d9", None)], "fact_id int, target string, document_id string, container string")
    aliases = spark.createDataFrame([(4, "c", "lib.core")], "fact_id int, alias string, replacement string")
    got = {r["fact_id"]: (r["state"], r["basis"], r["node_id"]) for r in graph.resolve(facts, nodes, aliases).collect()}
    assert got == {1: ("resolved", "container", "2"), 2: ("resolved", "source_document", "1"), 3: ("ambiguous", "workspace_name", None), 4: ("resolved", "alias", "3"), 5: ("unresolved", None, None), 6: ("resolved", "stable_key", "3")}


# --- memories and context -------------------------------------------------------------------


def test_token_overlap(spark):
    rows = spark.createDataFrame([(1, 1, "alpha beta gamma delta"), (1, 2, "alpha beta gamma epsilon"), (2, 3, "alpha")], "scope int, memory_id int, content string").withColumn("created_at", F.col("memory_id").cast("timestamp"))
    assert [(r["older"], r["newer"], r["ratio"]) for r in memory.token_overlap(rows, "scope").collect()] == [(1, 2, 0.75)]


def test_supersession_needs_trust_and_no_circle(spark):
    m = spark.createDataFrame([(1, "trusted"), (2, "trusted"), (3, "unreviewed")], "memory_id long, trust string")
    links = spark.createDataFrame([(1, 2)], "superseded long, superseding long")
    with pytest.raises(ValueError, match="circular"):
        memory.supersede(links, m, 2, 1)
    with pytest.raises(ValueError, match="trusted"):
        memory.supersede(links, m, 3, 1)


def test_long_chains(spark):
    line, ring = [(i, i + 1) for i in range(1, 301)], [(1000 + i, 1000 + (i + 1) % 100) for i in range(100)]
    tail = [(2000, 2001), (2001, 1000)]
    got = {r["item"]: r for r in graph.chain_roots(spark.createDataFrame(line + ring + tail, "old long, new long"), "old", "new").collect()}
    assert len(got) == 402
    assert all((got[i]["root"], got[i]["hops"], got[i]["cyclic"]) == (301, 301 - i, False) for i, _ in line)
    assert all(got[i]["cyclic"] for i, _ in ring + tail)


def test_supersession_at_the_end_of_a_long_chain(spark):
    m = spark.createDataFrame([(i, "trusted") for i in range(1, 103)], "memory_id long, trust string")
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 101)], "superseded long, superseding long")
    assert memory.supersede(links, m, 101, 102).count() == 101
    with pytest.raises(ValueError, match="circular"):
        memory.supersede(links, m, 101, 1)


def test_trust_reviews(spark):
    m = spark.createDataFrame([(1, "unreviewed", "imported"), (2, "unreviewed", "human_authorized")], "memory_id long, trust string, origin string")
    r = spark.createDataFrame([(1, "unreviewed", "trusted", 1), (1, "unreviewed", "rejected", 2), (2, "unreviewed", "trusted", 3)], "memory_id long, previous string, trust string, seq long")
    assert {x["memory_id"]: x["trust"] for x in memory.reviewed(m, r).collect()} == {1: "trusted", 2: "unreviewed"}


class Candidate:
    def __init__(self, place, source_type="code", content="x", path="p", final=0.5, required=255, structural=False):
        self.__dict__.update(place=place, source_type=source_type, source_id=place, content=content, path=path, final=final, semantic=0, lexical=0, structural_evidence=structural, required=required)


def test_packets():
    rng = random.Random(4)
    for _ in range(200):
        pool = [Candidate(i, rng.choice(["code", "memory", "event", "task_state"]), "abcdefgh"[: rng.randint(1, 8)] * rng.randint(1, 9), f"p{rng.randrange(3)}", rng.random(), rng.choice([255, 255, 0, 2]), rng.random() < 0.3) for i in range(12)]
        got = context.fill(pool, 40)
        assert sum(x[2] for x in got) <= 40 and len({x[:2] for x in got}) == len(got)
        first = [pool[x[1]].required < 255 for x in got]
        assert first == sorted(first, reverse=True) or any(pool[x[1]].required < 255 for x in got)
        assert all(not x[3] or pool[x[1]].required < 255 or pool[x[1]].structural_evidence for x in got)


# --- history --------------------------------------------------------------------------------


class Event:
    def __init__(self, kind, passed=None, scope="s", failure="f", subject="x", accepted=False, source_change=False, closed=True):
        self.__dict__.update(kind=kind, passed=passed, scope=scope, failure=failure, subject=subject, accepted=accepted, source_change=source_change, closed=closed)


def test_episodes():
    fail, ok, change = Event("verification", False), Event("verification", True), Event("change")
    read = lambda *e: experience.interpret(list(e))
    assert read(fail, change, ok)[:5] == ("proposal", "success", "verified_passed", "moderate", 1)
    assert read(fail, fail, change, ok, ok)[1:6] == ("success", "verified_passed", "strong", 1, 1)
    assert read(fail, change, fail)[1:3] == ("failure", "verified_failed")
    assert read(ok, change)[0] == "no_supported_failure"
    assert read(fail)[0] == "no_attempt_evidence"
    assert read(fail, ok)[0] == "ambiguous_pre_attempt_result"
    assert read(fail, change)[0] == "pending_attempt_has_no_verification"
    assert read(Event("verification", False, closed=False), change)[1:4] == ("abandoned", "missing", "weak")
    assert read(fail, change, ok, fail)[0] == "conflicting_terminal_results"
    assert read(fail, change, ok, Event("verification", False, subject="y"))[1:3] == ("partial_success", "conflicting")
    assert read(fail, Event("change", source_change=True), Event("verification", True, accepted=True))[2:] == ("explicitly_accepted", "moderate", 1, 0, "historical_snapshot_unavailable,unauthenticated_user_acceptance")


def test_episode_requests(spark):
    e = spark.createDataFrame([(1, 0, "open")], "episode_id long, version long, status string")
    r = spark.createDataFrame([("a", 1, "add", 0, [5, 6], 1), ("a", 1, "add", 0, [5, 6], 2), ("a", 1, "add", 0, [7], 3), ("b", 1, "add", 1, [6], 4), ("c", 1, "add", 0, [8], 5), ("d", 1, "close", 1, [], 6), ("e", 1, "add", 2, [9], 7)], "request_key string, episode_id long, action string, expected_version long, event_ids array<long>, seq long")
    assert [x["result"] for x in experience.mutated(e, r).collect()] == ["applied", "replayed", "conflict", "invalid", "conflict", "applied", "conflict"]


# --- ingestion and sources --------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "abc", "a" * 500, "ñ" * 200, "# A\n\ntext " * 40, "word " * 100 + "\n\n" + "x" * 300, "😀\n#" * 60])
def test_chunks_cover_texts(text):
    data = text.encode()
    ranges = ingest.chunk_ranges(data, 100, 10)
    assert (not data and not ranges) or (ranges[0][0] == 0 and ranges[-1][1] == len(data))
    for (a, b), (c, d) in zip(ranges, ranges[1:], strict=False):
        assert a < c <= b < d
    for a, b in ranges:
        data[a:b].decode()
    for n in (30, 64):
        parts = ingest.segment_ranges(data, n, 5)
        assert parts[0][0] == 0 and parts[-1][1] == len(data) and all(b - a <= n for a, b in parts)
        assert all(c <= b for (_, b), (c, _) in zip(parts, parts[1:], strict=False))


def test_batch_plans():
    assert ingest.batch_plan([3, 3, 3, 1], 2, 6) == [[0, 1], [2, 3]]
    assert ingest.batch_plan([5, 5], 9, 6) == [[0], [1]]
    with pytest.raises(ValueError):
        ingest.batch_plan([7], 9, 6)


def test_capacity_is_halved():
    class Small(embedding.HashedWords):
        def embed(self, texts):
            if len(texts) > 3:
                raise embedding.CapacityError
            return super().embed(texts)

    texts = [f"t{i}" for i in range(11)]
    assert embedding.embedded_texts(Small(8), texts) == embedding.HashedWords(8).embed(texts)
    assert [embedding.classified(*x) for x in ((413, ""), (400, "maximum context length is 5 tokens"), (504, ""), (503, ""), (500, "?"))] == ["batch_too_large", "input_too_large", "timeout", "unavailable", "unknown"]


def test_scan(spark, tmp_path):
    files = {"src/a.py": b"def f():\n    g()\n", ".git/config": b"x", "bin/b.dat": b"a\x00b", "bad.txt": b"\xff\xfe", "target/out.rs": b"fn x() {}", "big.txt": b"y" * 50}
    for name, data in files.items():
        p = tmp_path / "ws" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = workspace.scan(spark, f"{tmp_path}/ws", exclude=["target/"], most_bytes=40)
    assert sorted(r["path"] for r in got.collect()) == ["src/a.py"]
    assert workspace.matches("*.py", "x/y.py") and not workspace.matches("/src/*.py", "src/a/b.py")
    files = got.withColumn("language", workspace.language_of(F.col("path")))
    names = {(r["kind"], r["qualified_name"]) for r in analyzers.symbols(files).collect()}
    assert ("function", "f") in names
    assert ("calls", "g") in {(r["edge_type"], r["target"]) for r in analyzers.facts(files).collect()}
    assert embedding.embedded(got.select(F.col("path").alias("chunk_id"), "content"), lambda: embedding.HashedWords(8)).count() == 1


def test_analyzers():
    symbols, facts = analyzers.analyzed("a.py", "import os\nclass A(B):\n    def m(self):\n        return os.path.join(x())\ndef test_a():\n    A()\n", "python")
    assert [(s[4], s[3], s[10]) for s in symbols] == [("class", "A", False), ("method", "A.m", False), ("function", "test_a", True)]
    assert {("imports", "os"), ("extends", "B"), ("calls", "os.path.join"), ("tests", "A")} <= {(f[2], f[4]) for f in facts}
    symbols, facts = analyzers.analyzed("a.rs", "use std::io;\nstruct S;\nimpl T for S {\n    fn go(&self) { run(1); }\n}\n#[test]\nfn works() { go(); }\n", "rust")
    assert {s[2] for s in symbols} == {"S", "go", "works"} and {s[2] for s in symbols if s[10]} == {"works"}
    assert {("imports", "std::io"), ("implements", "T"), ("calls", "run"), ("tests", "go")} <= {(f[2], f[4]) for f in facts}
    assert analyzers.analyzed("x.bin", "no code", "generic")[0][0][4] == "file"
    assert analyzers.module_candidates("..util", "python", "pkg/sub/a.py") == ["pkg/util.py", "pkg/util/__init__.py"]
    assert analyzers.module_candidates("../b", "typescript", "src/x/a.ts")[0] == "src/b.ts"


def test_workspaces():
    known = [{"id": "1", "name": "App", "root": "/a"}, {"id": "2", "name": "app", "root": "/a/b"}, {"id": "3", "name": "Lib", "root": "/l"}]
    assert workspace.resolve_workspace(known, "lib")["id"] == "3"
    assert workspace.resolve_workspace(known, "file:///a/b/c.py")["id"] == "2"
    assert workspace.resolve_workspace(known, "App")["id"] == "1"
    with pytest.raises(ValueError):
        workspace.resolve_workspace(known, "APP")
    with pytest.raises(KeyError):
        workspace.resolve_workspace(known, "/zzz")


def test_captures(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"runner": {"id": "v", "version": "1"}, "completed_run": {"modules": [{"relative_module_id": "a.ts", "cases": [{"namespace": ["s"], "name": "n", "state": "failed"}, {"namespace": [], "name": "o", "state": "passed"}]}]}}')
    (tmp_path / "c.json").write_text('{"runner": {"id": "u", "version": "1"}, "probe": {"observations": [{"kind": "outcome", "case": ["t", "A", "b"], "outcome": "error"}, {"kind": "sub", "case": ["x"], "parent": ["t"], "outcome": "failure"}]}}')
    assert {(r["identity"], r["status"]) for r in captures.module_cases(spark, f"{tmp_path}/m.json").collect()} == {("s::n", "assertion_failed"), ("o", "passed")}
    assert [(r["identity"], r["status"]) for r in captures.callback_cases(spark, f"{tmp_path}/c.json").collect()] == [("t::A::b", "errored")]


def test_snapshots(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    one = sinks.publish(spark, store, {"t": a, "u": a}, 0)
    new = sinks.upserted(sinks.read(spark, one, "t"), spark.createDataFrame([(2, "z")], a.schema), ["id"])
    two = sinks.publish(spark, store, {"t": new}, 1)
    assert {(r["id"], r["v"]) for r in sinks.read(spark, two, "t").collect()} == {(1, "x"), (2, "z")}
    assert sinks.read(spark, one, "t").count() == 2 and two["tables"]["u"] == one["tables"]["u"]
    with pytest.raises(RuntimeError):
        sinks.publish(spark, store, {"t": new}, 1)


# --- streams --------------------------------------------------------------------------------


def test_streams_equal_tables(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, i % 2, i) for i in range(40)], "session_id long, source_id long, event_id long").withColumn("created_at", F.timestamp_seconds(F.col("event_id") * 600))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = changes.signals(spark, f"{tmp_path}/in", rows.schema)
    changes.run_available(changes.activation_stream(stream), changes.by_batch(f"{tmp_path}/out"), f"{tmp_path}/cp", "update")
    got = {(r["session_id"], r["source_id"]): round(r["score"], 9) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r["session_id"], r["source_id"]): round(r["score"], 9) for r in memory.activate(rows).collect()}
    assert got == want
    changes.run_available(changes.once(stream, "source_id"), changes.by_batch(f"{tmp_path}/out2"), f"{tmp_path}/cp2")
    assert spark.read.parquet(f"{tmp_path}/out2").count() == 2


def test_failures_stay_alone(spark):
    def work(row):
        if row["id"] == 2:
            raise ValueError("no")
        return {"out": row["id"] * 10}

    got = {r["out"]: r["status"] for r in changes.isolated(spark.range(4), work, "out long").collect()}
    assert got == {0: "done", 10: "done", None: "failed", 30: "done"}


def test_run_and_tool_failures(spark):
    case = "array<struct<status:string,namespace:array<string>,name:string,error_class:string>>"
    names = ("profile_id", "profile_version", "runner_id", "runner_version", "project_root", "import_root", "selection_kind", "selection_value", "test_file")
    bad, good = ("assertion_failed", ["a", "ñ"], "t", "E"), ("passed", [], "u", None)
    runs = spark.createDataFrame(
        [(i, status, cases, *names) for i, status, cases in [(1, "eligible_failed", [good, bad]), (2, "eligible_failed", [bad, bad]), (3, "ineligible", [bad]), (4, "eligible_passed", [good])]],
        f"run_id long, status string, cases {case}, " + ", ".join(f"{c} string" for c in names),
    )
    got = {r["report_id"]: r for r in evidence.test_run_failure(runs).collect()}
    assert [got[i]["status"] for i in (1, 2, 3, 4)] == ["compatible_only", "ambiguous_test_run_failure", "ineligible_test_run_failure", "ineligible_test_run_failure"]
    assert got[1]["components"] == {c: c for c in names[:-1]} | {"case_namespace": "2:1:a2:ñ", "case_name": "t", "error_class": "E"}
    assert got[1]["key"] and got[2]["key"] is None

    rules = spark.createDataFrame([("r", "1", "v", "1", "lint", "check", ["file"])], "rule_id string, rule_version string, verifier_id string, verifier_version string, required_tool string, required_operation string, allowed_subject_kinds array<string>")
    ok = ("v", "1", "lint", "check", "exited_nonzero", "failed", ("file", "x"))
    change = lambda i, v: (*ok[:i], v, *ok[i + 1 :])
    rows = [ok, change(4, "exited_zero"), change(5, "passed"), change(1, "2"), change(2, "fmt"), change(6, ("file", "a/b")), change(6, ("crate", "x"))]
    reports = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "report_id long, verifier_id string, verifier_version string, tool string, operation string, process_outcome string, reported_result string, subject struct<kind:string,value:string>")
    out = [r for r in evidence.registered_tool_failure(reports, rules).orderBy("report_id").collect()]
    assert [r["status"] for r in out] == ["compatible_only", "not_a_failure", "not_a_failure", "unregistered_verifier_rule", "verifier_rule_mismatch", "invalid_verification_subject", "verifier_subject_not_allowed"]
    assert out[0]["components"] == {"rule_id": "r", "rule_version": "1", "subject_kind": "file", "subject_value": "x", "exit_class": "nonzero"}
