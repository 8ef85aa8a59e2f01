"""Column forms of rules against their plain Python ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import evidence, filters, ingest
from tessera.sources import analyzers, embedding, workspace


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").select("i", *columns).orderBy("i").drop("i").collect()]


def test_scopes(spark):
    rows = [(s,) for s in ("a", " a/b/ ", "/a", "a//b", "a/../b", ".", "a/.", "..", "", "  ", "a\\b", "x" * 512, "x" * 513, "é" * 257, "a/b.c", "...", "a/...", "\ta\n", "a///")]

    def plain(s):
        try:
            return filters.normalized_scopes([s])[0]
        except ValueError:
            return None

    assert [x for (x,) in values(spark, rows, "s string", filters.normalized_scope(F.col("s")))] == [plain(s) for (s,) in rows]


def test_module_paths(spark):
    rows = [(t, lang, s) for t in ("a.b", ".c", "..c", "...c.d", ".", "./u", "../u/v", "../../../u", "crate::m::n", "self::x", "std", "fmt/p", "") for lang in ("python", "javascript", "typescript", "rust", "go", "csharp", "other") for s in ("x/y/z.py", "top.py", "a/b.ts") if lang != "python" or "/" not in t]
    got = values(spark, rows, "t string, l string, s string", analyzers.module_paths(F.col("t"), F.col("l"), F.col("s")))
    # Python's negative slices would lead back down from above the root; there is nothing above it
    deep = lambda t, s: s.count("/") - (len(t) - len(t.lstrip("."))) + 1 < 0
    assert [(r, g) for r, (g,) in zip(rows, got, strict=True) if not (r[1] == "python" and deep(r[0], r[2])) and g != analyzers.module_candidates(*r)] == []


def test_failures_and_segmentations(spark):
    bodies = ["", "Maximum tokens exceeded", "batch too large", "context length", "timed out", "Overloaded", "token", "large batch exceed", "odd"]
    rows = [(s, b) for s in (200, 400, 408, 413, 429, 503, 504) for b in bodies]
    assert [x for (x,) in values(spark, rows, "s int, b string", embedding.failure_class(F.col("s"), F.col("b")))] == [embedding.classified(*r) for r in rows]
    rows = [(1000, 100), (None, 0), (500, 7)]
    assert [x for (x,) in values(spark, rows, "b int, o int", ingest.segmentation_names(F.col("b"), F.col("o")))] == [ingest.segmentation_id(*r) for r in rows]


@pytest.mark.parametrize("seed", range(2))
def test_workspaces(spark, seed):
    rng = random.Random(seed)
    known = [{"id": f"i{i}", "name": rng.choice(["App", "app", "Lib", "lib", f"n{i}"]), "root": root} for i, root in enumerate(rng.sample(["/a", "/a/b", "/a/b/c/", "/x", "/x/y", "/z"], 5))]
    asked = ["i1", "i9", "App", "APP", "lib", "LIB", "n2", "/a", "/a/b/c/d.py", "/ab", "file:///a/b/x", "file://localhost/x/y/z", "/a\\b\\q", "", "/", "/nowhere", "/z/"]

    def plain(s):
        try:
            return workspace.resolve_workspace(known, s)["id"]
        except ValueError:
            return "ambiguous"
        except KeyError:
            return "not_found"

    got = workspace.resolved(spark.createDataFrame(list(enumerate(asked)), "request int, selector string"), spark.createDataFrame([(w["id"], w["name"], w["root"]) for w in known], "workspace_id string, name string, root string"))
    assert {r["request"]: r["workspace_id"] or r["outcome"] for r in got.collect()} == {i: plain(s) for i, s in enumerate(asked)}


def test_stable_texts_and_paths(spark):
    rows = [("a b", "src/a.rs"), ("", ""), ("x" * 513, "/a"), ("a#b", "a/../b"), ("a\n", "a//b"), ("A::b<c, &d>", "a:b"), (None, None), ("é", "a/"), ("ok", "a/.b/c-d_e")]
    got = values(spark, rows, "s string, p string", evidence.stable(F.col("s")), F.coalesce(evidence.relative(F.col("p")), F.lit(False)))
    assert got == [(True, True), (False, False), (False, False), (False, False), (False, False), (True, False), (False, False), (False, False), (True, True)]


def test_a_test_report_with_an_odd_name_keeps_its_class(spark):
    schema = "report_id int, exit_code int, subject struct<kind:string,value:string>, failures array<struct<test_name:string,assertion_class:string>>"
    got = evidence.test_failure(spark.createDataFrame([(1, 1, ("package", "p"), [("bad name!", "c")]), (2, 1, ("package", "p"), [("bad name!", None)]), (3, 1, ("package", "a/b"), [("t", None)])], schema)).orderBy("report_id").collect()
    assert [r["status"] for r in got] == ["compatible_only", "missing_test_identity", "invalid_verification_subject"]
    assert got[0]["components"] == {"subject_kind": "package", "subject_value": "p", "assertion_class": "c"}
