"""Files of a workspace as a table."""

from __future__ import annotations

import fnmatch
import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import WorkspaceFiles, glob_regex

MOST_BYTES = 1 << 20


def pattern_regex(pattern: str) -> str:
    """An ignore or include pattern as a regular expression on relative paths.

    A pattern without an inner slash matches at any depth, one with a slash from the
    root; ** crosses folders, * and ? don't; a trailing slash means all below.
    """
    p = pattern.strip()
    anchored = "/" in p.rstrip("/")
    p = p.lstrip("/")
    below = p.endswith("/")
    p = p.rstrip("/")
    out = ""
    for part in re.split(r"(\*\*/?|\*|\?|\[[^]]*\])", p):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part if part.startswith("[") and part.endswith("]") else re.escape(part))
    return ("^" if anchored else "(?:^|.*/)") + out + ("/.*$" if below else "(?:/.*)?$")


def selected(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a path is taken: by an include pattern if there is any, and by no exclude
    pattern; a later exclude pattern with ! takes a path back."""
    ok = reduce(lambda a, b: a | b, [F.rlike(path, F.lit(f"{pattern_regex(p)}")) for p in include], F.lit(not include))
    for p in exclude:
        ok = F.when(F.rlike(path, F.lit(pattern_regex(p[1:]))), True).otherwise(ok) if p.startswith("!") else ok & ~F.rlike(path, F.lit(pattern_regex(p)))
    return ok


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, most_bytes: int = MOST_BYTES, glob: str | None = None, subtrees: int = 256) -> DataFrame:
    """path (relative), size_bytes, modified_at, content_hash and content of text files.

    Hidden files are seen and ignore files are followed, as ``sources.files`` says. Files that
    are too large, hold a NUL in their first 8 KiB or are no UTF-8 are left out; ``glob`` tests
    names besides.
    """
    good = _files(spark, root, include, exclude, most_bytes, subtrees).filter("error IS NULL")
    if glob:
        good = good.filter(F.rlike("path", F.lit(f"(?:^|/){glob_regex(glob)}$")))
    return good.select("path", "size_bytes", "modified_at", F.sha2("content", 256).alias("content_hash"), "content")


def failed(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, error) of what can't be read: not to be taken for removed."""
    return _files(spark, root, include, exclude, most_bytes, 256).filter("error IS NOT NULL").select("path", "error")


def _files(spark: SparkSession, root: str, include: list[str] | None, exclude: list[str] | None, most_bytes: int, subtrees: int) -> DataFrame:
    spark.dataSource.register(WorkspaceFiles)
    return spark.read.format("workspace_files").option("include", json.dumps(include or [])).option("exclude", json.dumps(exclude or [])).option("mostBytes", most_bytes).option("subtrees", subtrees).load(root)


def language_of(path: Column, enabled: tuple[str, ...] | None = None) -> Column:
    """Analyzer of a file by its extension; ``generic`` where none is, or it is switched off."""
    known = {"rust": ("rs",), "python": ("py", "pyi"), "javascript": ("js", "jsx", "mjs", "cjs"), "typescript": ("ts", "tsx", "mts", "cts"), "csharp": ("cs",), "go": ("go",)}
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit("generic")
    for name, exts in known.items():
        if enabled is None or name in enabled:
            out = F.when(ext.isin(*exts), name).otherwise(out)
    return out


def resolve_workspace(workspaces: list[dict], selector: str, path: str | None = None) -> dict:
    """The workspace that a selector means: id, exact name, a name that is unique without
    regard to case, a file URI or path inside the deepest root; raises if none or several."""
    for test in (lambda w: w["id"] == selector, lambda w: w["name"] == selector, lambda w: w["name"].lower() == selector.lower()):
        hits = [w for w in workspaces if test(w)]
        if len(hits) == 1:
            return hits[0]
        if hits:
            raise ValueError(f"{selector!r} names several workspaces")
    where = re.sub(r"^file://(localhost)?", "", selector).replace("\\", "/").rstrip("/")
    inside = [w for w in workspaces if where == w["root"].rstrip("/") or where.startswith(w["root"].rstrip("/") + "/")]
    if not inside:
        raise KeyError(selector)
    return max(inside, key=lambda w: len(w["root"]))


def resolved(requests: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(request, outcome, workspace_id): which of ``workspaces`` (workspace_id, name, root) the
    selector of each request means. An id comes first, then an exact name, then a name without
    regard to case; several of a kind are ambiguous. Else a file URI or path lies in the deepest
    root above it: paths meet roots by their ancestors, so nothing is compared with all roots."""
    w = workspaces.select("workspace_id", "name", F.rtrim("root", F.lit("/")).alias("root"))
    r = requests.select("request", "selector")
    named = [(0, "workspace_id", F.col("selector")), (1, "name", F.col("selector")), (2, "low", F.lower("selector"))]
    w = w.withColumn("low", F.lower("name"))
    arms = [r.select("request", by.alias(column)).join(w.groupBy(column).agg(F.count("*").alias("n"), F.min(F.col("workspace_id")).alias("found")), column).select("request", F.lit(tier).alias("tier"), F.lit(0).alias("deep"), "n", "found") for tier, column, by in named if column != "workspace_id"]
    ids = r.join(w.select(F.col("workspace_id").alias("found")), F.col("selector") == F.col("found")).select("request", F.lit(0).alias("tier"), F.lit(0).alias("deep"), F.lit(1).cast("long").alias("n"), "found")
    where = F.rtrim(F.replace(F.regexp_replace("selector", "^file://(localhost)?", ""), F.lit("\\"), F.lit("/")), F.lit("/"))
    parts = F.split(where, "/")
    above = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    roots = w.groupBy("root").agg(F.min("workspace_id").alias("found"))
    paths = r.filter(F.startswith(where, F.lit("/"))).select("request", F.explode(F.array_distinct(above)).alias("root")).join(roots, "root").select("request", F.lit(3).alias("tier"), (-F.length("root")).alias("deep"), F.lit(1).cast("long").alias("n"), "found")
    best = reduce(DataFrame.unionByName, [*arms, ids, paths]).groupBy("request").agg(F.min(F.struct("tier", "deep", "n", "found")).alias("b")).select("request", "b.*")
    outcome = F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    return r.select("request").join(best, "request", "left").select("request", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("found")).alias("workspace_id"))


def matches(pattern: str, path: str) -> bool:
    """``pattern_regex`` in plain Python, for callers without a session."""
    return re.match(pattern_regex(pattern), path) is not None or fnmatch.fnmatch(path, pattern)
