"""Predicates whose bounds may be absent. An absent bound adds nothing to the plan, so what
remains is pushed to the scan; no OR with a null test ever stands in its way."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import path_in_scope

MOST_SCOPES, MOST_SCOPE_BYTES = 64, 512
UNSCOPED = ("code", "document")


def bounded(df: DataFrame, column: str, after: object = None, before: object = None) -> DataFrame:
    if after is not None:
        df = df.filter(F.col(column) >= F.lit(after))
    if before is not None:
        df = df.filter(F.col(column) <= F.lit(before))
    return df


def activity_time() -> Column:
    return F.coalesce("modified_at", "created_at")


def in_session(df: DataFrame, session_id: object | None) -> DataFrame:
    """Rows of a session; code and documents belong to every session."""
    if session_id is None:
        return df
    return df.filter(F.col("source_type").isin(*UNSCOPED) | (F.col("session_id") == F.lit(session_id)))


def current_only(df: DataFrame, include_superseded: bool = False) -> DataFrame:
    return df if include_superseded else df.filter(~F.col("is_superseded"))


def of_types(df: DataFrame, types: list[str] | None) -> DataFrame:
    return df.filter(F.col("source_type").isin(*types)) if types else df


def scoped(df: DataFrame, paths: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    if paths:
        df = df.filter(path_in_scope("path", normalized_scopes(paths)))
    if languages:
        df = df.filter(F.lower("language").isin(*sorted({x.lower() for x in languages})))
    return df


def normalized_scopes(scopes: list[str]) -> list[str]:
    """Sorted distinct relative paths; raises for what is none."""
    out = set()
    for s in scopes:
        s = s.strip().rstrip("/")
        parts = s.split("/")
        if not s or len(s.encode()) > MOST_SCOPE_BYTES or s.startswith("/") or "\\" in s or {"", ".", ".."} & set(parts):
            raise ValueError(f"scope {s!r} is no relative path")
        out.add(s)
    if len(out) > MOST_SCOPES:
        raise ValueError(f"more than {MOST_SCOPES} scopes")
    return sorted(out)


def normalized_scope(scope: Column) -> Column:
    """A scope as ``normalized_scopes`` takes it; null for what is no relative path."""
    s = F.rtrim(F.regexp_replace(scope, r"^\s+|\s+$", ""), F.lit("/"))
    bad = (s == "") | (F.octet_length(s) > MOST_SCOPE_BYTES) | F.contains(s, F.lit("\\")) | F.rlike(s, F.lit(r"(^|/)\.{0,2}(/|$)"))
    return F.when(~bad, s)


def same_task(df: DataFrame, task_id: object | None) -> DataFrame:
    return df.filter(F.col("task_id").eqNullSafe(F.lit(task_id)))


def trusted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("trust") == "trusted")


def window_start(now: datetime, hours: int = 0, days: int = 0) -> datetime:
    """The first moment of a recent window; raises if it is empty or out of the calendar."""
    if hours + 24 * days <= 0:
        raise ValueError("a recent window must not be empty")
    return now - timedelta(hours=hours, days=days)


def valid_range(after: datetime | None, before: datetime | None) -> None:
    if after is not None and before is not None and after > before:
        raise ValueError("time bounds are inverted")


def with_components(df: DataFrame, wanted: dict[str, str], column: str = "components") -> DataFrame:
    """Rows whose map holds all of ``wanted``."""
    for k, v in sorted(wanted.items()):
        df = df.filter(F.col(column)[k] == v)
    return df


def exists(df: DataFrame, condition: Column) -> DataFrame:
    """One row, whether any row meets ``condition``; reads no more than it needs."""
    return df.filter(condition).limit(1).agg((F.count("*") > 0).alias("found"))
