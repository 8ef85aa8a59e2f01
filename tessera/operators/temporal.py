"""Sessions, time and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.columns import freshness_priority, recency
from tessera.operators.intervals import containing, smallest_enclosing


def sessions(events: DataFrame, gap: str, owner: str = "owner") -> DataFrame:
    """Sessions of each owner: events no more than ``gap`` apart (equal to it: same session).

    session_id is the first event's id. One shuffle by owner; sessions never meet in a
    single task.
    """
    order = Window.partitionBy(owner).orderBy("created_at", "event_id")
    before = F.lag("created_at").over(order)
    new = (before.isNull() | (F.col("created_at") > before + F.expr(f"INTERVAL {gap}"))).cast("int")
    numbered = events.withColumn("__new", new).withColumn("__n", F.sum("__new").over(order))
    return numbered.groupBy(owner, "__n").agg(
        F.min_by("event_id", F.struct("created_at", "event_id")).alias("session_id"), F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"), F.count("*").alias("n_events")
    ).drop("__n")


def previous_session(sessions: DataFrame, owner: str = "owner") -> DataFrame:
    """Each session's latest session that started before it."""
    order = Window.partitionBy(owner).orderBy("started_at", "session_id")
    return sessions.withColumn("previous_id", F.lag("session_id").over(order))


def events_in_sessions(events: DataFrame, sessions: DataFrame, now: Column, owner: str = "owner") -> DataFrame:
    """Events within [started_at, ended_at or now] of their owner's sessions, which may overlap."""
    s = sessions.select(owner, "session_id", F.unix_micros("started_at").alias("__from"), F.unix_micros(F.coalesce("ended_at", now)).alias("__to")).filter("__to >= __from")
    return containing(events, F.unix_micros("created_at"), s, F.col("__from"), F.col("__to"), [owner]).drop("__from", "__to")


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    names = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*names), F.struct(*order)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, "__best.*")


def recent(df: DataFrame, n: int, time: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(time), F.asc(key)).limit(n)


def page(df: DataFrame, time: str, key: str, size: int, cursor: tuple | None = None) -> DataFrame:
    """The next ``size`` rows, newest first, behind ``cursor`` (time, key); has_more tells
    whether any follow."""
    if cursor is not None:
        t, k = F.lit(cursor[0]).cast(df.schema[time].dataType), F.lit(cursor[1])
        df = df.filter((F.col(time) < t) | ((F.col(time) == t) & (F.col(key) < k)))
    probe = df.orderBy(F.desc(time), F.desc(key)).limit(size + 1)
    order = Window.orderBy(F.desc(time), F.desc(key))  # of size + 1 rows at most
    placed = probe.withColumn("__n", F.row_number().over(order)).withColumn("has_more", F.max("__n").over(Window.partitionBy()) > size)
    return placed.filter(F.col("__n") <= size).drop("__n")


def freshness(hours: Column, recent_hours: float = 72.0, superseded: Column | None = None) -> Column:
    out = F.when(hours <= 24, "current").when(hours <= recent_hours, "recent").otherwise("historical")
    return out if superseded is None else F.when(superseded, "superseded").otherwise(out)


def age_hours(now: Column, at: Column | str) -> Column:
    at = F.col(at) if isinstance(at, str) else at
    return F.greatest((F.unix_micros(now) - F.unix_micros(at)) / 3.6e9, F.lit(0.0))


def temporal_retrieval(candidates: DataFrame, now: Column, limit: int, include_superseded: bool = False) -> DataFrame:
    """Candidates by freshness, recency, type and id; ``limit`` is at most 100."""
    if not include_superseded:
        candidates = candidates.filter(~F.col("is_superseded"))
    hours = age_hours(now, F.coalesce("modified_at", "created_at"))
    scored = candidates.withColumn("freshness", freshness(hours, superseded=F.col("is_superseded"))).withColumn("recency", recency(hours))
    return scored.orderBy(F.desc(freshness_priority("freshness")), F.desc("recency"), "source_type", "source_id").limit(min(limit, 100))


def change_rollup(changes: DataFrame, session_id: object) -> DataFrame:
    """Per path: changes, those in the session and in none, kinds, first and last time.

    Backslashes and a leading ./ are normalised first.
    """
    path = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    return changes.withColumn("path", path).groupBy("path").agg(
        F.count("*").alias("changes"), F.count(F.when(F.col("session_id") == F.lit(session_id), 1)).alias("in_session"), F.count(F.when(F.col("session_id").isNull(), 1)).alias("unscoped"),
        F.array_sort(F.collect_set("kind")).alias("kinds"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
    )


def siblings(chunks: DataFrame, parent: list[str], *order: str, key: str = "chunk_id") -> DataFrame:
    """The chunk before and behind each one under the same parent, and its ordinal."""
    w = Window.partitionBy(*parent).orderBy(*order)
    return chunks.withColumn("previous_id", F.lag(key).over(w)).withColumn("next_id", F.lead(key).over(w)).withColumn("ordinal", (F.row_number().over(w) - 1).cast("long"))


def expanded(chunks: DataFrame, limit: int = 4, document: str = "document_id") -> DataFrame:
    """(chunk_id, relation, related_id, place) around each chunk, at most ``limit``: its
    container (that of its ``parent_key``, or else the narrowest chunk around it), the chunks
    before and behind it under the same parent, and its first child, or else the first
    sibling that is not among these. Chunks have stable_key, parent_key, start and end."""
    parents = chunks.select(document, F.col("stable_key").alias("parent_key"), F.col("chunk_id").alias("__p"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    holds = (F.col("__s") <= F.col("start")) & (F.col("__e") >= F.col("end"))
    named = chunks.join(parents, [document, "parent_key"]).groupBy("chunk_id").agg(F.min_by("__p", F.struct(~holds, F.col("__e") - F.col("__s"), "__s", "__p")).alias("__named"))
    around = smallest_enclosing(chunks, document).withColumnRenamed("enclosing_id", "__around")
    first = chunks.filter("parent_key IS NOT NULL").groupBy(document, F.col("parent_key").alias("stable_key")).agg(F.min_by("chunk_id", F.struct("start", "chunk_id")).alias("__child"))
    group = Window.partitionBy(document, "parent_key").orderBy("start", "chunk_id")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # five siblings are enough: itself, the two beside it, its container, and one more
    firsts = F.array(*[F.nth_value("chunk_id", i).over(whole) for i in range(1, 6)])
    r = chunks.withColumn("__before", F.lag("chunk_id").over(group)).withColumn("__next", F.lead("chunk_id").over(group)).withColumn("__firsts", firsts)
    r = r.join(named, "chunk_id", "left").join(around, "chunk_id", "left").join(first, [document, "stable_key"], "left").withColumn("__container", F.coalesce("__named", "__around"))
    other = F.get(F.filter("__firsts", lambda x: x.isNotNull() & (x != F.col("chunk_id")) & ~x.eqNullSafe(F.col("__before")) & ~x.eqNullSafe(F.col("__next")) & ~x.eqNullSafe(F.col("__container"))), F.lit(0))
    one = lambda relation, c: F.struct(F.lit(relation).alias("relation"), c.alias("related_id"))
    every = F.array(one("container", F.col("__container")), one("neighbor", F.col("__before")), one("neighbor", F.col("__next")), one("related", F.coalesce(F.col("__child"), other)))
    some = F.slice(F.filter(every, lambda x: x["related_id"].isNotNull()), 1, limit)
    return r.select("chunk_id", F.posexplode(some).alias("place", "x")).select("chunk_id", "x.relation", "x.related_id", "place")


def rank_score(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """(count - index) / count of each row within its keys: 1 for the first."""
    w = Window.partitionBy(*keys)
    return df.withColumn("score", (F.count("*").over(w) - F.row_number().over(w.orderBy(*order)) + 1) / F.count("*").over(w))
