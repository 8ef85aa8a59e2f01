"""Operations that are built from several operators: structural retrieval, whole contexts,
indexing with adaptive segments, repair under a lease."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.config import DEFAULTS, Settings
from tessera.functions.columns import path_in_scope, path_score
from tessera.functions.metrics import Counters
from tessera.functions.storage import kept
from tessera.operators import context as K
from tessera.operators import experience as X
from tessera.operators import graph as G
from tessera.operators import ingest as N
from tessera.operators import intervals as I
from tessera.operators.filters import normalized_scopes
from tessera.sources import sinks
from tessera.sources import store as stores
from tessera.streaming import changes

#: How a query's intent walks the graph: direction, edge types, depth.
WALKS = {
    "callers": ("in", ("calls", "references", "uses_type", "constructs"), 1), "callees": ("out", ("calls",), 1), "implementations": ("in", ("implements", "extends", "overrides"), 1), "tests": ("in", ("tests",), 1),
    "dependencies": ("out", ("imports", "depends_on"), 1), "dependents": ("in", ("imports", "depends_on"), 1),
    "general": ("both", ("calls", "references", "uses_type", "constructs", "implements", "extends", "tests", "imports", "depends_on"), 1),
}
LEASE_SECONDS = 120


def structural_retrieval(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, seeds: DataFrame, intent: str, exact: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """(chunk_id, score, node_id): the structural arm of a hybrid search.

    Seeds that the query names exactly bring one chunk with score 0, which is evidence
    but adds nothing; the nodes that the intent leads to bring up to four chunks each, in
    order of discovery, ``candidates`` chunks in all. Nodes and chunks have document_id,
    start and end.
    """
    s = settings.structural
    if intent == "impact":
        found = G.traverse(edges, nodes, seeds, "in", G.IMPACT_EDGES, min(s.candidates, 16), min(s.candidates * 8, G.MOST_EDGES), s.depth, contains_from_files=True)
    else:
        direction, types, depth = WALKS[intent]
        found = G.traverse(edges, nodes, seeds, direction, types, min(s.candidates, 16), min(s.candidates * 8, G.MOST_EDGES), min(depth, s.depth))
    named = found.filter("depth = 0").join(nodes.filter(F.lower("name").isin(*[e.lower() for e in exact])).select("node_id"), "node_id", "left_semi")
    scored = named.select("node_id", F.lit(0.0).alias("score"), F.lit(1).alias("most"), F.lit(-1).alias("depth"), "ord").unionByName(found.filter("depth > 0").select("node_id", path_score("edge_types", "confidence", s).alias("score"), F.lit(4).alias("most"), "depth", "ord"))
    placed = nodes.select("node_id", "document_id", F.col("start").alias("node_start"), F.col("end").alias("node_end"))
    wanted = scored.join(placed, "node_id")
    pairs = I.nearest_chunks(wanted.select("document_id", "node_id", F.col("node_start").alias("start"), F.col("node_end").alias("end")), chunks, 4).select("node_id", "chunk_id", "rank")
    near = pairs.join(scored, "node_id").filter(F.col("rank") <= F.col("most"))
    first = near.orderBy("depth", "ord", "rank").limit(s.candidates)
    return first.groupBy("chunk_id").agg(F.max("score").alias("score"), F.max_by("node_id", "score").alias("node_id"))


#: Of each arm of a pool: the score that it gives, its value if it is fixed, and the reason.
ARMS = {
    "temporal": (None, None, "recent_activity"), "semantic": ("semantic", None, "semantic_match"), "lexical": ("lexical", None, "lexical_match"), "memories": ("lexical", None, "memory_match"),
    "working_set": ("working_set", None, "active_working_set"), "pins": ("working_set", 1.0, "pinned"), "task": ("task", 1.0, "active_task_reference"), "session": ("task", 0.8, "resume_state"), "structural": (None, None, None),
}


def candidate_pool(arms: dict[str, DataFrame], key: str, paths: list[str] | None = None, languages: list[str] | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """The bounded, ranked pool of each request from its arms, named as in ``ARMS``.

    An arm has ``key``, source_type, source_id, content, path, language, freshness and
    recency, its score where the arm gives one, and the structural arm its own ``reason``.
    Sources of several arms are merged, those outside the scope of paths and languages go.
    """
    parts = []
    for name, df in arms.items():
        score, fixed, reason = ARMS[name]
        scores = [(F.lit(fixed).cast("double") if fixed is not None else F.col("score").cast("double") if s == score else F.lit(None).cast("double")).alias(s) if s == score else F.lit(None).cast("double").alias(s) for s in ("semantic", "lexical", "task", "working_set")]
        why = F.col("reason") if reason is None else F.lit(reason)
        parts.append(df.select(key, "source_type", "source_id", "content", "path", "language", "freshness", F.col("recency").cast("double").alias("recency"), *scores, F.array(why).alias("reasons"), F.lit(name == "structural").alias("structural_evidence")))
    every = reduce(DataFrame.unionByName, parts)
    free = ~F.col("source_type").isin("code", "document")
    if paths:
        every = every.filter(free | path_in_scope("path", normalized_scopes(paths)))
    if languages:
        every = every.filter(free | F.lower("language").isin(*sorted({x.lower() for x in languages})))
    return K.bounded(K.ranked(K.merged(every.drop("language"), key)), key, limit=settings.candidate_pool)


def resume_context(sessions: DataFrame, tasks: DataFrame, checkpoints: DataFrame, memories: DataFrame, events: DataFrame, key: str, most: tuple[int, int, int] = (32, 128, 50)) -> DataFrame:
    """(``key``, part, id, rank) of what a workspace would resume with: its newest memories;
    the newest events of the evidence session, that of the checkpoint or else the session
    itself; and the paths that those events touched, the last ones first."""
    base = K.resumed(sessions, tasks, checkpoints, key)
    at = base.join(checkpoints.select(key, "checkpoint_id", F.col("session_id").alias("__s")), [key, "checkpoint_id"], "left").select(key, F.coalesce("__s", "session_id").alias("session_id"))

    def top(df: DataFrame, name: str, part: str, n: int, *order: Column) -> DataFrame:
        ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).filter(F.col("rank") <= n)
        return ranked.select(key, F.lit(part).alias("part"), F.col(name).cast("string").alias("id"), "rank")

    seen = events.join(at, [key, "session_id"])
    w = Window.partitionBy(key).orderBy(F.desc("created_at"), "event_id")
    recent = seen.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most[1])
    touched = recent.filter("path IS NOT NULL").groupBy(key, "path").agg(F.max("created_at").alias("last_at"))
    return (
        top(memories.join(at.select(key), key, "left_semi"), "memory_id", "memory", most[0], F.desc("created_at"), F.asc("memory_id"))
        .unionByName(recent.select(key, F.lit("event").alias("part"), F.col("event_id").cast("string").alias("id"), F.col("__n").cast("long").alias("rank")))
        .unionByName(top(touched, "path", "path", most[2], F.desc("last_at"), F.asc("path")))
    )


def reindexed(spark: SparkSession, store: str, scanned: DataFrame, seen: DataFrame, work: Callable[[dict], dict], schema: str, expected: int, counters: Counters | None = None) -> tuple[dict, DataFrame]:
    """Brings the ``documents`` of a store to what a scan found, and publishes that.

    ``scanned``: path, content and content_hash. Texts whose hash is stored need no work;
    ``work`` (a function of one row's dict, giving the columns of ``schema``) runs on each
    of the others alone, and one that fails keeps what is stored of it. Documents that
    ``seen``, a second look at the paths, no longer has are removed. Returns the manifest
    and (path, action, error): added, modified, unchanged, failed or removed. ``counters`` take
    what was worked on, what failed, what was written, and how many of each action.
    """
    watch = counters.watch if counters else lambda df, stage, **metrics: df
    state = sinks.manifest(spark, store)
    old = sinks.read(spark, state, "documents") if "documents" in state["tables"] else None
    known = scanned.limit(0).select("path", F.col("content_hash").alias("__old")) if old is None else old.select("path", F.col("content_hash").alias("__old"))
    both = scanned.join(known, "path", "left")
    same = F.col("__old").eqNullSafe(F.col("content_hash"))
    todo = both.filter(~same).select("path", "content", "content_hash")
    worked = changes.isolated(todo, lambda row: {"path": row["path"], "content_hash": row["content_hash"], **work(row)}, f"path string, content_hash string, {schema}")
    one = lambda c: F.count(F.when(c, 1))
    done = kept(watch(worked, "work", read=F.count(F.lit(1)), failed=one(F.col("status") == "failed"), done=one(F.col("status") == "done")), "reindexed")
    # a failed row has no columns of its own, so failures are what is not done
    good = done.filter("status = 'done'").drop("status", "error")
    failed = kept(todo.select("path").join(good.select("path"), "path", "left_anti"), "reindex-failed")
    gone = N.removed(known.select("path"), seen, failed)
    actions = both.select("path", F.when(same, "unchanged").when(F.col("__old").isNull(), "added").otherwise("modified").alias("action"))
    actions = actions.join(failed.withColumn("__failed", F.lit(True)), "path", "left").select("path", F.when(F.col("__failed"), "failed").otherwise(F.col("action")).alias("action"))
    names = ("added", "modified", "unchanged", "failed", "removed")
    actions = kept(watch(actions.unionByName(gone.select("path", F.lit("removed").alias("action"))), "actions", **{a: one(F.col("action") == a) for a in names}), "reindex-actions")
    new = watch(good if old is None else good.select(*old.columns), "store", written=F.count(F.lit(1)))
    return stores.commit(spark, store, expected, {"documents": stores.Change(new, gone)}, {"documents": stores.Keyed("path")})[0], actions


def accepted(spark: SparkSession, folder: str, requests: DataFrame, proposals: Callable[[], DataFrame], evidence: DataFrame, attempts: int = 5) -> DataFrame:
    """Decides on requests for acceptance and stores the records that come about, sealed, with
    their evidence (episode_id, event_id, ordinal). Returns what became of each request; those
    by which records come about (``made``) have the fingerprint and proposal_hash of theirs.

    Proposals are read, and compared with what requests expect, against the very revision
    that the records are published behind: whoever publishes first wins, and the other
    decides again, on what is stored then. So retries and restarts give the same record.
    """
    for left in reversed(range(attempts)):
        state = stores.state(spark, folder)
        records = stores.read(spark, state, "experiences") if "experiences" in state["tables"] else spark.createDataFrame([], f"experience_id string, episode_id {requests.schema['episode_id'].dataType.simpleString()}, fingerprint string, proposal_hash string")
        decided = X.acceptances(requests, proposals(), records)
        decided = kept(decided.withColumns({c: F.when(F.col("made"), F.col(c)) for c in ("fingerprint", "proposal_hash")}), "acceptances", compression="zstd")
        new = decided.filter("made").select("experience_id", "episode_id", "fingerprint", "proposal_hash")
        if new.isEmpty():
            return decided

        def told(headers: DataFrame) -> DataFrame:
            return evidence.join(headers.select("episode_id", "experience_id"), "episode_id").select("experience_id", "ordinal", "event_id")

        def work(now: dict, at: int = state["revision"], new: DataFrame = new) -> tuple[DataFrame, dict[str, Callable]]:
            if now["revision"] != at:
                raise stores.Conflict("decided on another revision")
            return new, {"experience_evidence": told}

        try:
            sinks.sealed(spark, folder, "experiences", "experience_id", work)
            return decided
        except stores.Conflict:
            if not left:
                raise
    raise AssertionError


def assembled(candidates: DataFrame, key: str, token_budget: int, experiences: DataFrame | None = None, members: DataFrame | None = None, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame | None]:
    """Packets of all requests from their raw candidates, and the history that fits behind
    them. Where there is history its room is kept free first."""
    pool = K.bounded(K.ranked(K.merged(candidates, key)), key, limit=settings.candidate_pool)
    history = None if experiences is None else K.with_experiences(pool, experiences, members, key)
    room = min(768, token_budget // 4) if history is not None else 0
    return K.packets(pool, key, token_budget - room, settings.budget), history


def adaptively_segmented(chunks: DataFrame, key: str, ceiling: int, fits: Callable[[DataFrame], DataFrame], overlap: int = 0, attempts: int = 8) -> DataFrame:
    """Segments that an embedding endpoint takes: whatever ``fits`` (segments to those that
    are taken) refuses is cut again with half the ceiling, ``attempts`` times at most."""
    done, left = None, chunks
    for _ in range(attempts):
        # written, so that no round cuts again what those before it cut, or asks the endpoint twice
        cut = kept(N.segmented(left, key, ceiling, overlap), "segments")
        good = kept(fits(cut), "segments-taken")
        bad = cut.select(key).distinct().join(good.groupBy(key).agg(F.count("*").alias("__ok")), key, "left").join(cut.groupBy(key).agg(F.count("*").alias("__n")), key).filter(F.coalesce("__ok", F.lit(0)) < F.col("__n")).select(key)
        whole = cut.join(bad, key, "left_anti")
        done = whole if done is None else done.unionByName(whole)
        left = kept(left.join(bad, key, "left_semi"), "segments-left")
        if left.isEmpty():
            return done
        ceiling //= 2
    raise ValueError(f"some chunks were refused {attempts} times")


class Lease:
    """The right to repair a graph: one holder, for ``LEASE_SECONDS`` since it last renewed.

    The state is the driver's, or whatever mapping it is given; there is one writer.
    """

    def __init__(self, state: dict, clock: Callable[[], float] = time.time) -> None:
        self.state, self.clock, self.id = state, clock, uuid.uuid4().hex

    def acquire(self) -> bool:
        held = self.state.get("holder") not in (None, self.id) and self.clock() < self.state.get("until", 0)
        if held:
            return False
        interrupted = self.state.get("holder") is not None and self.state.get("status") == "running"
        self.state.update(holder=self.id, until=self.clock() + LEASE_SECONDS, status="running", done=0, interrupted=interrupted)
        return True

    def renew(self, done: int) -> None:
        if self.state.get("holder") != self.id or self.clock() >= self.state["until"]:
            raise RuntimeError("the lease is lost")
        self.state.update(until=self.clock() + LEASE_SECONDS, done=done)

    def finish(self, error: str | None = None) -> None:
        self.renew(self.state["done"])
        self.state.update(holder=None, status="failed" if error else "complete", error=error)


def repaired(plan: DataFrame, lease: Lease, work: Callable[[DataFrame, str], int]) -> int:
    """Runs ``work`` on the documents of each disposition of a repair plan, under a lease."""
    if not lease.acquire():
        raise RuntimeError("another repair is running")
    total = 0
    try:
        for (rule,) in plan.select("disposition").distinct().orderBy("disposition").collect():  # ten at most
            if rule not in ("current", "skip_disabled", "skip_unreadable"):
                total += work(plan.filter(F.col("disposition") == rule), rule)
                lease.renew(total)
    except Exception as e:
        lease.finish(str(e))
        raise
    lease.finish()
    return total


def ordinals(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Position from 0 within a container."""
    return df.withColumn("ordinal", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
