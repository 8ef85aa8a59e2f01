"""Context pools and packets.

Merging and ranking are DataFrame operations. A packet is filled greedily: each choice
depends on all before it, so a request's bounded pool is folded in Python, one request
after another, over partitions that are sorted by request.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.config import DEFAULTS, Budget
from tessera.functions.columns import final_score, freshness_priority, freshness_weight, provenance_weight, structural_reason_weight

SCORES = ("semantic", "lexical", "task", "working_set", "recency")
REQUIRED = ("active_task_reference", "current_checkpoint", "pinned")
ORDER = ("final", "working_set", "task", "semantic", "lexical", "freshness_priority", "recency")
CATEGORIES = ("code", "structural", "memory", "event", "state")


def merged(candidates: DataFrame, *keys: str) -> DataFrame:
    """One row a source of each request: greatest scores, all reasons, best freshness, and
    the content of a candidate that a query found, before any other's."""
    found = F.coalesce("semantic", "lexical").isNotNull()
    rank = F.struct(found.cast("int"), F.coalesce("semantic", F.lit(0.0)) + F.coalesce("lexical", F.lit(0.0)), F.coalesce("content", F.lit("")))
    best = F.max_by(F.struct("content", "path"), rank).alias("__best")
    fresh = F.max_by("freshness", freshness_priority("freshness")).alias("freshness")
    out = candidates.groupBy(*keys, "source_type", "source_id").agg(
        *[F.max(s).alias(s) for s in SCORES], F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"), F.bool_or("structural_evidence").alias("structural_evidence"), fresh, best
    )
    return out.select("*", "__best.*").drop("__best")


def ranked(pool: DataFrame) -> DataFrame:
    """``pool`` with final, the weighted mean of all scores, to nine places, so that equal
    candidates stay equal whatever the order of additions."""
    parts = {s: F.col(s) for s in SCORES} | {"provenance": provenance_weight("source_type"), "freshness": freshness_weight("freshness"), "structural": structural_reason_weight("reasons")}
    return pool.withColumn("structural", parts["structural"]).withColumn("final", F.round(final_score(parts), 9)).withColumn("freshness_priority", freshness_priority("freshness"))


def candidate_order() -> list[Column]:
    """The nine keys that put candidates in a total order."""
    return [*[F.desc(F.coalesce(F.col(c), F.lit(0))) for c in ORDER], F.asc("source_type"), F.asc("source_id")]


def required() -> Column:
    """0 to 2 for reasons that a packet can't do without, 255 for none."""
    return reduce(lambda rest, i: F.when(F.array_contains("reasons", REQUIRED[i]), i).otherwise(rest), reversed(range(len(REQUIRED))), F.lit(255))


def bounded(pool: DataFrame, *keys: str, limit: int = DEFAULTS.candidate_pool) -> DataFrame:
    """The first ``limit`` of each request, required ones first; if none of them has
    structural evidence, the best that has takes the last place that isn't required."""
    w = Window.partitionBy(*keys)
    r = pool.withColumn("__req", required()).withColumn("__n", F.row_number().over(w.orderBy("__req", *candidate_order())))
    inside = F.col("__n") <= limit
    r = r.withColumn("__in", F.max(F.when(inside & F.col("structural_evidence"), 1).otherwise(0)).over(w))
    r = r.withColumn("__spare", F.min(F.when(~inside & F.col("structural_evidence"), F.col("__n"))).over(w)).withColumn("__last", F.max(F.when(inside & (F.col("__req") == 255), F.col("__n"))).over(w))
    swap = (F.col("__in") == 0) & F.col("__spare").isNotNull() & F.col("__last").isNotNull()
    keep = F.when(swap, (inside & (F.col("__n") != F.col("__last"))) | (F.col("__n") == F.col("__spare"))).otherwise(inside)
    return r.filter(keep).drop("__req", "__n", "__in", "__spare", "__last")


def category(source_type: str, structural: bool) -> str:
    if source_type in ("code", "document"):
        return "structural" if structural else "code"
    return source_type if source_type in ("memory", "event") else "state"


def cut(text: str, budget: int) -> str:
    """The longest prefix of whole characters within ``budget`` bytes."""
    return text.encode()[: max(budget, 0)].decode("utf-8", "ignore")


def fill(pool: list, token_budget: int, shares: Budget = DEFAULTS.budget) -> list[tuple]:
    """Chosen (source_type, source_id, tokens, truncated, content) in the order of choice.

    Required candidates come first and may be cut; then one with structural evidence,
    cut to what its category leaves; then whole ones by value a token within their
    category's share; then whole ones regardless of shares. Code that another chosen
    piece of the same path contains, or that contains one, is passed over.
    """
    caps = {c: math.floor(token_budget * getattr(shares, c)) for c in CATEGORIES}
    used = dict.fromkeys(CATEGORIES, 0)
    out: list[tuple] = []
    chosen: set = set()
    texts: dict[str, list[str]] = {}
    total = 0
    size = {id(r): len(r.content.encode()) for r in pool}
    kind = {id(r): category(r.source_type, bool(r.structural_evidence)) for r in pool}

    def redundant(r) -> bool:  # noqa: ANN001
        return r.source_type == "code" and any(r.content in t or t in r.content for t in texts.get(r.path, ()))

    def take(r, room: int, may_cut: bool) -> None:  # noqa: ANN001
        nonlocal total
        content, n = r.content, size[id(r)]
        if n > room:
            if not may_cut or room <= 0:
                return
            content = cut(r.content, room)
            n = len(content.encode())
            if not n:
                return
        out.append((r.source_type, r.source_id, n, n < size[id(r)], content))
        chosen.add((r.source_type, r.source_id))
        used[kind[id(r)]] += n
        total += n
        if r.source_type == "code":
            texts.setdefault(r.path, []).append(content)

    rest = lambda: token_budget - total
    open_ = lambda r: (r.source_type, r.source_id) not in chosen and not redundant(r)
    for r in sorted((r for r in pool if r.required < 255), key=lambda r: (r.required, r.place)):
        if not redundant(r):
            take(r, rest(), True)
    value = lambda r: (r.final + (r.semantic or 0) + (r.lexical or 0)) / max(size[id(r)], 1)
    by_value = sorted(pool, key=lambda r: (-value(r), r.place))
    spare = next((r for r in by_value if r.structural_evidence and open_(r)), None)
    if spare is not None:
        take(spare, min(caps["structural"] - used["structural"], rest()), True)
    for capped in (True, False):
        for r in by_value:
            n = size[id(r)]
            if open_(r) and n <= rest() and not (capped and used[kind[id(r)]] + n > caps[kind[id(r)]]):
                take(r, rest(), False)
    return out


def packets(pool: DataFrame, key: str, token_budget: int, shares: Budget = DEFAULTS.budget, beside: tuple[str, ...] = ()) -> DataFrame:
    """The packet of each request from its bounded, ranked pool: one row an item, with rank, and
    with those columns of the pool that stand ``beside`` it, outside its budget."""
    w = Window.partitionBy(key).orderBy(*candidate_order())
    extra = [f"__beside_{c}" for c in beside]
    rows = pool.select(key, "source_type", "source_id", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("path", F.lit("")).alias("path"), F.col("final"), F.coalesce("semantic", F.lit(0.0)).alias("semantic"), F.coalesce("lexical", F.lit(0.0)).alias("lexical"), "structural_evidence", required().alias("required"), F.row_number().over(w).alias("place"), *[F.col(c).alias(x) for c, x in zip(beside, extra)])
    cols = [key, "rank", "source_type", "source_id", "tokens", "truncated", "content", *beside]
    fixed = rows.columns[: len(rows.columns) - len(extra)]

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []

        def done() -> list[tuple]:
            more = {(r.source_type, r.source_id): x for r, x in held}
            return [(now, i, *item, *more[item[:2]]) for i, item in enumerate(fill([r for r, _ in held], token_budget, shares), 1)]

        for pdf in batches:
            out = []
            more = zip(*[pdf[x] for x in extra]) if extra else repeat(())
            for r, x in zip(pdf[fixed].itertuples(index=False), more):
                k = getattr(r, key)
                if held and k != now:
                    out += done()
                    held = []
                now = k
                held.append((r, x))
            yield pd.DataFrame(out, columns=cols)
        if held:
            yield pd.DataFrame(done(), columns=cols)

    kinds = {f.name: f.dataType.simpleString() for f in pool.schema}
    # the window behind ``place`` has each request in one task already
    ordered = rows.sortWithinPartitions(key, "place")
    return ordered.mapInPandas(assemble, ", ".join([f"{key} {kinds[key]}, rank long, source_type string, source_id {kinds['source_id']}, tokens long, truncated boolean, content string", *[f"{c} {kinds[c]}" for c in beside]]))


def explained(packet: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """Each item's reasons and scores, beside the packet and outside its budget: for packets that
    were made without. ``packets`` puts them beside items without a join."""
    return packet.drop("content").join(pool.select(key, "source_type", "source_id", "reasons", "final", "structural"), [key, "source_type", "source_id"])


def _eligible(hits: DataFrame) -> DataFrame:
    return hits.filter(F.col("lifecycle").isin("active") & F.col("verification").isin("verified_passed", "verified_failed") & F.col("strength").isin("strong", "moderate"))


def _told_once(ok: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Those of eligible hits all of whose events no better one tells."""
    first = members.join(ok.select(key, "experience_id", "rank"), "experience_id").groupBy(key, "event_id").agg(F.min("rank").alias("rank"))
    told = first.groupBy(key, "rank").agg(F.count("*").alias("own"))
    size = members.groupBy("experience_id").agg(F.count("*").alias("events"))
    return ok.join(told, [key, "rank"]).join(size, "experience_id").filter("own = events")


def _within(alone: DataFrame, key: str, room: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return alone.withColumn("tokens", F.octet_length("summary")).withColumn("__sum", F.sum("tokens").over(w)).filter(F.col("__sum") <= room).select(key, "experience_id", "rank", "tokens")


def with_experiences(packet: DataFrame, hits: DataFrame, members: DataFrame, key: str, room: int = 768) -> DataFrame:
    """History that fits behind a packet: active, verified, strong or moderate; no event is
    told twice (the better rank keeps it), and all within ``room`` tokens."""
    return _within(_told_once(_eligible(hits), members, key), key, room)


def history_explained(requests: DataFrame, hits: DataFrame, members: DataFrame, key: str, room: int = 768) -> DataFrame:
    """How the history of each request (``key``, requested, enabled, available) came out:
    candidates, selected, deduplicated, over_budget, and by which code, if any, it is less than
    was asked for: not_requested, disabled, search_unavailable, no_eligible_result, deduplicated
    or budget_exhausted. Hits of requests without a search count for nothing."""
    asked = requests.filter("requested AND enabled AND available").select(key)
    ok = _eligible(hits).join(asked, key, "left_semi")
    alone = _told_once(ok, members, key)
    stages = [(0, ok), (1, alone), (2, _within(alone, key, room))]
    counts = reduce(DataFrame.unionByName, [df.select(key, F.lit(i).alias("stage")) for i, df in stages]).groupBy(key).agg(*[F.count(F.when(F.col("stage") == i, 1)).alias(f"__{i}") for i, _ in stages])
    n = [F.coalesce(F.col(f"__{i}"), F.lit(0)) for i in range(3)]
    code = (
        F.when(~F.col("requested"), "not_requested").when(~F.col("enabled"), "disabled").when(~F.col("available"), "search_unavailable").when(n[0] == 0, "no_eligible_result")
        .when(n[2] > 0, None).when(n[0] > n[1], "deduplicated").otherwise("budget_exhausted")
    )
    return requests.join(counts, key, "left").select(key, n[0].alias("candidates"), n[2].alias("selected"), (n[0] - n[1]).alias("deduplicated"), (n[1] - n[2]).alias("over_budget"), code.alias("degradation"))


def resumed(sessions: DataFrame, tasks: DataFrame, checkpoints: DataFrame, key: str) -> DataFrame:
    """Where each workspace would go on: session, task and checkpoint, and by which rule.

    A session: the latest active one, else the latest ended. A task: the session's latest
    active, its latest incomplete, the workspace's latest active, its latest incomplete. A
    checkpoint: the task's, else the session's without a task, else the workspace's.
    """
    s = sessions.groupBy(key).agg(F.max_by(F.struct("session_id", F.col("ended_at").isNull().alias("active")), F.struct(F.col("ended_at").isNull(), "started_at", "session_id")).alias("s")).select(key, F.col("s.session_id").alias("session_id"), F.when(F.col("s.active"), "latest_active").otherwise("latest_ended").alias("session_rule"))
    open_ = tasks.filter("status <> 'completed'").join(s, key, "left").withColumn("own", F.coalesce(tasks["session_id"] == s["session_id"], F.lit(False))).select(key, "task_id", "own", (F.col("status") == "active").alias("active"), "created_at")
    t = open_.groupBy(key).agg(F.max_by(F.struct("task_id", "own", "active"), F.struct("own", "active", "created_at", "task_id")).alias("t"))
    t = t.select(key, F.col("t.task_id").alias("task_id"), F.concat(F.when(F.col("t.own"), "session_").otherwise("workspace_"), F.when(F.col("t.active"), "active").otherwise("incomplete")).alias("task_rule"))
    both = s.join(t, key, "full")
    c = checkpoints.select(key, "checkpoint_id", F.col("session_id").alias("__s"), F.col("task_id").alias("__t"), F.col("created_at").alias("__at")).join(both, key)
    rank = F.when(F.col("__t") == F.col("task_id"), 2).when(F.col("__t").isNull() & (F.col("__s") == F.col("session_id")), 1).otherwise(0)
    best = c.groupBy(key).agg(F.max_by("checkpoint_id", F.struct(rank, "__at", "checkpoint_id")).alias("checkpoint_id"))
    return both.join(best, key, "left")


def hydrated(packet: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Requested items (with a reason) and whether the packet holds them; those outside are
    allowed only with a reason and are to be audited."""
    inside = packet.select(key, "source_type", "source_id").distinct().withColumn("__in", F.lit(True))
    w = wanted.join(inside, [key, "source_type", "source_id"], "left").withColumn("in_packet", F.coalesce("__in", F.lit(False))).drop("__in")
    has = F.coalesce(F.trim("reason"), F.lit("")) != ""
    return w.withColumn("allowed", F.col("in_packet") | has).withColumn("audit", ~F.col("in_packet") & has)


def preparable(requests: DataFrame, sessions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Whether a context can be prepared for each request (request, workspace_id, session_id,
    task_id, query, token_budget): ``prepared``, or why not. Session and task must be of the
    request's workspace, the task the session's if it has one, and both must be going on."""
    s = sessions.select("session_id", F.col("workspace_id").alias("__sw"), F.col("ended_at").isNotNull().alias("__ended"))
    t = tasks.select("task_id", F.col("workspace_id").alias("__tw"), F.col("session_id").alias("__ts"), "status")
    r = requests.join(s, "session_id", "left").join(t, "task_id", "left")
    ours = (F.col("__sw") == F.col("workspace_id")) & (F.col("__tw") == F.col("workspace_id")) & (F.col("__ts").isNull() | (F.col("__ts") == F.col("session_id")))
    outcome = (
        F.when(F.trim(F.coalesce("query", F.lit(""))) == "", "empty_query").when(F.coalesce("token_budget", F.lit(0)) <= 0, "no_budget").when(F.col("__sw").isNull(), "session_not_found").when(F.col("__tw").isNull(), "task_not_found")
        .when(~ours, "provenance_mismatch").when(F.col("__ended"), "session_ended").when(F.col("status") != "active", "task_not_active").otherwise("prepared")
    )
    return r.select("request", outcome.alias("outcome"))
