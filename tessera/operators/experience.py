"""Episodes and the verified history that is distilled from them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.columns import packed, unpacked

ARM, MOST_EVENTS = 200, 100
#: Lifecycles by weight: the heaviest assessment decides, and confirmation has none.
LIFECYCLES = ("active", "disputed", "refuted", "superseded")
FOLDED = "episode_id {}, result string, outcome string, verification string, strength string, attempts long, supporting long, reviews string"


def consolidated(events: DataFrame) -> DataFrame:
    """One row an episode: what its ordered events establish, or why nothing.

    Columns: episode_id, ordinal, kind (change, verification, other), passed, scope,
    failure (identity of the failure), subject, accepted (by a user), source_change,
    closed. The order of events decides, so each episode is folded in sequence: rows are
    sorted by key in their partition and read once, in constant memory besides one
    episode, which has ``MOST_EVENTS`` at most.
    """
    names = ["episode_id", "ordinal", "kind", "passed", "scope", "failure", "subject", "accepted", "source_change", "closed"]
    key = events.schema["episode_id"].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["episode_id", "result", "outcome", "verification", "strength", "attempts", "supporting", "reviews"]
        now, rows = None, []
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if now is not None and r.episode_id != now:
                    out.append((now, *interpret(rows)))
                    rows = []
                now = r.episode_id
                rows.append(r)
            yield pd.DataFrame(out, columns=cols)
        if now is not None:
            yield pd.DataFrame([(now, *interpret(rows))], columns=cols)

    ordered = events.select(*names).repartition("episode_id").sortWithinPartitions("episode_id", "ordinal")
    return ordered.mapInPandas(fold, FOLDED.format(key))


def interpret(rows: list) -> tuple:
    """(result, outcome, verification, strength, attempts, supporting, reviews) of an episode."""

    def none(code: str) -> tuple:
        return (code, None, None, None, 0, 0, None)

    if len(rows) > MOST_EVENTS:
        return none("evidence_limit_exceeded")
    initial, supporting, pending, attempts, snapshot = None, 0, 0, [], False
    for r in rows:
        if r.kind == "change":
            if initial is not None:
                pending, snapshot = pending + 1, snapshot or bool(r.source_change)
        elif r.kind == "verification":
            if initial is None:
                if not r.passed:
                    if r.failure is None:
                        return none("unsupported_initial_failure")
                    initial = r
            elif not pending and not attempts:
                if r.passed or r.scope != initial.scope or r.failure != initial.failure:
                    return none("ambiguous_pre_attempt_result")
                supporting += 1
            elif pending:
                if r.scope != initial.scope:
                    return none("following_verification_scope_mismatch")
                attempts.append([r])
                pending = 0
            else:
                attempts[-1].append(r)
    if initial is None:
        return none("no_supported_failure")
    closed = bool(rows[0].closed)
    if pending:
        if closed:
            return none("pending_attempt_has_no_verification")
        attempts.append([])
    if not attempts:
        return none("no_attempt_evidence")
    reviews = ["historical_snapshot_unavailable"] * snapshot
    if not closed:
        return ("proposal", "abandoned", "missing", "weak", len(attempts), supporting, ",".join([*reviews, "abandoned_episode"]))
    facts = attempts[-1]
    if not any(f.scope == initial.scope for f in facts):
        return none("initial_scope_not_covered")
    sides: dict = {}
    for f in facts:
        sides.setdefault(f.subject, set()).add(bool(f.passed))
    if any(len(s) > 1 for s in sides.values()):
        return none("conflicting_terminal_results")
    seen = {x for s in sides.values() for x in s}
    by_user = [bool(f.accepted) for f in facts]
    if seen == {True}:
        outcome, verified = "success", "explicitly_accepted" if all(by_user) else "verified_passed"
    else:
        outcome, verified = ("failure", "verified_failed") if seen == {False} else ("partial_success", "conflicting")
    times: dict = {}
    for f in facts:
        times[bool(f.passed), f.scope] = times.get((bool(f.passed), f.scope), 0) + 1
    repeated = not any(by_user) and min(times.values()) >= 2
    reviews += ["unauthenticated_user_acceptance"] * any(by_user)
    return ("proposal", outcome, verified, "strong" if repeated else "moderate", len(attempts), supporting, ",".join(reviews))


def lifecycle(experiences: DataFrame, assessments: DataFrame) -> DataFrame:
    """``experiences`` with their lifecycle: superseded > refuted > disputed > active."""
    weight = reduce(lambda rest, i: F.when(F.col("assessment") == LIFECYCLES[i], i).otherwise(rest), range(1, len(LIFECYCLES)), F.lit(0))
    worst = assessments.groupBy("experience_id").agg(F.max(weight).alias("__w"))
    name = reduce(lambda rest, i: F.when(F.col("__w") == i, LIFECYCLES[i]).otherwise(rest), range(1, len(LIFECYCLES)), F.lit("active"))
    return experiences.join(worst, "experience_id", "left").withColumn("lifecycle", name).drop("__w")


def search(experiences: DataFrame, limit: int, failure_key: str | None = None, components: dict[str, str] | None = None, text: Column | None = None, path: str | None = None, graph_key: str | None = None, outcomes: tuple = (), strengths: tuple = (), lifecycles: tuple = ("active",), created_after: object = None, created_before: object = None) -> DataFrame:
    """Ranked history: experience_id, exact, matched, total.

    Every selector is an arm of its newest ``ARM`` candidates; without any selector the
    newest rows are the arm. Selectors also filter: a path by signature or snapshots, a
    graph key by snapshots, components all of them. ``text`` is a condition on the rows.
    """
    wanted = components or {}
    hit = {k: F.col("components")[k] == v for k, v in wanted.items()}
    matched = sum((F.when(c, 1).otherwise(0) for c in hit.values()), F.lit(0))
    flags = {
        "exact": F.col("failure_key") == failure_key if failure_key else None, "component": matched > 0 if wanted else None, "lexical": text,
        "path": (F.col("path") == path) | F.array_contains("snapshot_paths", path) if path else None, "graph": F.array_contains("snapshot_nodes", graph_key) if graph_key else None,
    }
    given = {k: F.coalesce(c, F.lit(False)) for k, c in flags.items() if c is not None}
    rows = experiences.withColumn("matched", matched)
    rows = rows.select("*", *[given.get(k, F.lit(False)).alias(f"is_{k}") for k in flags])
    newest = [F.desc("created_at"), F.desc("experience_id")]
    arms = [rows.filter(F.col(f"is_{k}")).orderBy(*newest).limit(ARM) for k in given] or [rows.orderBy(*newest).limit(ARM)]
    ids = reduce(DataFrame.union, [a.select("experience_id") for a in arms]).distinct()
    in_arm = {k: a.select("experience_id").withColumn(f"__{k}", F.lit(True)) for k, a in zip(given, arms, strict=False)}
    found = rows.join(F.broadcast(ids), "experience_id", "left_semi")  # at most six arms of ARM rows
    for k, a in in_arm.items():
        found = found.join(F.broadcast(a), "experience_id", "left").withColumn(f"is_{k}", F.coalesce(f"__{k}", F.lit(False))).drop(f"__{k}")
    keep = F.lit(True)
    for col, values in (("outcome", outcomes), ("strength", strengths), ("lifecycle", lifecycles)):
        if values:
            keep = keep & F.col(col).isin(*values)
    for c in ("path", "graph"):
        if c in given:
            keep = keep & F.col(f"is_{c}")
    if wanted:
        keep = keep & (F.col("matched") == len(wanted))
    if created_after is not None:
        keep = keep & (F.col("created_at") >= F.lit(created_after))
    if created_before is not None:
        keep = keep & (F.col("created_at") <= F.lit(created_before))
    one = lambda c, w: F.when(F.col(c), w).otherwise(0)
    total = one("is_exact", 1000) + F.least("matched", F.lit(16)) * 20 + one("is_lexical", 40) + one("is_path", 60) + one("is_graph", 60)
    rank = lambda c, values: reduce(lambda rest, kv: F.when(F.col(c) == kv[0], kv[1]).otherwise(rest), values.items(), F.lit(0))
    authority = F.struct(rank("verification", {"verified_passed": 2, "verified_failed": 1}), rank("strength", {"strong": 2, "moderate": 1}), rank("outcome", {"success": 3, "partial_success": 2, "failure": 1}))
    scored = found.filter(keep).withColumn("total", total).withColumn("__authority", authority)
    return scored.orderBy(F.desc("is_exact"), F.desc("matched"), F.desc("__authority"), F.desc("total"), "experience_id").limit(limit).select("experience_id", F.col("is_exact").alias("exact"), F.col("matched").cast("long").alias("matched"), F.col("total").cast("long").alias("total"))


def references(snapshots: DataFrame, documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """How what a snapshot saw stands now: unchanged, changed, or missing."""
    d = documents.select(F.col("path"), F.col("content_hash").alias("__hash"), F.col("revision").alias("__revision"))
    n = nodes.select(F.col("stable_key"), F.lit(True).alias("__node"))
    s = snapshots.join(d, "path", "left").join(n, "stable_key", "left")
    doc = F.when(F.col("__hash").isNull(), "missing").when((F.col("__hash") == F.col("content_hash")) & (F.col("__revision") == F.col("revision")), "current").when(F.col("__hash") == F.col("content_hash"), "same_content").otherwise("changed")
    return s.select("experience_id", "path", doc.alias("document_status"), F.when(F.col("__node"), "current").otherwise("missing").alias("node_status"))


def disputes(experiences: DataFrame, recurring: DataFrame, ingress: DataFrame) -> DataFrame:
    """Experiences to dispute: all recurring events are known and came after acceptance.

    An unknown acceptance order never proposes anything.
    """
    r = recurring.join(ingress, "event_id", "left").join(experiences.select("experience_id", "accepted_seq"), "experience_id")
    judged = r.groupBy("experience_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("seq") > F.col("accepted_seq"), 1)).alias("later"), F.first("accepted_seq").alias("accepted_seq"))
    return judged.filter(F.col("accepted_seq").isNotNull() & (F.col("n") == F.col("later"))).select("experience_id", F.col("n").alias("events"))


def violations(experiences: DataFrame) -> DataFrame:
    """(experience_id, rule) of every rule that a record breaks."""
    hexed = lambda c: ~F.rlike(F.coalesce(F.col(c), F.lit("")), F.lit("^[0-9a-f]{64}$"))
    rules = {
        "outcome": ~F.col("outcome").isin("success", "failure", "partial_success", "inconclusive", "abandoned"), "strength": ~F.col("strength").isin("strong", "moderate", "weak", "unsupported"),
        "summary": (F.trim("summary") == "") | (F.length("summary") > 4096), "fingerprint": hexed("fingerprint"), "proposal_hash": hexed("proposal_hash"), "attempts": F.col("attempts") < 1,
        "success_verified": (F.col("outcome") == "success") & ~F.col("verification").isin("verified_passed", "explicitly_accepted"), "failure_verified": (F.col("outcome") == "failure") & (F.col("verification") != "verified_failed"),
        "abandoned_weak": (F.col("outcome") == "abandoned") & (F.col("strength") != "weak"),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), n) for n, c in rules.items()]), lambda x: x.isNotNull())
    return experiences.select("experience_id", F.explode(broken).alias("rule"))


ASSESSMENTS = ("confirmed", "disputed", "refuted", "superseded")


def assessed(requests: DataFrame, experiences: DataFrame, receipts: DataFrame) -> DataFrame:
    """``requests`` for assessments (request_key, experience_id, kind, replacement_id, reason,
    seq) with what becomes of each: applied, replayed, conflict (another content under the
    same key), invalid, or not_found.

    A supersession, and nothing else, names its replacement: another experience that exists.
    """
    from tessera.sources.sinks import delivered

    known = experiences.select("experience_id").distinct()
    has = known.withColumn("__has", F.lit(True))
    there = known.select(F.col("experience_id").alias("replacement_id")).withColumn("__there", F.lit(True))
    content = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("experience_id", "kind", "replacement_id", "reason")]), 256)
    r = delivered(requests.withColumn("content", content), receipts, ["request_key"], "content").join(has, "experience_id", "left").join(there, "replacement_id", "left")
    superseded = F.col("kind") == "superseded"
    valid = F.col("kind").isin(*ASSESSMENTS) & (F.trim(F.coalesce("reason", F.lit(""))) != "") & (superseded == F.col("replacement_id").isNotNull()) & ~F.col("replacement_id").eqNullSafe(F.col("experience_id"))
    missing = F.col("__has").isNull() | (F.col("replacement_id").isNotNull() & F.col("__there").isNull())
    result = F.when(F.col("result") != "new", F.col("result")).when(~F.coalesce(valid, F.lit(False)), "invalid").when(missing, "not_found").otherwise("applied")
    return r.withColumn("result", result).drop("__has", "__there", "content")


# --- acceptance -------------------------------------------------------------------------


def fingerprinted(events: DataFrame, most: int = MOST_EVENTS) -> DataFrame:
    """(episode_id, fingerprint, events) of what an episode's ordered events say, by which a
    later commit can tell that nothing has changed. Over ``most`` events there is none."""
    # rows beyond the first ones past the limit tell nothing more, so that no episode is gathered whole
    near = events.filter(F.col("ordinal") <= most)
    said = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(events.columns) if c != "episode_id"]), 256)
    one = near.groupBy("episode_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", said.alias("said")))), lambda x: x["said"]), "|"), 256).alias("fingerprint"))
    many = events.groupBy("episode_id").agg(F.count("*").alias("events"))
    return many.join(one, "episode_id", "left").select("episode_id", F.when(F.col("events") <= most, F.col("fingerprint")).alias("fingerprint"), "events")


def proposed(folded: DataFrame, fingerprints: DataFrame, episodes: DataFrame) -> DataFrame:
    """What acceptance compares, a row an episode: version and status of ``episodes``, the
    result of its fold, the fingerprint of its input, and a hash of the material proposal.
    Whatever asks for a review isn't taken automatically."""
    material = ("outcome", "verification", "strength", "attempts", "supporting")
    said = F.sha2(F.concat_ws("|", "fingerprint", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in material]), 256)
    r = episodes.select("episode_id", "version", "status").join(folded, "episode_id", "left").join(fingerprints.select("episode_id", "fingerprint"), "episode_id", "left")
    return r.withColumn("proposal_hash", said).withColumn("result", F.coalesce("result", F.lit("episode_empty"))).withColumn("automatic", F.coalesce("reviews", F.lit("")) == "")


def acceptances(requests: DataFrame, proposals: DataFrame, records: DataFrame) -> DataFrame:
    """What becomes of each request (seq, episode_id, expected_version, expected_fingerprint,
    expected_proposal_hash), in order of seq: accepted, by which a record comes about; replayed,
    if the very proposal is one already; or why not.

    ``records`` (episode_id, experience_id, fingerprint, proposal_hash) are those that exist: an
    episode has one. Of a batch the first request that could be accepted makes it, so requests
    of an episode need no fold: those before it fail for their own reason, those behind it meet
    the record. ``made`` is true in one row of each record that comes about.

    Each side moves once, by episode, with its hashes packed; requests of an episode meet in one task.
    """
    have = records.select("episode_id", F.col("experience_id").alias("__id"), packed("fingerprint").alias("__fp"), packed("proposal_hash").alias("__hash"))
    asked = requests.select("seq", "episode_id", "expected_version", *[packed(c).alias(c) for c in ("expected_fingerprint", "expected_proposal_hash")])
    said = proposals.select("episode_id", "version", "status", "result", "automatic", *[packed(c).alias(c) for c in ("fingerprint", "proposal_hash")])
    r = asked.join(said, "episode_id", "left").join(have, "episode_id", "left")
    asks = lambda fp, h: F.col("expected_fingerprint").eqNullSafe(F.col(fp)) & F.col("expected_proposal_hash").eqNullSafe(F.col(h))
    own = (
        F.when(F.col("status").isNull(), "episode_not_found").when(~F.col("expected_version").eqNullSafe(F.col("version")), "stale_episode_version").when(~F.col("status").isin("closed", "abandoned"), "episode_not_closed")
        .when(F.col("result") != "proposal", F.col("result")).when(~F.col("automatic"), "review_required").when(~F.col("expected_fingerprint").eqNullSafe(F.col("fingerprint")), "fingerprint_mismatch")
        .when(~F.col("expected_proposal_hash").eqNullSafe(F.col("proposal_hash")), "proposal_hash_mismatch").otherwise("accepted")
    )
    met = lambda fp, h: F.when(asks(fp, h), "replayed").otherwise("already_consolidated")
    can = (F.col("own") == "accepted") & F.col("__id").isNull()
    w = Window.partitionBy("episode_id").orderBy(F.when(can, 0).otherwise(1), F.asc_nulls_last("seq"))
    first = F.struct(F.when(can, F.col("seq")).alias("seq"))  # of the rows in order the first, null or not
    r = r.withColumn("own", own).withColumn("__first", F.first(first).over(w)["seq"]).withColumn("made", can & (F.row_number().over(w) == 1))
    outcome = F.when(F.col("__id").isNotNull(), met("__fp", "__hash")).when(F.col("__first").isNull() | (F.col("seq") <= F.col("__first")), F.col("own")).otherwise(met("fingerprint", "proposal_hash"))
    fresh = F.left(F.sha2(F.concat_ws("|", F.col("episode_id").cast("string"), unpacked("fingerprint")), 256), F.lit(32))
    known = F.when(F.col("outcome").isin("accepted", "replayed"), F.coalesce("__id", fresh))
    return r.withColumn("outcome", outcome).withColumn("experience_id", known).select("seq", "episode_id", "outcome", "experience_id", *[unpacked(c).alias(c) for c in ("fingerprint", "proposal_hash")], "made")


# --- episodes ---------------------------------------------------------------------------


def mutated(episodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Episodes after requests (request_key, episode_id, action, expected_version,
    event_ids, seq), each with its outcome: applied, replayed, conflict, or invalid.

    A request applies only to the version that it expects, closed episodes take none, an
    event joins once, and the same key with the same content is answered again. Requests
    of an episode depend on each other, so each episode is folded in order, one row after
    the other over whole Arrow batches.
    """

    asked = ["request_key", "action", "expected_version", "event_ids", "seq"]
    kind = episodes.schema["episode_id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, version, status, members, seen = None, 0, "", set(), {}
        for batch in batches:
            out = []
            for episode, asks, first, state, request, action, expected, events in zip(*(batch.column(c).to_pylist() for c in ("episode_id", "asks", "version", "status", *asked[:4])), strict=True):
                if not asks:
                    if episode != now:  # of several rows of an episode the first counts
                        now, version, status, members, seen, n = episode, first, state, set(), {}, 0
                    continue
                if episode != now:  # there is no such episode
                    continue
                content = (action, expected, tuple(events or ()))
                if request in seen:
                    out.append((episode, request, "replayed" if seen[request] == content else "conflict", version, status, n))
                    continue
                new = [e for e in content[2] if e not in members]
                if expected != version or status != "open":
                    result = "conflict"
                elif action == "add" and (len(new) != len(content[2]) or n + len(new) > MOST_EVENTS):
                    result = "invalid"
                else:
                    result, version = "applied", version + 1
                    if action == "add":
                        members, n = members.union(new), n + len(new)
                    status = {"close": "closed", "abandon": "abandoned"}.get(action, status)
                    seen[request] = content
                out.append((episode, request, result, version, status, n))
            kinds = {"episode_id": batch.schema.field("episode_id").type, "request_key": pa.string(), "result": pa.string(), "version": pa.int64(), "status": pa.string(), "members": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    every = episodes.select("episode_id", F.lit(False).alias("asks"), "version", "status").unionByName(requests.filter("request_key IS NOT NULL").select("episode_id", F.lit(True).alias("asks"), *asked), allowMissingColumns=True)
    # by a hash: a repartition by the column itself is dropped where both parts are dealt by it, though their partitions are merged apart
    ordered = every.filter("episode_id IS NOT NULL").repartition(F.xxhash64("episode_id")).sortWithinPartitions("episode_id", "asks", "seq")
    return ordered.mapInArrow(fold, f"episode_id {kind}, request_key string, result string, version long, status string, members long")
