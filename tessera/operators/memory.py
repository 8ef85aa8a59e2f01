"""Memories: consolidation analysis, supersession, trust, and the working set."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.config import DEFAULTS, WorkingSet
from tessera.functions.columns import decayed, terms
from tessera.operators.graph import chain_roots


def token_overlap(memories: DataFrame, scope: str, key: str = "memory_id", text: str = "content", least: float = 0.0) -> DataFrame:
    """(older, newer, ratio) of the pairs of a scope with a common token and a ratio of
    ``least`` or more: common tokens, with multiplicity, over the smaller number of tokens.

    With a ``least`` only few pairs meet: the smaller text of such a pair has one of its
    rarest tokens, all but ``least`` of them, in common with the other. So each text brings
    these to the join, the other all of its own, and words that are in most texts rarely
    bring two together. Without it pairs meet on every token.
    """
    t = memories.select(scope, key, "created_at", F.explode(terms(text)).alias("term"))
    tf = t.groupBy(scope, key, "created_at", "term").agg(F.count("*").alias("tf"))
    size = tf.groupBy(key).agg(F.sum("tf").alias("n"))
    side = lambda df, k, i: df.select(scope, "term", F.col(key).alias(k), F.col("created_at").alias(f"t{i}"), F.col("tf").alias(f"f{i}"))
    before = (F.col("t1") < F.col("t2")) | ((F.col("t1") == F.col("t2")) & (F.col("older") < F.col("newer")))
    a, b = side(tf, "older", 1), side(tf, "newer", 2)
    if least > 0:
        df = tf.groupBy(scope, "term").agg(F.count("*").alias("df"))
        sized = tf.join(df, [scope, "term"]).join(size, key)
        # tokens up to and with this term, rarest first; the term is needed if those before
        # it leave more than ``least`` of the text behind them
        w = Window.partitionBy(key).orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
        rare = sized.withColumn("__before", F.coalesce(F.sum("tf").over(w), F.lit(0))).filter(F.col("n") - F.col("__before") >= F.ceil(F.col("n") * least - 1e-9))
        one = rare.select(scope, "term", F.col(key).alias("x"), F.col("n").alias("nx"))
        other = tf.join(size, key).select(scope, "term", F.col(key).alias("y"), F.col("n").alias("ny"))
        met = one.join(other, [scope, "term"]).filter("x <> y AND nx <= ny").select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q")).distinct()
        words = tf.groupBy(key, "created_at").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("words"))
        end = lambda k, i: words.select(F.col(key).alias(k), F.col("words").alias(f"w{i}"), F.col("created_at").alias(f"u{i}"))
        both = met.join(end("p", 1), "p").join(end("q", 2), "q")
        first = (F.col("u1") < F.col("u2")) | ((F.col("u1") == F.col("u2")) & (F.col("p") < F.col("q")))
        common = F.aggregate(F.map_entries("w1"), F.lit(0).cast("long"), lambda s, e: s + F.least(e["value"], F.coalesce(F.col("w2")[e["key"]], F.lit(0))))
        common = both.select(F.when(first, F.col("p")).otherwise(F.col("q")).alias("older"), F.when(first, F.col("q")).otherwise(F.col("p")).alias("newer"), common.alias("common"))
    else:
        common = a.join(b, [scope, "term"]).filter(before).groupBy("older", "newer").agg(F.sum(F.least("f1", "f2")).alias("common"))
    n = lambda k, name: size.select(F.col(key).alias(k), F.col("n").alias(name))
    found = common.join(n("older", "n1"), "older").join(n("newer", "n2"), "newer").select("older", "newer", (F.col("common") / F.least("n1", "n2")).alias("ratio"))
    return found.filter(F.col("ratio") >= least - 1e-12) if least > 0 else found


def proposals(overlap: DataFrame, sources: DataFrame, trust: DataFrame) -> DataFrame:
    """Likely duplicates: tokens from 0.8, or sources from 0.8 with tokens from 0.5. A
    supersession is proposed only where both are trusted."""
    t = lambda k: trust.select(F.col("memory_id").alias(k), (F.col("trust") == "trusted").alias(f"{k}_ok"))
    joined = overlap.join(sources, ["older", "newer"], "left").join(t("older"), "older", "left").join(t("newer"), "newer", "left")
    dup = (F.col("ratio") >= 0.8) | ((F.coalesce("source_ratio", F.lit(0.0)) >= 0.8) & (F.col("ratio") >= 0.5))
    return joined.filter(dup).select("older", "newer", "ratio", (F.coalesce("older_ok", F.lit(False)) & F.coalesce("newer_ok", F.lit(False))).alias("supersede"))


def contradictions(claims: DataFrame) -> DataFrame:
    """Claims (claim_key, memory_id, claim_value) with different values, per key: the values
    and their memories, without listing pairs."""
    by_value = claims.groupBy("claim_key", "claim_value").agg(F.count("*").alias("n"), F.min("memory_id").alias("first_id"))
    return by_value.groupBy("claim_key").agg(F.count("*").alias("values"), F.sum("n").alias("memories"), (F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("__x2")).filter("values > 1").select("claim_key", "values", "memories", (F.col("__x2") / 2).cast("long").alias("pairs"))


def flagged(memories: DataFrame, supersession: DataFrame) -> DataFrame:
    """Memories with ``is_superseded``."""
    s = supersession.select(F.col("superseded").alias("memory_id")).distinct().withColumn("__s", F.lit(True))
    return memories.join(s, "memory_id", "left").withColumn("is_superseded", F.col("__s").isNotNull()).drop("__s")


def supersede(links: DataFrame, memories: DataFrame, old: object, new: object) -> DataFrame:
    """``links`` with one more; raises unless both memories are trusted and no circle closes."""
    pair = memories.filter(F.col("memory_id").isin(old, new) & (F.col("trust") == "trusted"))
    if old == new or pair.count() != 2:
        raise ValueError("supersession needs two trusted memories")
    more = links.unionByName(memories.sparkSession.createDataFrame([(old, new)], links.schema))
    if not chain_roots(more, "superseded", "superseding").filter("cyclic").isEmpty():
        raise ValueError("supersession must not be circular")
    return more


def reviewed(memories: DataFrame, reviews: DataFrame) -> DataFrame:
    """Trust after reviews (memory_id, previous, trust, seq): only imported memories, and
    only a review whose ``previous`` is what the memory has then; in order of seq. Only
    memories with reviews are grouped."""
    kinds = memories.select("memory_id", "trust", "origin")
    steps = reviews.filter("seq IS NOT NULL").groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("seq", "previous", F.col("trust").alias("then")))).alias("steps"))

    def step(now: Column, r: Column) -> Column:
        changed = F.struct(r["then"].alias("trust"), (now["reviews"] + 1).alias("reviews"))
        return F.when(r["previous"] == now["trust"], changed).otherwise(now)

    begin = F.struct(F.col("trust").alias("trust"), F.lit(0).cast("long").alias("reviews"))
    end = F.when((F.col("origin") == "imported") & F.col("steps").isNotNull(), F.aggregate("steps", begin, step)).otherwise(begin)
    return kinds.join(steps, "memory_id", "left").select("memory_id", end.alias("end")).select("memory_id", "end.trust", "end.reviews")


KINDS = ("fact", "decision", "preference", "summary", "note", "user", "assistant", "system", "tool")


def recorded(records: DataFrame, sessions: DataFrame, most_bytes: int = 1 << 16) -> DataFrame:
    """``records`` to be stored with what becomes of each: recorded, invalid (no content, too
    much of it, or an unknown kind), or unknown_session."""
    known = sessions.select("session_id").distinct().withColumn("__known", F.lit(True))
    ok = (F.trim(F.coalesce("content", F.lit(""))) != "") & (F.octet_length("content") <= most_bytes) & F.col("kind").isin(*KINDS)
    result = F.when(~F.coalesce(ok, F.lit(False)), "invalid").when(F.col("session_id").isNotNull() & F.col("__known").isNull(), "unknown_session").otherwise("recorded")
    return records.join(known, "session_id", "left").withColumn("result", result).drop("__known")


def checkpoints_created(checkpoints: DataFrame, decisions: DataFrame, memories: DataFrame) -> DataFrame:
    """``checkpoints`` with ``result``: created, or missing_decision where one of its
    ``decisions`` (checkpoint_id, memory_id) is no trusted decision memory."""
    good = memories.filter((F.col("kind") == "decision") & (F.col("trust") == "trusted")).select("memory_id").distinct()
    bad = decisions.join(good, "memory_id", "left_anti").select("checkpoint_id").distinct().withColumn("__bad", F.lit(True))
    return checkpoints.join(bad, "checkpoint_id", "left").withColumn("result", F.when(F.col("__bad"), "missing_decision").otherwise("created")).drop("__bad")


def latest_checkpoint(checkpoints: DataFrame, *scope: str) -> DataFrame:
    """The latest checkpoint of each workspace, session or task, as ``scope`` names them."""
    known = checkpoints.filter(" AND ".join(f"{c} IS NOT NULL" for c in scope))
    return known.groupBy(*scope).agg(F.max_by("checkpoint_id", F.struct("created_at", "checkpoint_id")).alias("checkpoint_id"))


# --- the working set --------------------------------------------------------------------


def activate(activations: DataFrame, w: WorkingSet = DEFAULTS.working_set) -> DataFrame:
    """Score of each (session_id, source_id) after its activations in order of time.

    A fold, as every step decays and caps the score of the one before; it runs in
    constant memory for each key, over batches that are sorted by key.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, score, last = None, 0.0, 0.0
        for pdf in batches:
            out = []
            for s, k, t in zip(pdf["session_id"], pdf["source_id"], pdf["t"], strict=True):
                if (s, k) != now:
                    if now is not None:
                        out.append((*now, score, last))
                    now, score = (s, k), 0.0
                else:
                    score *= 0.5 ** (max(t - last, 0) / 60 / w.half_life_minutes)
                score, last = min(w.most, score + w.increment), t
            yield pd.DataFrame(out, columns=["session_id", "source_id", "score", "t"])
        if now is not None:
            yield pd.DataFrame([(*now, score, last)], columns=["session_id", "source_id", "score", "t"])

    rows = activations.select("session_id", "source_id", (F.unix_micros("created_at") / 1e6).alias("t"), "event_id")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    ordered = rows.repartition("session_id", "source_id").sortWithinPartitions("session_id", "source_id", "t", "event_id").drop("event_id")
    out = ordered.mapInPandas(fold, f"session_id {kinds['session_id']}, source_id {kinds['source_id']}, score double, t double")
    return out.select("session_id", "source_id", "score", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("last_at"))


def working_set(entries: DataFrame, now: Column, pins: DataFrame | None = None, w: WorkingSet = DEFAULTS.working_set) -> DataFrame:
    """Decayed entries of each session without those under ``least`` that aren't pinned;
    pinned first, then by score, time and id, at most ``items`` each."""
    pinned = F.lit(False)
    if pins is not None:
        entries = entries.join(pins.select("session_id", "source_id").distinct().withColumn("__pin", F.lit(True)), ["session_id", "source_id"], "left")
        pinned = F.coalesce("__pin", F.lit(False))
    minutes = (F.unix_micros(now) - F.unix_micros("last_at")) / 6e7
    live = entries.withColumn("pinned", pinned).withColumn("current", decayed("score", minutes, w.half_life_minutes)).filter(F.col("pinned") | (F.col("current") >= w.least))
    order = Window.partitionBy("session_id").orderBy(F.desc("pinned"), F.desc("current"), F.desc("last_at"), "source_id")
    return live.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= w.items).select("session_id", "source_id", "pinned", "current", "rank")


def pin(pins: DataFrame, session_id: object, source_id: object, most: int = 64) -> DataFrame:
    """``pins`` with one more (the same again changes nothing); raises over ``most``."""
    more = pins.unionByName(pins.sparkSession.createDataFrame([(session_id, source_id)], pins.select("session_id", "source_id").schema)).distinct()
    if more.filter(F.col("session_id") == F.lit(session_id)).count() > most:
        raise ValueError("too many pins")
    return more


def unpin(pins: DataFrame, session_id: object, source_id: object) -> DataFrame:
    return pins.filter(~((F.col("session_id") == F.lit(session_id)) & (F.col("source_id") == F.lit(source_id))))


def checkpoint_allowed(decisions: list, memories: DataFrame) -> bool:
    """Whether all decisions are trusted memories of that kind."""
    ok = memories.filter(F.col("memory_id").isin(*decisions) & (F.col("kind") == "decision") & (F.col("trust") == "trusted"))
    return ok.select("memory_id").distinct().count() == len(set(decisions))
