"""Sinks: snapshots, appends in ingress order, idempotent delivery, deregistration.

Snapshots are revisions of a store (``sources.store``): readers follow one manifest, so they
see one snapshot throughout, and a publication states which revision it started from.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.storage import folders, kept
from tessera.sources import store


def manifest(spark: SparkSession, folder: str) -> dict:
    """The current state; revision 0 for a new store."""
    return store.state(spark, folder)


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame], expected: int) -> dict:
    """Writes ``tables`` whole as the next revision; the other tables stay. Raises if the
    current revision is not ``expected``, before writing, or if another writer publishes that
    revision first."""
    return store.commit(spark, folder, expected, tables)[0]


def read(spark: SparkSession, state: dict, name: str) -> DataFrame:
    return store.read(spark, state, name)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], drop: DataFrame | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same keys, and without the
    keys in ``drop``. Of rows of ``new`` with equal keys the greatest by the other columns counts."""
    others = [c for c in new.columns if c not in keys]
    new = new.groupBy(*keys).agg(F.max(F.struct(*others)).alias("__row")).select(*keys, "__row.*").select(*new.columns) if others else new.distinct()
    rest = old.join(new.select(*keys).distinct(), keys, "left_anti")
    if drop is not None:
        rest = rest.join(drop.select(*keys).distinct(), keys, "left_anti")
    return rest.unionByName(new)


def replaced(old: DataFrame, new: DataFrame, document: str) -> DataFrame:
    """All rows of the documents in ``new`` replaced: a document's projection is whole."""
    return old.join(new.select(document).distinct(), document, "left_anti").unionByName(new)


def sequenced(events: DataFrame, start: int, *order: str) -> DataFrame:
    """``events`` of one append with their ingress order behind ``start``, without gaps.

    Ranges of ``order`` are counted first, so no task sees more than its own range; within a
    range rows are numbered as they are written.
    """
    ranged = events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    ranged = kept(ranged, "append").withColumn("__p", F.shiftright("__id", 33)).withColumn("__i", F.col("__id").bitwiseAND((1 << 33) - 1) + 1)
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = ranged.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__from", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    return ranged.join(F.broadcast(starts), "__p").withColumn("ingress_seq", F.col("__from") + F.col("__i") + start).drop("__p", "__id", "__i", "__n", "__from")


def sealed(spark: SparkSession, folder: str, name: str, key: str, work: Callable[[dict], tuple[DataFrame, dict[str, DataFrame | Callable[[DataFrame], DataFrame]]]], buckets: int = 64) -> dict:
    """Appends headers with their children and the seals that make them count, as one
    transaction over all these tables: ``name``, those of the children, and ``name``_seals.

    ``work`` makes of a state the headers and, by table, the children, or what makes them of the
    headers that are appended; it is asked again if another writer was first, and folders that it
    names go when the append is over. Headers whose key is sealed already are left alone, with their
    children; a child without a header in the append goes nowhere. A seal has the order in
    which its header was accepted, without gaps over all appends. A run that dies at any step
    shows nothing of its own, and ``store.vacuum`` sweeps what it staged.
    """
    seals = f"{name}_seals"

    def changes(state: dict) -> dict[str, store.Change]:
        headers, children = work(state)
        done = store.read(spark, state, seals) if seals in state["tables"] else None
        headers = kept(headers if done is None else headers.join(done.select(key), key, "left_anti"), "sealed", compression="zstd")
        last = 0 if done is None else done.agg(F.max("acceptance_order")).first()[0] or 0
        order = sequenced(headers.select(key).distinct(), last, key).select(key, F.col("ingress_seq").alias("acceptance_order"))
        parts = {child: rows(headers) if callable(rows) else rows.join(headers.select(key).distinct(), key, "left_semi") for child, rows in children.items()}
        # none of these keys is stored, so no bucket need be read or written anew
        return {n: store.Change(rows, append=True) for n, rows in {name: headers, seals: order, **parts}.items()}

    keyed = store.Keyed(key, buckets)
    state = store.state(spark, folder)
    names = [name, seals, *work(state)[1]]
    with folders(spark):
        return store.transact(spark, folder, changes, dict.fromkeys(names, keyed))[0]


def delivered(requests: DataFrame, receipts: DataFrame, keys: list[str], content: str) -> DataFrame:
    """``requests`` with what becomes of each: new, replayed (same content under a known
    key, or earlier in this batch), or conflict (another content under it)."""
    first = Window.partitionBy(*keys).orderBy("seq")
    r = requests.withColumn("__n", F.row_number().over(first)).withColumn("__first", F.first(content).over(first))
    known = receipts.select(*keys, F.col(content).alias("__known"))
    base = F.coalesce("__known", "__first")
    result = F.when(F.col(content) != base, "conflict").when(F.col("__known").isNotNull() | (F.col("__n") > 1), "replayed").otherwise("new")
    return r.join(known, keys, "left").withColumn("result", result).drop("__n", "__first", "__known")


def imported(runs: DataFrame, receipts: DataFrame, known: DataFrame) -> DataFrame:
    """Imports of evidence: unique by request key, and by producer, version and run."""
    d = delivered(runs, receipts, ["request_key"], "digest")
    ids = ["producer", "producer_version", "run_id"]
    seen = known.select(*ids).distinct().withColumn("__seen", F.lit(True))
    return d.join(seen, ids, "left").withColumn("result", F.when((F.col("result") == "new") & F.col("__seen"), "conflict").otherwise(F.col("result"))).drop("__seen")


PLAN_SECONDS = 300


def workspace_counts(tables: dict[str, DataFrame], workspace: str) -> DataFrame:
    """(name, rows): rows of a workspace in each table, all in one job."""
    names = tables.values()
    spark = next(iter(names)).sparkSession
    every = reduce(DataFrame.unionByName, [df.filter(F.col("workspace_id") == workspace).select(F.lit(n).alias("name")) for n, df in sorted(tables.items())])
    return spark.createDataFrame([(n,) for n in sorted(tables)], "name string").join(every.groupBy("name").agg(F.count("*").alias("rows")), "name", "left").select("name", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def deregistration(tables: dict[str, DataFrame], workspace: str, now: float = 0.0) -> dict:
    """What a deregistration would remove: counts, a hash of that state, and until when the
    plan holds."""
    counts = {r["name"]: r["rows"] for r in workspace_counts(tables, workspace).collect()}  # a row a table
    state = hashlib.sha256(json.dumps([workspace, counts], sort_keys=True).encode()).hexdigest()
    return {"workspace": workspace, "counts": counts, "state": state, "expires_at": now + PLAN_SECONDS, "consumed": False}


def stale_reason(plan: dict, tables: dict[str, DataFrame], workspace: str, now: float) -> str | None:
    """Why a plan can't be carried out any more: another workspace's, used, too old, or the
    workspace has changed since; None if it can."""
    if plan["workspace"] != workspace:
        return "workspace_mismatch"
    if plan["consumed"]:
        return "already_consumed"
    if now >= plan["expires_at"]:
        return "expired"
    return None if deregistration(tables, workspace)["state"] == plan["state"] else "state_changed"


# --- deregistration that runs -------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    """How a table's rows belong to a workspace: by a column of their own, or by that of the
    parent's row that ``column`` names in ``parent_column``."""

    column: str = "workspace_id"
    parent: str | None = None
    parent_column: str | None = None


def belonging(spark: SparkSession, at: dict, members: dict[str, Member], workspace: str) -> dict[str, DataFrame]:
    """The rows of a workspace in each table; parents are named before their children."""
    out: dict[str, DataFrame] = {}
    for name, m in members.items():
        rows = store.read(spark, at, name)
        if m.parent is None:
            out[name] = rows.filter(F.col(m.column) == F.lit(workspace))
        else:
            ids = out[m.parent].select(F.col(m.parent_column).alias(m.column)).distinct()
            out[name] = rows.join(ids, m.column, "left_semi")
    return out


def _counts(rows: dict[str, DataFrame]) -> tuple[dict[str, int], str]:
    """Rows of each table, and a hash of them that any change of a row changes."""
    parts = [df.agg(F.count("*").alias("rows"), F.sum(F.pmod(F.xxhash64(*sorted(df.columns)), F.lit(1 << 40))).alias("mark")).withColumn("name", F.lit(n)) for n, df in rows.items()]
    found = sorted((r["name"], r["rows"], r["mark"]) for r in reduce(DataFrame.unionByName, parts).collect())  # a row a table
    return {n: k for n, k, _ in found}, hashlib.sha256(json.dumps(found).encode()).hexdigest()


PLANS = "plan_id string, workspace_id string, counts string, state string, expires_at double, consumed boolean"


def plan_deregistration(spark: SparkSession, folder: str, members: dict[str, Member], workspace: str, now: float) -> str:
    """Stores a plan to remove a workspace, and returns its id."""
    at = store.state(spark, folder)
    counts, mark = _counts(belonging(spark, at, members, workspace))
    plan = hashlib.sha256(f"{workspace}|{mark}|{now}".encode()).hexdigest()[:32]
    row = spark.createDataFrame([(plan, workspace, json.dumps(counts, sort_keys=True), mark, now + PLAN_SECONDS, False)], PLANS)
    store.transact(spark, folder, lambda _: {"deregistrations": store.Change(row)}, {"deregistrations": store.Keyed("plan_id", 1)})
    return plan


def deregister(spark: SparkSession, folder: str, members: dict[str, Member], plan_id: str, workspace: str, now: float) -> str:
    """Carries a plan out, or says why not: unknown_plan, workspace_mismatch, already_consumed,
    expired, state_changed. Rows go from all tables, and the plan is used up, in one
    transaction: a run that dies has removed nothing, and a plan removes once."""
    said = ["unknown_plan"]

    def work(at: dict) -> dict[str, store.Change]:
        plans = store.read(spark, at, "deregistrations").filter(F.col("plan_id") == plan_id).collect() if "deregistrations" in at["tables"] else []
        rows = belonging(spark, at, members, workspace)
        said[0] = "unknown_plan" if not plans else "workspace_mismatch" if plans[0]["workspace_id"] != workspace else "already_consumed" if plans[0]["consumed"] else "expired" if now >= plans[0]["expires_at"] else "done"
        if said[0] == "done" and _counts(rows)[1] != plans[0]["state"]:
            said[0] = "state_changed"
        if said[0] != "done":
            raise _Refused
        used = spark.createDataFrame([tuple(plans[0])[:-1] + (True,)], PLANS)
        changes: dict[str, store.Change | DataFrame] = {"deregistrations": store.Change(used)}
        for name, df in rows.items():
            key = at["tables"][name]["key"]
            columns = df.columns
            # rows of one key may belong to several workspaces, so they are told apart by all columns
            changes[name] = store.read(spark, at, name).exceptAll(df) if key is None else store.Change(row_keys=[key, *[c for c in columns if c != key]], remove=kept(df, "removed"))
        return changes

    try:
        store.transact(spark, folder, work)
    except _Refused:
        pass
    return said[0]


class _Refused(Exception):
    pass


def consistently(spark: SparkSession, folder: str, work: Callable[[dict], object], attempts: int = 3) -> object:
    """``work`` on the current manifest, again if another one was published meanwhile."""
    for _ in range(attempts):
        state = manifest(spark, folder)
        out = work(state)
        if manifest(spark, folder)["revision"] == state["revision"]:
            return out
    raise RuntimeError(f"the store changed {attempts} times while it was read")


def without_workspace(tables: dict[str, DataFrame], workspace: str) -> dict[str, DataFrame]:
    return {n: df.filter(F.col("workspace_id") != workspace) for n, df in tables.items()}
