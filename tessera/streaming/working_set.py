"""Working sets as a stream with state: ``transformWithState`` of a session.

The state of a session is a map from source to (score, time of its last activation), so a
session is one key however many sources it has, and one call a batch. A score halves every
half-life. What has decayed under ``least`` at the time of an activation goes, and so does,
beyond ``items`` entries, the least by score, time and source: a session's state is bounded. A
timer is set for when its last entry will have decayed; until then the session comes again, and
when it fires without the session having come, its state is deleted whole. So idle sessions
leave the store.

Time is that of the activations, by watermark, or that of the clock (``time_mode``). Sessions
meet in one task each, as an activation depends on those before it; between batches they are
dealt over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.config import DEFAULTS, WorkingSet

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUT = "session_id {session}, source_id {source}, score double, t double"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that these streams need, while they start."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    try:
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Activations(StatefulProcessor):
    def __init__(self, w: WorkingSet, source: str, timed: bool) -> None:
        self.w, self.source, self.timed = w, source, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", f"source_id {self.source}", "score double, t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        w = self.w
        entries = {k[0]: (v[0], v[1]) for k, v in self.entries.iterator()}
        before, touched = set(entries), set()
        soonest = min(map(self.gone_at, entries.values()), default=math.inf)
        batch = pd.concat(list(rows)).sort_values(["t", "source_id"], kind="stable")
        for source, t in zip(batch["source_id"].tolist(), batch["t"].tolist(), strict=True):
            score, last = entries.get(source, (0.0, t))
            score *= 0.5 ** (max(t - last, 0) / 60 / w.half_life_minutes)
            entries[source] = (min(w.most, score + w.increment), max(t, last))
            touched.add(source)
            soonest = min(soonest, self.gone_at(entries[source]))
            if t > soonest or len(entries) > w.items:
                self.prune(entries, t)
                soonest = min(map(self.gone_at, entries.values()), default=math.inf)
        for source in before - set(entries):
            self.entries.removeKey((source,))
        kept = sorted(touched & set(entries))
        for source in kept:
            self.entries.updateValue((source,), entries[source])
        if self.timed:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if entries:
                self.handle.registerTimer(math.ceil(1000 * max(map(self.gone_at, entries.values()))))
        if kept:
            yield pd.DataFrame([(key[0], s, *entries[s]) for s in kept], columns=["session_id", "source_id", "score", "t"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.entries.clear()
        return iter(())

    def close(self) -> None:
        pass

    def prune(self, entries: dict, now: float) -> None:
        """Drops what has decayed, and the least beyond the most entries."""
        w = self.w
        live = {k: s * 0.5 ** (max(now - t, 0) / 60 / w.half_life_minutes) for k, (s, t) in entries.items()}
        order = sorted(live, key=lambda k: (-live[k], -entries[k][1], k))
        for i, k in enumerate(order):
            if i >= w.items or live[k] < w.least:
                del entries[k]

    def gone_at(self, entry: tuple[float, float]) -> float:
        """When an entry falls under ``least``."""
        score, t = entry
        return t + 60 * self.w.half_life_minutes * math.log2(max(score / self.w.least, 1.0))


def working_sets(activations: DataFrame, w: WorkingSet = DEFAULTS.working_set, time_mode: str = "none", late: str = "10 minutes") -> DataFrame:
    """(session_id, source_id, score, t) of what each batch of activations (session_id,
    source_id, created_at) touches. ``time_mode``: eventTime, processingTime, or none (timers
    need one of the first two; entries are pruned in any mode). Start it within ``state_store``."""
    kinds = {f.name: f.dataType.simpleString() for f in activations.schema}
    rows = activations.withWatermark("created_at", late) if time_mode == "eventTime" else activations
    rows = rows.select("session_id", "source_id", "created_at", (F.unix_micros("created_at") / 1e6).alias("t"))
    processor = Activations(w, kinds["source_id"], time_mode != "none")
    return rows.groupBy("session_id").transformWithStateInPandas(processor, OUT.format(session=kinds["session_id"], source=kinds["source_id"]), "Update", time_mode)
