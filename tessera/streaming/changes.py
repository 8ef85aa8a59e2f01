"""Change streams: debounced batches, deduplicated delivery, decaying activation.

Every function works on a stream and on a table alike, where its operators do.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DEFAULTS, WorkingSet


def signals(spark: SparkSession, path: str, schema, most_files: int | None = None) -> DataFrame:  # noqa: ANN001
    """Change signals as they arrive; ``most_files`` bounds what one batch takes."""
    reader = spark.readStream.schema(schema)
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    return reader.parquet(path)


def debounced(signals: DataFrame, gap: str, late: str = "10 minutes", *keys: str) -> DataFrame:
    """Batches of signals (path, event_type, ts): a batch closes after ``gap`` of silence,
    and each signal starts the gap anew. Per batch and path the last type counts.

    That is a session window: a signal exactly ``gap`` after the last still joins it.
    """
    marked = signals.withWatermark("ts", late) if signals.isStreaming else signals
    last = F.max_by("event_type", "ts").alias("event_type")
    out = marked.groupBy(F.session_window("ts", gap).alias("batch"), "path", *keys).agg(last, F.count("*").alias("signals"))
    return out.select(*keys, "path", F.col("batch.start").alias("started_at"), F.col("batch.end").alias("closes_at"), "event_type", "signals")


def overflowed(batches: DataFrame, capacity: int = 1024) -> DataFrame:
    """Batches of more signals than the queue holds: these need a full scan instead."""
    return batches.groupBy("started_at").agg(F.sum("signals").alias("signals")).withColumn("rescan", F.col("signals") > capacity)


def routed(signals: DataFrame, documents: DataFrame) -> DataFrame:
    """Signals with what to do: reconcile a known path, or look for an unknown one by a scan."""
    known = documents.select("path").distinct().withColumn("__known", F.lit(True))
    return signals.join(known, "path", "left").withColumn("action", F.when(F.col("__known"), "reconcile").otherwise("rescan")).drop("__known")


def isolated(rows: DataFrame, work, schema: str) -> DataFrame:  # noqa: ANN001
    """``work`` (a function of one row's dict, giving a dict) on each row: its columns, and
    status and error. A row that fails does not stop the others."""
    fields = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[dict[str, Any]] = []
            for row in pdf.to_dict("records"):
                try:
                    out.append({**dict.fromkeys(fields), **work(row), "status": "done", "error": None})
                except Exception as e:  # noqa: BLE001 - the failure is this row's result
                    out.append({**dict.fromkeys(fields), "status": "failed", "error": str(e)[:500]})
            yield pd.DataFrame(out, columns=[*fields, "status", "error"])

    return rows.mapInPandas(run, f"{schema}, status string, error string")


def once(deliveries: DataFrame, *keys: str) -> DataFrame:
    """Each request key's first delivery; state is kept for good, as replays may come late."""
    return deliveries.dropDuplicates(list(keys))


def activation_stream(activations: DataFrame, w: WorkingSet = DEFAULTS.working_set) -> DataFrame:
    """Scores of (session_id, source_id) as activations arrive, decaying between them.

    The state of a key is its score and the time it is of. Rows of a batch are taken in
    the order of their time; one that is older than the state doesn't decay it.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        score, last = state.get if state.exists else (0.0, None)
        for t in pd.concat(list(parts))["t"].sort_values():
            if last is not None:
                score *= 0.5 ** (max(t - last, 0) / 60 / w.half_life_minutes)
            score, last = min(w.most, score + w.increment), t if last is None else max(t, last)
        state.update((float(score), float(last)))
        yield pd.DataFrame({"session_id": [key[0]], "source_id": [key[1]], "score": [score], "t": [last]})

    rows = activations.select("session_id", "source_id", (F.unix_micros("created_at") / 1e6).alias("t"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = f"session_id {kinds['session_id']}, source_id {kinds['source_id']}, score double, t double"
    return rows.groupBy("session_id", "source_id").applyInPandasWithState(step, out, "score double, t double", "update", "NoTimeout")


def run_available(stream: DataFrame, sink, checkpoint: str, mode: str = "append") -> None:  # noqa: ANN001
    """Takes what is there now through ``sink`` (a function of a batch's rows and number)
    and stops. A batch that is tried again has the same number: sinks write by it."""
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def armed(stream: DataFrame, sink, checkpoint: str, scan, mode: str = "append") -> object:  # noqa: ANN001
    """Starts to listen, then scans, then takes what came meanwhile: no change between the
    scan and the subscription is lost. Returns what ``scan`` (a function) gives."""
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).start()
    try:
        found = scan()
        query.processAllAvailable()
    finally:
        query.stop()
    return found


def by_batch(path: str):  # noqa: ANN201
    """A sink that writes each batch to a folder of its own: written again, it is replaced."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write
