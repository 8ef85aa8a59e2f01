"""Change signals as a streaming source with offsets of its own: ``workspace_signals``.

A watcher writes what it sees to a journal, a folder of files ``<number>-<signals>.jsonl`` whose
numbers rise by one; a file appears under its name only when it is whole. An offset is the number
of the last file taken, so that a stream that starts again goes on behind what its checkpoint
has, and a batch that is tried again reads the same files. The name of a file says how many
signals it holds, so a backlog is measured by a listing.

A batch whose backlog is over ``capacity`` isn't read: it is one row of kind ``rescan``, with
the number of signals that it stands for. That is data like others, so what follows decides
about a full scan without a second channel. Files that all checkpoints are past can be deleted
with ``clean``; numbers go on.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

CAPACITY = 1024
NAME = re.compile(r"([0-9]{12})-([0-9]+)\.jsonl")
SCHEMA = "kind string, seq long, path string, event_type string, ts timestamp, signals long"


def file_name(number: int, signals: int) -> str:
    return f"{number:012}-{signals}.jsonl"


def opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", root) if ":" in root else f"file://{root}")


def files(root: str) -> list[tuple[int, int, str]]:
    """(number, signals, path) of the journal's files, in order."""
    at, base = opened(root)
    found = at.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted((int(m[1]), int(m[2]), f.path) for f in found if (m := NAME.fullmatch(f.base_name)))


def append(root: str, signals: list[tuple[str, str, datetime]]) -> int:
    """Adds a file of signals (path, event_type, ts) and returns its number. A journal has one
    writer, its watcher."""
    at, base = opened(root)
    at.create_dir(base)
    last = [n for n, _, _ in files(root)]
    mark = at.get_file_info(f"{base}/cleaned")
    if mark.type == fs.FileType.File:
        with at.open_input_stream(mark.path) as f:
            last.append(int(f.read()))
    number = max(last, default=0) + 1
    lines = "".join(json.dumps({"path": p, "event_type": e, "ts": t.astimezone(UTC).isoformat()}) + "\n" for p, e, t in signals)
    temporary = f"{base}/.tmp-{uuid.uuid4().hex}"
    with at.open_output_stream(temporary) as f:
        f.write(lines.encode())
    at.move(temporary, f"{base}/{file_name(number, len(signals))}")
    return number


def clean(root: str, upto: int) -> int:
    """Deletes files up to a number that every reader has taken; how many."""
    at, base = opened(root)
    with at.open_output_stream(f"{base}/cleaned") as f:
        f.write(str(upto).encode())
    gone = [p for n, _, p in files(root) if n <= upto]
    for p in gone:
        at.delete_file(p)
    return len(gone)


@dataclass
class Files(InputPartition):
    """Files to read, or, with none, a rescan up to ``last`` in place of ``signals``."""

    paths: list[str]
    last: int
    signals: int

    def __init__(self, paths: list[str], last: int, signals: int) -> None:
        super().__init__(last)
        self.paths, self.last, self.signals = paths, last, signals


class SignalReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root, self.capacity = options["path"], int(options.get("capacity", CAPACITY))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"file": max((n for n, _, _ in files(self.root)), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        pending = [x for x in files(self.root) if start["file"] < x[0] <= end["file"]]
        total = sum(n for _, n, _ in pending)
        if total > self.capacity:
            return [Files([], end["file"], total)]
        return [Files([p], number, n) for number, n, p in pending]

    def read(self, partition: Files) -> Iterator[tuple]:
        if not partition.paths:
            yield "rescan", partition.last, None, None, None, partition.signals
        at, _ = opened(self.root)
        for path in partition.paths:
            with at.open_input_stream(path) as f:
                for line in f.read().decode().splitlines():
                    s = json.loads(line)
                    yield "signal", partition.last, s["path"], s["event_type"], datetime.fromisoformat(s["ts"]), 1


class SignalSource(DataSource):
    """``spark.readStream.format("workspace_signals")``; options: path, capacity."""

    @classmethod
    def name(cls) -> str:
        return "workspace_signals"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> SignalReader:  # noqa: ANN001, N802
        return SignalReader(self.options)


def signals(spark: SparkSession, root: str, capacity: int = CAPACITY) -> DataFrame:
    """The journal at ``root`` as a stream."""
    spark.dataSource.register(SignalSource)
    return spark.readStream.format("workspace_signals").option("capacity", capacity).load(root)


def between(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signals (path, event_type) that lead from one scan (path, content_hash) to the next."""
    a, b = old.select("path", F.col("content_hash").alias("__a")), new.select("path", F.col("content_hash").alias("__b"))
    kind = F.when(F.col("__a").isNull(), "created").when(F.col("__b").isNull(), "removed").otherwise("modified")
    return a.join(b, "path", "full").filter(~F.col("__a").eqNullSafe(F.col("__b"))).select("path", kind.alias("event_type"))


def planned(batch: DataFrame) -> DataFrame:
    """What a batch asks for: (action, path, event_type, signals). One rescan of everything if
    any row says so, else the last signal of each path."""
    rescan = batch.agg(F.max(F.col("kind") == "rescan").alias("any"), F.sum("signals").alias("signals"))
    whole = rescan.filter("any").select(F.lit("rescan").alias("action"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("event_type"), "signals")
    last = F.max_by("event_type", F.struct("ts", "seq", "event_type")).alias("event_type")
    single = batch.groupBy("path").agg(last, F.sum("signals").alias("signals")).crossJoin(F.broadcast(rescan.select("any"))).filter("NOT any")  # one row
    return whole.unionByName(single.select(F.lit("reconcile").alias("action"), "path", "event_type", "signals"))
