"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Folders:
    """The folders that calls within a ``folders`` block name."""

    def __init__(self, spark: SparkSession, outer: Folders | None) -> None:
        self.spark, self.outer, self.named, self.kept = spark, outer, [], set()

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, whose folders outlive the block: they are the block's around it, if any."""
        self.kept |= self._read_by(df)
        return df

    def release(self, df: DataFrame) -> None:
        """Deletes the folders that ``df`` reads, if they are this block's."""
        for path in self._read_by(df):
            self._delete(path)
            self.named.remove(path)

    def _read_by(self, df: DataFrame) -> set[str]:
        read = df.inputFiles()
        return {p for p in self.named if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in read)}

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def close(self) -> None:
        for path in self.named:
            if path not in self.kept:
                self._delete(path)
            elif self.outer is not None:
                self.outer.named.append(path)


#: The innermost block of this thread: calls in other threads have blocks of their own.
_within: ContextVar[Folders | None] = ContextVar("folders", default=None)


@contextmanager
def folders(spark: SparkSession) -> Iterator[Folders]:
    """A block at whose end the folders that calls within it named are deleted, and no others;
    what is kept passes to the block around. If the block fails nothing is kept. A DataFrame
    that reads a folder must be written, or kept, before its block ends."""
    own = Folders(spark, _within.get())
    token = _within.set(own)
    try:
        yield own
    except BaseException:
        own.kept.clear()
        raise
    finally:
        _within.reset(token)
        own.close()


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh folder path under ``spark.checkpoint.dir``. Only a local session, as in tests,
    may be without that setting; on a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file:///tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    if (block := _within.get()) is not None:
        block.named.append(path)
    return path


def counted(df: DataFrame, what: str) -> tuple[DataFrame, int]:
    """``kept``, and how many rows that wrote, by the same job."""
    seen = Observation()
    out = kept(df.observe(seen, F.count(F.lit(1)).alias("rows")), what)
    return out, seen.get["rows"]


def kept(df: DataFrame, what: str, **options: str) -> DataFrame:
    """``df`` written once, with ``options`` of the writer, and read again, so that loops don't
    grow their lineage."""
    path = shared_path(df.sparkSession, what)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
