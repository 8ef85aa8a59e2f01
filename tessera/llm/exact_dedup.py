"""Exact deduplication by a stream with disk-backed keyed state (operator 4).

Two texts are equal when they are identical after all white space (space and
\\t \\n \\v \\f \\r) is deleted. A streaming aggregation keyed by the SHA-256 of that
form keeps, for each digest and without expiry, how many rows had it, the stable
identifier of the best row so far and its locator (file and row in the file). The
state lives in RocksDB on the executors' disks, with its checkpoint in the shared
folder. A digest that more than one row has is a hit; hits are compared by their full
normalised bytes, so that texts whose digests collide stay apart.

All of it is DataFrame operations: partial aggregation before the only shuffle of the
stream, then one join of the texts with the hit digests, which a bitmap of hashed hit digests,
of fixed size, keeps most other texts out of.

Edge cases: a null text is an empty one, and all empty or blank texts are one group.
Of a group the row with the most code points stays, then the smallest ``doc_id`` (null
ids last), then the first by locator, so that of repeated rows exactly one stays.
Columns beside ``doc_id`` and ``text`` are not looked at; an empty table gives none.
"""

from __future__ import annotations

import re
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessera.functions.storage import shared_path
from tessera.llm._common import squeezed, stored, text_or_empty

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: no disk reserved ahead for each one's logs
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # and one bound for the native memory of all stores of an executor
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}

#: Bits of the filter of hit digests: 8 MiB, at any size of the input.
BITS = 1 << 26
_one_at_a_time = threading.Lock()


def _rows(df: DataFrame) -> DataFrame:
    """doc_id, normalised text, its digest, and what orders the rows of a group."""
    norm = squeezed(text_or_empty())
    return df.select(
        "doc_id",
        norm.alias("norm"),
        F.unhex(F.sha2(norm, 256)).alias("digest"),
        F.struct(
            (-F.length(text_or_empty())).alias("points"),
            F.col("doc_id").isNull().alias("no_id"),
            F.col("doc_id").alias("doc_id"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("row"),
        ).alias("place"),
    )


def _bare(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def as_pattern(path: str) -> str:
    """``path`` as a pattern, which a stream takes for one file or a folder of files. As
    for every reader, a path with one of ``*?[{`` is a pattern already."""
    path = path.rstrip("/")
    return path if re.search(r"[*?\[{]", path) else f"{path[:-1]}[{path[-1]}]"


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """The session with the settings of the state store, for one call at a time."""
    with _one_at_a_time:
        before = {k: spark.conf.get(k, None) for k in STATE_CONF}
        try:
            for k, v in STATE_CONF.items():
                spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def digest_state(spark: SparkSession, path: str, checkpoint: str | None = None) -> DataFrame:
    """Streams the Parquet table at ``path`` into keyed state: digest, n, best place.

    ``checkpoint`` names the state to go on with: rows of files that came since the
    last call are added, nothing is read twice. By default the state is new. It is read
    once, under the same bound of memory as the stream, and written as a table.
    """
    checkpoint = checkpoint or shared_path(spark, "dedup-state")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(as_pattern(path))
    seen = _rows(stream).groupBy("digest").agg(F.count("*").alias("n"), F.min("place").alias("best"))
    writer = seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with _settings(spark):  # a query takes the settings of its session as it starts
        query = writer.start()
    query.awaitTermination()
    with _settings(spark):
        state = spark.read.format("statestore").load(checkpoint)
        n, best = state.schema["value"].dataType.names[:2]
        return stored(state.select("key.digest", F.col("value")[n].alias("n"), F.col("value")[best].alias("best")), "dedup-digests")


def maybe(rows: DataFrame, hit: DataFrame, bits: int = BITS) -> DataFrame:
    """``rows`` without most of those whose digest is not in ``hit``, before anything moves: a
    filter of ``bits`` bits, which is the size of what is broadcast, however many hits there
    are. It never loses a hit; the more of its bits are set, the less it holds back."""
    bit = F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1
    there = hit.groupBy(F.bitmap_bucket_number(bit).alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("__bits"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("__part", F.bitmap_bucket_number(bit)).join(F.broadcast(there), "__part")  # bits / 32,768 rows of 4 KiB
    return found.filter(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1).select(*rows.columns)


def exact_groups(spark: SparkSession, path: str, checkpoint: str | None = None) -> DataFrame:
    """For each row of the Parquet table at ``path``: its group and whether it stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256, and the row's locator
    (file, row).
    """
    try:
        state = digest_state(spark, path, checkpoint)
    except AnalysisException as e:
        # a table without rows leaves no state to read
        if not spark.read.parquet(path).limit(1).isEmpty():
            raise e
        kind = spark.read.parquet(path).schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"doc_id {kind}, keep_id {kind}, group_size long, kept boolean, text_sha256 string, file string, row long")
    alone = state.filter("n = 1").select(
        F.col("best.doc_id").alias("doc_id"), F.col("best.doc_id").alias("keep_id"), F.col("n").cast("long").alias("group_size"),
        F.lit(True).alias("kept"), _bare(F.col("digest")).alias("text_sha256"), F.col("best.file").alias("file"), F.col("best.row").alias("row"),
    )
    hit = stored(state.filter("n > 1").select("digest"), "dedup-hit-digests")
    # Texts that the filter lets through move once, to their digests; those that are hit
    # are written, and all that follows reads no other. Grouping by the text itself compares full bytes; it
    # has an exchange of its own, so that equal rows of a task merge before they move, and
    # its result is written, so that a hot digest may be split in the joins before and after.
    # an inner join, as digests of hits differ: a semi-join would be pushed below the filter
    rows = stored(maybe(_rows(spark.read.parquet(path)), hit).join(hit, "digest"), "dedup-hits")
    texts = rows.groupBy("norm").agg(F.first("digest").alias("digest"), F.count("*").alias("size"), F.min("place").alias("best"))
    texts = stored(texts.groupBy("digest").agg(F.count("*").alias("texts"), F.collect_list(F.struct("size", "best", "norm")).alias("all")), "dedup-texts")
    one = texts.filter("texts = 1").select("digest", F.col("all")[0]["size"].alias("size"), F.col("all")[0]["best"].alias("best"))
    many = texts.filter("texts > 1").select("digest", F.inline("all"))
    found = rows.select("digest", "place").join(one, "digest").select("digest", "place", "size", "best")
    apart = rows.join(many.withColumnRenamed("norm", "its"), "digest").filter("norm = its").select("digest", "place", "size", "best")
    grouped = found.unionByName(apart).select(
        F.col("place.doc_id").alias("doc_id"), F.col("best.doc_id").alias("keep_id"), F.col("size").cast("long").alias("group_size"),
        (F.struct("place.file", "place.row") == F.struct("best.file", "best.row")).alias("kept"), _bare(F.col("digest")).alias("text_sha256"), F.col("place.file").alias("file"), F.col("place.row").alias("row"),
    )
    return alone.unionByName(grouped)


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another row that stays has too.

    The rows are first written to the shared folder, where the stream reads them.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "dedup-rows")
    docs.write.parquet(path)
    kept = exact_groups(spark, path).filter("kept").select(F.col("file").alias("__file"), F.col("row").alias("__row"))
    rows = spark.read.schema(docs.schema).parquet(path).withColumns({"__f": F.col("_metadata.file_path"), "__r": F.col("_metadata.row_index")})
    return rows.join(kept, (F.col("__f") == F.col("__file")) & (F.col("__r") == F.col("__row")), "left_semi").select(*docs.columns)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""
