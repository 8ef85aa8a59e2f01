"""A kept full-text index: postings of every term, written once and read by term.

``build`` writes three tables under a folder: postings (part, term, key, tf, dl), sorted by
term inside folders by a hash of the term; terms (part, term, df); and one row of corpus
statistics. A query reads the folders and row groups of its own terms, never the corpus.
``refreshed`` takes changed documents in; ``of`` keeps one index a state of a table for as
long as an application runs.

Edge cases: null texts have no terms but count as documents; texts of a repeated key are
one document; an index of no documents matches nothing.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.columns import terms
from tessera.functions.storage import kept, shared_path

#: Folders of terms, and how many tasks write the postings of one.
PARTS, SPREAD = 32, 8


def part_of(term: str) -> int:
    return zlib.crc32(term.encode()) % PARTS


@dataclass(frozen=True)
class LexicalIndex:
    spark: SparkSession
    folder: str
    key: str
    key_type: str
    n: int
    avgdl: float

    def postings(self) -> DataFrame:
        return self.spark.read.schema(f"key {self.key_type}, term string, tf long, dl long, part int").parquet(f"{self.folder}/postings")

    def terms(self) -> DataFrame:
        return self.spark.read.schema("term string, df long, part int").parquet(f"{self.folder}/terms")

    def lengths(self) -> DataFrame:
        return self.spark.read.schema(f"key {self.key_type}, dl long").parquet(f"{self.folder}/lengths")

    def df(self, wanted: list[str]) -> dict[str, int]:
        """In how many documents each wanted term is; at most as many rows as terms."""
        rows = of_terms(self.terms(), wanted).select("term", "df").collect()
        return {r["term"]: r["df"] for r in rows}


def of_terms(table: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows of some terms: the folders are pruned, then row groups by the sorted terms."""
    return table.filter(F.col("part").isin(*sorted({part_of(t) for t in wanted})) & F.col("term").isin(*wanted))


def _counted(docs: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    tokens = F.concat(*[terms(F.coalesce(F.col(c), F.lit(""))) for c in columns])
    return docs.select(F.col(key).alias("key"), tokens.alias("t")).select("key", "t", F.size("t").cast("long").alias("dl"))


def _write(spark: SparkSession, postings: DataFrame, lengths: DataFrame, folder: str, key: str) -> LexicalIndex:
    dealt = postings.withColumn("part", (F.crc32(F.col("term").cast("binary")) % PARTS).cast("int"))
    # a term that is in every third text is written by several tasks
    dealt = dealt.repartition("part", F.pmod(F.xxhash64("key"), F.lit(SPREAD))).sortWithinPartitions("part", "term", "key")
    dealt.write.partitionBy("part").parquet(f"{folder}/postings")
    lengths.write.parquet(f"{folder}/lengths")
    index = LexicalIndex(spark, folder, key, lengths.schema["key"].dataType.simpleString(), 0, 1.0)
    index.postings().groupBy("part", "term").agg(F.count("*").alias("df")).repartition("part").sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{folder}/terms")
    stats = index.lengths().agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    return replace(index, n=stats["n"], avgdl=float(stats["avgdl"] or 1.0))


def build(docs: DataFrame, key: str, *columns: str, folder: str | None = None) -> LexicalIndex:
    """Indexes all rows of ``docs``; the corpus is tokenised once."""
    spark = docs.sparkSession
    # texts are dealt by key once, so that terms are counted where they are
    dealt = _counted(docs.select(key, *columns).repartition(key), key, columns)
    counts = dealt.filter("key IS NOT NULL").select("key", F.explode("t").alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    postings = counts.withColumn("dl", F.sum("tf").over(Window.partitionBy("key")))
    # read once more for the lengths, of which a row a text moves
    lengths = kept(_counted(docs, key, columns).groupBy("key").agg(F.sum("dl").alias("dl")), "index-lengths")
    return _write(spark, postings, lengths, folder or shared_path(spark, "index"), key)


def refreshed(index: LexicalIndex, changed: DataFrame, removed: DataFrame, *columns: str, folder: str | None = None) -> LexicalIndex:
    """The index with the rows of ``changed`` in place of those of the same keys and without
    the keys in ``removed``; only changed texts are tokenised."""
    spark = index.spark
    gone = kept(changed.select(F.col(index.key).alias("key")).union(removed.select(F.col(index.key).alias("key"))).distinct(), "index-gone")
    tokens = kept(_counted(changed, index.key, columns), "index-changed")
    lengths = tokens.groupBy("key").agg(F.sum("dl").alias("dl"))
    fresh = tokens.select("key", F.explode("t").alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf")).join(lengths, "key")
    stay = index.postings().join(gone, "key", "left_anti").select("key", "term", "tf", "dl")
    every = index.lengths().join(gone, "key", "left_anti").unionByName(lengths)
    return _write(spark, stay.unionByName(fresh.select("key", "term", "tf", "dl")), kept(every, "index-lengths"), folder or shared_path(spark, "index"), index.key)


_kept: dict[tuple, LexicalIndex] = {}


def of(docs: DataFrame, key: str, *columns: str) -> LexicalIndex:
    """The index of the files that ``docs`` reads as they are now, built at first use."""
    spark = docs.sparkSession
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    state = []
    for f in sorted(docs.inputFiles()):
        at = path(f)
        s = at.getFileSystem(conf).getFileStatus(at)
        state.append((f, s.getModificationTime(), s.getLen()))
    name = (spark.sparkContext.applicationId, docs.semanticHash(), key, columns, tuple(state))
    if name not in _kept:
        _kept[name] = build(docs, key, *columns)
    return _kept[name]
