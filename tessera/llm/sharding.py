"""Sharding by best-fit-decreasing bin packing (operator 8).

Groups of equal texts are indivisible. Taken by falling size, each enters the bin with
the tightest remaining capacity that still holds it, found in a balanced search tree;
if none does, a new bin opens. Items of equal size are alike, and after one of them has
entered the tightest bin that bin stays the tightest for the next, so placing "as many
of this size as fit" gives the packing of item after item. The driver therefore packs
the histogram of sizes, not the groups: it gets one row for each distinct size. Sizes
above ``EXACT`` are planned rounded up to 16 significant bits, so that the histogram
has a bounded number of rows at any input size and no bin overflows.

Each group then finds its bin by its rank among the groups of its size, and each row
its slot by its rank in the shard; both ranks come from counts of cells, so no size,
shard or group has to fit in one task. Rows of a group are never collected.

With a fixed number of shards the capacity is the least, within ``SLACK``, that packs
into that many bins. A group larger than an even share has a bin of its own, as it
can't be divided, and the others share the rest evenly.

Edge cases: a null text counts as empty and equals an empty one; every row weighs one
byte more than its text, so none is free; equal rows are one group; an empty table has
no shards; ids may repeat or be null; other columns are not read.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import documents, ranked, stored, text_or_empty

SHARDS = 16
EXACT = 1 << 16
SLACK = 0.001


class Tree:
    """A treap of (remaining, bin): a search tree that random priorities keep balanced."""

    def __init__(self) -> None:
        self.root, self.random = None, random.Random(0)

    @staticmethod
    def _split(node, key):
        """Nodes under ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            a, b = Tree._split(node[3], key)
            return [node[0], node[1], node[2], a], b
        a, b = Tree._split(node[2], key)
        return a, [node[0], node[1], b, node[3]]

    @staticmethod
    def _merge(a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return [a[0], a[1], a[2], Tree._merge(a[3], b)]
        return [b[0], b[1], Tree._merge(a, b[2]), b[3]]

    def add(self, key: tuple[int, int]) -> None:
        a, b = self._split(self.root, key)
        self.root = self._merge(self._merge(a, [key, self.random.random(), None, None]), b)

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns the first entry with ``least`` or more remaining."""
        a, b = self._split(self.root, (least, -1))
        if b is None:
            return None
        first = b
        while first[2] is not None:
            first = first[2]
        c, d = self._split(b, (first[0][0], first[0][1] + 1))
        self.root = self._merge(a, d)
        return first[0]


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Packs (size, how many), given by falling size; an item over ``capacity`` is alone.

    Returns (size, rank of the first item, rank behind the last, bin), or None as soon
    as more than ``most`` bins are needed.
    """
    tree, bins, out = Tree(), 0, []
    for size, n in sizes:
        at = 0
        while at < n:
            entry = tree.take(size)
            if entry is None:
                entry, bins = (max(capacity, size), bins), bins + 1
                if most is not None and bins > most:
                    return None
            room, b = entry
            k = min(room // size, n - at)
            out.append((size, at, at + k, b))
            at += k
            if room - k * size:
                tree.add((room - k * size, b))
    return out


def fixed_shards(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """The packing with the least capacity, within ``SLACK``, that needs ``shards`` bins at most."""
    left, alone, rest = shards, [], [list(x) for x in sizes]
    # groups over an even share of what is left are alone in their bins
    while rest and left > 1 and rest[0][0] * left > sum(s * n for s, n in rest):
        size = rest[0][0]
        alone.append((size, sizes_taken(alone, size), sizes_taken(alone, size) + 1, len(alone)))
        rest[0][1] -= 1
        left -= 1
        if not rest[0][1]:
            rest.pop(0)
    if not rest:
        return alone
    total = sum(s * n for s, n in rest)
    low = max(-(-total // left), rest[0][0])
    high, found = low, None
    while (found := best_fit_decreasing([tuple(x) for x in rest], high, left)) is None:
        low, high = high, high + max(1, int(high * SLACK * 4))
    while high - low > max(1, int(low * SLACK)):
        mid = (low + high) // 2
        if (f := best_fit_decreasing([tuple(x) for x in rest], mid, left)) is None:
            low = mid
        else:
            high, found = mid, f
    return alone + [(s, a + sizes_taken(alone, s), b + sizes_taken(alone, s), k + len(alone)) for s, a, b, k in found]


def sizes_taken(alone: list[tuple[int, int, int, int]], size: int) -> int:
    return sum(x[0] == size for x in alone)


def grid(size):
    """``size`` rounded up to 16 significant bits."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size.cast("double"))) - 15, F.lit(0))).cast("long")
    return F.when(size <= EXACT, size).otherwise((F.ceil(size / step) * step).cast("long"))


def packed(groups: DataFrame, key: str, size: str, *, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """``groups`` (one row for each ``key``) with the ``shard`` of each.

    With ``capacity``: as few shards of that size as best fit decreasing needs. With
    ``shards``: that many at most, of near equal size.
    """
    spark = groups.sparkSession
    sized = groups.withColumn("__size", grid(F.col(size)))
    histogram = sized.groupBy("__size").agg(F.count("*").alias("n")).orderBy(F.desc("__size"))
    sizes = [(r[0], r[1]) for r in histogram.toLocalIterator()]
    plan = fixed_shards(sizes, shards) if shards else best_fit_decreasing(sizes, capacity)
    runs = spark.createDataFrame(plan, "__its long, __from long, __to long, shard int")
    in_size = ranked(sized, ["__size"], [key], "__rank", cells=256)
    return in_size.join(runs, (F.col("__size") == F.col("__its")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))).drop("__size", "__its", "__rank", "__from", "__to")


def op8_bin_packing(spark: SparkSession, sf_dir: str, shards: int = SHARDS) -> DataFrame:
    text = text_or_empty()
    rows = stored(documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("__group")
    ), "shard-rows")
    groups = stored(rows.groupBy("__group").agg(F.sum("size").alias("__bytes")), "shard-groups")
    placed = packed(groups, "__group", "__bytes", shards=shards).select("__group", "shard")
    dealt = rows.join(placed, "__group").drop("__group")
    return ranked(dealt, ["shard"], ["doc_id", "text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
