"""Packing by optimal length buckets (operator 5).

The global histogram of lengths decides the buckets: dynamic programming over its
distinct lengths chooses the ``buckets`` upper bounds that minimise padding, the sum
over all rows of bound minus length. Inside each bucket rows form batches of
``budget // bound`` rows, so that a padded batch stays within the token budget; all
batches of a bucket but the last are full. The budget bounds what is planned: a longer row
can share no batch. Such rows have one more bucket, behind the others, where each is a batch
alone and its own bound, so that nothing is padded there.

Lengths are counted in words unless another expression is given, such as the number of
pieces of an encoding. The driver gets the histogram up to the budget only, so its rows are
bounded at any input size, and every length counts exactly. Cost matrices of this kind are
Monge, so each layer is solved by divide and conquer in O(n log n). A row's place comes
from ``ranked``: no bucket has to fit in one task and texts are not moved.

Edge cases: null and blank texts have length 0 and go to the first bucket; null lengths
count as 0; a row longer than the budget is a batch alone, never cut; fewer distinct lengths
than buckets give as many buckets as lengths; equal rows get different slots; an empty table
gives none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import documents, n_words, ranked, stored

BUCKETS = 16
#: Tokens of a padded batch.
BUDGET = 16_384


def optimal_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The upper bounds of at most ``buckets`` buckets with the least padding.

    ``lengths`` rise. Layer k holds the least cost of the first j lengths in k buckets;
    the best last cut moves right with j, which divide and conquer uses, level by level.
    """
    n = len(lengths)
    if n <= buckets:
        return list(lengths)
    size = np.array(lengths, np.int64)
    rows = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
    tokens = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) * size)])
    cost = np.concatenate([[0], size * rows[1:] - tokens[1:]])  # one bucket; padding without the other tokens
    cuts = []
    for k in range(2, buckets + 1):
        new, cut = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        todo = [(k, n, k - 1, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            total = cost[i] + size[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])
            best = int(np.argmin(total))
            new[j], cut[j] = total[best], i[best]
            todo += [(low, j - 1, first, int(cut[j])), (j + 1, high, int(cut[j]), last)]
        new[:k] = np.iinfo(np.int64).max // 4  # fewer lengths than buckets
        cost = new
        cuts.append(cut)
    bounds, j = [], n
    for cut in reversed(cuts):
        bounds.append(int(size[j - 1]))
        j = int(cut[j])
    return [int(size[j - 1]), *reversed(bounds)]


def length_bounds(sized: DataFrame, length: str, buckets: int = BUCKETS, budget: int = BUDGET) -> list[int]:
    """Bounds from the histogram of all rows within the budget."""
    histogram = sized.filter(F.col(length) <= budget).groupBy(F.col(length).alias("l")).agg(F.count("*").alias("n")).orderBy("l").collect()
    return optimal_bounds([r["l"] for r in histogram], [r["n"] for r in histogram], buckets) if histogram else []


def packed(sized: DataFrame, length: str, order: list[str], buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``sized`` with bucket, bound, batch (in the bucket) and slot (in the batch)."""
    bounds = length_bounds(sized, length, buckets, budget)
    which, bound = F.lit(len(bounds)), F.col(length).cast("long")
    for k in reversed(range(len(bounds))):
        which = F.when(F.col(length) <= bounds[k], k).otherwise(which)
        bound = F.when(F.col("bucket") == k, F.lit(bounds[k]).cast("long")).otherwise(bound)
    dealt = ranked(sized.withColumn("bucket", which), ["bucket"], order, "__rank")
    room = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bound"), F.lit(1))), F.lit(1)).cast("long")
    return dealt.withColumn("bound", bound).withColumn("batch", F.floor(F.col("__rank") / room).cast("long")).withColumn("slot", (F.col("__rank") % room).cast("long")).drop("__rank")


def pack_documents(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, length: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, bound, batch, slot of every row of ``docs``; ``length``:
    its number of tokens, by default of words."""
    tokens = n_words(F.col("text")) if length is None else F.coalesce(length, F.lit(0)).cast("long")
    sized = stored(docs.select("doc_id", tokens.alias("n_tokens"), F.xxhash64("text").alias("__text")), "pack-lengths")
    return packed(sized, "n_tokens", ["doc_id", "__text"], buckets, budget).drop("__text")


def op5_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
