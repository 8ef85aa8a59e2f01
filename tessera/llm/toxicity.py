"""Toxicity by a linear classifier on character n-grams (operator 9).

The features of a text are the hashed n-grams of its lower-case UTF-8 bytes, present
or absent. Each is scaled by its naive Bayes log-count ratio between the two classes,
and a logistic regression is fitted on the scaled features (NB-SVM with the logistic
loss). Length does not enter, so one bad word weighs the same in a long text.

Training reads at most ``rows_per_class`` labelled rows of each class, those whose
hashed ids are smallest; executors turn them into sets of at most ``2 ** BITS``
integers before the driver gets them, so what the driver holds is bounded however
large the corpus and its texts are. The loss weighs classes by their true counts, so
scores are probabilities. Scoring reads every whole text once and needs no shuffle.

Edge cases: null and empty texts have no features and get the intercept's score;
without labelled rows all scores are 0; with one class only, its (smoothed) share;
labels that contradict each other for one id count by their majority, ties as toxic;
labels without a document and null labels are left out; an id with several texts is
learnt from its least one; repeated documents get equal scores; other columns of the documents are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import documents, sliced

BITS = 18
ORDERS = (3, 4, 5)
THRESHOLD = 0.3


def features(text: str | None, last: np.ndarray) -> np.ndarray:
    """The distinct hashed n-grams of a text. ``last`` is scratch of length 2 ** BITS."""
    if not text:
        return np.zeros(0, np.int32)
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    h, found = np.zeros(len(b) + 1, np.uint32), []
    for n in range(1, max(ORDERS) + 1):
        if len(b) < n:
            break
        h = h[:-1] * np.uint32(16777619) + b[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            found.append((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS))
    if not found:
        return np.zeros(0, np.int32)
    grams = np.concatenate(found)
    at = np.arange(len(grams))
    last[grams] = at
    return grams[last[grams] == at].astype(np.int32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    intercept: float

    def score(self, text: str | None, last: np.ndarray) -> float:
        z = float(self.weights[features(text, last)].sum(dtype=np.float64)) + self.intercept
        return float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))


def fit(rows: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, l2: float = 0.01, least: int = 4, steps: int = 60) -> Model:
    """Log-count ratios, then logistic regression by Adam on the scaled features.

    ``weight``: of each row in the loss. ``least``: rows that a feature must be in.
    """
    size = 1 << BITS
    if not len(rows):
        return Model(np.zeros(size, np.float32), -40.0)
    share = (weight @ toxic + 0.5) / (weight.sum() + 1)
    prior = float(np.log(share / (1 - share)))
    if toxic.min() == toxic.max():
        return Model(np.zeros(size, np.float32), prior)
    blocks = [slice(i, i + 256) for i in range(0, len(rows), 256)]  # bounds the scratch memory
    flat = [(np.concatenate(rows[s]), np.array([len(x) for x in rows[s]])) for s in blocks]

    def summed(values: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        for s, (grams, n) in zip(blocks, flat, strict=True):
            out += np.bincount(grams, np.repeat(values[s], n), size)
        return out

    pos, neg = summed(toxic) + 1, summed(1 - toxic) + 1
    ratio = np.log(pos / (toxic.sum() + 2)) - np.log(neg / ((1 - toxic).sum() + 2))
    ratio[pos + neg - 2 < least] = 0
    # what has no ratio, as it is rare or in all rows alike, would only add zeros
    used = [(ratio[grams] != 0, n) for grams, n in flat]
    flat = [(grams[u], np.add.reduceat(np.r_[u, False], np.r_[0, np.cumsum(n)[:-1]], dtype=np.int64) * (n > 0)) for (grams, n), (u, _) in zip(flat, used, strict=True)]
    number = np.cumsum(ratio != 0) - 1  # few features, side by side, are read and summed faster
    flat, size, all_ratios = [(number[grams].astype(np.int32), n) for grams, n in flat], int((ratio != 0).sum()), ratio
    ratio = ratio[ratio != 0]
    weight = weight / weight.sum()
    v, b, m1, m2 = np.zeros(size), prior, np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        scaled = ratio * v
        z = np.empty(len(rows))
        for s, (grams, n) in zip(blocks, flat, strict=True):
            ends = np.concatenate([[0.0], np.cumsum(scaled[grams])])[np.concatenate([[0], np.cumsum(n)])]
            z[s] = np.diff(ends) + b
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic) * weight
        g = summed(error) * ratio + l2 * v
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        v -= 0.02 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
        b -= 0.05 * error.sum()
    weights = np.zeros(len(all_ratios), np.float32)
    weights[all_ratios != 0] = ratio * v
    return Model(weights, float(b))


def held_out(key: Column) -> Column:
    """Rows from which nothing is learnt."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = 2000) -> Model:
    """Fits the model on a bounded sample of the labelled rows that are not held out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for c in (0, 1)]
    # at most 2 * rows_per_class pairs of numbers, whatever the size of the corpus
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    # and as many texts: of an id that repeats, the least one, taken before rows move
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(1 << BITS, np.int64)
        for b in sliced(batches):
            grams = [features(t, last) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(grams, pa.list_(pa.int32()))], names=["doc_id", "toxic", "grams"])

    key = docs.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(counted, f"doc_id {key}, toxic int, grams array<int>").toArrow().combine_chunks()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")  # tasks end in any order; sums of floats must not differ
    columns = got["grams"].chunks[0] if got.num_rows else None
    rows = [columns[int(i)].values.to_numpy(zero_copy_only=False) for i in order]
    toxic = got["toxic"].to_numpy()[order].astype(np.float64)
    seen = {c: max(1, int((toxic == c).sum())) for c in (0, 1)}
    return fit(rows, toxic, np.array([total.get(int(c), 0) / seen[int(c)] for c in toxic]))


def scored(docs: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with a column ``name``: the probability that a text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        last = np.zeros(1 << BITS, np.int64)
        for batch in texts:
            yield pa.array([shared.value.score(t.as_py(), last) for t in batch], pa.float64())

    return docs.withColumn(name, score(F.col(text)))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``."""
    name = "__toxic"
    return scored(docs, train(docs, labels), name).filter(F.col(name) < threshold).drop(name)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
