"""N-gram Jaccard join by chosen paths (operator 3).

Two texts are linked when the sets of their shingles (five words in a row; a shorter
text is one shingle) have a Jaccard similarity of ``similarity`` or more. Equal texts,
those with equal words in equal order, are one class and take part once.

Chosen paths: in each run a set picks those of its tokens whose hash, seeded by the run,
is under ``SAMPLED / (similarity * size)``. A token picked by several sets is a bucket. A
bucket that is small is brute-forced; in a larger one every set goes on by one more token,
that with the least hash, seeded by the path that led there, and so on to ``DEPTH``. Two
sets that are similar enough share ``SAMPLED`` first picks or more on average, and each
later step with a probability of ``similarity`` or more; runs are repeated until a pair
that is always in large buckets still meets at the last depth with the target recall. A
large bucket whose sets are alike on the whole (a family of near copies, which no token
divides), or that is still large at the last depth, is brute-forced too, in pairs of
blocks of ``BLOCK`` sets, so that no task holds more than two blocks and no pair is left
out.

Brute force has two steps. First only sizes and sketches (128 one-bit minhashes) are
compared; a true pair falls five standard deviations short of the bound with a
probability of 3e-7. Pairs that meet in several buckets belong to the least of them.
Then those sets that have a partner in a bucket are brought there once and verified
exactly. No pair ever leaves its task: what leaves is each set's number of links, and
edges that connect it to the least linked set of the block. Links are counted once each,
so the numbers are exact but for the recall of the search.

Edge cases: null and blank texts are equal to each other and have no links; texts of
under five words link only if equal; equal rows and repeated ids are members of their
text's class; a class takes the least id of its members, null if all are null, and where ids
repeat ``class_key``, the least key of its texts, still tells classes apart; other columns
are not read. ``one_of_each`` goes by rows, not ids: of each class the row of the least id
stays (null ids last), of several such rows the first in the files, and no other row of the
id is touched; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.storage import folders, shared_path
from tessera.llm._common import documents, on_files, places, sliced, stored
from tessera.llm.components import components

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
#: First picks that similar sets share on average; buckets up to LIMIT are small.
SAMPLED, LIMIT, BLOCK, DEPTH = 3.0, 512, 512, 4
#: Mean similarity from which a large bucket is one family.
ALIKE = 0.4
BITS = 128
#: Bytes of a hashed shingle: two of the some thousand tokens of a pair of sets are taken
#: for one with a probability of about one in a million.
TOKEN_BYTES = 5
#: Tokens that are unpacked together to count common ones.
AT_ONCE = 1_000_000

_MIX1, _MIX2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_SEEDS = mix(np.arange(1, 4097, dtype=np.uint64) * _GOLD)
_FACTORS = _SEEDS[:BITS] | np.uint64(1)
_PLACES = _SEEDS[BITS : BITS + WORDS] | np.uint64(1)


def runs_for(recall: float, similarity: float) -> int:
    """A pair shares a Poisson number of first picks, of which similarity ** (DEPTH - 1)
    are shared to the end."""
    return math.ceil(-math.log(1 - recall) / (SAMPLED * similarity ** (DEPTH - 1)))


class WordHashes(dict):
    """Hashes of words, each taken once."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Turns texts into keys of their words and sets of hashed shingles."""

    def __init__(self) -> None:
        self.hashes = WordHashes()

    def __call__(self, text: str | None) -> tuple[bytes, np.ndarray]:
        words = (text or "").encode("utf-8", "surrogatepass").split()  # by space, \t \n \v \f \r
        key = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
        if not words:
            return key, np.zeros(0, np.uint64)
        if len(self.hashes) > 250_000:
            self.hashes.clear()
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        n = min(WORDS, len(words))
        total = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            total += h[k : len(words) - n + 1 + k] * _PLACES[k]
        return key, np.unique(mix(total + np.uint64(n)) >> np.uint64(64 - 8 * TOKEN_BYTES))


def packed(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def unpacked(data: bytes | memoryview) -> np.ndarray:
    few = np.frombuffer(data, np.uint8).reshape(-1, TOKEN_BYTES)
    out = np.zeros((len(few), 8), np.uint8)
    out[:, :TOKEN_BYTES] = few
    return out.view("<u8").ravel().astype(np.uint64)


def sketch(tokens: np.ndarray) -> tuple[int, int]:
    """128 one-bit minhashes, as two signed integers."""
    low = np.full(BITS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), 4096):
        low = np.minimum(low, (tokens[at : at + 4096, None] * _FACTORS).min(axis=0))
    bits = np.packbits((mix(low) & np.uint64(1)).astype(np.uint8)).view(np.int64)
    return int(bits[0]), int(bits[1])


def picks(path: np.ndarray, tokens: np.ndarray, similarity: float) -> np.ndarray:
    """The first paths: those of the tokens that each run, a seed in ``path``, picks."""
    share = SAMPLED / (similarity * max(len(tokens), 1))
    limit = np.uint64(min(int(share * 2**64), 2**64 - 1))
    out = []
    for p, seed in zip(path, mix(path + _GOLD), strict=True):
        chosen = tokens[mix(tokens ^ seed) <= limit]
        out.append(mix(chosen * _MIX1 + p))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def led_on(path: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Each of ``path`` with one more token, that of the least hash there."""
    least = [tokens[np.argmin(mix(tokens ^ seed))] for seed in mix(path + _GOLD)]
    return mix(np.array(least, np.uint64) * _MIX1 + path)


def signed(rows: DataFrame, runs: int, similarity: float) -> DataFrame:
    """For each of ``rows`` (text, then other columns, which stay): key and size of its set,
    sketch, and the paths of the first step."""
    starts = _SEEDS[1000 : 1000 + runs]
    kinds = {"key": pa.binary(), "n": pa.int32(), "s0": pa.int64(), "s1": pa.int64(), "paths": pa.list_(pa.int64())}
    names = [*rows.columns[1:], *kinds]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for b in sliced(batches):
            found = []
            for t in b.column(0).to_pylist():
                key, tokens = shingle(t)
                found.append((key, len(tokens), *sketch(tokens), picks(starts, tokens, similarity).view(np.int64)))
            cols = list(zip(*found, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True))], names=names)

    stay = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(sign, f"{stay}, key binary, n int, s0 long, s1 long, paths array<long>")


def token_sets(docs: DataFrame) -> DataFrame:
    """key and packed tokens, in rising order, of each row's text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for b in sliced(batches):
            keys, tokens = [], []
            for t in b.column(0).to_pylist():
                key, found = shingle(t)
                if len(found):
                    keys.append(key)
                    tokens.append(packed(found))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(tokens, pa.binary())], names=["key", "tokens"])

    return docs.select("text").mapInArrow(sets, "key binary, tokens binary")


@contextmanager
def sets_by_key(docs: DataFrame) -> Iterator[DataFrame]:
    """The token set of each different text, as a table bucketed by key: sets move once,
    and later joins on their keys bring only the other side to them."""
    spark, name = docs.sparkSession, f"tessera_sets_{uuid.uuid4().hex}"
    sets = token_sets(docs).groupBy("key").agg(F.first("tokens").alias("tokens"))
    sets.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").option("path", shared_path(spark, "join-sets")).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def lead_on(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(path, key) of the next step, from (path, key) rows in buckets that are split."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            keys, paths = [], []
            for key, path, tokens in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                found = led_on(path.values.to_numpy().view(np.uint64), unpacked(tokens.as_buffer())).view(np.int64)
                keys += [key] * len(found)
                paths.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(paths) if paths else [], pa.int64()), pa.array(keys, pa.binary())], names=["path", "key"])

    by_key = rows.groupBy("key").agg(F.collect_list("path").alias("paths"))
    return sets.join(by_key.hint("shuffle_hash"), "key").select("key", "paths", "tokens").mapInArrow(split, "path long, key binary")


def buckets(rows: DataFrame, signs: DataFrame, last: bool) -> tuple[DataFrame, DataFrame]:
    """Leaves (path, key, blocks) and the rows (path, key) whose buckets are split on."""
    counts = stored(rows.groupBy("path").agg(F.count("*").alias("many")).filter("many > 1"), "path-counts")
    shared = stored(rows.join(counts, "path"), "path-rows")
    leaves = shared.filter(F.col("many") <= LIMIT).select("path", "key", F.lit(1).alias("blocks"))
    large = shared.filter(F.col("many") > LIMIT)
    blocks = F.ceil(F.col("many") / BLOCK).cast("int").alias("blocks")
    if last:
        return leaves.union(large.select("path", "key", blocks)), large.limit(0).select("path", "key")
    # Mean similarity of all pairs of a bucket, from how often its sets have each of 32
    # bits of the sketches set: two sets agree on a bit with probability (1 + J) / 2.
    share = [F.avg((F.shiftright("s0", i).bitwiseAND(F.lit(1))).cast("double")).alias(f"b{i}") for i in range(32)]
    bits = large.join(signs.select("key", "s0"), "key").groupBy("path").agg(*share)
    mean = sum(2 * (F.col(f"b{i}") ** 2 + (1 - F.col(f"b{i}")) ** 2) - 1 for i in range(32)) / 32
    alike = stored(bits.select("path", (mean >= ALIKE).alias("alike")), "path-alike")
    judged = stored(large.join(alike, "path"), "path-large")
    return leaves.union(judged.filter("alike").select("path", "key", blocks)), judged.filter("not alike").select("path", "key")


# --- brute force inside blocks --------------------------------------------------------


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of whole groups of equal (path, i, j), from sorted batches."""
    kept: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        kept.append(b)
        rows += b.num_rows
        if rows < most:
            continue
        t = pa.Table.from_batches(kept).combine_chunks()
        new = _starts(t)
        cut = int(new[-1]) if len(new) else 0
        if cut:
            yield t.slice(0, cut)
            t = t.slice(cut)
        kept, rows = t.to_batches(), t.num_rows
    if rows:
        yield pa.Table.from_batches(kept).combine_chunks()
    del kept
    pa.default_memory_pool().release_unused()


def _starts(t: pa.Table) -> np.ndarray:
    p, i, j = (t[c].to_numpy() for c in ("path", "i", "j"))
    return np.r_[0, np.flatnonzero((p[1:] != p[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1]


def candidate_pairs(t: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (a, b) of pairs that may be similar and belong to this bucket; group starts."""
    starts = _starts(t)
    size = np.diff(np.r_[starts, t.num_rows])
    left = np.repeat(starts + size, size) - np.arange(t.num_rows) - 1  # rows behind, in the group
    n, block = t["n"].to_numpy().astype(np.int64), t["block"].to_numpy()
    same = t["i"].to_numpy() == t["j"].to_numpy()
    s0, s1 = (t[c].to_numpy().view(np.uint64) for c in ("s0", "s1"))
    p = (1 + similarity) / 2
    least = math.floor(BITS * p - 5 * math.sqrt(BITS * p * (1 - p)))
    found_a, found_b = [], []
    a = np.arange(t.num_rows)
    for d in range(1, int(size.max(initial=0))):
        a = a[left[a] >= d]
        b = a + d
        ok = (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]) - 1e-9) & (same[a] | (block[a] != block[b]))
        x, y = a[ok], b[ok]
        ok = BITS - np.bitwise_count(s0[x] ^ s0[y]) - np.bitwise_count(s1[x] ^ s1[y]) >= least
        found_a.append(x[ok])
        found_b.append(y[ok])
    a = np.concatenate(found_a) if found_a else np.zeros(0, np.int64)
    b = np.concatenate(found_b) if found_b else np.zeros(0, np.int64)
    # a pair that also meets in a lesser bucket belongs there
    path, leaves = t["path"].to_numpy(), t["leaves"]
    lesser: dict[int, set[int]] = {}
    for r in np.unique(np.r_[a, b]).tolist():
        lesser[r] = {x for x in leaves[r].as_py() if x < path[r]}
    ok = np.fromiter((lesser[x].isdisjoint(lesser[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)), bool, len(a))
    return a[ok], b[ok], starts


ROW = "path long, i int, j int, block int, key binary, n int, s0 long, s1 long, leaves array<long>"


def with_partners(rows: DataFrame, similarity: float) -> DataFrame:
    """Those of the ``ROW`` rows that have a possible partner in their block or pair of blocks."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 20_000):
            a, b, _ = candidate_pairs(t, similarity)
            yield from t.take(pa.array(np.unique(np.r_[a, b]))).combine_chunks().to_batches()

    return rows.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j").mapInArrow(search, ROW)


def common_tokens(sets: list[bytes | memoryview], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Size of the intersections of the packed sets a[k] and b[k].

    Many pairs are counted by matrix products over the tokens that several sets have, in
    ranges of the tokens' last byte, so that some ``AT_ONCE`` tokens are unpacked at a time
    however long the texts are.
    """
    if len(a) < 3 * len(sets):
        pairs = ((unpacked(sets[i]), unpacked(sets[j])) for i, j in zip(a, b, strict=True))
        return np.array([len(x) + len(y) - len(np.unique(np.concatenate([x, y]))) for x, y in pairs], np.int64)
    last = [np.frombuffer(s, np.uint8)[TOKEN_BYTES - 1 :: TOKEN_BYTES] for s in sets]
    ranges = min(256, 1 + sum(map(len, last)) // AT_ONCE)
    total = np.zeros((len(sets), len(sets)), np.float64)
    for low, high in itertools.pairwise(np.linspace(0, 256, ranges + 1).astype(np.int64).tolist()):
        cut = [np.searchsorted(x, [low, high]) * TOKEN_BYTES for x in last]
        part = [unpacked(memoryview(s)[i:j]) for s, (i, j) in zip(sets, cut, strict=True)]
        _, which, many = np.unique(np.concatenate(part), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(part)), [len(x) for x in part])
        kept = many[which] > 1
        column = np.cumsum(many > 1) - 1
        row, column = row[kept], column[which[kept]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            s = slice(*np.searchsorted(column, [at, at + 4096]))
            x = np.zeros((len(part), 4096), np.float32)
            x[row[s], column[s] - at] = 1
            total += x @ x.T
    return total[a, b].astype(np.int64)


def verified(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(key, links, root): how many links a set has in a block, and the least set linked there."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 1_000):
            a, b, starts = candidate_pairs(t, similarity)
            n = t["n"].to_numpy().astype(np.int64)
            keys, links = t["key"].to_pylist(), np.zeros(t.num_rows, np.int64)
            parent = list(range(t.num_rows))

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]  # noqa: B023
                    x = parent[x]  # noqa: B023
                return x

            group = np.searchsorted(starts, a, side="right")
            order = np.argsort(group, kind="stable")
            a, b, group = a[order], b[order], group[order]
            for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(group)) + 1):
                if not len(part):
                    continue
                members, at = np.unique(np.r_[a[part], b[part]], return_inverse=True)
                sets = [t["tokens"][int(r)].as_buffer() for r in members]
                common = common_tokens(sets, at[: len(part)], at[len(part) :])
                x, y = a[part], b[part]
                ok = common >= similarity * (n[x] + n[y] - common) - 1e-9
                np.add.at(links, x[ok], 1)
                np.add.at(links, y[ok], 1)
                for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                    i, j = root(i), root(j)
                    if i != j:
                        i, j = (i, j) if keys[i] < keys[j] else (j, i)
                        parent[j] = i
            linked = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[r] for r in linked], pa.binary()), pa.array(links[linked]), pa.array([keys[root(int(r))] for r in linked], pa.binary())], names=["key", "links", "root"]
            )

    full = sets.join(rows.hint("shuffle_hash"), "key").select("path", "i", "j", "block", "key", "n", "s0", "s1", "leaves", "tokens")
    return full.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j").mapInArrow(verify, "key binary, links long, root binary")


def _links(rows: DataFrame, texts: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(key, links, root) of all blocks, from the first paths (path, key)."""
    leaf, deep = buckets(rows, texts, last=False)
    every = leaf
    for depth in range(2, DEPTH + 1):
        if deep.isEmpty():
            break
        leaf, deep = buckets(stored(lead_on(deep, sets), "path-next"), texts, last=depth == DEPTH)
        every = every.union(leaf)
    by_key = every.groupBy("key").agg(F.collect_list(F.struct("path", "blocks")).alias("found"))
    at = by_key.join(texts.select("key", "n", "s0", "s1"), "key").select("*", F.col("found.path").alias("leaves"), F.explode("found").alias("f"))
    block = F.pmod(F.xxhash64("key"), F.col("f.blocks")).cast("int")
    dealt = at.select(F.col("f.path").alias("path"), block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("f.blocks") - 1)).alias("other"), "key", "n", "s0", "s1", "leaves")
    dealt = dealt.select("path", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "n", "s0", "s1", "leaves")
    partners = stored(with_partners(dealt, similarity), "join-partners")
    return stored(verified(partners, sets, similarity), "join-links")


def _classes(docs: DataFrame, signs: DataFrame, similarity: float) -> DataFrame:
    """key, copy_id, class_id, class_key and n_links of each different text in ``signs``."""
    # of equal texts one takes part; equal rows merge before they move
    texts = stored(signs.groupBy("key").agg(F.min("doc_id").alias("copy_id"), F.first(F.struct("n", "s0", "s1", "paths")).alias("x")).select("key", "copy_id", "x.*"), "join-texts")
    rows = texts.filter("n > 0").select(F.explode("paths").alias("path"), "key")
    with sets_by_key(docs) as sets:
        links = _links(rows, texts, sets, similarity)
    roots = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = roots.join(texts.select(F.col("key").alias("node"), "copy_id"), "node")
    least = stored(named.groupBy("root").agg(F.min("copy_id").alias("class_id")), "join-least")
    counted = links.groupBy("key").agg(F.sum("links").alias("n_links"))
    linked = stored(named.join(least, "root").select(F.col("node").alias("key"), "class_id", F.col("root").alias("class_key")).join(counted, "key"), "join-classes")
    found = texts.select("key", "copy_id").join(linked, "key", "left")
    alone = F.col("class_key").isNull()
    return stored(
        found.select("key", "copy_id", F.when(alone, F.col("copy_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_key", "key").alias("class_key"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")),
        "join-found",
    )


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row for each row of ``docs``: doc_id; copy_id, the least id with equal words;
    class_id and class_key, the least id and key of all that links connect; n_links, its
    text's links to different texts."""
    with folders(docs.sparkSession) as own:
        signs = stored(signed(docs.select("text", "doc_id"), runs_for(recall, similarity), similarity), "join-signs")
        found = _classes(docs, signs, similarity)
        return own.keep(stored(signs.select("doc_id", "key").join(found, "key").select("doc_id", "class_id", "copy_id", "n_links", F.lower(F.hex("class_key")).alias("class_key")), "join-rows"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of each class of near copies: that of the least id, null ids
    last, then the first by file and row. Which rows go is decided by their places in files
    alone; so ``docs`` is written first unless it is a plain read of files."""
    docs = on_files(docs, "join-input")
    place, names = places(docs), docs.columns
    file, row = place
    with folders(docs.sparkSession) as own:
        signs = stored(signed(docs.select("text", "doc_id", *[c.alias(k) for k, c in place.items()]), runs_for(recall, similarity), similarity), "join-signs")
        found = _classes(docs, signs, similarity)
        rows = signs.join(found.select("key", "class_key"), "key").select("class_key", F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(file), F.col(row)).alias("at"))
        stays = rows.groupBy("class_key").agg(F.min("at").alias("first"), F.count("*").alias("many")).filter("many > 1")
        gone = own.keep(stored(rows.join(stays, "class_key").filter("at <> first").select(F.col(f"at.{file}").alias(file), F.col(f"at.{row}").alias(row)), "join-gone"))
    return docs.withColumns(place).join(gone, [file, row], "left_anti").select(*names)


def op3_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir))
