"""Joins and unions of byte ranges [start, end)."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlaps(nodes: DataFrame, chunks: DataFrame, document: str = "document_id", width: int = 4096) -> DataFrame:
    """Pairs of a node and a chunk of one document whose ranges overlap.

    Both sides are dealt to every stretch of ``width`` bytes that they touch, so a long
    document is not one key, and each pair is kept in the first stretch that both touch.
    """
    def dealt(df: DataFrame) -> DataFrame:
        last = F.greatest(F.col("end") - 1, F.col("start"))
        return df.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(last / width))))

    a = dealt(nodes.select(document, F.col("node_id"), F.col("start").alias("start"), F.col("end").alias("end"))).select(document, "__cell", "node_id", F.col("start").alias("node_start"), F.col("end").alias("node_end"))
    b = dealt(chunks.select(document, "chunk_id", "start", "end"))
    both = a.join(b, [document, "__cell"]).filter((F.col("node_start") < F.col("end")) & (F.col("start") < F.col("node_end")))
    first = F.floor(F.greatest("node_start", "start") / width)
    return both.filter(F.col("__cell") == first).drop("__cell")


def _level(length: Column) -> Column:
    """The least power of two that is not under ``length``, as its exponent."""
    return F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double"))).cast("int")


def _cell(at: Column, level: Column) -> Column:
    return F.floor(at / F.pow(F.lit(2.0), level)).cast("long")


def containing(points: DataFrame, at: Column, ranges: DataFrame, first: Column, last: Column, keys: list[str]) -> DataFrame:
    """``points`` joined with those ``ranges`` of their keys that begin at ``first`` and end at
    ``last``, both inside, around ``at`` (whole numbers).

    A range lies in at most two cells of the least power of two that holds it; a point
    looks into its one cell of each width that its key has ranges of. So points meet ranges
    about as long as their distance only, and a key is dealt over its cells.
    """
    r = ranges.withColumn("__first", first).withColumn("__last", last).withColumn("__level", _level(F.col("__last") - F.col("__first") + 1))
    r = r.withColumn("__cell", F.explode(F.sequence(_cell(F.col("__first"), F.col("__level")), _cell(F.col("__last"), F.col("__level")))))
    levels = r.groupBy(*keys).agg(F.collect_set("__level").alias("__levels"))  # 63 at most
    p = points.withColumn("__at", at).join(levels, keys).withColumn("__level", F.explode("__levels")).withColumn("__cell", _cell(F.col("__at"), F.col("__level")))
    inside = (F.col("__first") <= F.col("__at")) & (F.col("__at") <= F.col("__last"))
    return p.join(r, [*keys, "__level", "__cell"]).filter(inside).drop("__at", "__levels", "__level", "__cell", "__first", "__last")


def nearest(pairs: DataFrame, most: int = 4) -> DataFrame:
    """Each node's chunks: those that overlap, then by distance of starts, width, start, id."""
    over = (F.col("node_start") < F.col("end")) & (F.col("start") < F.col("node_end"))
    w = Window.partitionBy("node_id").orderBy(F.desc(over), F.abs(F.col("start") - F.col("node_start")), F.col("end") - F.col("start"), "start", "chunk_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def _swept(rows: DataFrame, columns: list[str], order: list[Column], sweep: Callable[[Iterator[tuple]], Iterator[tuple]], out: dict[str, str]) -> DataFrame:
    """What ``sweep`` makes of the rows (their ``columns``; a key first) in ``order`` within each
    key. A column of the result has the type of the one that ``out`` names for it. They
    are dealt by a hash of the key: Spark drops a repartition by the key itself above a union
    whose parts are dealt by it, and then merges the partitions of each part by itself."""
    key = columns[0]
    ordered = rows.filter(F.col(key).isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()).select(columns).repartition(F.xxhash64(key)).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[str, pa.DataType] = {}

        def every() -> Iterator[tuple]:
            for b in batches:
                kinds.update({f.name: f.type for f in b.schema})
                yield from zip(*(b.column(c).to_pylist() for c in columns), strict=True)

        found = sweep(every())
        while part := list(islice(found, 8192)):
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[c]) for v, c in zip(zip(*part, strict=True), out.values(), strict=True)], names=list(out))

    return ordered.mapInArrow(run, ", ".join(f"{name} {ordered.schema[c].dataType.simpleString()}" for name, c in out.items()))


def nearest_chunks(nodes: DataFrame, chunks: DataFrame, most: int = 4, document: str = "document_id") -> DataFrame:
    """``nearest`` of all chunks of each node's document, without pairing them all.

    Nodes and chunks of a document are swept once, by start. Of the chunks that begin no later
    than a node those count that come last, and the last ones that overlap; for those behind it
    a node waits until ``most`` of them overlap, or as many have begun and it has ended. Ranges
    without a start or an end are left out.
    """

    def rank(x: int, e: int, chunk: tuple) -> tuple:
        start, end, i = chunk
        return not (x < end and start < e), abs(start - x), end - start, start, i

    def done(document_: object, node: list) -> Iterator[tuple]:
        i, x, e, some = node[:4]
        for start, end, chunk in sorted(set(some), key=lambda c: rank(x, e, c))[:most]:
            yield document_, i, x, e, chunk, start, end

    def sweep(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, before, active, last, waiting = None, None, [], deque(maxlen=most), []
        for row in rows:
            if row == before:
                continue
            before = row
            document_, is_node, node_id, chunk_id, start, end = row
            if document_ != now:
                for w in waiting:
                    yield from done(now, w)
                now, active, waiting = document_, [], []
                last.clear()
            if is_node:
                over, seen = [], 0
                for c in reversed(active):
                    seen += 1
                    if start < c[1] and c[0] < end:
                        over.append(c)
                        if len(over) == most:
                            break
                if seen > 4 * most + 16:
                    active = [c for c in active if c[1] > start]  # later nodes begin no earlier
                waiting.append([node_id, start, end, [*last, *over], 0, 0, start])
                continue
            chunk, still = (start, end, chunk_id), []
            for w in waiting:
                _, x, e, some, overlapping, behind, at = w
                # the widest of a place comes first, so a place is over where the next begins
                if start != at and (overlapping >= most or (start >= e and behind >= most)):
                    yield from done(now, w)
                    continue
                some.append(chunk)
                if len(some) > 8 * most + 64:
                    some[:] = sorted(some, key=lambda c, x=x, e=e: rank(x, e, c))[:most]
                w[4:] = overlapping + (x < end and start < e), behind + 1, start
                still.append(w)
            waiting = still
            active.append(chunk)
            last.append(chunk)
        for w in waiting:
            yield from done(now, w)

    def part(df: DataFrame, *ids: str) -> DataFrame:
        return df.select(document, F.lit("node_id" in ids).alias("node"), *ids, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))

    every = part(nodes, "node_id").unionByName(part(chunks, "chunk_id"), allowMissingColumns=True)
    order = [F.col("start"), F.col("node"), F.desc("end"), F.desc("chunk_id"), F.col("node_id")]
    pairs = _swept(every, [document, "node", "node_id", "chunk_id", "start", "end"], order, sweep, {document: document, "node_id": "node_id", "node_start": "start", "node_end": "end", "chunk_id": "chunk_id", "start": "start", "end": "end"})
    return nearest(pairs, most)


def smallest_enclosing(chunks: DataFrame, document: str = "document_id") -> DataFrame:
    """(chunk_id, enclosing_id): the narrowest other chunk of the document that holds it.

    The chunks of a document are swept once, by start; those that may still hold a later one
    are kept by width, so that the first wide enough that reaches the end is the narrowest.
    """

    def sweep(rows: Iterator[tuple]) -> Iterator[tuple]:
        now, open_, limit = None, [], 64
        for document_, chunk_id, start, end in rows:
            if document_ != now:
                now, open_, limit = document_, [], 64
            width = end - start
            for i in range(bisect_left(open_, (width + 1,)), len(open_)):
                w, s, enclosing = open_[i]
                if s + w >= max(start, end):
                    yield chunk_id, w, s, enclosing
                    break
            insort(open_, (width, start, chunk_id))
            if len(open_) > limit:  # later chunks begin no earlier
                open_ = [x for x in open_ if x[0] + x[1] >= start]
                limit = 2 * len(open_) + 64

    rows = chunks.select(document, "chunk_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    found = _swept(rows, [document, "chunk_id", "start", "end"], [F.col("start"), F.desc("end")], sweep, {"chunk_id": "chunk_id", "width": "start", "s": "start", "enclosing_id": "chunk_id"})
    return found.groupBy("chunk_id").agg(F.min_by("enclosing_id", F.struct("width", "s", "enclosing_id")).alias("enclosing_id"))


def covered(segments: DataFrame, *keys: str) -> DataFrame:
    """Bytes of each key under any of its ranges, and the sum of their lengths."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.col("start"))), F.lit(0))
    return segments.withColumn("__new", new).groupBy(*keys).agg(F.sum("__new").alias("covered"), F.sum(F.col("end") - F.col("start")).alias("total"))


def overlap_ratio(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Common bytes of two sets of ranges (key, source, start, end) over the smaller total.

    Two ranges overlap if one begins inside the other; those that begin together count once.
    """
    x = a.select(key, "source", F.col("start").alias("s1"), F.col("end").alias("e1")).filter("e1 > s1")
    y = b.select(key, "source", F.col("start").alias("s2"), F.col("end").alias("e2")).filter("e2 > s2")
    cols = [key, "s1", "e1", "s2", "e2"]
    first = containing(x, F.col("s1"), y, F.col("s2"), F.col("e2") - 1, [key, "source"]).select(cols)
    second = containing(y, F.col("s2"), x, F.col("s1"), F.col("e1") - 1, [key, "source"]).filter("s2 > s1").select(cols)
    both = first.unionByName(second).groupBy(key).agg(F.sum(F.least("e1", "e2") - F.greatest("s1", "s2")).alias("common"))
    size = lambda df, n: df.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias(n))
    return size(a, "n1").join(size(b, "n2"), key).join(both, key, "left").select(key, (F.coalesce("common", F.lit(0)) / F.least("n1", "n2")).alias("ratio"))
