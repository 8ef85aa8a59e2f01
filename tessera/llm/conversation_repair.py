"""Conversation structure repair (operator 12): the cheapest edits that make a conversation
whole, by dynamic programming over a time-major tensor.

A whole conversation is empty, or has an optional system turn and then pairs of user and
assistant: ``(s?(ua)+)?`` over the initials of its roles. Edits of a row are Keep (0), Rerole
to user or assistant (3) and Delete (4, the only one for blank and repeated rows); Insert adds
an empty turn anywhere (3); a truncated row that stays costs 3 more. Of the cheapest edits those
count whose initials, in order, are least in ASCII.

* Rows find their place in a conversation by a window, which spills; what an edit depends on is
  one byte a row.
* A task streams these bytes in order, gathers conversations up to ``CELLS`` rows, buckets them
  by length (powers of two, so padding at most doubles a bucket) and lays each bucket out with
  time first. Costs to the end are updated for all conversations of a bucket at once, turn by
  turn from the last, and kept; edits are then traced from the first turn on, again for all
  conversations at once. A conversation has some 20 bytes a row in a task and no texts.
* Edits and rows meet in one stream, ordered by place, which writes repaired rows; digests are
  taken from that stream as it passes. Texts of a conversation are never gathered.

Edge cases: nulls of any column read as one space, so null roles start no known initial and null
texts are blank; rows without a turn come first; rows of equal turn follow by role and text, so
their order is defined; equal rows are repeats but for the first; a null ``conv_id`` is a
conversation of its own; one without rows after damage has zeros, no edits and the hash of the
empty string; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._common import SPACE_CHARS, batched, runs, sliced, stored

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows that a task solves at once.
CELLS = 1 << 20
NEVER = 1 << 30
#: States: nothing yet, behind system, behind user, behind assistant. The last column of costs
#: is a state that is never left.
START, SYSTEM, USER, ASSISTANT, NOWHERE = range(5)
#: Where a kept row leads, by state and by its initial's class (s, u, a, other).
KEPT = np.array([[SYSTEM, USER, NOWHERE, NOWHERE], [NOWHERE, USER, NOWHERE, NOWHERE], [NOWHERE, NOWHERE, ASSISTANT, NOWHERE], [NOWHERE, USER, NOWHERE, NOWHERE]])
#: Where a changed or inserted turn leads: user, or assistant behind user.
MADE = np.array([USER, USER, ASSISTANT, USER])
CLASSES = {"s": 0, "u": 1, "a": 2}
ROWS = pa.schema([("key", pa.string()), ("role", pa.string()), ("text", pa.string())])
HASHES = pa.schema([("key", pa.string()), ("sha256", pa.string())])
#: Bits of a row's byte: its initial's class, must go, truncated.
CLASS, GOES, CUT = 3, 4, 8


def costs(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """[t, conversation, state]: the least cost from turn t to the end. ``codes``: [t, conversation]."""
    steps, n = codes.shape
    end = np.full(5, NEVER, np.int32)
    end[[START, SYSTEM, USER, ASSISTANT]] = 0, 2 * INSERT, INSERT, 0
    out = np.empty((steps + 1, n, 5), np.int32)
    out[steps] = end
    who = np.arange(n)[:, None]
    for t in range(steps - 1, -1, -1):
        code, after = codes[t], out[t + 1]
        extra = np.where(code & CUT, TRUNCATED, 0)[:, None]
        stays = np.minimum(after[who, KEPT[:, code & CLASS].T], REROLE + after[:, MADE]) + extra
        best = np.minimum(DELETE + after[:, :4], np.where((code & GOES)[:, None] > 0, NEVER, stays))
        user, assistant = best[:, USER].copy(), best[:, ASSISTANT].copy()
        best[:, USER] = np.minimum(user, INSERT + assistant)
        best[:, ASSISTANT] = np.minimum(assistant, INSERT + user)
        best[:, :USER] = np.minimum(best[:, :USER], INSERT + best[:, USER, None])
        out[t, :, :4], out[t, :, 4] = np.minimum(best, NEVER), NEVER
        over = t >= lengths
        out[t, over] = end
    return out


def trace(codes: np.ndarray, lengths: np.ndarray, cost: np.ndarray) -> list[str]:
    """The edits of each conversation: at every turn the least initial that stays cheapest."""
    steps, n = codes.shape
    text, at = np.zeros((n, 3 * steps + 4), np.uint8), np.zeros(n, np.int64)
    state = np.full(n, START)
    for t in range(steps + 1):
        open_ = np.flatnonzero(t <= lengths)
        while len(open_):
            s, row = state[open_], t < lengths[open_]
            now = cost[t, open_, s]
            after = cost[min(t + 1, steps), open_]
            code = codes[min(t, steps - 1), open_] if steps else np.zeros(len(open_), np.uint8)
            k, who = KEPT[s, code & CLASS], np.arange(len(open_))
            extra = np.where(code & CUT, TRUNCATED, 0)
            delete = row & (DELETE + after[who, s] == now)
            insert = ~delete & (INSERT + cost[t, open_, MADE[s]] == now)
            keep = ~delete & ~insert & row & ((code & GOES) == 0) & (extra + after[who, k] == now) & (k != NOWHERE)
            rerole = row & ~delete & ~insert & ~keep
            for chosen, letter in ((delete, b"D"), (insert, b"I"), (keep, b"K"), (rerole, b"R")):
                to = open_[chosen]
                text[to, at[to]] = letter[0]
                at[to] += 1
            state[open_[keep]] = k[keep]
            made = insert | rerole
            state[open_[made]] = MADE[s[made]]
            open_ = open_[insert]
    return [text[i, : at[i]].tobytes().decode() for i in range(n)]


def solved(conversations: list[np.ndarray]) -> list[tuple[int, str]]:
    """(cost, edits) of conversations, each given as a byte a row."""
    lengths = np.array([len(c) for c in conversations], np.int64)
    classes = np.frexp(lengths.astype(float))[1]
    out: list[tuple[int, str]] = [(0, "")] * len(conversations)
    for k in np.unique(classes):
        members = np.flatnonzero(classes == k)
        codes = np.zeros((int(lengths[members].max()), len(members)), np.uint8)
        for j, i in enumerate(members):
            codes[: lengths[i], j] = conversations[i]
        cost = costs(codes, lengths[members])
        for i, c, edits in zip(members, cost[0, :, START].tolist(), trace(codes, lengths[members], cost), strict=True):
            out[i] = c, edits
    return out


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, cost, edits) of rows (key, place, code) that come by key and place."""
    keys: list[str] = []
    parts: list[list[np.ndarray]] = []
    cells = 0

    def flush(last: int) -> pa.RecordBatch:
        found = solved([np.concatenate(p) for p in parts[:last]])
        out = pa.RecordBatch.from_pydict({"key": keys[:last], "cost": [c for c, _ in found], "edits": [e for _, e in found]}, pa.schema([("key", pa.string()), ("cost", pa.int64()), ("edits", pa.string())]))
        del keys[:last], parts[:last]
        return out

    for new, key, b in runs(batches, "key"):
        if new:
            if cells >= CELLS:
                yield flush(len(keys))
                cells = 0
            keys.append(key)
            parts.append([])
        parts[-1].append(b["code"].to_numpy().astype(np.uint8))
        cells += b.num_rows
    if keys:
        yield flush(len(keys))


def key_of(column: str = "conv_id") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """key, turn, role, text, copy: faults planted in rows by a checksum of their place."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    pick = F.crc32(F.concat(key_of(), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select(key_of().alias("key"), "turn", spaced("role").alias("role"), spaced("text").alias("text"), pick.alias("pick")).filter("pick <> 0")
    text = F.when(F.col("pick") == 1, "").when(F.col("pick") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("pick") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("pick") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("key", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` (key, turn, role, text) with their place, fault (blank, duplicate, truncated
    or none), whether their step from the row before is illegal, whether their turn is new,
    and the byte that edits depend on."""
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    w = Window.partitionBy("key").orderBy(*order)
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    initial = F.substring("role", 1, 1)
    before = F.lag("initial").over(w)
    r = rows.withColumn("initial", initial).select("key", "turn", "role", "text", "initial", F.row_number().over(w).alias("place"), before.alias("before"), (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(w))).alias("new_turn"), same.alias("same"))
    r = r.withColumn("again", F.row_number().over(Window.partitionBy("key", "same").orderBy("place")) > 1)
    ends = F.substring(F.rtrim("text", F.lit(SPACE_CHARS)), -1, 1)
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.col("again"), "duplicate").when(~ends.isin(".", "!", "?"), "truncated").otherwise("none")
    r = r.withColumn("fault", fault)
    illegal = (F.col("place") > 1) & ~F.concat("before", "initial").isin("su", "ua", "au")
    kind = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    code = kind + F.when(F.col("fault").isin("blank", "duplicate"), GOES).otherwise(0) + F.when(F.col("fault") == "truncated", CUT).otherwise(0)
    return r.select("key", "turn", "role", "text", "place", "new_turn", "fault", illegal.alias("illegal"), code.cast("byte").alias("code"))


def edits(rows: DataFrame) -> DataFrame:
    """(key, cost, edits) of each conversation in ``rows`` (key, place, code)."""
    return rows.select("key", "place", "code").repartition("key").sortWithinPartitions("key", "place").mapInArrow(_solve, "key string, cost long, edits string")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, str]]:
    """Repaired rows of a stream in which each row follows its edits."""
    state, edit = START, ""
    made = lambda: "user" if state == USER else "assistant"
    for new, key, b in runs(batches, "key"):
        if new:
            state = START
        for todo, role, text in zip(b["edits"].to_pylist(), b["role"].to_pylist(), b["text"].to_pylist(), strict=True):
            if todo is not None:
                for _ in range(todo.count("I")):
                    state = MADE[state]
                    yield key, made(), ""
                edit = todo[-1]
            elif edit == "K":
                state = KEPT[state, CLASSES.get(role[:1], 3)]
                yield key, role, text
            elif edit == "R":
                state = MADE[state]
                yield key, made(), text


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """key, role, text: the rows of each conversation after its edits. Those of a conversation
    lie in one partition, in order."""
    steps = found.select("key", F.posexplode(F.regexp_extract_all("edits", F.lit("I*[DKR]|I+$"), F.lit(0))).alias("at", "edits"))
    steps = steps.select("key", (F.col("at") + 1).alias("place"), F.lit(0).alias("kind"), "edits", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    both = steps.unionByName(rows.select("key", "place", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("edits"), "role", "text"))
    return both.repartition("key").sortWithinPartitions("key", "place", "kind").mapInArrow(lambda batches: batched(_apply(sliced(batches)), ROWS), "key string, role string, text string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    """(key, sha256) of ``role:text``, joined by newlines, of rows in order."""
    last, h, between = None, hashlib.sha256(), ""
    for new, key, b in runs(batches, "key"):
        if new:
            if last is not None:
                yield last, h.hexdigest()
            last, h, between = key, hashlib.sha256(), ""
        for role, text in zip(b["role"].to_pylist(), b["text"].to_pylist(), strict=True):
            h.update(f"{between}{role}:{text}".encode())
            between = "\n"
    if last is not None:
        yield last, h.hexdigest()


def audit(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each ``conv_id`` of ``conversations``: what is wrong with its ``rows`` (key,
    turn, role, text), what its repair costs, the edits, and a hash of the repaired rows."""
    rows = stored(marked(rows), "repair-rows")
    found = stored(edits(rows), "repair-edits")
    n = lambda c: F.count(F.when(c, 1))
    wrong = rows.groupBy("key").agg(
        (F.max("turn") - F.min("turn") + 1 - n(F.col("new_turn"))).alias("gaps"), *[n(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], n(F.col("illegal")).alias("illegal")
    )
    hashes = repaired(rows, found).mapInArrow(lambda batches: batched(_digest(batches), HASHES), "key string, sha256 string")
    every = conversations.groupBy(key_of().alias("key")).agg(F.first("conv_id").alias("conv_id"))
    out = every.join(wrong, "key", "left").join(found, "key", "left").join(hashes, "key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("edits", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return audit(conversations, damaged(conversations))
