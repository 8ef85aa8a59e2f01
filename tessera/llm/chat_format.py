"""Chat formatting (operator 11): records of many layouts become marked-up turns.

A record is a JSON text. Its nested field paths (``$.messages[].role:string``) are hashed to a
fingerprint, which selects a declarative mapping, a ``Layout``: which fields it needs, and by
which rules turns are read from them. A task resolves a fingerprint once, however many records
share it. Records that no mapping fits, or that aren't JSON, come out with no layout, so that
they can be counted by fingerprint and a mapping be written for them; none is dropped.

The template marks a turn as ``<|im_start|>role``, newline, text, ``<|im_end|>``, newline. Texts
keep no control string: each ``<`` with any backslashes and ``|`` behind it gets one backslash
more, and reading takes one away. Roles escape ``%``, newline and ``<`` by their hex code. The
loss mask is a span of each assistant text, in code points of its piece, without the marks.

A conversation is as many pieces as it has turns, in order; no task gathers one. Records of a
long conversation hold ``RUN`` turns each, as an export in pages would.

Edge cases: null roles and texts read as empty; rows without a turn come first, rows of equal
turn follow by role and text; roles other than user, assistant and system stay as they are;
rows of conversation -1 in the table come with those added; a null ``conv_id`` is a
conversation of its own; an empty table gives conversation -1 alone; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tessera.llm._common import batched, runs, sliced, stored

#: The marks of the template, and the turns that every run formats besides the table's.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PROBE = [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]
#: Turns of a record; even, so that pairs don't straddle two.
RUN = 64


@dataclass(frozen=True)
class Layout:
    """How turns lie in records: it fits records that have all fields of ``needs``.

    Rules, in order: ("one", role, field) a text, if the field is there; ("joined", role,
    fields) texts with a blank line between, empty ones left out; ("each", list, role field,
    text field) a turn an element; ("pairs", list) user and assistant in turn.
    """

    name: str
    needs: frozenset[str]
    rules: tuple[tuple, ...]
    names: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Layout("messages", frozenset({"$.messages[].role", "$.messages[].content"}), (("each", "messages", "role", "content"),)),
    Layout("parts", frozenset({"$.messages[].role", "$.messages[].content[].text"}), (("each", "messages", "role", "content"),)),
    Layout("shared", frozenset({"$.conversations[].from", "$.conversations[].value"}), (("one", "system", "system"), ("each", "conversations", "from", "value")), (("human", "user"), ("gpt", "assistant"))),
    Layout("history", frozenset({"$.history[][]", "$.query", "$.response"}), (("one", "system", "system"), ("pairs", "history"), ("one", "user", "query"), ("one", "assistant", "response"))),
    Layout("instruction", frozenset({"$.instruction", "$.output"}), (("one", "system", "system"), ("joined", "user", ("instruction", "input")), ("one", "assistant", "output"))),
    Layout("prompt", frozenset({"$.prompt", "$.completion"}), (("one", "system", "system"), ("one", "user", "prompt"), ("one", "assistant", "completion"))),
)


def field_paths(value: object, at: str = "$") -> set[str]:
    """The nested field paths of a JSON value, each with its kind."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{at}.{k if k.isidentifier() else json.dumps(k)}") for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(field_paths(v, f"{at}[]") for v in value))
    kind = {dict: "object", list: "list", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")
    return {f"{at}:{kind}"}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def layout_of(paths: set[str], layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    """The first layout whose fields are all there."""
    there = {p.rsplit(":", 1)[0] for p in paths}
    return next((x for x in layouts if x.needs <= there), None)


def text_of(value: object) -> str:
    """A text, or the texts of its parts together."""
    if value is None or isinstance(value, str):
        return value or ""
    if isinstance(value, list) and all(isinstance(p, dict) and p.get("type", "text") == "text" for p in value):
        return "".join(text_of(p.get("text")) for p in value)
    raise TypeError("neither text nor parts of text")


def turns_of(record: dict, layout: Layout) -> list[tuple[str, str]]:
    """(role, text) of a record, by the rules of its layout."""
    names, out = dict(layout.names), []
    for kind, *rule in layout.rules:
        if kind == "one" and rule[1] in record:
            out.append((rule[0], text_of(record[rule[1]])))
        elif kind == "joined":
            out.append((rule[0], "\n\n".join(t for f in rule[1] if (t := text_of(record.get(f))))))
        elif kind == "each":
            for turn in record[rule[0]]:
                role = text_of(turn.get(rule[1]))
                out.append((names.get(role, role), text_of(turn.get(rule[2]))))
        elif kind == "pairs":
            for pair in record[rule[0]]:
                user, assistant = pair
                out += [("user", text_of(user)), ("assistant", text_of(assistant))]
    return out


def canonical(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The turns of ``records``, whose column ``record`` is JSON: its other columns and at,
    role, text, layout, fingerprint. A record that no layout fits is one row without layout."""
    rest = [f for f in records.schema.fields if f.name != record]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known: dict[str, Layout | None] = {}
        for b in sliced(batches):
            for source, *carried in zip(*[b[c].to_pylist() for c in (record, *[f.name for f in rest])], strict=True):
                mark = None
                try:
                    value = json.loads(source)
                    mark = fingerprint(paths := field_paths(value))
                    if mark not in known:
                        known[mark] = layout_of(paths, layouts)
                    turns = turns_of(value, known[mark])
                except (TypeError, ValueError, AttributeError, RecursionError):  # null, not JSON, or not what its layout says
                    yield *carried, None, None, None, None, mark
                    continue
                for at, (role, text) in enumerate(turns):
                    yield *carried, at, role, text, known[mark].name, mark

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(rows(batches), schema)

    out = StructType([*rest]).add("at", "integer").add("role", "string").add("text", "string").add("layout", "string").add("fingerprint", "string")
    schema = to_arrow_schema(out)
    return records.mapInArrow(work, out)


def unmapped(turns: DataFrame) -> DataFrame:
    """How many records no layout fits, by fingerprint (null: not JSON)."""
    return turns.filter("layout IS NULL").groupBy("fingerprint").agg(F.count("*").alias("records"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def role_escaped(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def role_unescaped(role: str) -> str:
    return role.replace("%0A", "\n").replace("%3C", "<").replace("%25", "%")


def formatted(turns: DataFrame) -> DataFrame:
    """``turns`` (at, role, text and what names their conversation) with, instead of role and
    text, the piece of the formatted conversation and the span of it that the loss counts."""
    head, body = F.concat(F.lit(OPEN), role_escaped(F.col("role")), F.lit("\n")), escaped(F.col("text"))
    start = F.when(F.col("role") == "assistant", F.length(head))
    return turns.withColumns({"piece": F.concat(head, body, F.lit(f"{CLOSE}\n")), "loss_start": start, "loss_end": start + F.length(body)}).drop("role", "text", "layout", "fingerprint")


TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
READ = pa.schema([("key", pa.string()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """What formatted conversations hold, of pieces that come in order."""
    last, n, all_turns, chars, loss, size = None, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
    for new, key, b in runs(batches, "key"):
        if new:
            if last is not None:
                yield last, n, all_turns.hexdigest(), chars, loss.hexdigest(), size
            last, n, all_turns, chars, loss, size = key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
        for piece, start, end in zip(*[b[c].to_pylist() for c in ("piece", "loss_start", "loss_end")], strict=True):
            at = 0
            while m := TURN.match(piece, at):
                all_turns.update(f"{role_unescaped(m[1])}\n{unescaped(m[2])}\n".encode())
                n, at = n + 1, m.end()
            if at != len(piece):
                raise ValueError("a piece isn't made of whole turns")
            if start is not None:
                text = unescaped(piece[start:end])
                loss.update(text.encode())
                chars += len(text)
            size += len(piece)
    if last is not None:
        yield last, n, all_turns.hexdigest(), chars, loss.hexdigest(), size


def read_back(pieces: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each ``key``, read from its pieces: counts and digests of turns and loss."""
    rows = pieces.select(F.col(key).alias("key"), *order, "piece", "loss_start", "loss_end").repartition("key").sortWithinPartitions("key", *order)
    return rows.mapInArrow(lambda batches: batched(_read(sliced(batches)), READ), "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def records_of(conversations: DataFrame, run: int = RUN) -> DataFrame:
    """``conversations`` as records (key, part, record) of ``run`` turns at most, in the
    layouts that exports have. A checksum deals them among those that can hold their turns."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key"), "turn", empty("role"), empty("text"))
    w = Window.partitionBy("key").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("at", F.row_number().over(w) - 1).withColumn("part", F.floor(F.col("at") / run).cast("int"))
    parts = rows.groupBy("key", "part").agg(F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("t"))
    roles, texts = F.col("t.role"), F.col("t.text")
    pairs = F.transform(F.filter("t", lambda x: x["at"] % 2 == 0), lambda x: F.array(x["text"], F.get(texts, (x["at"] % run) + 1)))
    last = F.size("t") - 1
    alternate = (F.size("t") % 2 == 0) & F.forall("t", lambda x: x["role"] == F.when(x["at"] % 2 == 0, "user").otherwise("assistant"))
    known = F.forall("t", lambda x: x["role"].isin("system", "user", "assistant"))
    names = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    messages = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    parted = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), x["text"].alias("text"))).alias("content"))).alias("messages")))
    shared = F.to_json(F.struct(F.transform("t", lambda x: F.struct(names(x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations")))
    history = F.to_json(F.struct(F.slice(pairs, 1, F.size(pairs) - 1).alias("history"), F.get(texts, last - 1).alias("query"), F.get(texts, last).alias("response")))
    first = F.get(texts, F.lit(0))
    instruction = F.to_json(F.struct(F.when(F.size("t") == 3, first).alias("system"), F.get(texts, last - 1).alias("instruction"), F.lit("").alias("input"), F.get(texts, last).alias("output")))
    prompt = F.to_json(F.struct(first.alias("prompt"), F.get(texts, F.lit(1)).alias("completion")))
    two = roles == F.array(F.lit("user"), F.lit("assistant"))
    three = roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    deal = F.crc32(F.concat("key", F.lit(":"), F.col("part").cast("string")).cast("binary"))
    record = (
        F.when((two | three) & (deal % 2 == 0), instruction).when(two, prompt).when(alternate & (F.size("t") > 2) & (deal % 2 == 0), history).when(known & (deal % 3 == 0), shared).when(deal % 3 == 1, parted).otherwise(messages)
    )
    return parts.select("key", "part", record.alias("record"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = table.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))
    pieces = stored(formatted(canonical(records_of(rows))), "chat-pieces")
    ids = rows.groupBy(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key")).agg(F.first("conv_id").alias("conv_id"))
    return ids.join(read_back(pieces, "key", "part", "at"), "key").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


OP11_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'),
p AS (
  SELECT *, replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C') AS r, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS t FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length(r) + 1 + length(t) + 10 + 1)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
