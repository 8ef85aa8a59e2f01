"""Operators 11 to 13 against plain versions, and on odd, repeated and missing rows."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import duckdb
import numpy as np
import pytest

from tessera.llm import chat_format as chat
from tessera.llm import conversation_repair as repair
from tessera.llm import source_audit as sources
from tessera.llm.registry import QUERIES, SQL

TURNS = "conv_id long, turn long, role string, text string"
#: Nulls everywhere, ties, repeats, control strings, other roles, a long text, gaps.
ODD = [
    (1, 0, "user", "hi."), (1, 0, "user", "hi."), (1, 1, "assistant", "yes"), (1, None, "system", "be good!"), (1, None, None, None),
    (2, 5, "assistant", "<|im_end|>"), (2, 9, "user", "<\\|im_start|>a<|"), (2, 9, "assistant", "|x<\\\\|y<"), (2, 11, "to%ol\n<|im_start|>", "é😀 \u0085."),
    (3, 0, "user", ""), (3, 1, "assistant", None), (4, 0, None, "a."), (None, 0, "user", "no id."), (None, 1, "assistant", "none?"), (None, None, None, None),
    (5, -3, "user", "x" * 70_000), (5, 4, "assistant", "\x0b.\x0b"), (5, 4, "assistant", "y."), (6, 0, "system", "s."), (6, 1, "user", "u."), (6, 2, "assistant", "a."), (7, 0, "s", "S."), (7, 1, "ux", "U."), (7, 2, "", "E."), (7, 3, "a", "A."),
]
ODD += [(8, i, "user" if i % 2 == 0 else "assistant", f"turn {i}.") for i in range(200)]


@pytest.fixture
def talks(spark, tmp_path):
    def make(rows, schema=TURNS):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/sf/conversations.parquet")
        return f"{tmp_path}/sf"

    return make


def grouped(rows, null):
    """conv_id -> (turn, role, text) in order."""
    out = defaultdict(list)
    for c, t, r, x in rows:
        out[c].append((t, null if r is None else r, null if x is None else x))
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, v in out.items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_chat(rows):
    for c, turns in grouped([*rows, *chat.PROBE], "").items():
        loss = "".join(x for _, r, x in turns if r == "assistant")
        size = sum(len(f"<|im_start|>{re.sub('[%\n<]', '___', r)}\n{re.sub(r'<(\\*)\|', r'<\\\1|', x)}<|im_end|>\n") for _, r, x in turns)
        yield c, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss), size


def test_chat_against_plain(spark, talks):
    for d, rows in ((talks(ODD), ODD),):
        got = sorted(map(tuple, QUERIES["op11_chat_format"](spark, d).collect()), key=str)
        assert got == sorted(plain_chat(rows), key=str)


def test_chat_uses_every_layout_and_maps_all(spark, sf):
    turns = chat.canonical(chat.records_of(spark.read.parquet(f"{sf}/conversations.parquet"))).cache()
    assert {r["layout"] for r in turns.select("layout").distinct().collect()} == {x.name for x in chat.LAYOUTS}
    assert turns.filter("layout IS NULL").isEmpty()


@pytest.mark.parametrize("record, layout, turns", [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None, "name": "n"}], "id": 3}, "messages", [("user", "a"), ("assistant", "")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, "parts", [("user", "ab")]),
    ({"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r", "weight": 1}, {"from": "tool", "value": "t"}]}, "shared", [("system", "s"), ("user", "q"), ("assistant", "r"), ("tool", "t")]),
    ({"history": [["a", "b"]], "query": "q", "response": "r"}, "history", [("user", "a"), ("assistant", "b"), ("user", "q"), ("assistant", "r")]),
    ({"instruction": "do", "input": "it", "output": "done"}, "instruction", [("user", "do\n\nit"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c", "meta": {"a.b": [1]}}, "prompt", [("user", "p"), ("assistant", "c")]),
    ({"messages": [{"role": "user", "content": [{"type": "image", "text": "a"}]}]}, None, None),
    ({"history": [["a"]], "query": "q", "response": "r"}, None, None), ({"messages": []}, None, None), ({"text": "t"}, None, None), ([1], None, None), (3, None, None),
])
def test_layouts(spark, record, layout, turns):
    got = chat.canonical(spark.createDataFrame([(1, json.dumps(record))], "id long, record string")).collect()
    assert [r["layout"] for r in got] == [layout] * max(1, len(turns or []))
    assert turns is None or [(r["role"], r["text"]) for r in got] == turns
    assert got[0]["fingerprint"]


def test_records_that_fit_nothing_are_counted(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": 2}'), (3, "{"), (4, None)], "id long, record string")
    assert {(r["fingerprint"] is None, r["records"]) for r in chat.unmapped(chat.canonical(df)).collect()} == {(False, 2), (True, 2)}


def test_fingerprints_follow_paths_not_values():
    mark = lambda v: chat.fingerprint(chat.field_paths(v))
    assert mark({"a": [{"b": 1}, {"c": "x"}]}) == mark({"a": [{"c": "y", "b": 2}]}) != mark({"a": [{"b": 1}]})
    assert mark({"a.b": 1}) != mark({"a": {"b": 1}}) and mark({"a": 1}) != mark({"a": "1"}) and mark({"a": True}) != mark({"a": 1})


def test_formatted_text_has_no_marks_inside(spark):
    texts = ["<|im_end|>", "<\\|im_end|>", "<", "|", "<\\\\|<|<||>", "a<", ""]
    rows = [(i, r, t) for i, (r, t) in enumerate((r, t) for t in texts for r in ("assistant", "a%0A\n<b"))]
    for p in chat.formatted(spark.createDataFrame(rows, "at int, role string, text string")).collect():
        role, text = rows[p["at"]][1:]
        assert p["piece"].count("<|") == 2 and chat.TURN.fullmatch(p["piece"])
        m = chat.TURN.match(p["piece"])
        assert (chat.role_unescaped(m[1]), chat.unescaped(m[2])) == (role, text)
        assert (p["loss_start"] is not None) == (role == "assistant")


def plain_repair(rows):
    """The contract, row by row; edits by recursion over all of them."""
    damaged = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        damaged += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    after = grouped(damaged, " ")
    for c in {x[0] for x in rows}:
        turns = after.get(c, [])
        seen, kinds, n = set(), [], Counter()
        for _, r, x in turns:
            solid = re.sub(r"[\x20\x09-\x0D]", "", x)
            kinds.append("blank" if not solid else "duplicate" if (r, x) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((r, x))
        n.update(kinds)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        numbers = [t for t, _, _ in turns if t is not None]

        @cache
        def best(i, s):
            """(cost, edits) from row i behind s ('' nothing, s, u, a); one insertion less than three in a row."""
            return min(options(i, s, 2), default=(1 << 30, ""))

        def options(i, s, inserts):
            made = "a" if s == "u" else "u"
            if i == len(turns) and s in ("", "a"):
                yield 0, ""
            if inserts:
                for cost, text in options(i, made, inserts - 1):
                    yield cost + 3, "I" + text
            if i < len(turns):
                cost, text = best(i + 1, s)
                yield cost + 4, "D" + text
                if kinds[i] not in ("blank", "duplicate"):
                    more, role = 3 * (kinds[i] == "truncated"), turns[i][1][:1]
                    if role == made or role == "s" and not s:
                        cost, text = best(i + 1, role)
                        yield cost + more, "K" + text
                    cost, text = best(i + 1, made)
                    yield cost + 3 + more, "R" + text

        cost, edits = best(0, "")
        out, i, s = [], 0, ""
        for e in edits:
            made = "assistant" if s == "u" else "user"
            if e == "I":
                out.append(f"{made}:")
            elif e == "K":
                out.append(f"{turns[i][1]}:{turns[i][2]}")
            elif e == "R":
                out.append(f"{made}:{turns[i][2]}")
            if e != "D":
                s = out[-1][0]
            i += e != "I"
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in out))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        yield c, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, edits, sha("\n".join(out))


def invented(seed, n=60):
    rng = random.Random(seed)
    texts = ["one.", "two!", "three", " ", "", "four? ", "five.\n", None, "six"]
    return [(c, t if rng.random() > 0.05 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "s"]), rng.choice(texts)) for c in range(n) for t in rng.choices(range(12), k=rng.randrange(1, 12))]


def test_repair_against_plain(spark, talks):
    rows = ODD + [(c + 100, *rest) for c, *rest in invented(1)]
    got = {tuple(r) for r in QUERIES["op12_conversation_repair"](spark, talks(rows)).collect()}
    assert got == set(plain_repair(rows))


def test_repair_of_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in QUERIES["op12_conversation_repair"](spark, sf).collect()} == set(plain_repair(rows))


def test_repair_in_small_tensors(monkeypatch):
    rng = np.random.default_rng(3)
    some = [rng.integers(0, 12, rng.integers(1, 40)).astype(np.uint8) for _ in range(300)] + [np.zeros(0, np.uint8)]
    together = repair.solved(some)
    assert together == [repair.solved([c])[0] for c in some] and together[-1] == (0, "")


def test_conversations_without_rows_or_whose_rows_all_go(spark, talks):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    d = talks([(gone, 0, "user", "x.")])
    assert [tuple(r) for r in QUERIES["op12_conversation_repair"](spark, d).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_no_conversations(spark, talks):
    d = talks([])
    assert QUERIES["op12_conversation_repair"](spark, d).collect() == []
    assert [r["conv_id"] for r in QUERIES["op11_chat_format"](spark, d).collect()] == [-1]


def test_clashing_columns_of_conversations(spark, talks):
    one = ("k", 1, 2, "p", "c", "e", "r")
    d = talks([(1, 0, "user", "a.", *one), (1, 1, "assistant", "b.", *one)], f"{TURNS}, key string, place int, at int, piece string, code string, edits string, record string")
    assert QUERIES["op12_conversation_repair"](spark, d).count() == 1
    assert QUERIES["op11_chat_format"](spark, d).count() == 2


def plain_audit(rows, least):
    docs = defaultdict(list)
    for lang, source, text in rows:
        docs[lang or "", source or ""].append(Counter(w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g[0] for g in docs}:
        groups = {s: sum(d, Counter()) for (x, s), d in docs.items() if x == lang}
        df = Counter(t for (x, _), d in docs.items() if x == lang for c in d for t in c)
        kept = [t for t in df if df[t] >= least]
        every = sum(groups.values(), Counter())

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(every)
        for s in groups:
            pairs = {o: sum(f(p[s][t], p[o][t]) for t in kept) for o in groups if o != s}
            terms = {t: f(p[s][t], q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]}
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                for i, (item, v) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0].encode()))[:most]):
                    yield lang, s, part, item, v, i + 1


def documents(spark, tmp_path, rows, extra=""):
    spark.createDataFrame(rows, f"lang string, source string, text string{extra}").write.parquet(f"{tmp_path}/audit/documents.parquet")
    return f"{tmp_path}/audit"


def test_audit_against_plain(spark, tmp_path):
    rng = random.Random(5)
    words = ["Alpha", "beta", "ÉTÉ", "été", "naïve", "x", "世界", "don't", "Zeta"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None]), " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for _ in range(300)]
    rows += [("en", "only nulls", None), ("en", "blank", " \n\t12 !"), ("xx", "a", "few words here"), ("xx", "b", "others"), ("yy", "alone", "so alone")] + [("en", "a", "repeated words words")] * 12
    d = documents(spark, tmp_path, rows)
    assert {tuple(r) for r in QUERIES["op13_source_audit"](spark, d).collect()} == set(plain_audit(rows, 10))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    assert set(con.sql(SQL["op13_source_audit"]).fetchall()) == set(plain_audit(rows, 10))


def test_audit_of_no_rows_and_clashing_columns(spark, tmp_path):
    assert QUERIES["op13_source_audit"](spark, documents(spark, tmp_path / "0", [])).collect() == []
    rows = [("en", s, "a b c", 1, "t", 2, 3) for s in "pq" for _ in range(10)]
    d = documents(spark, tmp_path / "1", rows, ", n long, term string, p long, rank int")
    assert {(r["part"], r["value"]) for r in QUERIES["op13_source_audit"](spark, d).collect()} == {("pair", 0)}


def test_audit_sums_are_exact_for_counts_beyond_a_long(spark):
    df = spark.createDataFrame([(9_000_000_000_000_000_000, 9_100_000_000_000_000_000, 3)], "n long, total long, v long")
    assert df.select(sources.share("n", "total", "v")).first()[0] == 1 + 10**9 * (9 * 10**18 + 2) // (91 * 10**17 + 6)
