"""Secret scanning with one combined deterministic automaton (operator 10).

The rules' regular expressions are parsed, joined into one nondeterministic automaton,
made deterministic by subset construction over classes of bytes, minimised by
partition refinement, and laid out as one flat transition array. A text is read once,
byte by byte, whatever the number of rules; accepting states tell for each rule where
a match may end. The start of a match is then found by running the automaton of the
reversed rule back from there.

Matches of a rule are leftmost, longest and do not overlap; what a rule's filter
(a least length) drops is consumed all the same. The rules must be such that all
matches from one start are prefixes of each other and end where a run of accepting
positions ends; this holds for every rule that ends in a repeated class, and for
rules of fixed length whose match can't be extended.

A rule may have a tail: the automaton finds the header of a private key, and the match
then runs on through the key to its END line, or, where that is cut off, through the
lines that are base64.

Edge cases: a null or empty text has no secrets; long texts are read whole, in one
pass; offsets are code points, end exclusive; repeated rows give repeated results;
columns of the input other than the text and the id are not touched.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import documents, sliced

ALL = frozenset(range(256))
TAIL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


#: The lines that enclose a private key (RFC 7468, OpenPGP and SSH2 forms).
_KEY = "([A-Z0-9]+ )*PRIVATE KEY"
KEY_BEGIN, KEY_END = (f"(-----{x} {_KEY}( BLOCK)?-----|---- {x} {_KEY} ----)" for x in ("BEGIN", "END"))
#: What ends the search for the END line: itself (``end``), or that something else begins.
KEY_CLOSED = f"(?P<end>{KEY_END})|---- ?BEGIN "
#: A key whose END line is cut off: fields, long runs of base64, and short last lines, with
#: white space (also as escapes) and the marks of quoted, commented and joined lines between.
_GAP = r"""(?:\\[nrt]|[\s"'`,;>#*\\])"""
KEY_OPEN = rf"""(?:{_GAP}++[A-Za-z0-9-]+:\x20[^\r\n\\]*+)*+(?:{_GAP}*+[A-Za-z0-9+/=]{{16,}}+)++(?:{_GAP}++[A-Za-z0-9+/=]{{1,15}}+(?=[\x20\t]*+(?:[\r\n\\"'`]|\Z))){{0,2}}"""


@dataclass(frozen=True)
class Rule:
    """kind; the pattern (ASCII, see ``parse``); a regular expression with a group
    ``v`` for what is measured (default: the whole match) and its least length; regular
    expressions of the tail: what closes it, and how far it goes if nothing does."""

    kind: str
    pattern: str
    least: int = 1
    measured: str | None = None
    ignore_case: bool = False
    closed: str | None = None
    open: str | None = None


#: The rules whose kinds and limits are fixed, then those that the method adds.
BASE_KINDS = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 8, r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?P<v>[A-Za-z0-9+/_.=-]+)""", True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{8}[0-9a-f]*", 32),  # runs under 8 would only be dropped
    Rule("forge_token", r"(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]+", 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("pay_key", r"(sk|rk)_live_[A-Za-z0-9]+", 24),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", KEY_BEGIN, 1, closed=KEY_CLOSED, open=KEY_OPEN),
)


# --- regular expressions -> nondeterministic automata ---------------------------------


def parse(pattern: str, ignore_case: bool = False) -> tuple:
    """Syntax tree of a pattern: literals, \\xHH and escaped characters, [classes],
    (groups), |, and the repeats ? * + {n}."""
    at = 0

    def folded(chars: Iterable[int]) -> frozenset[int]:
        s = set(chars)
        if ignore_case:
            s |= {ord(chr(c).swapcase()) for c in s if chr(c).isascii() and chr(c).isalpha()}
        return frozenset(s)

    def char() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return ord({"n": "\n", "t": "\t"}.get(c, c))

    def one() -> tuple:
        nonlocal at
        if pattern[at] == "(":
            at += 1
            tree = union()
            at += 1
            return tree
        if pattern[at] == "[":
            at += 1
            chars: set[int] = set()
            while pattern[at] != "]":
                low = char()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    chars.update(range(low, char() + 1))
                else:
                    chars.add(low)
            at += 1
            return ("set", folded(chars))
        return ("set", folded([char()]))

    def row() -> tuple:
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            tree = one()
            while at < len(pattern) and pattern[at] in "?*+{":
                mark = pattern[at]
                at += 1
                if mark == "{":
                    end = pattern.index("}", at)
                    tree, at = ("row", [tree] * int(pattern[at:end])), end + 1
                else:
                    tree = (mark, tree)
            parts.append(tree)
        return ("row", parts)

    def union() -> tuple:
        nonlocal at
        ways = [row()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            ways.append(row())
        return ways[0] if len(ways) == 1 else ("any", ways)

    return union()


def reversed_tree(tree: tuple) -> tuple:
    kind, x = tree
    if kind == "set":
        return tree
    if kind == "row":
        return ("row", [reversed_tree(t) for t in reversed(x)])
    if kind == "any":
        return ("any", [reversed_tree(t) for t in x])
    return (kind, reversed_tree(x))


class Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.accepts: dict[int, int] = {}

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Adds ``tree`` behind ``start``; returns the state in which it ends."""
        kind, x = tree
        if kind == "set":
            end = self.state()
            self.moves[start].append((x, end))
        elif kind == "row":
            end = start
            for t in x:
                end = self.add(t, end)
        elif kind == "any":
            end = self.state()
            for t in x:
                s = self.state()
                self.empty[start].append(s)
                self.empty[self.add(t, s)].append(end)
        else:
            s, end = self.state(), self.state()
            self.empty[start].append(s)
            e = self.add(x, s)
            self.empty[e].append(end)
            if kind in "*+":
                self.empty[e].append(s)
            if kind in "?*":
                self.empty[start].append(end)
        return end


@dataclass(frozen=True)
class Automaton:
    """``classes`` maps a byte to its class; ``table[state + class]`` is the next state
    (a multiple of the number of classes). States from ``first`` on accept;
    ``rules[state // width]`` is the set of rules that they accept."""

    classes: bytes
    width: int
    table: list[int]
    first: int
    rules: list[frozenset[int]]
    start: int

    def __reduce__(self):
        return Automaton.of, (self.classes, self.width, array("i", self.table), self.first, self.rules, self.start)

    @classmethod
    def of(cls, classes: bytes, width: int, table: Iterable[int], first: int, rules: list[frozenset[int]], start: int) -> Automaton:
        """One int object a state keeps the table small enough for a CPU's cache."""
        offset = [i * width for i in range(len(rules))]
        return cls(classes, width, [offset[t // width] for t in table], first, rules, start)


def compile_rules(trees: list[tuple], search: bool) -> Automaton:
    """Subset construction and minimisation. ``search``: a match may start anywhere."""
    nfa = Nfa()
    root = nfa.state()
    for k, tree in enumerate(trees):
        s = nfa.state()
        nfa.empty[root].append(s)
        nfa.accepts[nfa.add(tree, s)] = k

    # bytes that no set tells apart are one class
    of = [0] * 256
    for chars in {c for m in nfa.moves for c, _ in m}:
        ids: dict[tuple[int, bool], int] = {}
        of = [ids.setdefault((of[b], b in chars), len(ids)) for b in range(256)]
    width = max(of) + 1
    sample = [of.index(c) for c in range(width)]

    def closed(states: Iterable[int]) -> frozenset[int]:
        out, todo = set(), list(states)
        while todo:
            if (s := todo.pop()) not in out:
                out.add(s)
                todo += nfa.empty[s]
        return frozenset(out)

    begin = closed([root])
    sets, todo, rows = {begin: 0}, [begin], []
    while todo:
        here = todo.pop(0)
        row = []
        for b in sample:
            to = closed([t for s in here for chars, t in nfa.moves[s] if b in chars] + [root] * search)
            if to not in sets:
                sets[to] = len(sets)
                todo.append(to)
            row.append(sets[to])
        rows.append(row)
    accepts = [frozenset(nfa.accepts[s] for s in states if s in nfa.accepts) for states in sets]

    # minimise: split blocks until all states of a block move to the same blocks
    names: dict = {}
    block = [names.setdefault(a, len(names)) for a in accepts]
    while True:
        names = {}
        finer = [names.setdefault((block[s], *(block[t] for t in rows[s])), len(names)) for s in range(len(rows))]
        if len(names) == len(set(block)):
            break
        block = finer
    member = {block[s]: s for s in reversed(range(len(rows)))}
    order = sorted(member, key=lambda b: (bool(accepts[member[b]]), member[b]))
    number = {b: i for i, b in enumerate(order)}
    table = [number[block[t]] * width for b in order for t in rows[member[b]]]
    rules = [accepts[member[b]] for b in order]
    first = sum(not a for a in rules) * width
    return Automaton.of(bytes(of), width, table, first, rules, number[block[0]] * width)


# --- scanning -------------------------------------------------------------------------


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        trees = [parse(r.pattern, r.ignore_case) for r in rules]
        self.all = compile_rules(trees, search=True)
        self.alone = [compile_rules([t], search=True) for t in trees]
        self.back = [compile_rules([reversed_tree(t)], search=False) for t in trees]
        self.dead = [next((s for s in range(0, a.first, a.width) if all(t == s for t in a.table[s : s + a.width])), None) for a in self.back]
        self.measured = [r.measured and re.compile(r.measured.encode(), re.I * r.ignore_case) for r in rules]
        self.tails = [r.closed and (re.compile(r.closed.encode()), re.compile(r.open.encode())) for r in rules]

    @staticmethod
    def runs(dfa: Automaton, data: bytes, offset: int = 0) -> dict[int, list[list[int]]]:
        """For each rule, the runs [first, last] of positions just after which it accepts."""
        state, table, first, width = dfa.start, dfa.table, dfa.first, dfa.width
        found: dict[int, list[list[int]]] = defaultdict(list)
        for at, c in enumerate(data.translate(dfa.classes)):
            state = table[state + c]
            if state >= first:
                for k in dfa.rules[state // width]:
                    runs = found[k]
                    if runs and runs[-1][1] == at + offset - 1:
                        runs[-1][1] = at + offset
                    else:
                        runs.append([at + offset, at + offset])
        return found

    def start(self, k: int, data: bytes, at: int, least: int) -> int | None:
        """The leftmost start, from ``least`` on, of a match of rule k that ends with byte ``at``."""
        dfa = self.back[k]
        state, table, first, classes, found = dfa.start, dfa.table, dfa.first, dfa.classes, None
        dead = self.dead[k]
        for i in range(at, least - 1, -1):
            state = table[state + classes[data[i]]]
            if state >= first:
                found = i
            elif state == dead:
                break
        return found

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, of all matches that the rules' filters keep, by start."""
        kept = []
        for k, runs in self.runs(self.all, data).items():
            done = 0  # end of the match before
            for first, last in runs:
                todo = [(first, last)]
                while todo:
                    a, z = todo.pop(0)
                    if z < done:
                        continue
                    s = self.start(k, data, a, done)
                    if s is None:
                        # the run began with a match that overlaps the one before: read this
                        # stretch again, as the rule alone would from where that one ended
                        again = self.runs(self.alone[k], data[done : z + 1], done).get(0, [])
                        todo = [(x, y) for x, y in again if self.start(k, data, x, done) is not None]
                        continue
                    done = self._through(k, data, z + 1)
                    if self._long_enough(k, data[s:done]):
                        kept.append((s, done, k))
        return sorted(kept)

    def _through(self, k: int, data: bytes, end: int) -> int:
        """Where a match of rule k whose pattern ends at ``end`` ends with its tail."""
        if not self.tails[k]:
            return end
        closed, still_open = self.tails[k]
        if (m := closed.search(data, end)) and m["end"]:
            return m.end()
        return m.end() if (m := still_open.match(data, end)) else end

    def _long_enough(self, k: int, match: bytes) -> bool:
        measured = self.measured[k]
        return len(measured.fullmatch(match)["v"] if measured else match) >= self.rules[k].least

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) in code points."""
        data = (text or "").encode("utf-8", "surrogatepass")
        found = self.scan(data)
        if not found or len(data) == len(text):
            return [(s, e, self.rules[k].kind) for s, e, k in found]
        places, at, points = {}, 0, 0
        for p in sorted({x for s, e, _ in found for x in (s, e)}):
            points += len(data[at:p].decode("utf-8", "surrogatepass"))
            at = p
            places[p] = points
        return [(places[s], places[e], self.rules[k].kind) for s, e, k in found]


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """The driver compiles a set of rules once and broadcasts the tables (a few MB, by the rules alone)."""
    return Scanner(rules)


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, and spans: array of (start, end, kind) in code points, by start, then by rule."""
    compiled = docs.sparkSession.sparkContext.broadcast(scanner(rules))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = compiled.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for b in sliced(batches):
            found = [[{"start": x, "end": y, "kind": k} for x, y, k in s.spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["key", "spans"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(scan, f"key {kind}, spans array<struct<start:bigint,end:bigint,kind:string>>").withColumnRenamed("key", key)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``<kind>``; all columns stay.

    ``n_chars``, where there is one, follows the text. Null texts stay null.
    """
    names = docs.columns
    compiled = docs.sparkSession.sparkContext.broadcast(scanner(rules))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = compiled.value
        at = names.index("text")
        for b in sliced(batches):
            texts = b.column(at).to_pylist()
            for i, t in enumerate(texts):
                if t and (found := s.spans(t)):
                    out, end = [], 0
                    for x, y, kind in found:
                        if y > end:
                            out += [t[end:x], f"<{kind}>"] if x >= end else []
                            end = y
                    texts[i] = "".join(out) + t[end:]
            columns = b.columns
            columns[at] = pa.array(texts, b.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                old = columns[k].to_pylist()
                columns[k] = pa.array([o if t is None else len(t) for o, t in zip(old, texts, strict=True)], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(clean, docs.schema)


def _digested(spans: list[tuple[int, int, str]], kinds: tuple[str, ...]) -> str:
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted((x for x in spans if x[2] in rank), key=lambda x: (x[0], rank[x[2]])))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: counts and digest of the base kinds, and all spans."""
    found = secret_spans(documents(spark, sf_dir))
    kinds = [r.kind for r in RULES]
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])

    def joined(spans):
        by = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(by, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
