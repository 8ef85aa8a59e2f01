"""Scalar functions of the engine, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import DEFAULTS, Ranking, Structural, WorkingSet

#: Letters with marks and what they fold to. Fixed values.
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"

#: Words that a structural query ignores. Fixed values.
STOP_WORDS = ("a", "an", "and", "are", "break", "by", "calls", "change", "changes", "could", "dependencies", "dependents", "does", "for", "how", "if", "implemented", "implements", "in", "is", "of", "on", "references", "tests", "the", "this", "uses", "what", "where", "which", "work")

#: Phrases that give a query's intent, first match first: (intent, any of, and any of).
INTENTS = (
    ("impact", ("could break", "changes if", "change if", "what changes", "impact", "blast radius"), ()),
    ("implementations", ("implement",), ()),
    ("tests", ("test",), ("cover", "which")),
    ("dependents", ("dependents", "depends on this"), ()),
    ("dependencies", ("dependencies", "depends on"), ()),
    ("callers", ("what calls", "callers", "uses"), ()),
    ("callees", ("callees", "does it call"), ()),
)

SOURCE_WEIGHT = {"code": 1.0, "document": 1.0, "task_state": 0.95, "session_state": 0.95, "memory": 0.9, "event": 0.8, "experience": 0.25}
FRESHNESS_WEIGHT = {"current": 1.0, "recent": 0.5, "historical": 0.25, "superseded": 0.0}
FRESHNESS_PRIORITY = {"current": 3, "recent": 2, "historical": 1, "superseded": 0}
REASON_WEIGHT = {"container": 1.0, "caller": 1.0, "callee": 1.0, "implementation": 1.0, "test": 1.0, "neighbor": 0.8, "reference": 0.8, "dependency": 0.8, "impact": 0.7, "related": 0.6}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(x: Column | str, values: dict, default: object) -> Column:
    x = _c(x)
    return reduce(lambda rest, kv: F.when(x == kv[0], kv[1]).otherwise(rest), reversed(list(values.items())), F.lit(default))


# --- vectors and scores ---------------------------------------------------------------


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity in doubles; null for unequal lengths, empty or zero vectors."""
    a, b = _c(a), _c(b)
    d = lambda x: x.cast("double")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: d(x) * d(y)), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + d(x) * d(x)))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b)))


def is_finite_vector(v: Column | str) -> Column:
    return F.forall(_c(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def decayed(score: Column | str, minutes: Column | str, half_life: float = DEFAULTS.working_set.half_life_minutes) -> Column:
    """Exponential decay; the future doesn't count."""
    return _c(score) * F.pow(F.lit(0.5), F.greatest(_c(minutes), F.lit(0.0)) / half_life)


def recency(hours: Column | str, half_life: float = DEFAULTS.recency_half_life_hours) -> Column:
    return F.pow(F.lit(0.5), F.greatest(_c(hours), F.lit(0.0)) / half_life)


def unit(x: Column | str) -> Column:
    """Clamped to 0..1; what is no finite number is 0."""
    x = _c(x).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def activated(score: Column | str, minutes: Column | str, w: WorkingSet = DEFAULTS.working_set) -> Column:
    """A working-set score after one more activation."""
    return F.least(F.lit(w.most), decayed(score, minutes, w.half_life_minutes) + w.increment)


def provenance_weight(source_type: Column | str) -> Column:
    return lookup(source_type, SOURCE_WEIGHT, 0.5)


def freshness_weight(freshness: Column | str) -> Column:
    return lookup(freshness, FRESHNESS_WEIGHT, 0.0)


def freshness_priority(freshness: Column | str) -> Column:
    return lookup(freshness, FRESHNESS_PRIORITY, 0)


def structural_reason_weight(reasons: Column | str) -> Column:
    return F.coalesce(F.array_max(F.transform(_c(reasons), lambda r: lookup(r, REASON_WEIGHT, 0.0))), F.lit(0.0))


def final_score(parts: dict[str, Column], r: Ranking = DEFAULTS.ranking) -> Column:
    """Weighted mean of the parts (missing: 0) over the whole weight."""
    return sum((unit(parts.get(k, F.lit(0.0))) * w for k, w in r.__dict__.items()), F.lit(0.0)) / r.total()


def edge_weight(edge_type: Column | str, s: Structural = DEFAULTS.structural) -> Column:
    kinds = {"calls": s.calls, "references": s.references, "uses_type": s.references, "constructs": s.references, "implements": s.implementations, "extends": s.implementations, "overrides": s.implementations, "tests": s.tests, "imports": s.dependencies, "depends_on": s.dependencies}
    return lookup(edge_type, kinds, s.other)


def path_score(edge_types: Column | str, confidence: Column | str, s: Structural = DEFAULTS.structural) -> Column:
    """confidence x least edge weight x decay ** (distance - 1); no edges: 0."""
    t = _c(edge_types)
    least = F.array_min(F.transform(t, lambda e: edge_weight(e, s)))
    return F.when(F.size(t) > 0, unit(_c(confidence) * least * F.pow(F.lit(s.distance_decay), F.size(t) - 1))).otherwise(0.0)


# --- text -----------------------------------------------------------------------------


def packed(text: Column | str) -> Column:
    """``text`` as bytes that differ for different texts: half as many for lower-case
    hexadecimal digits, as hashes are written, and one more for others."""
    c = _c(text)
    digits = c.rlike(r"\A[0-9a-f]+\z") & (F.length(c) % 2 == 0)
    return F.when(digits, F.concat(F.lit(bytearray(b"\0")), F.unhex(c))).otherwise(F.concat(F.lit(bytearray(b"\1")), c.cast("binary")))


def unpacked(data: Column | str) -> Column:
    """The text that was ``packed``."""
    rest = F.substring(_c(data), 2, 2**31 - 1)
    return F.when(F.substring(_c(data), 1, 1) == F.lit(bytearray(b"\0")), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def folded(text: Column | str) -> Column:
    return F.translate(F.lower(_c(text)), MARKED, PLAIN)


def terms(text: Column | str) -> Column:
    """Index terms: runs of letters, digits, _ and :, lower case without marks."""
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}_:]+"), F.lit(0))


def query_terms(text: str, most: int | None = None) -> list[str]:
    """Terms of a query, all of which must match."""
    table = str.maketrans(MARKED, PLAIN)
    return [t.lower().translate(table) for t in re.sub(r"[^\w:]+", " ", text).split()][:most]


def structural_tokens(query: Column | str) -> Column:
    """Names and paths in a query, without stop words, sorted and distinct."""
    found = F.regexp_extract_all(_c(query), F.lit(r"[\p{L}\p{N}_:./\\]+"), F.lit(0))
    kept = F.filter(found, lambda t: (F.octet_length(t) > 1) & ~F.lower(t).isin(*STOP_WORDS))
    return F.array_sort(F.array_distinct(F.transform(kept, normalized_path)))


def normalized_path(path: Column | str) -> Column:
    """Forward slashes; no empty or . segments; .. folded where it can be."""
    parts = F.split(F.replace(F.trim(_c(path)), F.lit("\\"), F.lit("/")), "/")

    def step(acc: Column, p: Column) -> Column:
        up = (p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return F.when(p.isin("", "."), acc).when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def intent(query: Column | str) -> Column:
    q = F.lower(_c(query))
    any_of = lambda words: reduce(lambda a, b: a | b, [F.contains(q, F.lit(w)) for w in words])
    out = F.lit("general")
    for name, words, also in reversed(INTENTS):
        out = F.when(any_of(words) & any_of(also) if also else any_of(words), name).otherwise(out)
    return out


def token_count(text: Column | str) -> Column:
    """By default a token is a byte of UTF-8."""
    return F.octet_length(_c(text))


def truncated(text: Column | str, budget: Column | int) -> Column:
    """The longest prefix of whole characters within ``budget`` bytes."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    raw = F.substring(_c(text).cast("binary"), F.lit(1), budget.cast("int"))
    whole = lambda n: F.substring(raw, F.lit(1), F.greatest(F.length(raw) - n, F.lit(0)))
    # a character is cut at most three bytes before its end
    return F.coalesce(*[F.when(F.is_valid_utf8(whole(n).cast("string")), whole(n).cast("string")) for n in range(4)])


def newline_count(text: Column | str) -> Column:
    return F.length(_c(text)) - F.length(F.replace(_c(text), F.lit("\n"), F.lit("")))


def compacted(text: Column | str, most: int = 2048) -> Column:
    """One line without repeated white space, of ``most`` bytes at most."""
    return truncated(F.trim(F.regexp_replace(_c(text), r"\s+", " ")), most)


def path_in_scope(path: Column | str, scopes: list[str]) -> Column:
    """A path equals a scope or lies under it; no scopes: everything does."""
    p = _c(path)
    return reduce(lambda a, b: a | b, [(p == s) | p.startswith(f"{s}/") for s in scopes], F.lit(not scopes))


# --- canonical forms ------------------------------------------------------------------


def content_hash(data: Column | str) -> Column:
    return F.sha2(_c(data).cast("binary"), 256)


def canonical_map(m: Column | str) -> Column:
    """A map's entries as text, by key: equal maps give equal texts."""
    return F.to_json(F.array_sort(F.map_entries(_c(m))))


def domain_hash(domain: str, text: Column) -> Column:
    """Hash of ``text`` in a domain of its own, so that forms of different kinds never meet."""
    return F.sha2(F.concat(F.lit(f"tessera.{domain}\x00"), text).cast("binary"), 256)


def signature_key(fields: dict[str, Column], components: Column) -> Column:
    """Length-delimited fields in a fixed order, then the sorted components."""
    one = lambda name, v: F.concat(F.lit(f"{name}="), F.octet_length(F.coalesce(v, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(v, F.lit("")), F.lit(";"))
    entries = F.transform(F.array_sort(F.map_entries(components)), lambda e: F.concat(e["key"], F.lit("="), F.octet_length(e["value"]).cast("string"), F.lit(":"), e["value"], F.lit(";")))
    return F.concat(*[one(k, v) for k, v in fields.items()], F.array_join(entries, ""))


def json_flag(payload: Column | str, path: str) -> Column:
    """A boolean inside JSON; null where it is missing."""
    return F.get_json_object(_c(payload), path).cast("boolean")
