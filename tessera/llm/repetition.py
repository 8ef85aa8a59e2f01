"""Quality rules by suffix-array repetition (operator 1).

The words of a text are numbered; prefix doubling sorts its suffixes, and the ranks of
every doubling give the longest common prefix of neighbours in the suffix array. A
suffix's longest common prefix with either neighbour is the longest repeat that starts
there; the intervals of ``least`` words or more are the maximal repeated substrings.
The union of their spans, in code points of words, must not cover more than a share of
the text, and the longest must stay under a limit.

Many texts are sorted together, in NumPy: the first key of a word is its text and its
word, so suffixes of different texts never meet, and only positions whose rank another
one shares are sorted again. A text of n words costs O(n log n log r) for a longest
repeat of r words; texts are whole, and nothing is shuffled.

Edge cases: null and blank texts have no words and fail the base rule; repeats may
overlap themselves, as in a word that goes on and on; texts are judged alone, so
repeated rows get equal verdicts; other columns are not touched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import SPACE_CHARS, documents, sliced

SYMBOLS = "#*$%&|<>"
#: The base rule: words of its windows, least words of a text, percent of repeated words.
WINDOW, LEAST_WORDS, BASE_PERCENT = 8, 20, 30
#: The method: words of the shortest repeat that counts, covered share, longest repeat.
LEAST, MAX_COVERED, MAX_REPEAT = 3, 0.31, 50
#: Bytes of the texts that are sorted together; a longer text is sorted alone.
TOGETHER = 1_200_000


def doubled_ranks(first: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... keys, until none are equal.

    Two suffixes have the same rank in array k exactly if their first 2 ** k keys are
    equal. Keys of the separators between texts must differ from all others. Arrays end
    with one more rank, of the empty suffix.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    rank = np.empty(n + 1, np.int64)
    new = np.r_[True, first[order][1:] != first[order][:-1]]
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    rank[n] = 0
    ranks, step = [rank], 1
    active = order[~(new & np.r_[new[1:], True])]
    while len(active):
        group = rank[active]
        then = rank[np.minimum(active + step, n)]
        by = np.lexsort((then, group))
        active, group, then = active[by], group[by], then[by]
        start = np.r_[True, group[1:] != group[:-1]]
        new = start | np.r_[True, then[1:] != then[:-1]]
        at = np.arange(len(active))
        moved = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(start, at, 0))
        rank = rank.copy()
        rank[active] = group + moved
        ranks.append(rank)
        active = active[~(new & np.r_[new[1:], True])]
        step *= 2
    return ranks


def longest_repeats(ranks: list[np.ndarray]) -> np.ndarray:
    """For each suffix, its longest common prefix with any other: with a neighbour."""
    n = len(ranks[0]) - 1
    suffix = np.empty(n, np.int64)
    suffix[ranks[-1][:n] - 1] = np.arange(n)
    a, b = suffix[:-1], suffix[1:]
    common = np.zeros(max(n - 1, 0), np.int64)
    near = np.flatnonzero(ranks[0][a] == ranks[0][b])
    for k in reversed(range(len(ranks))):
        x, y = a[near] + common[near], b[near] + common[near]
        common[near] += (ranks[k][np.minimum(x, n)] == ranks[k][np.minimum(y, n)]) * (1 << k)
    out = np.zeros(n, np.int64)
    out[a] = common
    out[b] = np.maximum(out[b], common)
    return out


def measure(texts: list[bytes], least: int = LEAST, window: int = WINDOW) -> dict[str, np.ndarray]:
    """Of each text: words, words in repeated windows, covered code points, longest repeat."""
    split = [t.split() for t in texts]  # bytes split at exactly the white space of ``SPACE_CHARS``
    ids: dict[bytes, int] = defaultdict(count().__next__)
    n = np.array([len(w) for w in split])
    total = int(n.sum())
    words = np.fromiter((ids[w] for ws in split for w in ws), np.int64, total)
    points = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in ids), np.int64, len(ids))[words] if total else words
    doc = np.repeat(np.arange(len(texts)), n)
    # one separator behind each text, with keys that no word has
    key = np.empty(total + len(texts), np.int64)
    place = np.arange(total) + doc
    ends = np.cumsum(n) + np.arange(len(texts))
    key[place] = doc * (len(ids) + 1) + words
    key[ends] = len(texts) * (len(ids) + 1) + np.arange(len(texts))
    repeat = longest_repeats(doubled_ranks(key))[place] if total else np.zeros(0, np.int64)

    def covered(least: int) -> np.ndarray:
        """Which words lie in a repeat of ``least`` words or more."""
        starts = repeat >= least
        edge = np.bincount(np.flatnonzero(starts), minlength=total + 1) - np.bincount((np.arange(total) + repeat)[starts], minlength=total + 1)
        return np.cumsum(edge)[:total] > 0

    def summed(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc, values, len(texts)).astype(np.int64)

    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, np.where(repeat >= least, repeat, 0))
    return {"n_words": n, "word_chars": summed(points), "n_repeat_words": summed(covered(window)), "covered_chars": summed(points * covered(least)), "longest_repeat": longest}


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_chars", "longest_repeat")


def repetition(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and the measures of each text, as in ``COLUMNS``."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 4096, TOGETHER):
            part = [t or "" for t in b.column(1).to_pylist()]
            found = measure([t.encode("utf-8", "surrogatepass") for t in part])
            found["n_symbols"] = [sum(map(t.count, SYMBOLS)) for t in part]
            found["n_dup_lines"] = [len(lines) - len(set(lines)) for t in part for lines in [[x for x in t.split("\n") if x.strip(SPACE_CHARS)]]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(found[c], pa.int64()) for c in COLUMNS)], names=["key", *COLUMNS])

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(measured, f"key {kind}, " + ", ".join(f"{c} long" for c in COLUMNS)).withColumnRenamed("key", key)


BASE_FAILED = f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words"


def judged(measures: DataFrame, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds base_failed and kept."""
    method = f"covered_chars <= {max_covered}D * word_chars AND longest_repeat <= {max_repeat}"
    return measures.selectExpr("*", f"({BASE_FAILED}) AS base_failed", f"(NOT ({BASE_FAILED}) AND {method}) AS kept")


def fitted_share(measures: DataFrame, labels: DataFrame, good: float = 0.05, least: int = 5) -> float | None:
    """The least covered share, in whole percents, above which at most ``good`` of the
    labelled texts that the base rule keeps are of good quality; there must be ``least`` of
    them (None: no such share). The driver gets 101 counts, whatever the corpus holds.
    Null labels are left out; an id's labels all count.
    """
    percent = F.ceil(100 * F.col("covered_chars") / F.greatest("word_chars", F.lit(1))).cast("int")
    known = measures.filter(f"NOT ({BASE_FAILED})").join(labels.filter("quality IS NOT NULL").select("doc_id", "quality"), "doc_id")
    rows = known.groupBy(percent.alias("percent")).agg(F.count("*").alias("n"), F.sum("quality").alias("fine")).collect()
    for limit in range(100):
        above = [r for r in rows if r["percent"] > limit]
        many = sum(r["n"] for r in above)
        if many < least:
            return None
        if sum(r["fine"] for r in above) <= good * many:
            return limit / 100
    return None


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(repetition(documents(spark, sf_dir)))
    return found.select("doc_id", *COLUMNS[:5], "base_failed", "kept", "covered_chars", "longest_repeat")


def _sql() -> str:
    """The same by ranks of all runs of 1, 2, 4, ... words that occur twice, each from those
    of half its length. A text's longest repeat is found bit by bit, from the highest: ``g``
    numbers its runs of as many words as are sure, and a run goes on by 2 ** k words
    if that run is in ``r{k}``."""
    levels = 24  # runs of up to 2 ** 24 words: more than a text of 2 GB can repeat
    ranks = ["r0 AS (SELECT * FROM (SELECT doc_id, i, dense_rank() OVER (PARTITION BY doc_id ORDER BY word) AS r, count(*) OVER (PARTITION BY doc_id, word) AS n FROM p) WHERE n > 1)"]
    lifts = [f"g{levels} AS (SELECT doc_id, i, 0 AS len, 0::BIGINT AS g FROM r0)"]
    for k in range(1, levels):
        half = 1 << (k - 1)
        ranks.append(
            f"r{k} AS MATERIALIZED (SELECT * FROM (SELECT doc_id, i, dense_rank() OVER (PARTITION BY doc_id ORDER BY a, b) AS r, count(*) OVER (PARTITION BY doc_id, a, b) AS n"
            f" FROM (SELECT x.doc_id, x.i, x.r AS a, y.r AS b FROM r{k - 1} x JOIN r{k - 1} y ON x.doc_id = y.doc_id AND y.i = x.i + {half})) WHERE n > 1)"
        )
    for k in reversed(range(levels)):
        lifts.append(
            f"t{k} AS MATERIALIZED (SELECT * FROM (SELECT doc_id, i, len + {1 << k} AS len, dense_rank() OVER (PARTITION BY doc_id ORDER BY a, b) AS g, count(*) OVER (PARTITION BY doc_id, a, b) AS n"
            f" FROM (SELECT x.doc_id, x.i, x.len, x.g AS a, y.r AS b FROM g{k + 1} x JOIN r{k} y ON x.doc_id = y.doc_id AND y.i = x.i + x.len)) WHERE n > 1)"
        )
        lifts.append(f"g{k} AS MATERIALIZED (SELECT doc_id, i, len, g FROM t{k} UNION ALL SELECT * FROM g{k + 1} WHERE doc_id NOT IN (SELECT doc_id FROM t{k}))")
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^ 	-]+') AS ws FROM t),
p AS MATERIALIZED (SELECT doc_id, i, ws[i] AS word, length(ws[i]) AS points FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
{", ".join(ranks)},
{", ".join(lifts)},
far AS (SELECT doc_id, max(len) AS longest FROM g0 GROUP BY doc_id),
few AS (SELECT x.doc_id, x.i FROM (SELECT x.doc_id, x.i, count(*) OVER (PARTITION BY x.doc_id, x.r, y.r) AS n FROM r1 x JOIN r1 y ON x.doc_id = y.doc_id AND y.i = x.i + {LEAST - 2}) x WHERE n > 1),
c AS (
  SELECT p.*, max((few.i IS NOT NULL)::INT) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN {LEAST - 1} PRECEDING AND CURRENT ROW) AS covered,
         max((r3.i IS NOT NULL)::INT) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS inside
  FROM p LEFT JOIN few ON p.doc_id = few.doc_id AND p.i = few.i LEFT JOIN r3 ON p.doc_id = r3.doc_id AND p.i = r3.i),
s AS (SELECT doc_id, sum(points * covered) AS covered, sum(inside) AS n_repeat_words, sum(points) AS word_chars FROM c GROUP BY doc_id),
l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^ 	-]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(s.word_chars, 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(s.n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(s.covered, 0)::BIGINT AS covered_chars, (CASE WHEN longest >= {LEAST} THEN longest ELSE 0 END)::BIGINT AS longest_repeat
  FROM w LEFT JOIN s USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN far USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE_FAILED} AS base_failed,
       NOT ({BASE_FAILED}) AND covered_chars <= {MAX_COVERED} * word_chars AND longest_repeat <= {MAX_REPEAT} AS kept,
       covered_chars, longest_repeat
FROM m
"""


OP1_SQL = _sql()
