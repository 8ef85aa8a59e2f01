"""Source divergence audit (operator 13): how far the wording of sources differs.

Each language keeps the terms of at least ``MIN_DOCS`` of its documents. A source's share of
a kept term is ``p = 1 + floor(10^9 (count + 2) / (N + 2V))``, and two shares lie
``f = floor((p - q)^2 / (p + q))`` apart. The distance of two sources sums that over all kept
terms, of which most sources have few. So nothing of size sources times terms is made:

* a pair of sources starts at V times f of two zero counts;
* an inverted index has a posting for each source in which a term occurs. A term that only
  one of the two has corrects the pair by an amount that depends on its count alone, so
  postings of equal count in a source are counted first, and each count corrects the
  source's pairs once;
* terms that both have add what those two corrections lack: the postings of a term meet in
  one row, which has at most as many entries as there are sources.

Terms that stand out in a source are ranked by a window, which Spark limits to the ranks
asked for before it moves rows. The result has a row for each ordered pair of sources of a
language: that, not the documents, is what grows with the square of the sources.

Terms are counted in Arrow batches, summed there and again before they move, so that a source
with any share of the documents is one row a term and task.

All arithmetic is whole numbers: shares are divided as decimals of 38 digits, everything else
fits a long.

Edge cases: null text, language and source read as ''; a source without kept terms, or without
any text, is a group like others; a language without kept terms has V = 0, so its pairs are 0
and it has no terms; a language with one source has no pairs; repeated rows count each; an
empty table gives no rows; ids and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._common import documents, sliced, stored

#: What lies between terms: ASCII but for its letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, PRIOR = 1_000_000_000, 2
MIN_DOCS, TOP = 10, 10


COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of texts, summed a slice: terms and groups are numbered
    once, so that all sums are over integers."""
    for b in sliced(batches, rows=1 << 16, size=1 << 24):
        parts = pc.split_pattern_regex(pc.ascii_lower(b["text"]), BETWEEN)
        terms = pc.dictionary_encode(pc.list_flatten(parts))
        group = pa.table({"lang": b["lang"], "source": b["source"], "row": np.arange(b.num_rows, dtype=np.int32)}).group_by(["lang", "source"], use_threads=False).aggregate([("row", "list")])
        of_row = np.empty(b.num_rows, np.int32)
        lists = group["row_list"].combine_chunks()
        of_row[lists.flatten().to_numpy()] = np.repeat(np.arange(group.num_rows, dtype=np.int32), lists.value_lengths().to_numpy())
        t = pa.table({"row": pc.list_parent_indices(parts).cast(pa.int32()), "term": terms.indices})
        blank = pc.index(terms.dictionary, "").as_py()
        t = t.filter(pc.not_equal(t["term"], blank)) if blank >= 0 else t
        t = t.group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
        t = pa.table({"group": of_row[t["row"].to_numpy()], "term": t["term"], "n": t["count_all"]}).group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ([], "count_all")])
        out = pa.table([group["lang"].take(t["group"]), group["source"].take(t["group"]), terms.dictionary.take(t["term"]), t["n_sum"], t["count_all"]], schema=COUNTED)
        yield from out.combine_chunks().to_batches(max_chunksize=1 << 16)


def share(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """p of a count, exactly; null where there are no terms."""
    as_decimal = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")
    top = (as_decimal(count) + F.lit(PRIOR)) * F.lit(SCALE).cast("decimal(10,0)")
    below = as_decimal(total) + F.lit(PRIOR).cast("decimal(1,0)") * as_decimal(terms)
    return F.when(below > 0, F.call_function("div", top, below) + 1)


def apart(p: Column | str, q: Column | str) -> Column:
    """f of two shares, exactly."""
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return F.call_function("div", (p - q) * (p - q), p + q)


def postings(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(the index, the groups). Index: a row for each source in which a kept term occurs, with
    p, p0 (the source's share of a term it lacks) and q (the language's share). Groups: every
    (lang, source) with V and p0."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = read.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    # one shuffle, by term, does for both sums: of a source, and of the language
    by_source = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by"))
    terms = stored(by_term.filter(F.col("docs") >= min_docs).drop("docs"), "audit-kept")
    kept = terms.select("lang", "term", "lang_n", F.inline("by"))
    langs = terms.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("terms"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = read.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    groups = stored(groups.withColumn("p0", share(F.lit(0), "total", "terms")), "audit-groups")
    index = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", share("n", "total", "terms").alias("p"), "p0", share("lang_n", "lang_total", "terms").alias("q"))
    return stored(index, "audit-index"), groups


def pair_sums(index: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) of all sources a < b of a language."""
    g = groups.select("lang", "source", "p0", "terms")
    a, b = g.select("lang", F.col("source").alias("a"), F.col("p0").alias("pa"), "terms"), g.select("lang", F.col("source").alias("b"), F.col("p0").alias("pb"))
    pairs = a.join(b, "lang")
    base = pairs.filter("a < b").select("lang", "a", "b", F.when(F.col("terms") > 0, F.col("terms") * apart("pa", "pb")).otherwise(0).alias("v"))
    # terms of one source against the other's zero count, equal counts together
    levels = index.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n"))
    one = levels.join(b, "lang").filter("source <> b").select(
        "lang", F.least("source", "b").alias("a"), F.greatest("source", "b").alias("b"), (F.col("n") * (apart("p", "pb") - apart("p0", "pb"))).alias("v")
    )
    met = index.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("all"))
    met = met.filter(F.size("all") > 1).select("lang", "all", F.explode("all").alias("x")).select("lang", "x", F.explode("all").alias("y")).filter("x.source < y.source")
    p, q, p0, q0 = F.col("x.p"), F.col("y.p"), F.col("x.p0"), F.col("y.p0")
    both = met.select("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), (apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0)).alias("v"))
    added = [x.groupBy("lang", "a", "b").agg(F.sum("v").alias("v")) for x in (one, both)]
    return base.unionByName(added[0]).unionByName(added[1]).groupBy("lang", "a", "b").agg(F.sum("v").cast("long").alias("value"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has every other source of the
    language, the farthest first; part `term` the ``top`` kept terms that a source uses more
    than its language does."""
    index, groups = postings(docs, min_docs)
    order = (F.desc("value"), F.asc("item"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
    sums = stored(pair_sums(index, groups), "audit-pairs")
    pair = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    term = index.filter("p > q").select("lang", "source", F.col("term").alias("item"), apart("p", "q").alias("value"))
    term = term.withColumn("rank", rank).filter(F.col("rank") <= top)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pair.withColumn("rank", rank), "pair").unionByName(columns(term, "term"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
langs AS (
  SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
every AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n AS lang_n
  FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
total AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM every GROUP BY ALL),
p AS (
  SELECT lang, source, term, e.n, 1 + 1000000000 * (e.n + 2) // (t.total + 2 * v) AS p, 1 + 1000000000 * (lang_n + 2) // (l.total + 2 * v) AS q
  FROM every e JOIN total t USING (lang, source) JOIN langs l USING (lang)),
pairs AS (
  SELECT lang, x.source AS source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM p x JOIN p y USING (lang, term) WHERE x.source <> y.source GROUP BY ALL),
terms AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
found AS (
  SELECT lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
  FROM g x JOIN g y USING (lang) LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source WHERE x.source <> y.source
  UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
