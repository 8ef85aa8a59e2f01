"""Licence scan by canonical digests (operator 7), DataFrame functions only.

A text is brought to a canonical form: lower case; copyright lines removed, those behind
comment marks too; every run of characters that are neither letters, marks nor digits of any
script made one space, so that quotes, dashes, spaces and comment marks of all kinds are
equal; links and the marks of lists left out; equivalent spellings made one; whoever is named as
holder, between the fixed words around, made one word. The SHA-256 of the form is joined to the digests of known
licences, with each title that a licence is known to go by and without one. The whole text
must be the licence: a document that only contains or mentions one doesn't match.

The known licences are a table of a few rows; a larger one is joined by whatever means
Catalyst picks for its size, as no broadcast is forced. Texts never move: only digests
and ids meet.

Edge cases: null and blank texts, and texts of copyright lines only, have an empty
canonical form and match nothing; several licences with one form give the smallest
name; repeated rows each get their result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import documents, text_or_empty
from tessera.llm.license_texts import AFTER_COPYRIGHT, LICENSES, SPELLINGS, STEMS, TITLED

#: In the wording of a licence the word is no mark of a copyright line, wherever lines break.
COPYRIGHT_WORD = r"copyright(ed|able|s?[^\p{L}\p{N}]+(?:" + "|".join(AFTER_COPYRIGHT) + r")(?:[^\p{L}\p{N}]|$))"
COPYRIGHT_LINE = r"(^|\n)[^\p{L}\p{N}\n(©]*(copyright|\(c\)[^\p{L}\p{N}\n]*(copyright|[0-9]{4}|year|yyyy)|©|all[^\p{L}\p{N}\n]+rights[^\p{L}\p{N}\n]+reserved)[^\n]*"
BETWEEN_WORDS = r"[^\p{L}\p{M}\p{N}]+"
#: Links, and marks of lists such as ``1.``, ``(a)`` or ``b)``: printings differ in both.
LINK = r"https?://[^\s\p{Z}<>()\[\]]+"
LIST_MARK = r"(^|[\s\p{Z}])\(?([0-9]{1,2}|[a-z])[.)]([\s\p{Z}]|$)"
#: Whom a licence names where its template says "the copyright holder", between fixed words.
HOLDERS = (
    (r"neither the names? of ([^ ]+ ){1,16}?nor the names? of (its |any |other |their )*contributors", "neither the name of holder nor the names of contributors"),
    (r"provided by ([^ ]+ ){1,16}?as is", "provided by holder as is"),
    (r"in no event shall ([^ ]+ ){1,16}?be liable", "in no event shall holder be liable"),
    (r"in no event will ([^ ]+ ){1,16}?be held liable", "in no event will holder be held liable"),
)


def canonical(text: Column) -> Column:
    low = F.lower(text)
    marked = F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("(c)")) | F.contains(low, F.lit("©")) | F.contains(low, F.lit("reserved"))
    kept = F.when(marked, F.regexp_replace(F.regexp_replace(low, COPYRIGHT_WORD, "copy right$1"), COPYRIGHT_LINE, "$1")).otherwise(low)
    for pattern, by in ((LINK, " "), (LIST_MARK, "$1$3")):
        kept = F.regexp_replace(kept, pattern, by)
    words = F.trim(F.regexp_replace(kept, BETWEEN_WORDS, " "))
    for a, b in STEMS:
        words = F.replace(words, F.lit(a), F.lit(b))
    # words stand between two spaces each, so that neighbours can both be replaced
    words = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in SPELLINGS:
        words = F.replace(words, F.lit(f" {a} "), F.lit(f" {b} "))
    words = F.trim(F.replace(words, F.lit("  "), F.lit(" ")))
    for pattern, by in HOLDERS:
        words = F.regexp_replace(words, pattern, by)
    return words


def printings(texts: dict[str, str]) -> list[tuple[str, str]]:
    """(name, text) of each text, by itself, without its title, and under each of its others."""
    return [*texts.items(), *((name, f"{title}\n\n{body}" if title else body) for name, (body, titles) in TITLED.items() if name in texts for title in ("", *titles))]


def known_licenses(spark: SparkSession, texts: dict[str, str] = LICENSES) -> DataFrame:
    """license_id and digest of each canonical form."""
    rows = spark.createDataFrame(printings(texts), "license_id string, text string")
    return rows.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def licensed(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``digest`` of the canonical form and ``license_id``, null if unknown."""
    form = canonical(text_or_empty(text))
    digests = known.select(F.col("digest").alias("__digest"), F.col("license_id").alias("__license"))
    found = docs.withColumn("digest", F.sha2(form, 256))
    return found.join(digests, found["digest"] == digests["__digest"], "left").withColumn("license_id", F.col("__license")).drop("__digest", "__license")


def op7_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return licensed(docs, known_licenses(spark)).select("doc_id", "digest", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def _sql_form(text: str) -> str:
    kept = rf"regexp_replace(regexp_replace(lower({text}), '{COPYRIGHT_WORD}', 'copy right\1', 'g'), '{COPYRIGHT_LINE}', '\1', 'g')"
    kept = rf"regexp_replace(regexp_replace({kept}, '{LINK}', ' ', 'g'), '{LIST_MARK}', '\1\3', 'g')"
    words = f"trim(regexp_replace({kept}, '{BETWEEN_WORDS}', ' ', 'g'))"
    for a, b in STEMS:
        words = f"replace({words}, '{a}', '{b}')"
    words = f"' ' || replace({words}, ' ', '  ') || ' '"
    for a, b in SPELLINGS:
        words = f"replace({words}, ' {a} ', ' {b} ')"
    words = f"trim(replace({words}, '  ', ' '))"
    for pattern, by in HOLDERS:
        words = f"regexp_replace({words}, '{pattern}', '{by}', 'g')"
    return f"sha256({words})"


_ROWS = ", ".join("('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in printings(LICENSES))
OP7_SQL = f"""
WITH known AS (SELECT {_sql_form("text")} AS digest, min(license_id) AS license_id FROM (VALUES {_ROWS}) AS k(license_id, text) GROUP BY 1),
d AS (SELECT doc_id, {_sql_form("coalesce(text, '')")} AS digest FROM documents)
SELECT doc_id, digest, license_id, license_id IS NOT NULL AS is_license FROM d LEFT JOIN known USING (digest)
"""
