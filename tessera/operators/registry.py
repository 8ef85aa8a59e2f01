"""Columns whose values belong to one document each, such as the stable keys of nodes.

A batch brings documents whole. A value that is stored with a document outside the batch stays
that document's; one that only documents of the batch claim goes to the least of them. A
document that claims a value of another's is refused, whole: what is stored of it stays. So a
refused document may still hold values that others of the batch counted on; those are refused
in turn, until nothing changes. Each round is a keyed aggregation over the values of the batch,
of which equal ones merge before they move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.storage import kept


def collisions(stored: DataFrame, batch: DataFrame, value: str, document: str) -> DataFrame:
    """(value, document, holder): the documents of ``batch`` that may not have a value, and who
    has it, given the ``stored`` rows that stay."""
    claims = batch.select(value, document).filter(F.col(value).isNotNull()).distinct()
    held = stored.select(value, document).join(claims.select(value).distinct(), value, "left_semi")
    every = held.select(value, F.struct(F.lit(0).alias("rank"), F.col(document).alias("document")).alias("by")).unionByName(claims.select(value, F.struct(F.lit(1).alias("rank"), F.col(document).alias("document")).alias("by")))
    holders = every.groupBy(value).agg(F.min("by").alias("by")).select(value, F.col("by.document").alias("holder"))
    return claims.join(holders, value).filter(~F.col("holder").eqNullSafe(F.col(document))).select(value, document, "holder")


def admitted(stored: DataFrame, batch: DataFrame, value: str, document: str) -> DataFrame:
    """All collisions (value, document, holder) by which documents of ``batch`` are refused."""
    claims = kept(batch.select(value, document).distinct(), "claims")
    documents = claims.select(document).distinct()
    found = kept(collisions(stored.join(documents, document, "left_anti"), claims, value, document), "collisions")
    every, refused = found, found.select(document).distinct()
    last = refused
    while True:
        # what the documents refused last still hold is lost to those that are left
        back = stored.join(last, document, "left_semi")
        left = claims.join(refused, document, "left_anti")
        held = back.select(value, F.col(document).alias("holder")).distinct()
        more = kept(left.join(held, value).filter(F.col("holder") != F.col(document)).groupBy(value, document).agg(F.min("holder").alias("holder")), "collisions")
        if more.isEmpty():
            return every
        last = more.select(document).distinct()
        every, refused = every.unionByName(more), refused.unionByName(last)
