"""Resolution of facts that follows changes of any number of documents.

What resolution looks up is a set of terms: a fact has one for each of its bases, a node one for
each of its names. Both are kept as inverted indexes in a store, in buckets of the term, beside
nodes, facts and outcomes in buckets of their document. A change of documents, all in one pass,

* gives signed deltas of (term, node): what a node lost and gained, without what stayed;
* meets the facts' index at the changed terms only, which names the facts of other documents
  that may resolve otherwise, whether for a node that came, went, or became one of several;
* resolves these and the documents' own facts, against the nodes' index at their terms;
* publishes nodes, facts, indexes and outcomes as one revision.

Every step reads the buckets of the terms or documents that the step before has named, so work
follows the change, not the corpus. A term that very many facts share is a delta of all of them:
their outcomes do change. Nodes are counted by term before facts meet them.

Aliases are not followed here; ``operators.graph.resolve`` does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.storage import kept
from tessera.operators.graph import BASES, sibling_name, simple
from tessera.sources import store as S

TABLES = {"nodes": "document_id", "facts": "document_id", "node_terms": "term", "fact_terms": "term", "outcomes": "document_id"}
NODE, FACT = ["node_id", "stable_key", "qualified_name", "name", "document_id"], ["fact_id", "target", "document_id", "container"]


def _term(kind: str, *values: object):
    return F.concat_ws("\x1f", F.lit(kind), *values)


def node_terms(nodes: DataFrame) -> DataFrame:
    """(term, node_id, document_id): the names by which each node can be found."""
    doc = F.col("document_id").cast("string")
    named = [(F.col(c), t) for c, t in (("stable_key", _term("key", "stable_key")), ("qualified_name", _term("path", "qualified_name")), ("name", _term("here", doc, "name")), ("name", _term("name", "name")))]
    terms = F.array(*[F.when(c.isNotNull(), t) for c, t in named])
    return nodes.select(F.explode(F.array_compact(terms)).alias("term"), "node_id", "document_id")


def fact_terms(facts: DataFrame) -> DataFrame:
    """(term, tier, fact_id, document_id): what each fact looks up, by the order of its bases."""
    target, doc = F.trim("target"), F.col("document_id").cast("string")
    one, beside = simple(target), sibling_name(F.col("container"), target)
    arms = [(0, F.lit(True), _term("key", target)), (2, one & beside.isNotNull(), _term("path", beside)), (3, F.lit(True), _term("path", target)), (4, one, _term("here", doc, target)), (5, one, _term("name", target))]
    found = F.array(*[F.when(ok & (target != ""), F.struct(F.lit(tier).alias("tier"), term.alias("term"))) for tier, ok, term in arms])
    return facts.select(F.explode(F.array_compact(found)).alias("x"), "fact_id", "document_id").select("x.term", "x.tier", "fact_id", "document_id")


def resolved(facts: DataFrame, wanted: DataFrame, there: DataFrame) -> DataFrame:
    """fact_id, document_id, state, basis, node_id, candidates of ``facts``, which look up
    ``wanted`` terms among ``there``, those of nodes. The first basis with any node decides."""
    named = there.groupBy("term").agg(F.countDistinct("node_id").alias("n"), F.min("node_id").alias("node_id"))
    best = wanted.join(named, "term").groupBy("document_id", "fact_id").agg(F.min(F.struct("tier", "n", "node_id")).alias("b")).select("document_id", "fact_id", "b.*")
    state = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    basis = reduce(lambda rest, i: F.when(F.col("tier") == i, BASES[i]).otherwise(rest), range(len(BASES)), F.lit(None).cast("string"))
    out = facts.select("fact_id", "document_id").join(best, ["document_id", "fact_id"], "left")
    return out.select("fact_id", "document_id", state.alias("state"), basis.alias("basis"), F.when(F.col("n") == 1, F.col("node_id")).alias("node_id"), F.coalesce("n", F.lit(0)).cast("long").alias("candidates"))


def deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """(term, node_id, sign) of what differs between two states of some nodes' terms."""
    signed = old.select("term", "node_id", F.lit(-1).alias("sign")).unionByName(new.select("term", "node_id", F.lit(1).alias("sign")))
    return signed.groupBy("term", "node_id").agg(F.sum("sign").alias("sign")).filter("sign <> 0")


def _part(spark: SparkSession, at: dict, name: str, keys: DataFrame, key: str, like: DataFrame) -> DataFrame:
    """Rows of a table whose ``key`` is among ``keys``, from the buckets that can hold them."""
    if name not in at["tables"]:
        return like.limit(0)
    rows = S.read(spark, at, name, S.holding(keys, at, name, key))
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def changes(spark: SparkSession, at: dict, documents: DataFrame, nodes: DataFrame, facts: DataFrame) -> dict[str, S.Change]:
    """What the store's tables become when ``documents`` have these nodes and facts, and no
    others; a document that has neither is gone."""
    documents = kept(documents.select("document_id").distinct(), "changed-documents")
    nodes, facts = kept(nodes.select(*NODE), "changed-nodes"), kept(facts.select(*FACT), "changed-facts")
    plus, own = node_terms(nodes), fact_terms(facts)
    minus = kept(node_terms(_part(spark, at, "nodes", documents, "document_id", nodes)), "lost-terms")
    lost = kept(fact_terms(_part(spark, at, "facts", documents, "document_id", facts)), "lost-fact-terms")
    terms = kept(deltas(minus, plus).select("term").distinct(), "changed-terms")
    others = _part(spark, at, "fact_terms", terms, "term", own).select("fact_id", "document_id").distinct().join(documents, "document_id", "left_anti")
    others = kept(others, "affected")
    again = _part(spark, at, "facts", others, "document_id", facts).join(others, ["document_id", "fact_id"], "left_semi")
    todo = kept(facts.unionByName(again.select(*FACT)), "facts-to-resolve")
    wanted = kept(fact_terms(todo), "wanted-terms")
    there = _part(spark, at, "node_terms", wanted, "term", plus).join(documents, "document_id", "left_anti").select(*plus.columns)
    outcomes = resolved(todo, wanted, there.unionByName(plus.join(wanted.select("term").distinct(), "term", "left_semi").select(*plus.columns)))
    return {
        "nodes": S.Change(nodes, documents), "facts": S.Change(facts, documents), "node_terms": S.Change(plus, row_keys=["term", "node_id"], remove=minus),
        "fact_terms": S.Change(own, row_keys=["term", "tier", "fact_id", "document_id"], remove=lost), "outcomes": S.Change(kept(outcomes, "outcomes"), documents, ["document_id", "fact_id"]),
    }


def update(spark: SparkSession, folder: str, documents: DataFrame, nodes: DataFrame, facts: DataFrame, buckets: int = 64) -> dict:
    """Brings the store to what changed documents say now; the new state."""
    layouts = {name: S.Keyed(key, buckets) for name, key in TABLES.items()}
    return S.transact(spark, folder, lambda at: changes(spark, at, documents, nodes, facts), layouts)[0]
