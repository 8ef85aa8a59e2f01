"""Typed property graph: lookups, one hop, bounded traversal, impact, resolution, repair.

Traversals run level by level. Each level joins the frontier with the edges, keeps the
first discovery of every node (a minimum per node, taken before rows move) and then the
first ``max_nodes`` in discovery order (a top-k), so the only windows without keys run
over at most ``max_nodes`` rows, a bound that ``bounds`` enforces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.storage import counted, kept

MOST_NODES, MOST_EDGES, MOST_DEPTH = 1000, 5000, 8
IMPACT_EDGES = ("calls", "references", "uses_type", "constructs", "implements", "extends", "overrides", "tests", "imports", "depends_on")
HOPS = {
    "callers": ("in", ("calls",)), "callees": ("out", ("calls",)), "references": ("in", ("references", "uses_type", "constructs")),
    "implementations": ("in", ("implements", "extends", "overrides")), "tests": ("in", ("tests",)),
    "dependencies": ("out", ("imports", "depends_on")), "dependents": ("in", ("imports", "depends_on")), "neighbors": ("both", None),
}


def bounds(max_nodes: int = 50, max_edges: int = 100, max_depth: int = 2) -> tuple[int, int, int]:
    if not (1 <= max_nodes <= MOST_NODES and 1 <= max_edges <= MOST_EDGES and 1 <= max_depth <= MOST_DEPTH):
        raise ValueError(f"bounds must be within {MOST_NODES} nodes, {MOST_EDGES} edges and depth {MOST_DEPTH}")
    return max_nodes, max_edges, max_depth


def fresh(documents: DataFrame, states: DataFrame, current_revision: int, analyzed_revision: int, allow_stale: bool = False) -> bool:
    """Whether the graph may be read: revisions equal, and no document with an error, a
    repair under way or another analyzer version. Raises if stale and not allowed."""
    bad = documents.join(states, "document_id", "left").filter(
        F.col("state").isNull() | (F.col("state") != "current") | F.col("last_error").isNotNull() | ~F.col("analyzer_version").eqNullSafe(F.col("state_version"))
    )
    ok = current_revision == analyzed_revision and bad.isEmpty()
    if not ok and not allow_stale:
        raise RuntimeError("the graph is stale")
    return ok


def find(nodes: DataFrame, names: list[str], limit: int, columns: tuple[str, ...] = ("stable_key", "qualified_name", "source_path", "name")) -> DataFrame:
    """Nodes that equal one of ``names`` in a column, by the best such column; ``truncated``
    tells whether more matched. Exact and case-sensitive."""
    columns = tuple(c for c in columns if c in nodes.columns)
    tier = reduce(lambda rest, i: F.when(F.col(columns[i]).isin(*names), i).otherwise(rest), reversed(range(len(columns))), F.lit(None).cast("int"))
    hits = nodes.withColumn("tier", tier).filter(F.col("tier").isNotNull()).orderBy("tier", "stable_key", "node_id").limit(limit + 1)
    order = Window.orderBy("tier", "stable_key", "node_id")
    return hits.withColumn("__n", F.row_number().over(order)).withColumn("truncated", F.max("__n").over(Window.partitionBy()) > limit).filter(F.col("__n") <= limit).drop("__n")


def seeds(nodes: DataFrame, tokens: DataFrame, limit: int) -> DataFrame:
    """Nodes named by the tokens (query_id, position, token): first token first, files and
    unknown symbols last, each node once."""
    keys = nodes.select("node_id", "node_type", "stable_key", F.explode(F.array_distinct(F.array("stable_key", "name"))).alias("token"))
    hits = tokens.join(keys, "token").groupBy("query_id", "node_id", "node_type", "stable_key").agg(F.min("position").alias("position"))
    order = Window.partitionBy("query_id").orderBy(F.col("node_type") == "file", F.col("node_type") == "unknown_symbol", "position", "stable_key")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def within_bounds(max_nodes: Column, max_edges: Column, max_depth: Column) -> Column:
    """Whether ``bounds`` takes these."""
    return max_nodes.between(1, MOST_NODES) & max_edges.between(1, MOST_EDGES) & max_depth.between(1, MOST_DEPTH)


def directed(edges: DataFrame, direction: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """Edges as (at, next, ...): outgoing, incoming, or both; a loop counts once."""
    if types is not None:
        edges = edges.filter(F.col("edge_type").isin(*types))
    rest = ["edge_id", "edge_type", "confidence"]
    out = edges.select(F.col("from_node").alias("at"), F.col("to_node").alias("next"), *rest)
    back = edges.select(F.col("to_node").alias("at"), F.col("from_node").alias("next"), *rest)
    if direction == "both":
        return out.unionByName(back.filter("at <> next"))
    return out if direction == "out" else back


def one_hop(edges: DataFrame, nodes: DataFrame, start: DataFrame, hop: str, limit: int = 100) -> DataFrame:
    """Edges of the ``start`` nodes (node_id) in the way that ``hop`` names, in edge order."""
    step = directed(edges, *HOPS[hop])
    found = step.join(start.select(F.col("node_id").alias("at")), "at").join(nodes.select(F.col("node_id").alias("next"), "stable_key"), "next")
    return found.orderBy("edge_type", "edge_id").limit(limit)


def traverse(edges: DataFrame, nodes: DataFrame, start: DataFrame, direction: str, types: tuple[str, ...] | None, max_nodes: int = 50, max_edges: int = 100, max_depth: int = 2, contains_from_files: bool = False) -> DataFrame:
    """``traversed`` without its flag."""
    return traversed(edges, nodes, start, direction, types, max_nodes, max_edges, max_depth, contains_from_files)[0]


def traversed(edges: DataFrame, nodes: DataFrame, start: DataFrame, direction: str, types: tuple[str, ...] | None, max_nodes: int = 50, max_edges: int = 100, max_depth: int = 2, contains_from_files: bool = False) -> tuple[DataFrame, bool]:
    """Breadth-first: node_id, depth, ord, path, edge_types, confidence of each node found; and
    whether a bound on nodes or edges may have cut the answer short (the depth cuts nothing: it
    is what was asked for).

    A node belongs to its first discovery, in order of the parent's discovery, edge type
    and edge id; dangling ends are visited but not returned. Edges are taken in the same
    order up to ``max_edges`` in all; a level asks for one more than it may take. With
    ``contains_from_files`` files also lead on to what they contain in the first step.
    """
    max_nodes, max_edges, max_depth = bounds(max_nodes, max_edges, max_depth)
    step = directed(edges, direction, types)
    exists = nodes.select(F.col("node_id").alias("next"))
    frontier = start.select(
        F.col("node_id").alias("at"), F.lit(0).alias("depth"), F.row_number().over(Window.orderBy("node_id")).alias("ord"), F.array("node_id").alias("path"), F.array().cast("array<string>").alias("types"), F.lit(1.0).alias("conf")
    ).limit(max_nodes)
    visited = frontier.select("at")
    found = frontier
    used, edges_used, truncated = frontier.count(), 0, False
    for depth in range(1, max_depth + 1):
        reach = frontier.join(step, "at")
        if depth == 1 and contains_from_files:
            files = nodes.filter("node_type = 'file'").select(F.col("node_id").alias("at"))
            reach = reach.unionByName(frontier.join(files, "at").join(directed(edges, "out", ("contains",)), "at"))
        # the edges are read once a level; what follows works on ``max_edges`` rows at most
        left = max_edges - edges_used
        reach, n = counted(reach.withColumn("order", F.struct("ord", "edge_type", "edge_id")).orderBy("order").limit(left + 1), "reach")
        if n > left:
            reach, n, truncated = reach.orderBy("order").limit(left), left, True
        edges_used += n
        new = reach.join(visited.withColumnRenamed("at", "next"), "next", "left_anti")
        first = new.groupBy("next").agg(F.min_by(F.struct("path", "types", "conf", "edge_type", "confidence", "order"), "order").alias("b"))
        rows = first.select("next", "b.*").select(
            F.col("next").alias("at"), F.lit(depth).alias("depth"), "order",
            F.concat("path", F.array("next")).alias("path"), F.concat("types", F.array("edge_type")).alias("types"), F.least(F.lit(1.0), F.col("conf") * F.col("confidence")).alias("conf"),
        )
        known = rows.join(exists.withColumnRenamed("next", "at"), "at", "left_semi").orderBy("order").limit(max_nodes - used + 1)
        frontier, n = counted(known.withColumn("ord", F.row_number().over(Window.orderBy("order")).cast("int")).select("at", "depth", "ord", "path", "types", "conf"), "frontier")
        if n > max_nodes - used:
            n, truncated = max_nodes - used, True
            frontier = frontier.filter(F.col("ord") <= n)
        visited = visited.union(rows.select("at"))
        found = found.unionByName(frontier)
        used += n
        if not n or used >= max_nodes or edges_used >= max_edges:
            truncated = truncated or bool(n) and depth < max_depth  # what was found last might have led on
            break
    return found.select(F.col("at").alias("node_id"), "depth", "ord", "path", F.col("types").alias("edge_types"), F.col("conf").alias("confidence")), truncated


def impact(edges: DataFrame, nodes: DataFrame, start: DataFrame, max_nodes: int = 50, max_edges: int = 100, max_depth: int = 2) -> DataFrame:
    """What a change may affect: reverse traversal, by distance, confidence and key."""
    found = traverse(edges, nodes, start, "in", IMPACT_EDGES, max_nodes, max_edges, max_depth, contains_from_files=True).filter("depth > 0")
    return found.join(nodes.select("node_id", "stable_key"), "node_id").orderBy("depth", F.desc("confidence"), "stable_key")


def chain_roots(links: DataFrame, old: str, new: str) -> DataFrame:
    """(item, root, hops, cyclic) along links old -> new, where each item has one link.

    Pointer jumping: the number of rounds is the logarithm of the longest chain, or of the
    number of links if there is a circle. Root and hops of cyclic items are those of the
    last round.
    """
    jump = links.select(F.col(old).alias("item"), F.col(new).alias("root"), F.lit(1).cast("long").alias("hops"))
    ends, most = 1, links.count()
    while ends < most:
        then = jump.select(F.col("item").alias("root"), F.col("root").alias("__root"), F.col("hops").alias("__hops"))
        jump = kept(jump.join(then, "root", "left").select("item", F.coalesce("__root", "root").alias("root"), (F.col("hops") + F.coalesce("__hops", F.lit(0))).alias("hops"), F.col("__root").isNotNull().alias("__on")), "chain")
        if jump.filter("__on").isEmpty():
            break
        ends *= 2
    inside = links.select(F.col(old).alias("root")).distinct().withColumn("__in", F.lit(True))
    return jump.join(inside, "root", "left").select("item", "root", "hops", F.col("__in").isNotNull().alias("cyclic"))


# --- resolution and repair --------------------------------------------------------------

BASES = ("stable_key", "alias", "container", "qualified_name", "source_document", "workspace_name")


def simple(name: Column) -> Column:
    return ~F.rlike(name, F.lit(r"::|[./\\]"))


def sibling_name(qualified: Column, name: Column) -> Column:
    """``name`` beside ``qualified``, by its last separator."""
    return F.when(F.rlike(qualified, F.lit(r"::|\.")), F.concat(F.regexp_extract(qualified, r"^(.*(?:::|\.))[^:.]*$", 1), name))


def resolve(facts: DataFrame, nodes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """fact_id, state, basis, node_id, candidates.

    Facts: fact_id, target, document_id, container (qualified name of the enclosing
    symbol). Nodes: node_id, stable_key, qualified_name, name, document_id. Aliases:
    fact_id, alias, replacement. The first basis with any candidate decides: one node
    resolves a fact, several make it ambiguous, and none of a later basis is looked at.
    """
    f = facts.withColumn("target", F.trim("target")).filter("target <> ''")
    one = simple(F.col("target"))

    def by(column: str, key: str, rows: DataFrame, tier: int, *also: str) -> DataFrame:
        """Facts with the number and the least of the nodes of that name: nodes are counted by
        name first, so a name that very many nodes have is one row of the join."""
        named = nodes.groupBy(F.col(column).alias(key), *also).agg(F.countDistinct("node_id").alias("n"), F.min("node_id").alias("node_id"))
        return rows.join(named, [key, *also]).select("fact_id", F.lit(tier).alias("tier"), "n", "node_id")

    arms = [
        by("stable_key", "target", f, 0),
        by("qualified_name", "beside", f.filter(one).withColumn("beside", sibling_name(F.col("container"), F.col("target"))), 2),
        by("qualified_name", "target", f, 3),
        by("name", "target", f.filter(one), 4, "document_id"),  # a name in the fact's own document comes before the same name elsewhere
        by("name", "target", f.filter(one), 5),
    ]
    if aliases is not None:
        a = f.join(aliases, "fact_id")
        at = F.length("alias")
        rest = F.substring(F.col("target"), at + 1, F.length("target"))
        expanded = F.when(F.col("target") == F.col("alias"), F.col("replacement")).when(F.startswith("target", F.col("alias")) & F.rlike(rest, F.lit(r"^(::|\.|/)")), F.concat("replacement", rest))
        arms.append(by("qualified_name", "expanded", a.select("fact_id", expanded.alias("expanded")).filter("expanded IS NOT NULL").distinct(), 1))
    # a node has one qualified name, so counts of different expansions add up
    every = reduce(DataFrame.unionByName, arms).groupBy("fact_id", "tier").agg(F.sum("n").alias("n"), F.min("node_id").alias("node_id"))
    chosen = every.groupBy("fact_id").agg(F.min(F.struct("tier", "n", "node_id")).alias("b")).select("fact_id", "b.*")
    state = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    basis = reduce(lambda rest, i: F.when(F.col("tier") == i, BASES[i]).otherwise(rest), range(len(BASES)), F.lit(None).cast("string"))
    return facts.select("fact_id").join(chosen, "fact_id", "left").select("fact_id", state.alias("state"), basis.alias("basis"), F.when(F.col("n") == 1, F.col("node_id")).alias("node_id"), F.coalesce("n", F.lit(0)).cast("long").alias("candidates"))


def changed_terms(old: DataFrame, new: DataFrame) -> DataFrame:
    """Terms whose sorted candidate lists differ between two states of the nodes."""
    lists = lambda df, name: df.groupBy("term").agg(F.array_sort(F.collect_set("node_id")).alias(name))
    return lists(old, "before").join(lists(new, "after"), "term", "full").filter(~F.col("before").eqNullSafe(F.col("after"))).select("term")


def affected(facts: DataFrame, edges: DataFrame, document: object, terms: DataFrame, removed: DataFrame) -> DataFrame:
    """Facts to resolve again: the document's own, those with a changed term, and those
    whose edge leads into a removed node."""
    return (
        facts.filter(F.col("document_id") == F.lit(document)).select("fact_id")
        .union(facts.join(terms, facts["target"] == terms["term"], "left_semi").select("fact_id"))
        .union(edges.join(removed, edges["to_node"] == removed["node_id"], "left_semi").select("fact_id"))
        .distinct()
    )


def projected_edges(outcomes: DataFrame, facts: DataFrame, old: DataFrame) -> DataFrame:
    """Edges of resolved facts; an edge whose ends and type stay keeps its id."""
    new = outcomes.filter("state = 'resolved'").join(facts.select("fact_id", "from_node", "edge_type"), "fact_id").select("fact_id", "from_node", F.col("node_id").alias("to_node"), "edge_type")
    was = old.select("fact_id", "edge_id", F.col("from_node").alias("f"), F.col("to_node").alias("t"), F.col("edge_type").alias("k"))
    same = (F.col("f") == F.col("from_node")) & (F.col("t") == F.col("to_node")) & (F.col("k") == F.col("edge_type"))
    fresh_id = F.sha2(F.concat_ws("|", "fact_id", "from_node", "to_node", "edge_type"), 256)
    return new.join(was, "fact_id", "left").select("fact_id", F.when(same, F.col("edge_id")).otherwise(fresh_id).alias("edge_id"), "from_node", "to_node", "edge_type", F.coalesce(same, F.lit(False)).alias("kept"))


def repair_plan(documents: DataFrame, states: DataFrame, manifests: DataFrame, counts: DataFrame) -> DataFrame:
    """Per document what a repair has to do, by the first rule that holds."""
    d = documents.join(states, "document_id", "left").join(manifests, "document_id", "left").join(counts, "document_id", "left")
    differ = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"expected_{c}"), F.lit(0)) != F.coalesce(F.col(c), F.lit(0)) for c in ("nodes", "facts", "edges", "unresolved")])
    rule = (
        F.when(~F.col("analyzer_enabled"), "skip_disabled").when(F.col("scan_failed"), "skip_unreadable").when(F.col("state").isNull(), "analyze_missing")
        .when(F.col("state") == "error", "analyze_error").when(F.col("state") == "updating", "analyze_interrupted").when(F.col("content_hash") != F.col("state_hash"), "analyze_content")
        .when(F.col("analyzer_version") != F.col("state_version"), "analyze_version").when(F.col("expected_nodes").isNull(), "project_manifest").when(differ, "project_counts").otherwise("current")
    )
    return d.select("document_id", rule.alias("disposition"))


def projection_counts(nodes: DataFrame, facts: DataFrame, edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Nodes, facts, edges and unresolved facts of each document."""
    kinds = [("nodes", nodes), ("facts", facts), ("edges", edges), ("unresolved", unresolved)]
    every = reduce(DataFrame.unionByName, [df.select("document_id", F.lit(k).alias("kind")) for k, df in kinds])
    return every.groupBy("document_id").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k, _ in kinds])
