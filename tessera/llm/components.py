"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the component's least node.

    Every round each node takes the least label around it, then the label of its label,
    so the rounds needed grow with the logarithm of a component's width. Each round is
    written to the shared folder. A node with very many edges is a hot key of a join
    only, which is split, and of a minimum, which is taken before rows move.

    Edge cases: repeated edges, in either direction, count once; an edge from a node to
    itself, or with a null end, counts for nothing, so its node is not returned unless
    another edge has it; no edges give no rows; other columns are not read.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        lower = stored(labels.join(around, "node").select("node", F.col("root").alias("old"), F.least("root", "seen").alias("root")), "lower")
        of = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = stored(lower.join(of, "root", "left").select("node", "old", F.least(F.col("root"), F.coalesce("next", "root")).alias("root")), "labels")
        labels = jumped.select("node", "root")
        if jumped.filter("root <> old").isEmpty():
            return labels
