"""Connected components over an edge table, by minimum labels with pointer jumping; all state stays in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Each round takes the least label among a node and its neighbours, then that label's own label. Labels only
    fall, and the loop ends when a round changes none. Edges with a null end are ignored; an empty table gives an
    empty table.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    both = pairs.select(F.col(a).alias("src"), F.col(b).alias("dst")).unionByName(pairs.select(F.col(b).alias("src"), F.col(a).alias("dst"))).distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("next"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("root"))
        step = materialize(step.join(jump, "next").select("node", F.least("next", "root").alias("component"), "old"), "labels")
        labels = step.select("node", "component")
        if step.where("component <> old").isEmpty():
            return labels
