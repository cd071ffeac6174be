"""Connected components by label propagation with shortcuts, as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.llm.common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest id reachable from each end of the edges (a, b).

    Each step lowers a node's label to the least label among its neighbours,
    then to its label's own label, so a path of length d needs about log d
    steps. Minima are combined before the shuffle, so a hub costs no more than
    its edges. Every step is written to the shared folder. Null ends are ignored.
    """
    e = edges.select("a", "b").where("a <> b")
    both = materialise(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node"))
                         .agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    changed = not labels.isEmpty()
    while changed:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near")))
        low = labels.join(near, "node").select(
            "node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        step = low.join(jump, "comp", "left").select(
            "node", "was", F.least("comp", F.coalesce("next", "comp")).alias("comp"))
        step = materialise(step, "labels")
        changed = not step.where("was <> comp").isEmpty()
        labels = step.select("node", "comp")
    return labels
