"""Connected components by minimum label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitext.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that is reachable, for each node
    that an edge names.  Edges are undirected; repeats and loops are allowed.
    Every round is written to the shared folder, so a lost executor costs no
    earlier round.  A round takes each node to its smallest neighbour's label
    and then to that label's own label, so chains shrink geometrically.
    """
    both = materialize(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v")))
        .distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
                         .select("node", F.least("node", "m").alias("component")), "cc-labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("v"), F.col("component").alias("near")), "v")
                .groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near")))
        step = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("up"))
        step = materialize(step.join(jump, "c", "left").select(
            "node", F.least("c", "up").alias("component"),
            (F.least("c", "up") != F.col("old")).alias("moved")), "cc-labels")
        labels = step.select("node", "component")
        if not step.filter("moved").limit(1).count():
            return labels
