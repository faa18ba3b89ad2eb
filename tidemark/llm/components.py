"""Connected components of a graph as a few joins per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of an edge.

    ``edges`` has columns ``a`` and ``b`` of one orderable type, without nulls.
    Each round takes the smallest label among a node's neighbours, hooks the
    node's own root below it and halves the paths to the roots, so the number
    of rounds grows with the logarithm of a component's width. Labels are
    written to the shared folder between rounds. Tables meet as plain shuffles
    of staged rows, so that adaptive execution can split a hot node.
    """
    edges = edges.select("a", F.col("b").cast(edges.schema["a"].dataType).alias("b"))
    both = batches.stage(
        edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(),
        f"{label}-both",
    )
    labels = batches.stage(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
        .select("node", F.least("node", "b").alias("component")),
        f"{label}-labels",
    )
    state = _state(labels)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").withColumn("new", F.least("component", "near"))
        pairs = F.array(
            F.struct(F.col("node"), F.col("new").alias("component")),
            F.struct(F.col("component").alias("node"), F.col("new").alias("component")),
        )
        hooked = batches.stage(
            step.select(F.inline(pairs)).groupBy("node").agg(F.min("component").alias("component")), f"{label}-hooked")
        roots = hooked.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = batches.stage(hooked.join(roots, "component").select("node", F.col("root").alias("component")), f"{label}-labels")
        before, state = state, _state(jumped)
        batches.drop(hooked)
        batches.drop(labels)
        labels = jumped
        if state == before:
            batches.drop(both)
            return labels


def _state(labels: DataFrame):
    """A sum over hashes of all labels: equal if nothing has changed."""
    return labels.agg(F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first()[0]
