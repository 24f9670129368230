"""Connected components of an edge table by contraction: every round links each node to its least neighbour, follows the
links twice, and keeps only edges between different targets. Rounds grow with the logarithm of the longest chain; each
round's tables are written to the shared folder, so lineage stays short and no executor is needed twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pullwise.session import written


def _follow(links: DataFrame) -> DataFrame:
    up = links.select(F.col("v").alias("to"), F.col("to").alias("further"))
    return links.join(up, "to", "left").select("v", F.coalesce("further", "to").alias("to"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, component) for every node of an edge; component is the least node that reaches it."""
    edges = written(edges.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    labels = None
    while edges.limit(1).count():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        links = ends.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("to"))
        links = written(_follow(_follow(links)), "links")
        if labels is None:
            labels = links.withColumnRenamed("to", "component")
        else:
            step = links.select(F.col("v").alias("component"), "to")
            labels = written(labels.join(step, "component", "left").select("v", F.coalesce("to", "component").alias("component")), "labels")
        left, right = (links.select(F.col("v").alias(x), F.col("to").alias(f"{x}2")) for x in ("a", "b"))
        edges = written(edges.join(left, "a").join(right, "b").filter("a2 != b2").select(
            F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("v"), F.col("b").alias("component"))
