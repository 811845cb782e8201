"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, cut) -> DataFrame:
    """(node, component) for all nodes of `links` (a, b): the smallest node reachable.

    Large-star and small-star steps in turn: every node hooks its larger neighbours, then
    its smaller ones and itself, to its smallest neighbour, until nothing changes. `cut`
    writes the links of a round, so lost executors cost one round at most. Null ends link
    nothing.
    """
    edges = cut(
        links.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = cut(_hook(both, both.groupBy("a").agg(F.min("b").alias("m")), larger=True))
        edges = cut(_hook(edges, edges.groupBy("a").agg(F.min("b").alias("m")), larger=False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def _hook(edges: DataFrame, mins: DataFrame, larger: bool) -> DataFrame:
    near = edges.join(mins.withColumnRenamed("a", "_a"), F.col("a") == F.col("_a"))
    if larger:
        out = near.filter("b > a").select(F.col("b").alias("x"), F.least("a", "m").alias("y"))
    else:
        out = near.select(F.col("b").alias("x"), F.col("m").alias("y")).unionAll(
            mins.select(F.col("a").alias("x"), F.col("m").alias("y"))
        )
    return out.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
