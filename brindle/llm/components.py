"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join back on the same key, in which rows of a node with very many edges are dealt to
all tasks; edges stay in DataFrames and every round is written to the shared folder, so lineage stays short and nothing
grows on the driver. A round never has more edges than the last one has nodes, and rounds grow with the logarithm of the
longest chain. It ends when every node but a root has one edge, which leads to a root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import with_group, written


def _unsettled(edges: DataFrame) -> tuple[int, int]:
    """The number of edges, and of nodes that still have two larger ends or an edge to a node that is no root."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    row = per.agg(F.coalesce(F.sum("up"), F.lit(0)).alias("n"), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).alias("bad")).first()
    return row["n"], row["bad"]


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest id that it reaches) for every id of an edge `a, b` between two different ids."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    n, unsettled = _unsettled(now)
    while unsettled:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        up = now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        large = written(with_group(up, ["u"], F.min("v").alias("m"), total=2 * n, of=both).select(F.col("v").alias("hi"), F.least("u", "m").alias("lo")).distinct(), "edges")
        least = with_group(large, ["hi"], F.min("lo").alias("m"), total=n)
        now = written(least.select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")).distinct(), "edges")
        n, unsettled = _unsettled(now)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
