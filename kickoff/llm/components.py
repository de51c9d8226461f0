"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Edges shrink to stars whose centre is the smallest node of the component, in about log(n) rounds.
Each step takes a minimum per node (partial aggregation) and one join on the node; the skewed side of
that join is splittable. Every round is written to the shared scratch folder, so lineage stays short
and nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickoff.session import materialize


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long) → (node, root) for every node that has an edge; root is the smallest node.

    Self loops and repeated edges are allowed; an empty table gives an empty result.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                      .distinct(), "components")
    before, sign = None, _signature(now)
    while sign != before:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        now = materialize(large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                          .union(low.select("u", F.col("m").alias("v"))).distinct(), "components")
        before, sign = sign, _signature(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
