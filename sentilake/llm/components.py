"""Connected components of large graphs by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentilake.llm.common import passing_tables, stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest member of the component of every node that has an edge: (node, component).

    Each round points the neighbours of a node to the smallest of them, first the larger ones, then the smaller, until
    nothing moves; every component is then a star around its smallest node. Neighbour minima are combined before the
    shuffle and stored, so that the join back to the edges can be split at hub nodes. Self loops, repeated edges and null
    ends are dropped; an empty edge table gives an empty result. Each half round is written, which cuts the lineage, and removed at the end.
    """
    with passing_tables(edges.sparkSession) as keep:
        rows = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(
            f"`{a}` IS NOT NULL AND `{b}` IS NOT NULL AND u > v"
        )
        rows = keep(rows.distinct(), "cc-edges")
        seen = None
        while (state := _state(rows)) != seen and state[0]:
            seen = state
            both = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")
            large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            rows = keep(large.filter("u > v").distinct(), "cc-large")
            least = keep(rows.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
            moved = rows.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            rows = keep(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc-small")
        roots = rows.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        found = rows.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        return stored(found, "components")
