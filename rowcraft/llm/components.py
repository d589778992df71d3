"""Connected components by alternating star contraction, as joins.

Each round points every vertex at the least vertex it knows of. The edge table
shrinks or stays; a round that changes nothing ends the loop. Each round is
written to the shared folder, so the plan does not grow and a lost executor
costs one round at most. The driver sees only a count and a checksum.

Minima are aggregated before they are shuffled, and written, so that a vertex
with very many edges meets its minimum in a join of plain exchanges, which Spark
splits when it is skewed. No list of neighbours is ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowcraft.llm.support import materialise


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least_neighbour(down)
    joined = down.join(least, "u")
    links = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return links.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex of ``edges`` (u, v); root is the least.

    Self links, repeated and reversed edges are fine; null ends are dropped.
    No edges: no rows.
    """
    current = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    current, mark = materialise(current, "edges"), None
    while True:
        seen = current.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if seen == mark or seen[0] == 0:
            break
        mark = seen
        current = materialise(_small_star(_large_star(current)), "edges")
    roots = current.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return roots.unionByName(current.select(F.col("v").alias("vertex"), F.col("v").alias("root"))).distinct()
