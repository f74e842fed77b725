"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import written


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node hangs on two others, or on one and has others hanging on it."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    busy = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.count("*").alias("all"))
    return not busy.where((F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("all") > 1))).isEmpty()


def star_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, root)`` for each node of ``edges`` that is not the smallest of its component.

    ``a`` and ``b`` hold longs; null ends and self loops are left out, repeated and reversed edges count
    once, an empty table gives an empty table. Each round costs a few joins on one node's key; the minima
    are written before the joins, so that both sides of a join come straight from an exchange and Spark can
    split a hub's partition. It ends when every edge is a ray of a star; as edges go from larger to smaller nodes, the stars'
    centres are the smallest. No edge ever reaches the driver.
    """
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        if not _unfinished(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        # large star: every larger neighbour of u hangs on the least of u's neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = written(
            both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "large",
        )
        # small star: u and its smaller neighbours hang on the least of them
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        hung = large.join(least, "u").select("u", "v", "m")
        now = written(
            hung.where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct(),
            "edges",
        )
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
