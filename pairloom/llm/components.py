"""Connected components of a graph given as edges, by alternating large-star and small-star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import materialize, remove


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return near.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: columns a, b of one orderable type. Returns node, label: the smallest node that each node reaches.

    Nodes without an edge to another node are not returned. Each round is written to the shared folder; the driver
    gets a count and a checksum. Repeated edges, loops and either direction are allowed.
    """
    def tidy(e: DataFrame) -> DataFrame:
        return materialize(e.where("a <> b").distinct(), "edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())

    now = tidy(edges)
    said = mark(now)
    for _ in range(rounds):
        if not said[0]:
            break
        after = tidy(_small_star(_large_star(now).where("a <> b").distinct()))
        remove(now)
        now, before, said = after, said, mark(after)
        if said == before:
            break
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b"), F.col("b")).distinct())
