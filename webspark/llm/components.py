"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webspark.llm.tables import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the component's smallest node.

    Alternating large-star and small-star rounds: every node hangs its larger, then its smaller
    neighbours to the smallest one known. Rounds grow with the logarithm of a component's diameter,
    and the edges never grow in number. Each round is a written table; the driver sees two figures.
    Minima are taken by aggregates that combine before the shuffle, so a node with very many
    neighbours is no hot key.
    """

    def hang(pairs: DataFrame) -> DataFrame:
        """Smallest neighbour of every node as ``least``, beside each of its neighbours."""
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
        return pairs.join(least, "u")

    at = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v")
        .distinct(),
        name,
    )
    state = None
    while True:
        both = at.union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: larger neighbours go to the smallest neighbour.
        large = hang(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("least").alias("v"))
        at = written(small.where("u <> v").distinct(), name)
        figures = at.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if tuple(figures) == state:
            break
        state = tuple(figures)
    roots = at.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
