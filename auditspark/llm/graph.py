"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links(a, b) of longs -> (node, label): the smallest node that each linked node reaches.

    Alternates two steps until only stars are left: every node ties its larger neighbours to its smallest
    neighbour, then every node ties itself and its smaller neighbours to the smallest of them. Both
    aggregate before they shuffle, so a hub costs no more than its links; the number of rounds grows
    with the logarithm of the nodes, and links that are stars to begin with need none."""
    edges = checkpoint(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for turn in range(rounds + 1):
        n, settled = stars(edges)
        if settled:
            break
        if turn == rounds:
            raise RuntimeError(f"links did not settle in {rounds} rounds")
        few = max(links.sparkSession.sparkContext.defaultParallelism, n // 100_000 + 1)  # few links need few tasks
        edges = edges.coalesce(few)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min(F.least("a", "b")).alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u"))
        edges = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = checkpoint(edges.coalesce(few))
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def stars(edges: DataFrame) -> tuple[int, bool]:
    """How many edges(a, b), a above b, there are, and whether all are rays of stars: every a has one b, and no b
    is an a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    found = nodes.agg(F.sum("ups").alias("n"), F.max(F.col("ups") > F.col("least")).alias("more")).first()
    return found["n"] or 0, not found["more"]
