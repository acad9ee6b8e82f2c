"""Connected components of a link table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acctpulse.session import staged


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them. Links go from large to small."""
    least = links.groupBy("a").agg(F.min("b").alias("low"))
    moved = links.join(least, "a").filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(least.select("a", F.col("low").alias("b"))).distinct()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """``(node, root)``: the smallest node of its component for every node that is not that node itself.

    ``links`` has ``a`` and ``b``. Large-star and small-star steps alternate until nothing changes, a number of rounds
    that grows with the logarithm of the longest chain. Every round is written to the shared work folder, so a
    lost executor repeats at most one round; the driver sees only counts.
    """
    apart = links.filter("a <> b")
    now = staged(apart.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        last, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if last == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = staged(_small_star(_large_star(now)), "links")
    raise RuntimeError(f"components did not settle within {rounds} rounds")
