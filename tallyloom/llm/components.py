"""Connected components of a graph whose edges lie in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import checkpoint


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node that it sees."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): the number of edges never grows, the rounds are
    about the logarithm of the longest path, and a hub's rows meet only its own minimum, a join whose large side
    adaptive execution can split. Each round is checkpointed, so the lineage stays short and a lost executor costs one
    round at most. Loops and repeated edges are allowed; rows with a null end are ignored; no edges give no rows.
    """
    current = checkpoint(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(current)
    for _ in range(most_rounds if mark[0] else 0):
        following = checkpoint(_small_star(_large_star(current)))
        seen = _mark(following)
        current = following
        if seen == mark:
            break
        mark = seen
    else:
        if mark[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and an order-free sum of their hashes: equal when the rounds no longer change them."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)
