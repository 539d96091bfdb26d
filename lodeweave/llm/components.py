"""Connected components of a link table, by alternating large-star and small-star rounds.

Only minima are aggregated for a node, never its list of neighbours, and each round's links are
written to the shared folder. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import staged


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node that has a link in links(a, b), two long columns; root is the smallest node.

    Self links and repeated links do no harm; an empty table gives an empty result.
    """
    links = staged(links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct())
    state = _state(links)
    if state[0]:
        for _ in range(max_rounds):
            links = staged(_small_star(_large_star(links)))
            new = _state(links)
            if new == state:
                break
            state = new
        else:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
