"""Connected components of a link table, by alternating large and small stars.

All state stays in tables: nothing is gathered on the driver, and every round
is written to the shared folder, so that a lost executor costs one round. The
least neighbours of a round are written before they are joined, too: both sides
of the join are then plain exchanges, and the rows of a node with very many
neighbours can be split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The moved edges, and the table they rest on."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = materialise(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), least


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b) -> (a, b): each linked node but the least of its component, with that least node.

    Self-links and repeated links are allowed; an empty table gives an empty one.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    print_of = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = print_of(edges)
    if not before[0]:
        return edges
    for _ in range(most_rounds):
        for star in (_large_star, _small_star):
            moved, least = star(edges)
            old, edges = edges, materialise(moved, "links")
            release(old, least)
        now = print_of(edges)
        if now == before:
            return edges
        before = now
    raise RuntimeError("components did not settle")
