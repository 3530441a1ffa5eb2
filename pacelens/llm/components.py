"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is one aggregation and one join on the links alone; stored tables cut
the lineage.  A vertex with very many links is aggregated map-side and its rows are
split by the adaptive skew join, so no vertex has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacelens.functions.storage import materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star round over links (a, b) with a > b; both ends of a star move to its least vertex."""
    around = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        around = around.union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u2"), F.least("u", "m").alias("m"))
    moved = around.join(least, F.col("u") == F.col("u2"))
    if large:
        out = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(moved.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with a link, from links (a, b); the root is the least node."""
    state = materialise(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = state.select(mark.alias("m")).first()["m"]
    for _ in range(most_rounds):
        state = materialise(_star(_star(state, large=True), large=False))
        now = state.select(mark.alias("m")).first()["m"]
        if now == before:
            roots = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
