"""Connected components of an undirected graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhetorica.sources.tables import stored


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node of its component.

    Each round is written to the shared folder. Rounds needed grow with the logarithm of the
    graph's size; ``RuntimeError`` if ``most_rounds`` don't settle it, never a partial result.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")

    def star(e: DataFrame, both: bool) -> DataFrame:
        around = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else e
        least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        linked = around.join(least, "a")
        if both:  # larger neighbours go to the least one
            return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        back = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(linked.select("a", F.col("m").alias("b")))
        return back.where("a <> b").distinct()

    seen = None
    for _ in range(most_rounds):
        now = stored(star(star(now, True), False), "star")
        mark = now.agg(F.count("a").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen:
            roots = now.select(F.col("b").alias("node")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root"))).distinct()
        seen = mark
    raise RuntimeError("the components did not settle")
