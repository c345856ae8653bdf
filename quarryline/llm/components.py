"""Connected components by alternating stars, entirely in shuffles that combine before they send."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import keep


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours the smallest label it sees."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours the smallest of them. Here a > b always."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    turned = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return turned.where("a <> b").distinct()


def connect(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes in links (a, b): label is the smallest node of the component."""
    edges = keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        after = keep(_small_star(_large_star(edges)))
        mark = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
        same = edges.agg(*mark).first() == after.agg(*mark).first()
        edges = after
        if same:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
