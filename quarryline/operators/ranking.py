"""Global ranks that no single task has to compute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def global_rank(rows: DataFrame, scope: str, phase: str, order: list[str], parts: int | None = None) -> DataFrame:
    """Rank over (phase, order), place and total within scope; each scope has one phase.

    Rows are range-partitioned by the whole order; each range counts itself, and the counts of the ranges
    before, one row per range and scope, are added to the place within the range. A range is fixed by its
    rows' order, so a recomputed task numbers alike.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [phase, scope, *order]
    cuts = rows.select(*keys).sample(withReplacement=False, fraction=_fraction(rows, parts), seed=3).orderBy(*keys).collect()
    cuts = cuts[:: max(1, len(cuts) // parts)][1:]
    # one literal per cut: as many as shuffle partitions, whatever the rows
    at = F.lit(0)
    here = F.struct(*keys)
    for cut in cuts:
        there = F.struct(*(F.lit(v).alias(k) for k, v in zip(keys, cut, strict=True)))
        at = at + F.when(here >= there, 1).otherwise(0)
    dealt = rows.withColumn("range_no", at)
    counts = dealt.groupBy("range_no", phase, scope).agg(F.count(F.lit(1)).alias("n"))
    ranges = counts.groupBy("range_no").agg(F.sum("n").alias("in_range"))
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    ranges = F.broadcast(ranges.select("range_no", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("before_range")))
    before = Window.partitionBy("range_no").orderBy(phase, scope).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(scope).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.join(ranges, "range_no").select(
        "range_no", scope, (F.col("before_range") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("ahead"), F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("ahead_in_scope"), F.sum("n").over(Window.partitionBy(scope)).alias("total")
    )
    local = F.row_number().over(Window.partitionBy("range_no", scope).orderBy(*order))
    placed = dealt.withColumn("local", local).join(firsts, ["range_no", scope])
    return placed.select(*rows.columns, (F.col("ahead") + F.col("local")).alias("rank"), (F.col("ahead_in_scope") + F.col("local")).alias("place"), "total")


def _fraction(rows: DataFrame, parts: int) -> float:
    """Sampling rate that yields about 20 rows per part."""
    return min(1.0, 20 * parts / max(1, rows.count()))
