"""Aggregations with fixed domains, bounded lists and several groupings of one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zero_filled(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """A count for every value of the domain, 0 where there is none; counts of other values, of which there may be many, are not sent."""
    spark = rows.sparkSession
    all_values = spark.createDataFrame([(v,) for v in domain], f"{column} string")
    counted = rows.where(F.col(column).isin(*domain)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return all_values.join(F.broadcast(counted), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def top_k_overflow(rows: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The k smallest distinct values of each key, comma-joined, and how many more there are.

    Distinct values are ranked, so that a frequent key's full list is never held in one row.
    """
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy(key).orderBy(value))
    ranked = rows.select(key, value).distinct().withColumn("topk_place", place)
    return ranked.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("topk_place") <= k, F.struct("topk_place", value)))), lambda s: s[value].cast("string")), ",").alias("ids"),
        F.greatest(F.count(F.lit(1)) - k, F.lit(0)).cast("long").alias("overflow"),
    )


def joined_set(value: Column, separator: str = ",") -> Column:
    """E5 as an aggregate: the distinct values in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(value)), separator)


def inverted_index(rows: DataFrame, dimensions: list[str], member: str) -> DataFrame:
    """(dimension, key, n_members) for several keys from one scan, by grouping sets."""
    exploded = rows.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key")) for d in dimensions))).alias("e"), member)
    return exploded.where("e.key is not null").groupBy("e.dimension", "e.key").agg(F.count_distinct(member).alias("n_members"))
