"""Window joins without theta conditions: a running count of sites is the join key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarryline.functions.lattice import by_cardinality


def window_ids(rows: DataFrame, owner: str, order: list[str], site: Column, name: str = "grp") -> DataFrame:
    """Number of sites strictly before each row of the same owner."""
    before = Window.partitionBy(owner).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(F.when(site, 1).otherwise(0)).over(before), F.lit(0)))


def windowed_values(rows: DataFrame, owner: str, order: list[str], site: Column, reference: Column, value: str, site_id: str) -> DataFrame:
    """One row per site: how many references and which distinct values lie in its window.

    The references after the last site carry a window id that no site has, so they drop out. All rows of a
    window are already together after the running count, so no second shuffle of the references is needed
    beyond the grouping itself.
    """
    ids = window_ids(rows, owner, order, site)
    inside = F.when(reference, F.col(value))
    return (
        ids.groupBy(owner, "grp")
        .agg(
            F.max(F.when(site, F.col(site_id))).alias(site_id),
            F.count_distinct(inside).cast(T.LongType()).alias("n_candidates"),
            F.count(F.when(reference, 1)).cast(T.LongType()).alias("n_references"),
            F.max(inside).alias("last_value"),
        )
        .where(F.col(site_id).isNotNull())
    )


def resolve_in_window(rows: DataFrame, owner: str, order: list[str], site: Column, reference: Column, value: str, site_id: str) -> DataFrame:
    """Sites with the cardinality class of their window's distinct values."""
    found = windowed_values(rows, owner, order, site, reference, value, site_id)
    return found.select(site_id, owner, "n_candidates", by_cardinality(F.col("n_candidates")).alias("status"))
