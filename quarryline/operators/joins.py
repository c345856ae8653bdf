"""Joins that decide by position, cardinality or order, all as equi-joins over window-numbered rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.operators.lineage import cut


def numbered(rows: DataFrame, keys: list[str], order: list, name: str = "place") -> DataFrame:
    """Rows with their 1-based place within the keys; order has to be total."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def guarded_zip(left: DataFrame, right: DataFrame, keys: list[str], left_order: list, right_order: list, columns: list[str]) -> DataFrame:
    """The k-th left row of a group gets the k-th right row's columns, but only where both groups have the same size; else NULLs."""
    size = lambda df: df.withColumn("zip_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    a, b = size(numbered(left, keys, left_order, "zip_k")), size(numbered(right, keys, right_order, "zip_k"))
    return a.join(b.select(*keys, "zip_k", "zip_n", *columns), [*keys, "zip_k", "zip_n"], "left").drop("zip_k", "zip_n")


def match_groups(left: DataFrame, right: DataFrame, keys: list[str], identity: str) -> DataFrame:
    """Per group, associated when both sides count the same and the right has one distinct identity."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_right"), F.count_distinct(identity).alias("n_identities"), F.min(identity).alias("one"))
    met = a.join(b, keys, "left").withColumn("n_right", F.coalesce("n_right", F.lit(0))).withColumn("n_identities", F.coalesce("n_identities", F.lit(0)))
    ok = (F.col("n_left") == F.col("n_right")) & (F.col("n_identities") == 1)
    return met.select(*keys, "n_left", "n_right", F.when(ok, F.col("one")).alias("identity"), ok.alias("associated"))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of groups that have exactly one member on either side."""
    alone = lambda df: df.withColumn("alone_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("alone_n = 1").drop("alone_n")
    return alone(left).join(alone(right), keys)


def consume_once(left: DataFrame, right: DataFrame, keys: list[str], left_order: list, right_order: list, columns: list[str]) -> DataFrame:
    """Each right row is used at most once, in order; what is left over of either side stays, with side left, both or right."""
    a = numbered(left, keys, left_order, "use_k").withColumn("in_left", F.lit(True))
    b = numbered(right, keys, right_order, "use_k").withColumn("in_right", F.lit(True)).select(*keys, "use_k", "in_right", *columns)
    met = a.join(b, [*keys, "use_k"], "full")
    side = F.when(F.col("in_left").isNull(), "right").when(F.col("in_right").isNull(), "left").otherwise("both")
    return met.withColumn("side", side).drop("in_left", "in_right", "use_k")


def as_of(sites: DataFrame, facts: DataFrame, key: str, time: str, value: str, facts_inclusive: bool = True) -> DataFrame:
    """Each site with the value of the last fact at or before it: one union, one running window, no theta join.

    Ties between facts at one time go to the largest value. The carried value is the last non-null one.
    """
    first, second = (0, 1) if facts_inclusive else (1, 0)
    both = sites.withColumn("asof_value", F.lit(None).cast(facts.schema[value].dataType)).withColumn("asof_rank", F.lit(second)).withColumn("asof_site", F.lit(True)).unionByName(
        facts.select(key, time, F.col(value).alias("asof_value")).withColumn("asof_rank", F.lit(first)).withColumn("asof_site", F.lit(False)), allowMissingColumns=True
    )
    before = Window.partitionBy(key).orderBy(time, "asof_rank", F.col("asof_value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("found", F.last("asof_value", ignorenulls=True).over(before)).where("asof_site").drop("asof_value", "asof_rank", "asof_site")


def next_greater(rows: DataFrame, section: str, value: str, end: Column) -> DataFrame:
    """Distinct values of a section with the next larger one, the section's end for the last."""
    distinct = rows.select(section, value).distinct()
    following = F.lead(value).over(Window.partitionBy(section).orderBy(value))
    return distinct.withColumn("next", F.coalesce(following, end))


def cascade(keys: DataFrame, attempts: list[DataFrame | Callable[[DataFrame], DataFrame]], key: str) -> DataFrame:
    """Keys with the candidates of the first attempt that has any for a key, and that attempt's number (level); NULLs where none has.

    An attempt is a table (key, candidate), or gets the rows of keys that are still without candidates and gives
    one, so that a wide fallback never meets what a narrow one has settled.
    """
    rest, found = cut(keys), None
    for i, attempt in enumerate(attempts):
        tried = attempt(rest) if callable(attempt) else attempt.join(rest.select(key), key, "left_semi")
        part = cut(tried.select(key, "candidate", F.lit(i).alias("level")).distinct())
        found = part if found is None else found.union(part)
        if i + 1 < len(attempts):
            rest = cut(rest.join(part.select(key).distinct(), key, "left_anti"))
    return keys.join(found, key, "left")


def cascade_summaries(keys: DataFrame, targets: DataFrame, levels: list[list[str]], key: str, candidate: str) -> DataFrame:
    """(key, level, n_candidates, first_candidate): how many candidates the first level of common columns has that has any.

    Targets are counted by each level's columns first, so a frequent value is one row, not all its pairs. Keys and candidates are unique.
    """
    met = keys
    for i, on in enumerate(levels):
        counted = targets.groupBy(*on).agg(F.count(F.lit(1)).alias(f"n_{i}"), F.min(candidate).alias(f"first_{i}"))
        met = met.join(counted, on, "left")
    level = F.coalesce(*(F.when(F.col(f"n_{i}").isNotNull(), i) for i in range(len(levels))))
    first = lambda name: F.coalesce(*(F.col(f"{name}_{i}") for i in range(len(levels))))
    return met.select(key, level.alias("level"), F.coalesce(first("n"), F.lit(0)).alias("n_candidates"), first("first").alias("first_candidate"))


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """one row of each key, the first by a total order."""
    return numbered(rows, keys, order, "first_k").where("first_k = 1").drop("first_k")
