"""Bounded call slices with caps that cut and say so."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.functions import lattice
from quarryline.operators.lineage import cut

#: Depth, functions and edges of a slice at most.
DEPTH, FUNCTIONS, EDGES = 4, 256, 512


def call_slices(triggers: DataFrame, edges: DataFrame, external: DataFrame | None = None, depth: int = DEPTH, functions: int = FUNCTIONS, most: int = EDGES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, flags) of the slice behind each trigger.

    triggers: (trigger, node), a trigger may have several nodes; edges: (edge, caller, site, kind, target,
    classification), target NULL or the class unresolved where no target is proven; external: (node) of
    functions that are not followed further.

    The search is breadth first, callers in the order they were reached, a caller's edges by (site, kind,
    target, edge). Level by level gives the same as edge by edge, for all of a level's nodes are known before its
    first edge is followed. An edge over the cap is dropped; at the greatest depth, and over the cap of
    functions, the edge stays and its target does not. A node's class is the weakest of all arrivals on its
    level. nodes: (trigger, node, depth, classification, via); edges: (trigger, edge); flags: (trigger, reasons).
    """
    out = edges.select("edge", "caller", "site", "kind", "target", F.when(F.col("target").isNull(), 0).otherwise(F.coalesce(lattice.rank(F.col("classification")), F.lit(0))).alias("edge_rank"))
    # no trigger takes more than the cap of edges from one caller, plus one that says there are more
    own = F.row_number().over(Window.partitionBy("caller").orderBy("site", "kind", F.coalesce("target", F.lit("")), "edge"))
    out = cut(out.withColumn("own", own).where(F.col("own") <= most + 1))
    start = triggers.select("trigger", "node").distinct()
    known = cut(start.select("trigger", "node", F.lit(0).alias("depth"), F.lit(2).alias("node_rank"), F.array().cast("array<string>").alias("via")))
    frontier = cut(start.withColumn("turn", F.row_number().over(Window.partitionBy("trigger").orderBy("node")).cast("long")).withColumn("node_rank", F.lit(2)))
    used = cut(start.select("trigger").distinct().select("trigger", F.lit(0).cast("long").alias("n_edges")))
    all_edges, all_flags = [], []
    for level in range(depth + 1):
        if frontier.isEmpty():
            break
        place = F.row_number().over(Window.partitionBy("trigger").orderBy("turn", "own"))
        met = frontier.join(out, F.col("node") == F.col("caller")).join(used, "trigger").withColumn("place", F.col("n_edges") + place)
        met = cut(met.where(F.col("place") <= most + 1))
        flag = lambda rows, reason: rows.select("trigger", F.lit(reason).alias("reason")).distinct()
        all_flags.append(flag(met.where(F.col("place") > most), "edge_limit"))
        taken = met.where(F.col("place") <= most)
        all_edges.append(taken.select("trigger", "edge"))
        used = cut(used.join(taken.groupBy("trigger").agg(F.max("place").alias("upto")), "trigger", "left").select("trigger", F.coalesce("upto", "n_edges").alias("n_edges")))
        followed = taken.where("edge_rank > 0")
        if level == depth:
            all_flags.append(flag(followed, "depth_limit"))
            break
        arrivals = followed.join(known.select("trigger", F.col("node").alias("target")), ["trigger", "target"], "left_anti")
        reached = arrivals.groupBy("trigger", "target").agg(F.min("place").alias("turn"), F.min(F.least("node_rank", "edge_rank")).alias("node_rank"), F.array_sort(F.collect_set("edge")).alias("via"))
        held = known.groupBy("trigger").agg(F.count(F.lit(1)).alias("held"))
        order = F.row_number().over(Window.partitionBy("trigger").orderBy("turn"))
        reached = cut(reached.join(held, "trigger").withColumn("number", F.col("held") + order))
        all_flags.append(flag(reached.where(F.col("number") > functions), "function_limit"))
        new = reached.where(F.col("number") <= functions)
        known = cut(known.union(new.select("trigger", F.col("target").alias("node"), F.lit(level + 1).alias("depth"), "node_rank", "via")))
        frontier = new.select("trigger", F.col("target").alias("node"), "turn", "node_rank")
        frontier = cut(frontier.join(external.select("node"), "node", "left_anti") if external is not None else frontier)
    nodes = known.select("trigger", "node", "depth", lattice.label(F.col("node_rank")).alias("classification"), "via")
    flags = reduce(DataFrame.union, all_flags).groupBy("trigger").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons")) if all_flags else start.select("trigger", F.lit("").alias("reasons")).where("false")
    traced = reduce(DataFrame.union, all_edges) if all_edges else start.select("trigger", F.col("node").alias("edge")).where("false")
    return nodes, traced, flags


def within(rows: DataFrame, most: int, what: str) -> DataFrame:
    """The rows, or an error that names the cap when there are more of them."""
    n = rows.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} {what}")
    return rows
