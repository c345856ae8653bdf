"""Type flow: declared types as roots, values that pass them on, and what each value may hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import rules
from quarryline.operators.flow import best_path
from quarryline.operators.graph import cyclic_components
from quarryline.operators.hierarchy import spec_roots
from quarryline.stages.artifact import Artifact


def flow_edges(parts: dict[str, DataFrame]) -> DataFrame:
    """(src, dst, confidence, hypothesis, edge): typed edge tables (src, dst) under their kinds, each kind with its confidence.

    A kind is written as name:confidence, with ? behind it where all its edges are hypotheses.
    """
    out = None
    for kind, rows in sorted(parts.items()):
        name, _, rank = kind.rstrip("?").partition(":")
        one = rows.select(F.col("src").cast("string"), F.col("dst").cast("string"), F.lit(int(rank or 3)).alias("confidence"), F.lit(kind.endswith("?")).alias("hypothesis"), F.concat_ws(">", F.lit(name), "src", "dst").alias("edge"))
        out = one if out is None else out.union(one)
    return out.dropDuplicates(["edge"])


def assignment_edges(assigned: DataFrame, known: DataFrame) -> DataFrame:
    """(src, dst) of assignments (function, target, value): from the one known variable in the value to the target.

    known is (function, variables); a value is a node function|variable.
    """
    met = assigned.join(known, "function").withColumn("source", rules.variable_of(F.col("value"), F.col("variables"))).where("source is not null and array_contains(variables, target)")
    node = lambda c: F.concat_ws("|", "function", c)
    return met.select(node("source").alias("src"), node("target").alias("dst"))


def infer_types(spark: SparkSession, tables: dict[str, DataFrame]) -> Artifact:
    """Tables in: specs (as in ``spec_roots``), classes, and edge tables (src, dst) named edges.kind:confidence[?]. Facts: values, atoms, cycles."""
    roots = spec_roots(tables["specs"], tables["classes"])
    started = roots.select(F.col("node").cast("string").alias("node"), F.concat_ws(" ", "kind", F.coalesce("class_name", F.lit(""))).alias("atom"), F.lit(3).alias("confidence"), "hypothesis")
    edges = flow_edges({k.removeprefix("edges."): v for k, v in tables.items() if k.startswith("edges.")})
    atoms = best_path(started, edges).select("node", "atom", "confidence", "hypothesis")
    counted = atoms.groupBy("node").agg(F.count(F.lit(1)).alias("n_atoms"), F.bool_or("hypothesis").alias("hypothesis"), F.min("confidence").alias("confidence"))
    every = edges.select(F.col("src").alias("node")).union(edges.select("dst")).union(started.select("node")).distinct()
    met = every.join(counted, "node", "left").na.fill({"n_atoms": 0, "hypothesis": False, "confidence": 1})
    values = met.select("node", "n_atoms", "confidence", rules.type_class(F.col("n_atoms"), F.col("hypothesis")).alias("classification"), rules.native_class(F.col("n_atoms"), F.col("hypothesis"), F.col("confidence")).alias("native_classification"))
    cycles = cyclic_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    open_ = values.where("classification = 'candidate_set'").select(F.lit("type").alias("kind"), F.col("node").alias("subject"), F.col("n_atoms").cast("string").alias("detail"))
    return Artifact("types", {"values": values, "atoms": atoms, "cycles": cycles}, open_)
