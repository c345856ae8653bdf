"""The platform map: where imported symbols come from and which message calls leave the application."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import rules
from quarryline.operators.aggs import inverted_index
from quarryline.operators.hierarchy import inherited
from quarryline.stages.artifact import Artifact


def imported_symbols(imports: DataFrame, libraries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(arch, name, kind, class_name, library, category, reason): the library that a symbol's ordinal names, and its catalogued category.

    imports is (arch, name, ordinal), libraries (arch, ordinal, library) in load order from 1, catalogue (library, category).
    """
    met = imports.join(libraries, ["arch", "ordinal"], "left").join(catalogue, "library", "left")
    told = met.withColumn("k", rules.import_kind(F.col("name")))
    return told.select("arch", "name", "k.kind", "k.class_name", "library", "category", F.when(F.col("library").isNull(), "ordinal_names_no_library").alias("reason"))


def message_status(callsites: DataFrame, imported: DataFrame, local: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(edge, external, n_external, n_local, status, classification) of message calls.

    A candidate class is external if it is imported, or if it inherits from an imported one without being defined here.
    callsites is (edge, class_names, receiver_kind, receiver_status, n_targets).
    """
    names = imported.where("class_name <> ''").select(F.col("class_name").alias("candidate")).distinct()
    outside = inherited(names.select(F.col("candidate").alias("node"), F.col("candidate").alias("member")), ancestors).select(F.col("node").alias("candidate")).distinct()
    outside = outside.join(local.select(F.col("class_name").alias("candidate")), "candidate", "left_anti")
    asked = callsites.select("edge", F.explode("class_names").alias("candidate")).distinct()
    counted = asked.join(outside, "candidate", "left_semi").groupBy("edge").agg(F.array_sort(F.collect_set("candidate")).alias("external"))
    proven = (F.col("receiver_status") == "resolved") & F.col("receiver_kind").isin("class_object", "super")
    met = callsites.join(counted, "edge", "left").withColumn("n_external", F.coalesce(F.size("external"), F.lit(0)))
    met = met.withColumn("s", rules.platform_status(F.col("n_external"), proven, F.col("n_targets")))
    return met.select("edge", F.coalesce("external", F.array().cast("array<string>")).alias("external"), "n_external", F.col("n_targets").alias("n_local"), "s.status", "s.classification")


def map_platform(spark: SparkSession, tables: dict[str, DataFrame]) -> Artifact:
    """Tables in: imports, libraries, catalogue, classes (arch, class_name, superclass), dispatch.callsites. Facts: symbols, messages, index; errors: ordinals."""
    symbols = imported_symbols(tables["imports"], tables["libraries"], tables["catalogue"])
    ancestors = tables["classes"].select(F.col("class_name").alias("node"), F.col("superclass").alias("parent"))
    messages = message_status(tables["dispatch.callsites"], symbols, tables["classes"], ancestors)
    errors = symbols.where("reason is not null").groupBy(F.col("reason").alias("code")).agg(F.count(F.lit(1)).alias("n")).select("code", F.lit("imports").alias("subject"), "n")
    return Artifact("platform", {"symbols": symbols, "messages": messages, "index": inverted_index(symbols, ["kind", "library", "category"], "name")}, errors=errors)
