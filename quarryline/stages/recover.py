"""Recovery: methods of classes and categories, mapped to functions once each, with the entities that only methods name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import rules
from quarryline.functions.ids import address, stable_id
from quarryline.operators.hierarchy import late_members
from quarryline.operators.joins import consume_once
from quarryline.operators.naming import collision_safe
from quarryline.stages.artifact import Artifact


def method_rows(classes: DataFrame) -> DataFrame:
    """Nested methods (arch, class_name, category, instance_methods, class_methods) as rows with their exact names."""
    each = lambda column, kind: classes.select("arch", "class_name", "category", F.lit(kind).alias("kind"), F.explode(column).alias("m"))
    rows = each("instance_methods", "instance").union(each("class_methods", "class"))
    shown = F.concat("class_name", F.coalesce(F.concat(F.lit("("), "category", F.lit(")")), F.lit("")))
    fixed = rules.canonical_address(F.col("m.implementation"), F.col("arch"))
    name = F.concat(F.when(F.col("kind") == "class", "+[").otherwise("-["), shown, F.lit(" "), F.col("m.selector"), F.lit("]"))
    rows = rows.where("m.implementation is not null").select("arch", "class_name", "category", "kind", F.col("m.selector").alias("selector"), F.col("m.encoding").alias("encoding"), fixed.alias("fixed"), name.alias("exact_name"))
    return rows.select("arch", "class_name", "category", "kind", "selector", "encoding", F.col("fixed.address").alias("address"), F.col("fixed.flagged").alias("flagged"), "exact_name")


def complete_methods(source: DataFrame, mapped: DataFrame) -> DataFrame:
    """Each source method with the function that is mapped to the same architecture, address and name, at most one each.

    source is what ``method_rows`` gives; mapped is (arch, address, exact_name, function_id). What is left over of either side
    stays: unmapped methods, and mapped ones that no metadata tells of.
    """
    keys = ["arch", "address", "exact_name"]
    met = consume_once(source, mapped, keys, ["class_name", "category", "kind"], ["function_id"], ["function_id"])
    state = F.when(F.col("side") == "both", "mapped").when(F.col("side") == "left", "unmapped").otherwise("method_only")
    reason = F.when(F.col("side") == "left", "no_function_at_the_address_has_the_name").when(F.col("side") == "right", "no_metadata_for_the_method")
    return met.select(stable_id("objc-method", F.col("arch"), address(F.col("address")), F.col("exact_name"), F.col("function_id")).alias("method_id"), *source.columns, "function_id", state.alias("state"), reason.alias("reason"))


def merged_protocols(protocols: DataFrame) -> DataFrame:
    """(arch, name, address, occurrences, methods, inherited): one row a name, the smallest address, lists united."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return protocols.groupBy("arch", "name").agg(F.min("address").alias("address"), F.count(F.lit(1)).alias("occurrences"), union("methods").alias("methods"), union("inherited").alias("inherited"))


def function_rows(functions: DataFrame, methods: DataFrame, statuses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(functions, missing): each function's class, methods and status; internal ones without a status are missing.

    functions is (function_id, external, thunk), statuses is (function_id, status).
    """
    held = methods.where("function_id is not null").groupBy("function_id").agg(F.array_sort(F.collect_set("method_id")).alias("method_ids"))
    met = functions.join(held, "function_id", "left").join(statuses.select("function_id", "status"), "function_id", "left")
    eligible = ~F.col("external") & ~F.col("thunk")
    rows = met.select(
        "function_id", rules.function_class(F.col("method_ids").isNotNull(), F.col("external"), F.col("thunk")).alias("kind"), F.coalesce("method_ids", F.array().cast("array<string>")).alias("method_ids"),
        F.coalesce("status", F.when(~eligible, "not_eligible")).alias("status"),
    )
    return rows, rows.where("status is null").select("function_id")


def recover(spark: SparkSession, tables: dict[str, DataFrame]) -> Artifact:
    """Tables in: nested_classes, mapped, functions, statuses, protocols. Facts: methods, functions, entities, protocols."""
    source = method_rows(tables["nested_classes"])
    methods = complete_methods(source, tables["mapped"])
    functions, missing = function_rows(tables["functions"], methods, tables["statuses"])
    known = tables["nested_classes"].select("arch", "class_name", "category").distinct()
    entities = late_members(known, methods.where("class_name is not null"), ["arch", "class_name", "category"])
    shown = F.concat("class_name", F.coalesce(F.concat(F.lit("+"), "category"), F.lit("")))
    entities = entities.withColumn("entity_id", stable_id("objc-entity", F.col("arch"), F.col("class_name"), F.col("category"))).withColumn("shown", shown)
    named = collision_safe(entities, "entity_id", "shown")
    errors = missing.select(F.lit("status_missing").alias("code"), F.col("function_id").alias("subject"), F.lit(1).cast("long").alias("n"))
    return Artifact("recovered", {"methods": methods, "functions": functions, "entities": entities.join(named, "entity_id"), "protocols": merged_protocols(tables["protocols"])}, errors=errors)
