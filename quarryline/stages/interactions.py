"""Interactions: what sets code off, what it reaches, and what that does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import lattice, rules
from quarryline.operators import evidence, slices
from quarryline.operators.aggs import zero_filled
from quarryline.stages.artifact import Artifact

KINDS = sorted(rules.ITEM_KINDS)


def screens_of(methods: DataFrame, screens: DataFrame) -> DataFrame:
    """(method_id, screens): the screens whose controller class has the method."""
    met = methods.join(screens.where("custom_class is not null").select(F.col("custom_class").alias("class_name"), F.concat_ws("#", "path", "node_id").alias("screen")), "class_name")
    return met.groupBy("method_id").agg(F.array_sort(F.collect_set("screen")).alias("screens"))


def action_triggers(actions: DataFrame, methods: DataFrame, screens: DataFrame) -> DataFrame:
    """A control's action with the functions of its methods."""
    each = actions.select(F.concat_ws("#", "path", "source").alias("subject"), "selector", "classification", F.explode_outer("method_ids").alias("method_id"))
    met = each.join(methods.select("method_id", "function_id"), "method_id", "left").join(screens_of(methods, screens), "method_id", "left")
    none = F.array().cast("array<string>")
    return met.groupBy("subject", "selector", "classification").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("screens", none))))).alias("screens"), F.array_sort(F.collect_set("function_id")).alias("handlers")
    ).select(F.lit("ui_action").alias("kind"), "subject", "selector", F.lit("control").alias("event"), "classification", "screens", "handlers", none.alias("reasons"))


def method_triggers(methods: DataFrame, contracts: DataFrame, screens: DataFrame) -> DataFrame:
    """Methods whose selector a catalogue (selector, kind, event) knows: life cycle, delegates, notifications, timers, completions."""
    met = methods.where("function_id is not null").join(contracts, "selector").join(screens_of(methods, screens), "method_id", "left")
    none = F.array().cast("array<string>")
    return met.select("kind", F.col("method_id").alias("subject"), "selector", "event", F.lit("exact").alias("classification"), F.coalesce("screens", none).alias("screens"), F.array("function_id").alias("handlers"), none.alias("reasons"))


def recover_interactions(spark: SparkSession, tables: dict[str, DataFrame]) -> Artifact:
    """Tables in: interface.actions, interface.screens, methods (method_id, class_name, selector, function_id), contracts, calls (as in ``call_slices``), external (node),
    operations (a fact table as in ``effects``). Facts: triggers, nodes, edges, effects, kinds; hypotheses: candidates; errors: cut slices."""
    methods, screens = tables["methods"], tables["interface.screens"]
    triggers = evidence.triggers([action_triggers(tables["interface.actions"], methods, screens), method_triggers(methods, tables["contracts"], screens)])
    roots = triggers.select("trigger", F.explode("handlers").alias("node"))
    nodes, traced, flags = slices.call_slices(roots, tables["calls"], tables.get("external"))
    effects = evidence.effects(nodes, triggers, [tables["operations"]])
    open_ = effects.where("classification <> 'exact'").select(F.concat(F.lit("effect_"), "kind").alias("kind"), F.col("effect").alias("subject"), F.col("classification").alias("detail"))
    errors = flags.select(F.explode(F.split("reasons", ",")).alias("code"), F.col("trigger").alias("subject"), F.lit(1).cast("long").alias("n"))
    facts = {"triggers": triggers, "nodes": nodes, "edges": traced, "effects": effects, "kinds": zero_filled(effects, "kind", KINDS)}
    return Artifact("interactions", facts, open_, errors)


def interaction_classes(effects: DataFrame) -> DataFrame:
    """K1: (trigger, n, classification): the weakest of a trigger's effects."""
    return effects.groupBy("trigger").agg(F.count(F.lit(1)).alias("n"), lattice.meet_lenient(F.col("classification")).alias("classification"))
