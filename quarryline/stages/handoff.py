"""The hand-off: work items in one order, packed by scope, with what is open about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import rules
from quarryline.functions.ids import stable_id
from quarryline.operators import evidence
from quarryline.operators.pack import next_fit
from quarryline.operators.ranking import global_rank
from quarryline.stages.artifact import Artifact

#: Items and bytes of a packet, and the phase of an item by its class and kind.
MOST_ITEMS, MOST_BYTES = 32, 4 << 20
PHASES = {"navigation": 1, "component": 2, "state": 3, "persistence": 4, "networking": 5, "platform_dependency": 6}


def work_items(effects: DataFrame, screens: DataFrame) -> DataFrame:
    """(item, scope, kind, phase, classification, subject, size): effects by screen, a screen NULL where there is none, and the screens themselves.

    effects is (effect, kind, classification, screens), screens is (screen, classification).
    """
    spread = effects.select(F.col("effect").alias("subject"), F.explode_outer("screens").alias("scope"), rules.item_kind(F.col("kind")).alias("kind"), "classification")
    every = spread.union(screens.select(F.col("screen").alias("subject"), F.col("screen").alias("scope"), F.lit("screen").alias("kind"), "classification"))
    number = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in PHASES.items() for x in pair)), F.col("kind")), F.lit(0))
    phase = F.when(F.col("classification") == "unresolved", 9).otherwise(number)
    return every.select(stable_id("item", F.col("kind"), F.col("subject"), F.col("scope")).alias("item"), F.coalesce("scope", F.lit("")).alias("scope"), "kind", phase.alias("phase"), "classification", "subject").withColumn("size", F.octet_length(F.to_json(F.struct("item", "scope", "kind", "classification", "subject"))).cast("long"))


def build_handoff(spark: SparkSession, tables: dict[str, DataFrame]) -> Artifact:
    """Tables in: effects, screens (as in ``work_items``), reasons (subject, reasons), candidates (subject, candidate).
    Facts: items, packets, plans, questions, alternatives; errors: screens that items name and nobody knows."""
    items = work_items(tables["effects"], tables["screens"])
    ranked = global_rank(items.withColumn("phase_scope", F.concat_ws("|", "phase", "scope")), "phase_scope", "phase", ["scope", "item"]).drop("place", "total", "phase_scope")
    packed = next_fit(ranked, "scope", ["rank"], "size", MOST_ITEMS, MOST_BYTES)
    documents = evidence.packet_documents(packed.withColumn("scope", F.nullif("scope", F.lit(""))), "scope")
    plans = ranked.groupBy("scope").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.count(F.lit(1)).alias("n"), *evidence.histogram_columns("classification", ("exact", "candidate_set", "unresolved")))
    said = items.join(tables["reasons"], "subject", "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))
    alternatives = evidence.alternatives(items.select("item", "subject").join(tables["candidates"], "subject").select("item", "candidate"), "item", "candidate")
    unknown = items.where("scope <> ''").select("scope").distinct().join(tables["screens"].select(F.col("screen").alias("scope")), "scope", "left_anti")
    errors = unknown.select(F.lit("screen_unknown").alias("code"), F.col("scope").alias("subject"), F.lit(1).cast("long").alias("n"))
    return Artifact("handoff", {"items": packed, "packets": documents, "plans": plans, "questions": evidence.questions(said, "item", "work_item"), "alternatives": alternatives}, errors=errors)
