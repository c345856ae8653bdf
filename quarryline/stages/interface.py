"""The interface: screens and their elements, connections to code, and the pictures and texts that they name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import rules
from quarryline.operators.graph import closure
from quarryline.operators.joins import cascade
from quarryline.sources import interfaces
from quarryline.sources.files import localized
from quarryline.stages.artifact import Artifact


def controller_classes(classes: DataFrame, bases: DataFrame) -> DataFrame:
    """I8: (class_name) of all classes at or below the base controllers."""
    below = closure(classes.where("superclass is not null").select(F.col("superclass").alias("a"), F.col("class_name").alias("b")), sources=bases.select(F.col("class_name").alias("a")))
    return bases.select("class_name").union(below.select(F.col("b").alias("class_name"))).distinct()


def field_values(elements: DataFrame) -> DataFrame:
    """(path, node, field, value, role) of all attributes."""
    rows = elements.select("path", "node", F.explode("attributes").alias("field", "value"))
    return rows.withColumn("role", rules.field_role(F.col("field")))


def asset_matches(fields: DataFrame, assets: DataFrame) -> DataFrame:
    """(path, node, value, candidate) of picture fields: by whole path, else by name, else by the name without suffix and scale; candidate NULL where none fits.

    assets is (asset, asset_path).
    """
    name = F.regexp_extract("asset_path", r"([^/]+)$", 1)
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"(?i)@[1-9][0-9]*x$", "")
    asked = fields.where("role = 'image'").select("value").distinct()
    wanted = F.regexp_replace("value", r"\\", "/")
    base = F.regexp_extract(wanted, r"([^/]+)$", 1)
    attempts = [(F.col("asset_path"), wanted), (name, base), (stem, F.regexp_replace(F.regexp_replace(base, r"\.[^.]*$", ""), r"(?i)@[1-9][0-9]*x$", ""))]
    found = [lambda rest, theirs=theirs, mine=mine: rest.select("value", mine.alias("k")).join(assets.select(theirs.alias("k"), F.col("asset").alias("candidate")), "k").select("value", "candidate") for theirs, mine in attempts]
    best = cascade(asked, found, "value").select("value", "candidate")
    return fields.where("role = 'image'").select("path", "node", "value").join(best, "value").select("path", "node", "value", "candidate")


def action_matches(connections: DataFrame, elements: DataFrame, methods: DataFrame) -> DataFrame:
    """(path, source, selector, method_id, classification): methods behind actions, by the destination's class and selector, else by selector alone."""
    named = elements.where("custom_class is not null").select("path", F.col("node_id").alias("destination"), "custom_class")
    actions = connections.where("kind = 'action'").join(named, ["path", "destination"], "left").withColumn("action", F.concat_ws("|", "path", "source", "selector", "destination"))
    named_by = methods.select(F.col("class_name").alias("custom_class"), "selector", F.col("method_id").alias("candidate"))
    asked = actions.select("action", "custom_class", "selector").distinct()
    found = cascade(asked, [lambda rest: rest.join(named_by, ["custom_class", "selector"]), lambda rest: rest.join(named_by.drop("custom_class"), "selector")], "action")
    counted = found.groupBy("action").agg(F.array_sort(F.collect_set("candidate")).alias("method_ids"))
    n = F.size("method_ids")
    return actions.join(counted, "action").select("path", "source", "selector", "method_ids", F.when(n == 0, "unresolved").when(n == 1, "exact").otherwise("candidate_set").alias("classification"))


def recover_interface(spark: SparkSession, tables: dict[str, DataFrame]) -> Artifact:
    """Tables in: interface_files and string_files (path, content), classes, bases (class_name), methods (method_id, class_name, selector), assets.
    Facts: elements, screens, connections, actions, fields, pictures, texts; errors: files and keys that were not accepted."""
    every = interfaces.elements(tables["interface_files"])
    elements = every.where("error is null")
    known = controller_classes(tables["classes"], tables["bases"])
    mine = elements.join(known.select(F.col("class_name").alias("custom_class"), F.lit(True).alias("is_known")), "custom_class", "left")
    screens = mine.where("is_known or lower(tag) like '%controller'").select("path", "node_id", "tag", "custom_class", F.when(F.col("is_known"), "exact").when(F.col("custom_class").isNull(), "exact").otherwise("candidate_set").alias("classification"))
    connections = interfaces.connections(elements)
    fields = field_values(elements)
    texts = localized(tables["string_files"]).withColumn("locale", F.regexp_extract("path", r"([^/]+)\.lproj/", 1))
    wrong = every.where("error is not null").select(F.col("error").alias("code"), F.col("path").alias("subject")).union(texts.where("error is not null").select("error", "path"))
    facts = {
        "elements": elements, "screens": screens, "connections": connections, "actions": action_matches(connections, elements, tables["methods"]), "fields": fields, "pictures": asset_matches(fields, tables["assets"]),
        "texts": texts.where("error is null").drop("error"),
    }
    return Artifact("interface", facts, errors=wrong.groupBy("code", "subject").agg(F.count(F.lit(1)).alias("n")))
