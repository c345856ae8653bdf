"""Native types: fields by their places, layouts by their owners, virtual calls by their slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import native
from quarryline.operators.joins import match_groups
from quarryline.stages.artifact import Artifact


def infer_native(spark: SparkSession, tables: dict[str, DataFrame], pointer: int = 4) -> Artifact:
    """Tables in: texts (function, text), receivers (function, base, classes, exact), indirect_edges (function, edge).
    Facts: accesses, fields, layouts, virtual_calls, associations (D10); errors: reasons of fields that are not exact."""
    accesses = native.field_accesses(tables["texts"], pointer)
    fields, layouts = native.layouts(accesses, tables["receivers"])
    calls = native.virtual_calls(tables["texts"], pointer)
    linked = match_groups(tables["indirect_edges"], calls, ["function"], "slot")
    errors = fields.where("reasons <> ''").select(F.explode(F.split("reasons", ",")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).select("code", F.lit("fields").alias("subject"), "n")
    return Artifact("native", {"accesses": accesses, "fields": fields, "layouts": layouts, "virtual_calls": calls, "associations": linked}, errors=errors)
