"""Behaviour of functions from their texts: contracts, returns, guards, constants and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import grammar, rules
from quarryline.functions.text import lines
from quarryline.operators import evidence
from quarryline.operators.matching import match_parameters
from quarryline.operators.slices import within
from quarryline.stages.artifact import Artifact

#: Most transitions, and the forms of guards, returns and numbers.
MOST_TRANSITIONS = 100_000
GUARD, RETURN, NUMBER = r"\b(?:if|while|switch)\s*\((.*)\)", r"^\s*return\b\s*([^;]*);", r"(?<![A-Za-z0-9_.])[0-9]+(?:\.[0-9]+)?(?![A-Za-z0-9_.])"


def contracts(texts: DataFrame, records: DataFrame) -> DataFrame:
    """(function, position, name, type, type_id) of each function's parameters, with the type record that goes with it."""
    heads = texts.select("function", grammar.heads(F.substring_index("text", "{", 1)).alias("head")).where("head.name is not null")
    parameters = heads.select("function", F.posexplode("head.parameters").alias("position", "p")).select("function", "position", F.coalesce("p.name", F.concat(F.lit("parameter_"), "position")).alias("name"), F.col("p.type").alias("type"))
    matched = match_parameters(parameters.select("function", "position", "name"), records, "function").select("function", "position", "type_id")
    return parameters.join(matched, ["function", "position"], "left")


def _unquoted(line):
    return F.regexp_replace(line, r'"(?:\\.|[^"\\])*+"', '""')


def sites(texts: DataFrame, form: str, name: str, strings: bool = True) -> DataFrame:
    """(function, line_no, ordinal, name) of a form's matches line by line; without strings, what stands in quotes does not count."""
    rows = lines(texts, "function", "text")
    rows = rows if strings else rows.withColumn("line", _unquoted(F.col("line")))
    found = rows.select("function", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(form), F.lit(1 if "(" in form.replace("(?", "") else 0))).alias("ordinal", name))
    return found


def accesses(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(function, line_no, member, access) of self->member and this->member; members is (function, member), those its class has."""
    rows = lines(texts, "function", "text").where(F.col("line").contains("->"))
    used = rows.select("function", "line_no", "line", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\b((?:self|this)->[A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1)))).alias("token"))
    named = used.withColumn("bare", F.substring_index("token", "->", -1))
    known = members.select("function", "member", F.explode(F.array_distinct(F.array("member", F.regexp_replace("member", "^_+", "")))).alias("bare"))
    return named.join(known, ["function", "bare"]).select("function", "line_no", "member", rules.access_kind(F.col("line"), F.col("token")).alias("access")).distinct()


def transitions(used: DataFrame) -> DataFrame:
    """(member, function, writer): functions that read a state with each function that writes it, capped by an error."""
    reads = used.where("access = 'read'").select("member", "function").distinct()
    writes = used.where("access = 'write'").select("member", F.col("function").alias("writer")).distinct()
    return within(reads.join(writes, "member").where("function <> writer"), MOST_TRANSITIONS, "transitions")


def lift_behavior(spark: SparkSession, tables: dict[str, DataFrame]) -> Artifact:
    """Tables in: texts (function, text), records (function, type_id, name, position), members (function, member).
    Facts: contracts, returns, guards, constants, accesses, states, transitions."""
    texts = tables["texts"]
    used = accesses(texts, tables["members"])
    state = evidence.state_variables(used.select(F.col("member").alias("state"), "function", "access", F.concat_ws(":", "function", F.col("line_no").cast("string")).alias("expression"), F.lit("member").alias("type"), F.lit("candidate_set").alias("classification")), "state")
    facts = {
        "contracts": contracts(texts, tables["records"]), "returns": sites(texts, RETURN, "value"), "guards": sites(texts, GUARD, "condition"), "constants": sites(texts, NUMBER, "number", strings=False),
        "accesses": used, "states": state, "transitions": transitions(used),
    }
    return Artifact("behavior", facts)
