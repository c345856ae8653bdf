"""Numeric field accesses and virtual calls in decompiled text, as rows, and the layouts that follow from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.ids import stable_id
from quarryline.functions.rules import native_type
from quarryline.functions.text import lines

_NAME, _NUMBER = r"[A-Za-z_$][A-Za-z0-9_$]*", r"(?:0x[0-9A-Fa-f]+|[0-9]+)"
#: How a decompiler writes an access to a field by its place, and a call by its slot. Earlier forms win where they start alike.
ACCESSES = {
    "pointer": rf"\*\s*\(\s*{_NAME}(?:[A-Za-z0-9_$:\s]*?)\s*\*\s*\)\s*\(\s*(?:\([^)]*\)\s*)?{_NAME}\s*[+-]\s*{_NUMBER}\s*\)",
    "array": rf"{_NAME}\s*->\s*field0_0x0\s*\[\s*[0-9]+\s*\]",
    "member": rf"{_NAME}\s*->\s*field(?:0)?_0x[0-9A-Fa-f]+",
}
CALLS = {
    "byte_offset": rf"\*\*\s*\(\s*code\s*\*\*\s*\)\s*\(\s*(?:\*\s*\([^)]*\)\s*)?{_NAME}[^;\n]{{0,100}}?\+\s*{_NUMBER}\s*\)",
    "array_index": ACCESSES["array"],
    "zero_offset": rf"\*\*\s*\(\s*code\s*\*\*\s*\)\s*\*\s*{_NAME}",
}


def _number(text: Column) -> Column:
    """A decimal or hexadecimal number."""
    return F.when(text.startswith("0x"), F.conv(F.substr(text, F.lit(3)), 16, 10)).otherwise(text).try_cast("long")


def _found(texts: DataFrame, forms: dict[str, str]) -> DataFrame:
    """(function, line_no, line, ordinal, start, body, form) of all matches of a line, from the left, each by its first form."""
    either = "|".join(f"(?:{p})" for p in forms.values())
    rows = lines(texts, "function", "text").where(F.col("line").rlike(either))
    rows = rows.select("function", "line_no", "line", F.regexp_extract_all("line", F.lit(either), F.lit(0)).alias("found"), F.transform(F.split("line", either, -1), F.length).alias("gaps"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    rows = rows.select("function", "line_no", "line", "found", "gaps", F.posexplode_outer("found").alias("ordinal", "body"))
    start = total(F.slice("gaps", F.lit(1), F.col("ordinal") + 1)) + total(F.transform(F.slice("found", F.lit(1), F.col("ordinal")), F.length))
    form = reduce(lambda out, f: out.when(F.col("body").rlike(f"^(?:{f[1]})$"), f[0]), forms.items(), F.when(F.lit(False), ""))
    return rows.select("function", "line_no", "line", "ordinal", start.alias("start"), "body", form.alias("form"))


def field_accesses(texts: DataFrame, pointer: int) -> DataFrame:
    """(function, line_no, ordinal, form, base, offset, width, type, access) of texts (function, text).

    An access left of the line's first equal sign writes; widths follow from the cast type, or are a pointer's for array places.
    """
    body = F.col("body")
    cast = F.trim(F.regexp_extract(body, r"^\*\s*\(\s*([^*]*?)\s*\*", 1))
    sign = F.when(F.regexp_extract(body, rf"([+-])\s*{_NUMBER}\s*\)$", 1) == "-", -1).otherwise(1)
    offset = (
        F.when(F.col("form") == "pointer", sign * _number(F.regexp_extract(body, rf"[+-]\s*({_NUMBER})\s*\)$", 1)))
        .when(F.col("form") == "array", _number(F.regexp_extract(body, r"\[\s*([0-9]+)", 1)) * pointer).otherwise(F.conv(F.regexp_extract(body, r"_0x([0-9A-Fa-f]+)$", 1), 16, 10).cast("long"))
    )
    base = F.when(F.col("form") == "pointer", F.regexp_extract(body, rf"({_NAME})\s*[+-]\s*{_NUMBER}\s*\)$", 1)).otherwise(F.regexp_extract(body, rf"^({_NAME})", 1))
    kind = F.when(F.col("form") == "pointer", cast)
    width = F.when(F.col("form") == "pointer", native_type(kind, pointer)["width"]).when(F.col("form") == "array", pointer)
    access = F.when(F.col("start") < F.instr("line", "=") - 1, "write").otherwise("read")
    return _found(texts, ACCESSES).select("function", "line_no", "ordinal", "form", base.alias("base"), offset.alias("offset"), width.cast("int").alias("width"), kind.alias("type"), access.alias("access"))


def virtual_calls(texts: DataFrame, pointer: int) -> DataFrame:
    """(function, line_no, ordinal, form, receiver, slot) of texts (function, text); byte places between slots are none."""
    body = F.col("body")
    bytes_ = _number(F.regexp_extract(body, rf"\+\s*({_NUMBER})\s*\)$", 1))
    slot = F.when((F.col("form") == "byte_offset") & (bytes_ % pointer == 0), F.expr("1") * (bytes_ / pointer).cast("long")).when(F.col("form") == "array_index", _number(F.regexp_extract(body, r"\[\s*([0-9]+)", 1))).when(F.col("form") == "zero_offset", F.lit(0).cast("long"))
    receiver = (
        F.when(F.col("form") == "array_index", F.regexp_extract(body, rf"^({_NAME})", 1)).when(F.col("form") == "zero_offset", F.regexp_extract(body, rf"({_NAME})$", 1))
        .otherwise(F.regexp_extract(body, rf"\)\s*\(\s*(?:\*\s*\([^)]*\)\s*)?({_NAME})", 1))
    )
    return _found(texts, CALLS).select("function", "line_no", "ordinal", "form", receiver.alias("receiver"), slot.alias("slot")).where("slot is not null")


def layouts(accesses: DataFrame, receivers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields, layouts) of accesses (function, base, offset, width, type) by receivers (function, base, classes, exact).

    A receiver that is surely of one class shares that class's layout, any other has a layout of its own. A field is
    exact with such an owner, one width and one type; reasons say what is missing or in conflict.
    """
    none = F.array().cast("array<string>")
    met = accesses.join(receivers, ["function", "base"], "left").withColumn("classes", F.coalesce("classes", none))
    sure = F.coalesce("exact", F.lit(False)) & (F.size("classes") == 1)
    owner = F.when(sure, F.concat(F.lit("class:"), F.get("classes", F.lit(0)))).otherwise(F.concat_ws(":", F.lit("anonymous"), "function", "base"))
    met = met.withColumn("sure", sure).withColumn("owner", owner).withColumn("layout", stable_id("native-layout", F.col("owner")))
    grouped = met.groupBy("layout", "owner", "sure", "offset").agg(F.array_sort(F.collect_set("width")).alias("widths"), F.array_sort(F.collect_set("type")).alias("types"), F.count(F.lit(1)).alias("n"))
    widths, types = F.size("widths"), F.size("types")
    state = F.when(F.col("sure") & (widths == 1) & (types == 1), "exact").when((widths > 0) | (types > 0), "candidate_set").otherwise("unresolved")
    reasons = F.array_sort(F.array_compact(F.array(F.when(widths == 0, "no_width"), F.when(widths > 1, "conflicting_widths"), F.when(types == 0, "no_type"), F.when(types > 1, "several_types"), F.when(~F.col("sure"), "owner_not_exact"))))
    fields = grouped.select("layout", "owner", "offset", "widths", "types", "n", state.alias("classification"), F.array_join(reasons, ",").alias("reasons"))
    known = met.groupBy("layout", "owner", "sure").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("classes")))).alias("classes"), F.count_distinct("offset").alias("n_fields"), F.count(F.lit(1)).alias("n_accesses"))
    kind = F.when(F.col("sure"), "exact").when(F.size("classes") > 0, "candidate_set").otherwise("unresolved")
    return fields, known.select("layout", "owner", "classes", "n_fields", "n_accesses", kind.alias("classification"))
