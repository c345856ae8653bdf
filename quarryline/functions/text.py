"""Text extraction: regular expressions where the language is regular, Arrow functions where it nests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What opens and closes, and the quotes within which neither counts.
OPENERS, CLOSERS, QUOTES = "([{", ")]}", "\"'"
_LIST = T.ArrayType(T.StringType())
_CALLS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", _LIST)]))


def lines(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line): lines split at line feeds, numbered from 1."""
    return rows.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def matches(rows: DataFrame, keep: list[str], text_col: str, pattern: str, group: int = 0) -> DataFrame:
    """one row per match of a line, with its ordinal from 0.

    The outer form of the generator, for the plain one would first search once more, in a filter on the number of matches.
    """
    return rows.select(*keep, F.posexplode_outer(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(group))).alias("ordinal", "match")).where("ordinal is not null")


def bounded(text: Column, most: int) -> Column:
    """Long texts become their start, an ellipsis and a digest."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("..."), F.substring(F.sha2(text, 256), 1, 12)))


def matching_close(text: str, start: int) -> int:
    """Place of the bracket that closes the one at start, -1 if none; quotes and backslashes are respected."""
    stack, quote, i = [], "", start
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in QUOTES:
            quote = c
        elif c in OPENERS:
            stack.append(CLOSERS[OPENERS.index(c)])
        elif c in CLOSERS:
            if not stack or stack.pop() != c:
                return -1
            if not stack:
                return i
        i += 1
    return -1


def split_arguments(text: str) -> list[str]:
    """The parts between top-level commas; brackets and quotes nest."""
    out, depth, quote, at, i = [], 0, "", 0, 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in QUOTES:
            quote = c
        elif c in OPENERS:
            depth += 1
        elif c in CLOSERS:
            depth = max(0, depth - 1)
        elif c == "," and depth == 0:
            out.append(text[at:i].strip())
            at = i + 1
        i += 1
    last = text[at:].strip()
    return [*out, last] if out or last else []


@F.pandas_udf(_LIST)
def arguments(text: pd.Series) -> pd.Series:
    return text.map(lambda t: split_arguments(t) if t is not None else None)


@F.pandas_udf(_CALLS)
def calls(text: pd.Series) -> pd.Series:
    """name(argument, ...) forms with balanced brackets, outermost and nested alike, in order of their names."""
    import re

    def of(t):
        out = []
        for m in re.finditer(r"([A-Za-z_][A-Za-z0-9_]*)\s*\(", t or ""):
            end = matching_close(t, m.end() - 1)
            if end >= 0:
                out.append({"name": m[1], "arguments": split_arguments(t[m.end() : end])})
        return out

    return text.map(of)


def strip_casts(text: Column) -> Column:
    """An expression without its leading casts."""
    return F.regexp_replace(text, r"^(?:\s*\(\s*(?:const\s+|struct\s+|unsigned\s+)*[A-Za-z_][A-Za-z0-9_]*\s*\**\s*\)\s*)+(?=[A-Za-z_(0-9*&])", "")


def is_new_family(selector: Column) -> Column:
    """Selectors whose first word is new."""
    return F.substring_index(selector, ":", 1).rlike("^new([^a-z]|$)")


def version_of(packed: Column) -> Column:
    """X.y.z of a 32-bit number: 16, 8 and 8 bits."""
    return F.concat_ws(".", F.shiftright(packed, 16).cast("string"), F.shiftright(packed, 8).bitwiseAND(255).cast("string"), packed.bitwiseAND(255).cast("string"))
