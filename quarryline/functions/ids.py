"""Identifiers: content-addressed ids, addresses and safe names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length of an id's digest, and what an absent part is written as.
DIGEST, ABSENT = 20, "None"
#: Fixed value: longest symbol fragment.
FRAGMENT = 180


def stable_id(kind: str, *parts: Column) -> Column:
    """The kind and the start of a SHA-256 over NUL-joined parts; an absent part is written out, not left out."""
    text = F.concat_ws("\0", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit(ABSENT)) for p in parts))
    return F.concat(F.lit(kind + ":"), F.substring(F.sha2(text, 256), 1, DIGEST))


def address(value: Column, width: int = 8) -> Column:
    """0x and at least width lower-case hex digits."""
    digits = F.lower(F.hex(value))
    return F.concat(F.lit("0x"), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))


def clear_low_bit(value: Column) -> Column:
    """The address that a mode flag in the lowest bit stands on."""
    return value.bitwiseAND(F.lit(-2))


def symbol_fragment(text: Column) -> Column:
    """Runs of anything but letters, digits and underscores become one underscore, none at the ends; a leading digit gets n_."""
    plain = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_]+", "_"), "_+", "_")
    bare = F.regexp_replace(plain, "^_+|_+$", "")
    return F.substring(F.when(bare.rlike("^[0-9]"), F.concat(F.lit("n_"), bare)).otherwise(bare), 1, FRAGMENT)


def file_stem(text: Column, most: int = 100) -> Column:
    """A name that any file system takes."""
    plain = F.substring(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^[. ]+|[. ]+$", ""), 1, most)
    return F.when(F.lower(plain).isin("con", "prn", "aux", "nul") | (plain == ""), F.concat(F.lit("_"), plain)).otherwise(plain)
