"""What several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.lineage import cut
from quarryline.tables import table  # noqa: F401  re-exported for the operators

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 64


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII rows take the fast built-in, which does the same there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def keep(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there and a lost executor costs no recomputation."""
    return cut(df, "kept")


def row_key(text: Column) -> Column:
    """Tells rows of one id, or without one, apart: those it does not tell apart have the same text, so one verdict fits them all."""
    return F.xxhash64(text)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """Evaluates value once per row and hands it to body; a plain reuse inside a lambda would evaluate it per element."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, start: Column, fold, levels: int = 2) -> Column:
    """Running folds of an array (entry i folds 0 to i) by an associative function with start as its nought.

    Blocks are folded first, their folds run up the same way, so that the work is some BLOCK steps an entry
    up to BLOCK ** (levels + 1) entries, and long arrays stay linear.
    """
    block = lambda i: F.floor(i / BLOCK).cast("int")
    if not levels:
        whole = lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.aggregate(F.slice(v, F.lit(1), i + 1), start, fold))
        return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(v))
    totals = lambda v: F.transform(F.sequence(F.lit(0), block(F.size(v) - 1)), lambda b: F.aggregate(F.slice(v, b * BLOCK + 1, BLOCK), start, fold))
    inside = lambda v, t: F.transform(
        F.sequence(F.lit(0), F.size(v) - 1),
        lambda i: F.aggregate(F.slice(v, block(i) * BLOCK + 1, i % BLOCK + 1), F.when(block(i) > 0, F.get(t, block(i) - 1)).otherwise(start), fold),
    )
    return let(values, lambda v: F.when(F.size(v) > 0, let(running(totals(v), start, fold, levels - 1), lambda t: inside(v, t))).otherwise(v))


def prefix_sums(values: Column) -> Column:
    """Running sums of an array of longs."""
    return running(values, F.lit(0).cast("long"), lambda a, b: a + b)


SPANS = "array<struct<s:bigint,e:bigint,body:string,part:string>>"


def match_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches of a pattern that never matches nothing: array of (s, e, body, part).

    s and e count code points, e exclusive; part is the numbered group. The gaps between matches come from
    split, the matches from regexp_extract_all; both walk the text with the same matcher, so the lengths of
    gaps and matches add up to positions. Texts without a match stop at the first test.
    """
    raw = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("parts"),
        F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long")).alias("gaps"),
    )

    def placed(r: Column) -> Column:
        steps = F.zip_with(r["found"], F.slice(r["gaps"], F.lit(1), F.size(r["found"])), lambda m, g: g + F.length(m))
        return F.zip_with(
            F.zip_with(r["found"], r["parts"], lambda m, p: F.struct(m.alias("body"), p.alias("part"))),
            prefix_sums(steps),
            lambda m, e: F.struct((e - F.length(m["body"])).alias("s"), e.alias("e"), m["body"].alias("body"), m["part"].alias("part")),
        )

    return F.when(text.rlike(pattern), let(raw, placed)).otherwise(no_spans())


def no_spans() -> Column:
    return F.array().cast(SPANS)


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order given."""
    return F.array_join(F.transform(spans, lambda z: F.concat_ws(":", z["kind"], z["s"].cast("string"), z["e"].cast("string"))), ",")


#: Rows of one id each that may be broadcast: about 40 MB.
MOST_BROADCAST = 2_000_000


def bounded(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """Marks a counted, small table for broadcast; a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.count() <= most else df
