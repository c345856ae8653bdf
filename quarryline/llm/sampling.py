"""Bounded, deterministic samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


#: Labels that a classifier tells apart at most: the most frequent ones.
MOST_LABELS = 400


def per_label(rows: DataFrame, label: str, id_col: str, most: int) -> DataFrame:
    """About most rows of each label, all of rarer labels, chosen by a hash of the id: the expected size is bounded by the number of labels, that by MOST_LABELS."""
    frequent = rows.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(MOST_LABELS)
    counts = {r[label]: r["count"] for r in frequent.collect()}
    if not counts:
        return rows.where(F.lit(False))
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30))
    return rows.where(reduce(lambda a, b: a | b, ((F.col(label) == F.lit(k)) & (place < int(min(1.0, most / n) * (1 << 30))) for k, n in sorted(counts.items()))))
