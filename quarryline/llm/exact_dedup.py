"""Exact duplicates by a distributed content sort.

Sampled splitters range-partition the normalised texts by a bounded sort key (leading characters, then
digest), an external sort inside each range places equal texts next to each other, and the window
compares neighbours by their full texts. Only digests and counts are shuffled beforehand: they tell which
texts are so frequent that their rows must be dealt to several ranges, whose representatives meet again in
a table of at most 2 * SPLITS rows per shuffle partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import ascii_lower, shuffle_partitions

#: A text counts as hot when its rows exceed this fraction (1 / SPLITS) of an even shuffle partition.
SPLITS = 4
#: Leading characters in the sort key; the digest breaks their ties, so any number is right.
LEAD = 16


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Equal means identical after lower-casing A-Z; null text counts as empty. The row with the largest id of
    a group stays. A null id never wins against another id. Of repeated rows with the winning id exactly one
    is kept. An empty table gives an empty result; further columns are not looked at.
    """
    parts = shuffle_partitions(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    base = base.withColumn("sha", F.unhex(F.sha2("norm", 256)))
    share = max(1, docs.count() // (SPLITS * parts))
    hot = base.groupBy("sha").agg(F.count(F.lit(1)).alias("n_equal")).where(F.col("n_equal") > share)
    # at most SPLITS * parts texts can be that frequent, so the broadcast is bounded by the partition count
    runs = F.ceil(F.col("n_equal") / share)
    keyed = base.join(F.broadcast(hot), "sha", "left").select(
        "doc_id", "norm", "sha", F.substring("norm", 1, LEAD).alias("lead"), F.col("n_equal").isNotNull().alias("hot"),
        F.when(F.col("n_equal").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), runs)).cast("int").alias("run"),
    )
    ranged = keyed.repartitionByRange("lead", "sha", "run")
    equal = Window.partitionBy("lead", "sha", "run", "norm")
    sorted_runs = ranged.select(
        "doc_id", "sha", "hot", "norm",
        F.row_number().over(equal.orderBy(F.col("doc_id").desc_nulls_last())).alias("place"),
        F.max("doc_id").over(equal).alias("run_id"),
        F.count(F.lit(1)).over(equal).alias("run_size"),
    )
    whole = Window.partitionBy("sha", "norm")
    merged = sorted_runs.where(F.col("hot") & (F.col("place") == 1)).select(
        F.col("sha").alias("m_sha"), F.col("run_id").alias("m_run"), F.max("run_id").over(whole).alias("m_keep"), F.sum("run_size").over(whole).alias("m_size"),
        F.row_number().over(whole.orderBy(F.col("run_id").desc_nulls_last())).alias("m_place"),
    )
    met = sorted_runs.join(F.broadcast(merged), (F.col("sha") == F.col("m_sha")) & F.col("run_id").eqNullSafe(F.col("m_run")) & F.col("hot"), "left")
    return met.select(
        "doc_id",
        F.when(F.col("hot"), F.col("m_keep")).otherwise(F.col("run_id")).alias("keep_id"),
        F.when(F.col("hot"), F.col("m_size")).otherwise(F.col("run_size")).alias("group_size"),
        ((F.col("place") == 1) & (~F.col("hot") | (F.col("m_place") == 1))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
