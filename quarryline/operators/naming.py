"""Names that differ even where case does not count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.ids import file_stem
from quarryline.operators.lineage import cut

#: Longest name, digits of the first suffix, and of the longest, in steps.
LONGEST, FIRST, LAST, STEP = 100, 10, 64, 2


def collision_safe(rows: DataFrame, key: str, shown: str) -> DataFrame:
    """(key, name): the file stem of what is shown; of equal stems the first by (shown, key) keeps it, others get digits of their key's digest.

    Suffixes grow only for names that still collide. Only the first row of each stem is looked for, by an
    aggregate that combines before it shuffles, so a frequent stem is no single task's sort. Keys are unique.
    """
    based = rows.select(key, F.lower(shown).alias("folded"), file_stem(F.col(shown), LONGEST).alias("stem"))
    first = based.groupBy(F.lower("stem").alias("stem_key")).agg(F.min(F.struct("folded", key)).alias("first"))
    named = based.join(first, F.lower("stem") == F.col("stem_key")).select(key, "stem", (F.col(f"first.{key}") == F.col(key)).alias("bare"))
    digest = F.sha2(F.col(key).cast("string"), 256)
    suffixed = lambda n: F.concat(F.substring("stem", 1, LONGEST - 2 - n), F.lit("--"), F.substring(digest, 1, n))
    named = cut(named.withColumn("name", F.when(F.col("bare"), F.col("stem")).otherwise(suffixed(FIRST))))
    for n in range(FIRST + STEP, LAST + 1, STEP):
        taken = cut(named.groupBy(F.lower("name").alias("name_key")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(~F.col("bare"), key)).alias("holder")).where("n > 1"))
        if taken.isEmpty():
            break
        met = named.join(taken, F.lower("name") == F.col("name_key"), "left")
        longer = F.col("n").isNotNull() & ~F.col("bare") & (F.col(f"holder.{key}") != F.col(key))
        named = cut(met.withColumn("name", F.when(longer, suffixed(n)).otherwise(F.col("name"))).select(key, "stem", "bare", "name"))
    return named.select(key, "name")
