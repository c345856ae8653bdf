"""Lookups that try one kind of match after another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exact_or_containing(addresses: DataFrame, bodies: DataFrame) -> DataFrame:
    """(address, body, how): the body that starts at an address, else the one around it, else NULLs.

    bodies is (body, start, size); bodies do not overlap and have starts of their own. One union and one running window: the
    body that starts last at or before an address is the only one that can hold it. Addresses are dealt out
    by their high bits; each bucket also gets the last body that starts before it.
    """
    distinct = addresses.select("address").distinct()
    bucket = lambda a: F.shiftright(a, BUCKET_BITS)
    starts = bodies.select(bucket(F.col("start")).alias("bucket"), F.col("start").alias("address"), F.struct("body", "start", "size").alias("at"))
    # a body that reaches into later buckets is known there too, so no bucket looks back
    reach = bodies.where(bucket(F.col("start")) < bucket(F.col("start") + F.greatest(F.col("size"), F.lit(1)) - 1))
    inner = reach.select(F.explode(F.sequence(bucket(F.col("start")) + 1, bucket(F.col("start") + F.col("size") - 1))).alias("bucket"), F.struct("body", "start", "size").alias("at"))
    inner = inner.select("bucket", F.shiftleft("bucket", BUCKET_BITS).alias("address"), "at")
    asked = distinct.select(bucket(F.col("address")).alias("bucket"), "address", F.lit(None).cast(starts.schema["at"].dataType).alias("at"))
    running = Window.partitionBy("bucket").orderBy("address", F.col("at").isNull(), F.col("at.start")).rowsBetween(Window.unboundedPreceding, 0)
    placed = starts.union(inner).union(asked).withColumn("last", F.last("at", ignorenulls=True).over(running)).where("at is null")
    inside = F.col("address") < F.col("last.start") + F.col("last.size")
    how = F.when(F.col("address") == F.col("last.start"), "exact").when(inside, "containing")
    return placed.select("address", F.when(how.isNotNull(), F.col("last.body")).alias("body"), how.alias("how"))


#: Addresses of one bucket share all but so many low bits.
BUCKET_BITS = 16


def missing_names(names: DataFrame, known: DataFrame, column: str = "name") -> DataFrame:
    """The distinct names that no known name equals or ends in after a slash, whatever the case."""
    tail = known.select(F.lower(column).alias("k"))
    # every suffix that starts a name or follows a slash is a key, so the suffix match is an equi-join
    parts = tail.select("k", F.split("k", "/").alias("p"))
    keys = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", i, F.size("p")), "/"))).alias("k")).distinct()
    first = names.groupBy(F.lower(column).alias("k")).agg(F.min(column).alias(column))
    return first.join(keys, "k", "left_anti").select(column)


def match_parameters(parameters: DataFrame, types: DataFrame, owner: str) -> DataFrame:
    """(owner, position, name, type_id): each parameter's type record by name, else by position, else in turn.

    parameters is (owner, position, name), types is (owner, type_id, name, position), the position NULL where a
    record has none. A record serves one parameter; parameters choose in order, records stand by (position, id),
    those without position last, and the k-th parameter takes the k-th of those still free. Both lists of one
    owner are as long as its signature, so a fold over them is bounded.
    """
    asked = parameters.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("asked"))
    record = F.struct(F.coalesce("position", F.lit((1 << 31) - 1)).alias("at"), "type_id", "name")
    held = types.groupBy(owner).agg(F.array_sort(F.collect_list(record)).alias("held"))
    none = F.array().cast(held.schema["held"].dataType)
    met = asked.join(held, owner, "left").withColumn("held", F.coalesce("held", none))
    start = F.struct(F.col("held").alias("free"), F.array().cast("array<struct<position:int,name:string,type_id:string>>").alias("out"))

    def take(a, p):
        named = F.filter(a["free"], lambda t: t["name"] == p["name"])
        placed = F.filter(a["free"], lambda t: t["at"] == p["position"])
        loose = F.filter(a["free"], lambda t: t["at"] == (1 << 31) - 1)
        got = F.coalesce(F.get(named, F.lit(0)), F.get(placed, F.lit(0)), F.get(loose, p["position"]))
        row = F.struct(p["position"].cast("int").alias("position"), p["name"].alias("name"), got["type_id"].cast("string").alias("type_id"))
        return F.struct(F.filter(a["free"], lambda t: ~t["type_id"].eqNullSafe(got["type_id"])).alias("free"), F.array_append(a["out"], row).alias("out"))

    return met.select(owner, F.explode(F.aggregate("asked", start, take)["out"]).alias("m")).select(owner, "m.*")
