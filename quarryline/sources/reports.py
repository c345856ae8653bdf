"""Reports with an envelope, bounded inputs with their manifest, texts held against an index, and rule catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Version of the envelope, its keys, and the keys of a hypothesis-free part.
VERSION, KEYS = 1, ("schema_version", "artifact", "facts", "hypotheses", "errors")


def report_records(spark: SparkSession, path: str, artifact: str, collection: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of one collection of report documents: rows by an explicit schema, with their place in the list.

    A document that is no object, lacks the envelope's keys, or is another artifact or version gives an error row.
    """
    envelope = T.StructType([T.StructField("schema_version", T.IntegerType()), T.StructField("artifact", T.StringType()), T.StructField("facts", T.StructType([T.StructField(collection, T.ArrayType(schema))]))])
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value", F.from_json("value", envelope).alias("r"), F.json_object_keys("value").alias("keys"))
    complete = F.coalesce(F.size(F.array_except(F.array(*map(F.lit, KEYS)), "keys")) == 0, F.lit(False))
    wrong = F.when(F.col("keys").isNull(), "no_object").when(~complete, "envelope").when(~F.col("r.artifact").eqNullSafe(artifact), "artifact").when(~F.col("r.schema_version").eqNullSafe(VERSION), "version").when(F.col(f"r.facts.{collection}").isNull(), "collection")
    checked = files.withColumn("error", wrong)
    records = checked.where("error is null").select("path", F.posexplode(f"r.facts.{collection}").alias("place", "record")).select("path", "place", "record.*")
    return records, checked.where("error is not null").select("path", "error")


def bounded_inputs(files: DataFrame, most_each: int, most_total: int) -> DataFrame:
    """(path, length, sha256, total, error): the manifest, with the files that are too large or pass the total, in order of their paths."""
    total = F.sum("length").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, 0))  # one row a file, without its content
    small = files.select("path", "length", F.when(F.col("length") <= most_each, F.sha2("content", 256)).alias("sha256"))
    return small.withColumn("total", total).withColumn("error", F.when(F.col("length") > most_each, "file_too_large").when(F.col("total") > most_total, "total_too_large"))


def verified_texts(index: DataFrame, files: DataFrame, most_each: int, hash_required: bool = True) -> DataFrame:
    """(owner, path, text, error) of the successful entries of an index (owner, path, status, sha256) over files (path, length, content).

    Content of files beyond the cap is never read on; a wrong, or where required a missing, digest is an error.
    """
    read = files.where(F.col("length") <= most_each).select("path", "length", F.sha2("content", 256).alias("now"), F.decode("content", "UTF-8").alias("text"))
    large = files.where(F.col("length") > most_each).select("path", F.lit(True).alias("large"))
    met = index.where("status = 'success'").join(read, "path", "left").join(large, "path", "left")
    missing = F.lit(hash_required) & F.col("sha256").isNull()
    error = F.when(F.col("large"), "too_large").when(F.col("now").isNull(), "missing").when(missing, "no_digest").when(F.col("sha256").isNotNull() & (F.col("sha256") != F.col("now")), "changed")
    return met.select("owner", "path", F.when(error.isNull(), F.col("text")).alias("text"), error.alias("error"))


def catalogue_faults(rules: DataFrame, key: str, category: str, categories: list[str], required: list[str]) -> DataFrame:
    """(key, fault) of a rule table: keys that are missing or repeated, categories that are unknown, required columns that are empty."""
    counted = rules.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(category)).alias("said"), *(F.count(c).alias(f"n_{c}") for c in required))
    unknown = F.size(F.array_except("said", F.array(*map(F.lit, categories)))) > 0
    faults = F.array_compact(F.array(F.when(F.col(key).isNull() | (F.col(key) == ""), "no_key"), F.when(F.col("n") > 1, "repeated_key"), F.when(unknown, "unknown_category"), *(F.when(F.col(f"n_{c}") < F.col("n"), f"no_{c}") for c in required)))
    return counted.select(key, F.explode(faults).alias("fault"))
