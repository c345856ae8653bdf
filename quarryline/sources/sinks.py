"""Sinks: canonical JSON for small reports, write-once evidence tables, stale rows by set difference."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(value) -> str:
    """Sorted keys, two spaces, UTF-8, one final line feed."""
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def report(df: DataFrame, order: list[str], most: int = 1000) -> str:
    """A summary table of at most ``most`` rows as canonical JSON; a larger one is an error, for it is no summary."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    return canonical_json([r.asDict(recursive=True) for r in rows])


def write_once(df: DataFrame, path: str) -> None:
    """A new table is written; an existing one must hold the same rows, else this is an error."""
    spark = df.sparkSession
    try:
        df.write.mode("errorifexists").parquet(path)
    except Exception as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
        there = spark.read.parquet(path).select(*df.columns)
        if not there.exceptAll(df).isEmpty() or not df.exceptAll(there).isEmpty():
            raise ValueError(f"{path} holds other evidence") from e


def stale(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Keys of the previous run that the current one lacks."""
    return previous.select(key).distinct().join(current.select(key), key, "left_anti")


def without(reports: DataFrame, producer: Column | str, rows: DataFrame) -> DataFrame:
    """Idempotent replacement: a producer's rows give way to its new ones."""
    return reports.where(F.col("producer") != producer).unionByName(rows, allowMissingColumns=True)


def swap(df: DataFrame, path: str, writer=lambda w, p: w.parquet(p)) -> None:
    """A table takes the place of the one at path only once it is written whole; a failed write leaves the old one.

    Works on any file system that Spark reaches, by its own rename.
    """
    spark = df.sparkSession
    fresh, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    writer(df.write.mode("overwrite"), fresh)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(hadoop(old), True)
    had = files.exists(hadoop(path))
    if had and not files.rename(hadoop(path), hadoop(old)):
        raise OSError(f"{path} cannot be moved")
    if not files.rename(hadoop(fresh), hadoop(path)):
        if had:
            files.rename(hadoop(old), hadoop(path))
        raise OSError(f"{fresh} cannot be moved")
    files.delete(hadoop(old), True)


def normalized_code(text: Column) -> Column:
    """Line feeds only, and one at the end of any text."""
    plain = F.regexp_replace(text, r"\r\n?", "\n")
    return F.when((plain == "") | plain.endswith("\n"), plain).otherwise(F.concat(plain, F.lit("\n")))


def code_copies(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, action, text): what a copy of code (path, text) has to write and to delete, nothing where both agree."""
    now = current.select("path", normalized_code(F.col("text")).alias("text"))
    met = now.join(previous.select("path", F.col("text").alias("was"), F.lit(True).alias("there")), "path", "full")
    action = F.when(F.col("text").isNull(), "delete").when(F.col("there").isNull(), "write").when(F.col("text") != F.col("was"), "write")
    return met.withColumn("action", action).where("action is not null").select("path", "action", "text")


def cell(value: Column) -> Column:
    """A value as it can stand in a table: one line, bars and comment ends taken apart."""
    plain = F.regexp_replace(F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), r"\*/", "* /")
    return F.coalesce(F.replace(plain, F.lit("|"), F.lit("\\|")), F.lit(""))


def markdown(title: str, df: DataFrame, order: list[str], most: int = 1000) -> str:
    """A summary table as Markdown; as ``report``, it is an error for a table that is no summary."""
    shown = df.select(*(cell(F.col(c)).alias(c) for c in df.columns), *(F.col(c).alias(f"order_{i}") for i, c in enumerate(order)))
    rows = shown.orderBy(*(f"order_{i}" for i in range(len(order)))).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    line = lambda values: "| " + " | ".join(values) + " |"
    return "\n".join([f"# {title}", "", line(df.columns), line(["---"] * len(df.columns)), *(line(list(r)[: len(df.columns)]) for r in rows), ""])


#: What a state file escapes, and its keys that callers cannot set.
ESCAPED, RESERVED = ("%", "\n", "\r", "="), ("magic", "version", "namespace")


def state_line(key: Column, value: Column) -> Column:
    """key=value with per cent signs, line ends and equal signs escaped."""

    def escape(c: Column) -> Column:
        for mark in ESCAPED:
            c = F.replace(c, F.lit(mark), F.lit(f"%{ord(mark):02X}"))
        return c

    return F.concat(escape(key), F.lit("="), escape(value))


def state_text(pairs: DataFrame, magic: str, version: int, namespace: str, most: int = 10_000) -> str:
    """A state file of (key, value) pairs, sorted; reserved, empty and repeated keys are errors."""
    rows = pairs.select("key", state_line(F.col("key"), F.col("value")).alias("line")).orderBy("key").limit(most + 1).collect()
    keys = [r["key"] for r in rows]
    if len(rows) > most or len(set(keys)) < len(keys) or not all(keys) or set(keys) & set(RESERVED):
        raise ValueError("too many, repeated, empty or reserved keys")
    return "\n".join([magic, f"version={version}", f"namespace={namespace}", *(r["line"] for r in rows), ""])


def instantiate(template: str, values: dict[str, str]) -> str:
    """A template with its {{names}} filled in; a name without value, or a value without name, is an error."""
    import re

    names = set(re.findall(r"\{\{(\w+)\}\}", template))
    if names != set(values):
        raise ValueError(f"unfilled or unknown: {sorted(names ^ set(values))}")
    return re.sub(r"\{\{(\w+)\}\}", lambda m: values[m[1]], template)
