"""Analysis of archives: members, the application's files, its executables' slices and libraries, its class metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.aggs import joined_set
from quarryline.sources import bundles, executables, images, metadata
from quarryline.sources.files import archive_members
from quarryline.stages.artifact import Artifact


def frameworks(commands: DataFrame) -> DataFrame:
    """(name, kind, path, slices) of linked libraries: a framework's name is its folder's, another library's its file's."""
    rows = commands.where("kind in ('library', 'weak_library', 'reexported_library')").select("path", "slice", F.col("kind").alias("linkage"), F.col("name").alias("library"))
    framework = F.regexp_extract("library", r"/([^/]+)\.framework/", 1)
    name = F.when(framework != "", framework).otherwise(F.regexp_extract("library", r"([^/]+)$", 1))
    rows = rows.withColumn("name", name).withColumn("kind", F.when(framework != "", "framework").otherwise("library"))
    return rows.groupBy("name", "kind", "library", "linkage").agg(joined_set(F.concat_ws("#", "path", F.col("slice").cast("string"))).alias("slices"))


def analyze(spark: SparkSession, tables: dict[str, DataFrame]) -> Artifact:
    """Tables in: archives (path, content), executable_names (archive, path, executable), executables (path, content).
    Facts: members, bundles, files, commands, frameworks, records, classes, methods, imports; errors: what was not accepted."""
    members = archive_members(tables["archives"])
    found = bundles.bundles(members.where("error is null and path is not null"), tables["executable_names"])
    commands = executables.load_commands(tables["executables"])
    records = metadata.records(tables["executables"])
    symbols = images.symbol_rows(tables["executables"])
    facts = {
        "members": members, "bundles": found, "files": bundles.inventory(members, found), "commands": commands, "frameworks": frameworks(commands), "records": records,
        "classes": metadata.classes(records, tables["executables"]), "methods": metadata.methods(records), "imports": images.imports(symbols),
    }
    wrong = members.select("error").union(found.select("error")).union(commands.select("error")).union(records.select("error")).where("error is not null")
    errors = wrong.groupBy(F.col("error").alias("code")).agg(F.count(F.lit(1)).alias("n")).select("code", F.lit("analysis").alias("subject"), "n")
    return Artifact("analysis", facts, errors=errors)
