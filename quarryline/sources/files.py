"""File sources: identities, archives, property lists, images, localisation tables, line records, key-value states.

Everything starts from Spark's own readers (binaryFile, text, json); formats that SQL cannot take apart are
decoded by Arrow-batched functions, one file per row. Bad input becomes error rows, not failed jobs.
"""

from __future__ import annotations

import io
import plistlib
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Limits of an accepted archive.
MOST_ENTRIES, MOST_BYTES, MOST_RATIO, MOST_LINK = 100_000, 8 << 30, 2_000, 4_096


def binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified, content) of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.col("modificationTime").alias("modified"), "content")


def identities(files: DataFrame) -> DataFrame:
    """A1: (path, length, modified, sha256); compare two of them with ``changed``."""
    return files.select("path", "length", "modified", F.sha2("content", 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose identity is not what it was, missing and new ones included."""
    a, b = before.select("path", F.col("sha256").alias("was")), after.select("path", F.col("sha256").alias("now"))
    return a.join(b, "path", "full").where(~F.col("was").eqNullSafe(F.col("now"))).select("path", "was", "now")


def safe_path(path: Column) -> Column:
    """A3: forward slashes, no doubled or trailing ones; NULL for absolute paths, drive letters and upward steps."""
    plain = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")
    parts = F.split(F.regexp_replace(plain, "/$", ""), "/")
    bad = plain.startswith("/") | plain.rlike("^[A-Za-z]:") | F.exists(parts, lambda p: p.isin("", ".", "..")) | path.contains("\0")
    return F.when(~bad, F.array_join(parts, "/"))


def resolve_link(path: Column, target: Column) -> Column:
    """A4: a link's target from the folder of its path; NULL when it leaves the archive or is absolute."""
    steps = F.concat(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1), F.split(target, "/"))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("ok"))
    walked = F.aggregate(
        steps, start,
        lambda a, s: F.when(s.isin("", "."), a).when((s == "..") & (F.size(a["at"]) == 0), F.struct(a["at"].alias("at"), F.lit(False).alias("ok")))
        .when(s == "..", F.struct(F.slice(a["at"], F.lit(1), F.size(a["at"]) - 1).alias("at"), a["ok"].alias("ok"))).otherwise(F.struct(F.array_append(a["at"], s).alias("at"), a["ok"].alias("ok"))),
    )
    return F.when(~target.startswith("/") & (F.length(target) <= MOST_LINK) & walked["ok"], F.array_join(walked["at"], "/"))


_MEMBERS = "archive string, member string, size long, packed long, crc32 long, link string, error string"


def _members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            rows, error = [], None
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    infos = z.infolist()
                    if len(infos) > MOST_ENTRIES or sum(i.file_size for i in infos) > MOST_BYTES:
                        error = "too_large"
                    seen: set[str] = set()
                    for i in infos if error is None else []:
                        bad = "encrypted" if i.flag_bits & 1 else "duplicate" if i.filename in seen else "ratio" if i.file_size > MOST_RATIO * max(1, i.compress_size) else None
                        seen.add(i.filename)
                        is_link = (i.external_attr >> 16) & 0o170000 == 0o120000 and bad is None and i.file_size <= MOST_LINK
                        rows.append((path, i.filename, i.file_size, i.compress_size, i.CRC, z.read(i).decode("utf-8", "replace") if is_link else None, bad))
            except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError) as e:
                error = type(e).__name__
            if error:
                rows = [(path, None, None, None, None, None, error)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _MEMBERS.split(", ")]).astype({c: "Int64" for c in ("size", "packed", "crc32")})


def archive_members(files: DataFrame) -> DataFrame:
    """A2: one row per archive member, or one with an error for an archive that is not accepted; member paths are checked too."""
    found = files.select("path", "content").mapInPandas(_members, _MEMBERS)
    safe = safe_path(F.regexp_replace("member", "/$", ""))
    return found.withColumn("path", safe).withColumn("error", F.coalesce("error", F.when(F.col("member").isNotNull() & safe.isNull(), "unsafe_path")))


#: Asset categories by suffix.
ASSETS = {
    "png": "image", "jpg": "image", "jpeg": "image", "gif": "image", "bmp": "image", "wav": "audio", "mp3": "audio", "caf": "audio", "m4a": "audio", "aac": "audio", "mp4": "video", "mov": "video", "m4v": "video",
    "ttf": "font", "otf": "font", "plist": "property_list", "strings": "localization", "nib": "interface", "xib": "interface", "storyboard": "interface", "json": "data", "xml": "data", "txt": "data", "html": "data", "sqlite": "database", "db": "database",
}


def asset_category(path: Column) -> Column:
    """By the lower-cased suffix, other where it is unknown."""
    known = F.create_map(*(F.lit(x) for pair in ASSETS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("other"))


_PLIST = T.MapType(T.StringType(), T.StringType())


@F.pandas_udf(_PLIST)
def plist_strings(content: pd.Series) -> pd.Series:
    """The scalar entries of a binary or XML property list as text; NULL for anything else."""

    def of(raw):
        try:
            found = plistlib.loads(bytes(raw))
        except Exception:  # a damaged list can fail anywhere in the decoder; the row says so by its NULL
            return None
        return {str(k): str(v) for k, v in found.items() if isinstance(v, str | int | float | bool)} if isinstance(found, dict) else None

    return content.map(of)


def image_size(content: Column) -> Column:
    """A26 for PNG, GIF and BMP: (width, height) from the header; NULL for other content."""
    at = lambda start, n: F.substring(content, start, n)
    big = lambda b: F.conv(F.hex(b), 16, 10).cast("int")
    little = lambda start, n: F.conv(F.concat(*(F.hex(at(start + n - 1 - i, 1)) for i in range(n))), 16, 10).cast("int")
    size = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    return (
        F.when(F.hex(at(1, 8)) == "89504E470D0A1A0A", size(big(at(17, 4)), big(at(21, 4))))
        .when(F.hex(at(1, 3)) == "474946", size(little(7, 2), little(9, 2)))
        .when(F.hex(at(1, 2)) == "424D", size(little(19, 4), little(23, 4)))
    )


def localized(files: DataFrame) -> DataFrame:
    """(path, key, value, error) of quoted pairs; comments are skipped, a repeated key is an error row."""
    head = F.hex(F.substring("content", 1, 2))
    text = F.when(head == "FFFE", F.decode(F.expr("substring(content, 3)"), "UTF-16LE")).when(head == "FEFF", F.decode(F.expr("substring(content, 3)"), "UTF-16BE")).otherwise(F.decode("content", "UTF-8"))
    quoted = r'"((?:[^"\\]|\\.)*+)"'
    plain = F.regexp_replace(text, r'(?s)("(?:[^"\\]|\\.)*+")|/\*.*?\*/|//[^\n]*', "$1")
    pair = quoted + r"\s*=\s*" + quoted + r"\s*;"
    rows = files.select("path", F.explode(F.arrays_zip(F.regexp_extract_all(plain, F.lit(pair), F.lit(1)).alias("key"), F.regexp_extract_all(plain, F.lit(pair), F.lit(2)).alias("value"))).alias("p"))
    undo = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\n", "\n"), r"\\t", "\t"), r"\\(.)", "$1")
    counted = rows.groupBy("path", undo(F.col("p.key")).alias("key")).agg(F.min(undo(F.col("p.value"))).alias("value"), F.count(F.lit(1)).alias("n"))
    return counted.select("path", "key", F.when(F.col("n") == 1, F.col("value")).alias("value"), F.when(F.col("n") > 1, "duplicate_key").alias("error"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, errors): rows by an explicit schema, and the lines that are no objects of it."""
    bad = "_damaged"
    wide = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", wide, {"columnNameOfCorruptRecord": bad}).alias("r"), "value")
    return rows.where(F.col(f"r.{bad}").isNull()).select("r.*").drop(bad), rows.where(F.col(f"r.{bad}").isNotNull()).select(F.col("value").alias("line"))


def state_pairs(spark: SparkSession, path: str, magic: str) -> DataFrame:
    """key=value lines below a magic first line, percent-decoded; a file without the magic gives nothing."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", "\n").alias("lines")).where(F.col("lines")[0] == magic)
    rows = lines.select(F.explode(F.slice("lines", F.lit(2), F.size("lines"))).alias("line")).where(F.col("line").contains("="))
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return rows.select(plain(F.substring_index("line", "=", 1)).alias("key"), plain(F.regexp_replace("line", "^[^=]*=", "")).alias("value"))


def state_guarded(spark: SparkSession, path: str, magic: str, version: int, namespace: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, errors) of state files whose first lines name the magic, version and namespace; others are error rows."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", "\n").alias("lines"))
    head = [magic, f"version={version}", f"namespace={namespace}"]
    wrong = F.when(F.get("lines", F.lit(0)) != head[0], "magic").when(~F.get("lines", F.lit(1)).eqNullSafe(head[1]), "version").when(~F.get("lines", F.lit(2)).eqNullSafe(head[2]), "namespace")
    checked = text.withColumn("error", wrong)
    rows = checked.where("error is null").select("path", F.explode(F.slice("lines", F.lit(4), F.size("lines"))).alias("line")).where("line like '%=%'")
    undo = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    pairs = rows.select("path", undo(F.substring_index("line", "=", 1)).alias("key"), undo(F.regexp_replace("line", "^[^=]*=", "")).alias("value"))
    return pairs, checked.where("error is not null").select("path", "error")
