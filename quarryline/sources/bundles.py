"""Bundles inside archives: chains of links, the one application folder, and the inventory of its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators.lineage import cut
from quarryline.sources.files import asset_category, resolve_link

#: Where an application's property list lies, and its keys of entry points.
INFO = r"^Payload/[^/]+\.app/Info\.plist$"
ENTRY_KEYS = {
    "main_storyboard": ("UIMainStoryboardFile", "UIMainStoryboardFile~ipad"), "main_nib": ("NSMainNibFile", "NSMainNibFile~ipad"), "launch_storyboard": ("UILaunchStoryboardName", "UILaunchStoryboardName~ipad"),
}


def link_targets(members: DataFrame) -> DataFrame:
    """A5: (archive, path, target, state, links) of links, followed to the end: file, missing, cycle or outside.

    members is (archive, path, link), link NULL for plain files. Chains are halved in each round (a link takes over the target
    of its target), so a chain of n links needs about log2(n) rounds; links that still point at links
    after as many rounds as any chain could need run in a circle. The column links counts a chain's links; in a circle
    it is NULL.
    """
    files = members.where("link is null").select("archive", F.col("path").alias("end")).distinct()
    links = cut(members.where("link is not null").select("archive", "path", resolve_link(F.col("path"), F.col("link")).alias("target"), F.lit(1).cast("long").alias("links")))
    rounds = max(1, links.count()).bit_length() + 1
    now = links
    for _ in range(rounds):
        step = now.select("archive", F.col("path").alias("target"), F.col("target").alias("next"), F.col("links").alias("more"), F.lit(True).alias("is_link"))
        met = cut(now.join(step, ["archive", "target"], "left"))
        if met.where("is_link").isEmpty():
            break
        now = cut(met.select("archive", "path", F.when(F.col("is_link"), F.col("next")).otherwise(F.col("target")).alias("target"), (F.col("links") + F.coalesce("more", F.lit(0))).alias("links")))
    still = now.select("archive", F.col("path").alias("target"), F.lit(True).alias("is_link"))
    met = now.join(still, ["archive", "target"], "left").join(files, (now["archive"] == files["archive"]) & (now["target"] == files["end"]), "left").select(now["archive"], now["path"], now["target"], "links", "is_link", "end")
    state = F.when(F.col("target").isNull(), "outside").when(F.col("is_link"), "cycle").when(F.col("end").isNotNull(), "file").otherwise("missing")
    return met.select("archive", "path", "target", state.alias("state"), F.when(F.col("is_link").isNull(), F.col("links")).alias("links"))


def bundles(members: DataFrame, executables: DataFrame) -> DataFrame:
    """(archive, bundle, error): the folder whose property list names an executable that is there; none or several are errors.

    members is (archive, path), executables is (archive, path, executable): the property lists' paths and what they name.
    """
    lists = executables.where(F.col("path").rlike(INFO)).select("archive", F.regexp_replace("path", r"/Info\.plist$", "").alias("bundle"), "executable")
    wanted = lists.withColumn("path", F.concat_ws("/", "bundle", "executable"))
    valid = wanted.join(members.select("archive", "path"), ["archive", "path"], "left_semi").groupBy("archive").agg(F.count_distinct("bundle").alias("n"), F.min("bundle").alias("one"))
    every = members.select("archive").distinct().join(valid, "archive", "left")
    return every.select("archive", F.when(F.col("n") == 1, F.col("one")).alias("bundle"), F.when(F.col("n").isNull(), "no_bundle").when(F.col("n") > 1, "several_bundles").alias("error"))


def inventory(members: DataFrame, found: DataFrame) -> DataFrame:
    """(archive, path, size, crc32, category, target, state) of the accepted members of each archive's bundle, one row a file."""
    rows = members.where("error is null and path is not null").join(found.where("error is null").select("archive", "bundle"), "archive")
    inside = rows.where(F.col("path").startswith(F.concat("bundle", F.lit("/"))))
    links = link_targets(members.where("error is null").select("archive", "path", "link"))
    return inside.join(links, ["archive", "path"], "left").select("archive", "path", "size", "crc32", asset_category(F.col("path")).alias("category"), "target", "state")


def entry_points(properties: Column) -> Column:
    """Array of (kind, name) that a property list's scalars name."""
    rows = [F.struct(F.lit(kind).alias("kind"), F.try_element_at(properties, F.lit(key)).alias("name")) for kind, keys in ENTRY_KEYS.items() for key in keys]
    return F.array_sort(F.array_distinct(F.filter(F.array(*rows), lambda r: r["name"] != "")))
