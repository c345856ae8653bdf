"""Message dispatch: which methods a call site can reach, and how surely."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators.graph import closure
from quarryline.operators.lineage import cut

#: Receiver kinds whose class is proven, and those whose class stands for its descendants too.
EXACT_RECEIVERS, OPEN_RECEIVERS = ("super", "class_object"), ("self", "typed_instance")


def lookup(starts: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """Starts (site, arch, class_name, kind, selector) with the first class at or above that defines the method.

    Gives (site, arch, class_name, method_id, function_id, path): the classes passed, joined by >. Chains end at
    unknown superclasses and at cycles.
    """
    waiting = cut(starts.select("site", "arch", "class_name", "kind", "selector", F.col("class_name").alias("at"), F.array("class_name").alias("trail")))
    known = methods.select("arch", F.col("class_name").alias("at"), "kind", "selector", "method_id", "function_id")
    up = classes.select("arch", F.col("class_name").alias("at"), "superclass").dropDuplicates(["arch", "at"])
    out = None
    while not waiting.isEmpty():
        tried = waiting.join(known, ["arch", "at", "kind", "selector"], "left")
        found = cut(tried.where("method_id is not null").select("site", "arch", "class_name", "method_id", "function_id", F.array_join("trail", ">").alias("path")))
        out = found if out is None else out.union(found)
        climbed = tried.where("method_id is null").join(up, ["arch", "at"]).where("superclass is not null and not array_contains(trail, superclass)")
        waiting = cut(climbed.select("site", "arch", "class_name", "kind", "selector", F.col("superclass").alias("at"), F.array_append("trail", F.col("superclass")).alias("trail")))
    return out if out is not None else waiting.select("site", "arch", "class_name", F.lit(None).cast("string").alias("method_id"), F.lit(None).cast("string").alias("function_id"), F.lit("").alias("path"))


def targets(sites: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """O1: (site, method_id, function_id, path) of every possible target.

    sites: (site, arch, selector, receiver_kind, receiver_class, caller_class). super starts above the caller's
    class, a class object looks for class methods, self and typed instances for instance methods of the class and
    of all its descendants; any other receiver may be whatever defines the selector.
    """
    above = classes.select("arch", F.col("class_name").alias("caller_class"), F.col("superclass").alias("class_name"))
    over = sites.where("receiver_kind = 'super'").join(above, ["arch", "caller_class"]).select("site", "arch", "class_name", F.lit("instance").alias("kind"), "selector")
    objects = sites.where("receiver_kind = 'class_object'").select("site", "arch", F.col("receiver_class").alias("class_name"), F.lit("class").alias("kind"), "selector")
    node = lambda c: F.concat_ws("\0", "arch", c)
    below = closure(classes.where("superclass is not null").select(node("superclass").alias("a"), node("class_name").alias("b")))
    open_ = sites.where(F.col("receiver_kind").isin(*OPEN_RECEIVERS)).withColumn("a", node("receiver_class"))
    family = open_.select("site", "arch", "selector", F.col("receiver_class").alias("class_name")).union(open_.join(below, "a").select("site", "arch", "selector", F.substring_index("b", "\0", -1).alias("class_name")))
    found = lookup(over.union(objects).union(family.select("site", "arch", "class_name", F.lit("instance").alias("kind"), "selector")), classes, methods)
    rest = sites.where(F.col("receiver_kind").isNull() | ~F.col("receiver_kind").isin(*EXACT_RECEIVERS, *OPEN_RECEIVERS))
    anywhere = rest.join(methods, ["arch", "selector"]).select("site", "method_id", "function_id", F.lit("").alias("path"))
    return found.select("site", "method_id", "function_id", "path").union(anywhere).groupBy("site", "method_id", "function_id").agg(F.min("path").alias("path"))


def resolve(sites: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """K6, K7: each site with n_targets, target ids, classification and the reasons why it is not resolved."""
    counted = targets(sites, classes, methods).groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.count("function_id").alias("mapped"), F.array_join(F.array_sort(F.collect_set("method_id")), ",").alias("target_ids"), F.min("path").alias("path"))
    met = sites.join(counted, "site", "left").withColumn("n_targets", F.coalesce("n", F.lit(0)))
    exact = F.col("receiver_kind").isin(*EXACT_RECEIVERS)
    sure = F.col("selector").isNotNull() & F.coalesce(exact, F.lit(False)) & (F.col("n_targets") == 1) & (F.col("mapped") == 1)
    reasons = F.array_compact(F.array(
        F.when(F.col("selector").isNull(), "selector_unresolved"), F.when(~F.coalesce(exact, F.lit(False)), "receiver_not_exact"), F.when(F.col("n_targets") == 0, "no_known_target"),
        F.when(F.col("n_targets") > 1, "several_targets"), F.when((F.col("n_targets") > 0) & (F.col("mapped") < F.col("n_targets")), "target_not_mapped"),
    ))
    return met.select(
        "site", "n_targets", F.coalesce("target_ids", F.lit("")).alias("target_ids"), F.coalesce("path", F.lit("")).alias("path"),
        F.when(sure, "resolved").when(F.col("n_targets") > 0, "candidate_set").otherwise("unresolved").alias("classification"), F.when(sure, "").otherwise(F.array_join(F.array_sort(reasons), ",")).alias("failure_reasons"),
    )
