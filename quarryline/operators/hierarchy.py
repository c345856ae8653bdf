"""Class hierarchies: indexes, inherited members, late members, families of declared types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators.graph import closure


def inherited(members: DataFrame, parents: DataFrame) -> DataFrame:
    """(node, member, own): the members of a node and of all its ancestors, each once; cycles are no harm.

    members is (node, member), parents is (node, parent), a node may have several.
    """
    up = closure(parents.where("parent is not null").select(F.col("node").alias("a"), F.col("parent").alias("b")))
    own = members.select("node", "member", F.lit(True).alias("own"))
    above = up.join(members.select(F.col("node").alias("b"), "member"), "b").select(F.col("a").alias("node"), "member", F.lit(False).alias("own"))
    return own.union(above).groupBy("node", "member").agg(F.max("own").alias("own"))


def class_index(classes: DataFrame, categories: DataFrame) -> DataFrame:
    """(arch, class_name, superclass, protocols): one row a class, the first by superclass, categories' protocols added to its own."""
    rows = classes.select("arch", "class_name", "superclass", "protocols").union(categories.select("arch", "class_name", F.lit(None).cast("string"), "protocols"))
    known = classes.select("arch", "class_name").distinct()
    merged = rows.groupBy("arch", "class_name").agg(F.min("superclass").alias("superclass"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("protocols")))).alias("protocols"))
    return merged.join(known, ["arch", "class_name"], "left_semi")


def spec_roots(specs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, kind, class_name, hypothesis): what a declared type may hold.

    specs: (node, kind, class_name, protocols, exact). A declared class stands for itself where exact, else
    for itself and all below it, by hypothesis if there are any below; without a class, protocols narrow it to one
    atom by hypothesis; kinds other than instances hold themselves.
    """
    instances = specs.where("kind = 'objective_c_instance'")
    below = closure(classes.where("superclass is not null").select(F.col("superclass").alias("a"), F.col("class_name").alias("b"))).withColumnsRenamed({"a": "class_name", "b": "below"})
    known = instances.join(classes.select("class_name"), "class_name", "left_semi")
    itself = known.select("node", "kind", "class_name", "exact")
    family = itself.union(known.where("not exact").join(below, "class_name").select("node", "kind", F.col("below").alias("class_name"), "exact")).distinct()
    several = family.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    typed = family.join(several, "node").select("node", "kind", "class_name", ((F.col("n") > 1) & ~F.col("exact")).alias("hypothesis"))
    protocols = instances.where("class_name is null and size(protocols) > 0").select("node", F.lit("objective_c_protocol").alias("kind"), F.concat(F.lit("id<"), F.array_join(F.array_sort("protocols"), ","), F.lit(">")).alias("class_name"), F.lit(True).alias("hypothesis"))
    plain = specs.where("kind <> 'objective_c_instance'").select("node", "kind", "class_name", F.lit(False).alias("hypothesis"))
    return typed.union(protocols).union(plain)


def late_members(dimension: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """The dimension and a bare row for each key that only facts name; present tells them apart."""
    known = dimension.withColumn("present", F.lit(True))
    named = dimension.select(*(F.col(k).alias(f"known_{k}") for k in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"known_{k}")) for k in keys))  # a key may have NULL parts
    late = facts.select(*keys).distinct().join(named, same, "left_anti").withColumn("present", F.lit(False))
    return known.unionByName(late, allowMissingColumns=True)


def one_architecture(functions: DataFrame, methods: DataFrame, architectures: DataFrame) -> DataFrame:
    """(function, arch): the one architecture that a function's methods agree on, else the only one there is if none says any, else unknown."""
    said = methods.where("arch is not null").groupBy("function").agg(F.count_distinct("arch").alias("n"), F.min("arch").alias("one"))
    every = architectures.agg(F.count_distinct("arch").alias("n"), F.min("arch").alias("one")).first()
    sole = F.lit(every["one"] if every["n"] == 1 else "unknown")
    met = functions.select("function").join(said, "function", "left")
    return met.select("function", F.when(F.col("n") == 1, F.col("one")).when(F.col("n").isNull(), sole).otherwise("unknown").alias("arch"))
