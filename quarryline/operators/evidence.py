"""Evidence roll-ups: states, merged members, alternatives, packets, triggers and effects, fingerprints of projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.functions import lattice, rules
from quarryline.functions.ids import stable_id
from quarryline.operators.aggs import joined_set

#: Candidates of an alternative at most, and digits in the name of a scope's file.
MOST_CANDIDATES, SCOPE_DIGITS = 24, 16


def state_variables(accesses: DataFrame, key: str) -> DataFrame:
    """(key, readers, writers, expressions, types, classification) of accesses (key, function, access, expression, type, classification).

    Lists are comma-joined sets; the class is the weakest of all accesses.
    """
    when = lambda access: F.when(F.col("access") == access, F.col("function"))
    return accesses.groupBy(key).agg(
        joined_set(when("read")).alias("readers"), joined_set(when("write")).alias("writers"), joined_set(F.col("expression")).alias("expressions"), joined_set(F.col("type")).alias("types"),
        lattice.meet_strict(F.col("classification")).alias("classification"),
    )


def fingerprint(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """(keys, n, digest) of a projection as a multiset: equal for equal rows in any order.

    The digest sums parts of each row's SHA-256, so it combines before it shuffles and needs no order.
    """
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns))
    part = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(part).cast("decimal(38,0)").cast("string").alias("digest"))


def refinements(baseline: DataFrame, refined: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, changed): which records of a baseline a refinement changes; a refinement without baseline is not taken."""
    differ = reduce(lambda a, b: a | b, (~F.col(f"b.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns))
    return baseline.alias("b").join(refined.alias("r"), key, "left").select(key, F.coalesce(F.when(F.col(f"r.{columns[0]}").isNotNull(), differ), F.lit(False)).alias("changed"))


def typed_records(sources: dict[str, DataFrame], owner: str) -> DataFrame:
    """(owner, records): records (owner, id, name, position) of several artifacts as one list by (position, id, artifact), those without position last."""
    tagged = [rows.select(owner, F.struct(F.coalesce("position", F.lit((1 << 31) - 1)).alias("position"), F.col("id"), F.lit(artifact).alias("artifact"), F.col("name")).alias("record")) for artifact, rows in sorted(sources.items())]
    return reduce(DataFrame.union, tagged).where(F.col(owner).isNotNull()).groupBy(owner).agg(F.array_sort(F.collect_list("record")).alias("records"))


def alternatives(candidates: DataFrame, item: str, kind: str, most: int = MOST_CANDIDATES) -> DataFrame:
    """(item, alternative_id, candidate_ids, omitted): the first candidates of each item in order, and how many more there are.

    candidates is (item, candidate); candidates without an identity do not count, items without any have no row.
    """
    distinct = candidates.where("candidate <> ''").select(item, "candidate").distinct()
    place = F.row_number().over(Window.partitionBy(item).orderBy("candidate"))
    ranked = distinct.withColumn("place", place)
    kept = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.struct("place", "candidate")))), lambda s: s["candidate"]), ",")
    grouped = ranked.groupBy(item).agg(kept.alias("candidate_ids"), F.greatest(F.count(F.lit(1)) - most, F.lit(0)).cast("long").alias("omitted"))
    return grouped.select(item, stable_id("alternative", F.col(item), F.lit(kind)).alias("alternative_id"), "candidate_ids", "omitted")


def questions(records: DataFrame, item: str, kind: str, most: int = MOST_CANDIDATES) -> DataFrame:
    """(item, question_id, classification, reasons, omitted): what is open about records (item, classification, reasons) that are not exact."""
    reasons = F.array_sort(F.array_distinct(F.filter("reasons", lambda r: r != "")))
    rows = records.where("classification <> 'exact'").withColumn("all_reasons", reasons).withColumn("shown", F.slice("all_reasons", 1, most))
    return rows.select(item, stable_id("question", F.col(item), F.lit(kind), F.array_join("shown", "\0")).alias("question_id"), "classification", F.array_join("shown", ",").alias("reasons"), F.greatest(F.size("all_reasons") - most, F.lit(0)).cast("long").alias("omitted"))


def packet_documents(packed: DataFrame, scope: str) -> DataFrame:
    """(scope, sequence, total, file, n_items, n_exact, n_candidate_set, n_unresolved, kinds) of packed items (scope, packet, kind, classification).

    The file's name holds a digest of the scope; the items of no scope belong to the application. Kinds are kind=count, in order.
    """
    kinds = packed.groupBy(scope, "packet", "kind", "classification").agg(F.count(F.lit(1)).alias("n"))
    of = lambda c: F.coalesce(F.sum(F.when(F.col("classification") == c, F.col("n"))), F.lit(0)).alias(f"n_{c}")
    by_kind = kinds.groupBy(scope, "packet", "kind").agg(F.sum("n").alias("n"), *(of(c) for c in lattice.RANKS))
    documents = by_kind.groupBy(scope, "packet").agg(
        F.sum("n").alias("n_items"), *(F.sum(f"n_{c}").alias(f"n_{c}") for c in lattice.RANKS), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", F.col("n").cast("string")))), ",").alias("kinds")
    )
    total = F.count(F.lit(1)).over(Window.partitionBy(scope))
    prefix = F.when(F.col(scope).isNull(), "application").otherwise(F.concat(F.lit("screen-"), F.substring(F.sha2(F.col(scope).cast("string"), 256), 1, SCOPE_DIGITS)))
    file = F.concat(prefix, F.lit("-"), F.lpad(F.col("packet").cast("string"), 4, "0"), F.lit(".json"))
    return documents.select(scope, F.col("packet").alias("sequence"), total.alias("total"), file.alias("file"), "n_items", *(f"n_{c}" for c in lattice.RANKS), "kinds")


def resources(functions: DataFrame) -> DataFrame:
    """(function, kind, value, classification) of the strings and assets (arrays) of functions; a reference alone proves no use, so all are candidates."""
    each = lambda column, kind: functions.select("function", F.lit(kind).alias("kind"), F.explode(column).alias("value"))
    return each("strings", "string").union(each("assets", "asset")).where("value is not null").withColumn("classification", F.lit("candidate_set"))


#: What a trigger's source has to say: who is named by what, how sure it is, and its handlers.
TRIGGER = ["kind", "subject", "selector", "event", "classification", "screens", "handlers", "reasons"]


def triggers(sources: list[DataFrame]) -> DataFrame:
    """One row a trigger of all sources (TRIGGER columns), the first source's where several name the same.

    A trigger without a handler, or of no or several screens, is weaker than its source says; the class is the
    weakest of source, handlers and screens, the reasons say why.
    """
    every = reduce(DataFrame.union, (s.select(F.lit(i).alias("source"), *TRIGGER) for i, s in enumerate(sources)))
    handled = F.size("handlers") > 0
    weakest = F.least(F.coalesce(lattice.rank(F.col("classification")), F.lit(0)), F.when(handled, 2).otherwise(0), F.when(F.size("screens") == 1, 2).when(F.size("screens") == 0, 0).otherwise(1))
    reasons = F.array_sort(F.array_distinct(F.concat("reasons", F.when(~handled, F.array(F.lit("handler_not_recovered"))).otherwise(F.array().cast("array<string>")))))
    made = every.select(stable_id("trigger", F.col("kind"), F.col("subject"), F.col("selector")).alias("trigger"), "source", "kind", "subject", "selector", "event", lattice.label(weakest).alias("classification"), "screens", "handlers", reasons.alias("reasons"))
    first = Window.partitionBy("trigger").orderBy("source", "event", "classification")
    return made.withColumn("first", F.row_number().over(first)).where("first = 1").drop("first", "source")


def effects(nodes: DataFrame, triggered: DataFrame, facts: list[DataFrame]) -> DataFrame:
    """(effect, trigger, function, kind, operation, target, classification): what the functions of each slice do.

    nodes is (trigger, node, classification) of call slices, triggered is (trigger, classification), facts are
    (function, catalogued, categories, status, operation, target, classification) tables of several sources. A
    fact without kind is none; the class is the weakest of trigger, path and fact; of facts with one identity the last source's counts.
    """
    every = reduce(DataFrame.union, (f.select(F.lit(i).alias("source"), "function", rules.effect_kind(F.col("catalogued"), F.col("categories"), F.col("status")).alias("kind"), "operation", "target", F.col("classification").alias("fact_class")) for i, f in enumerate(facts)))
    met = nodes.select("trigger", F.col("node").alias("function"), F.col("classification").alias("path_class")).join(every.where("kind is not null"), "function")
    met = met.join(triggered.select("trigger", F.col("classification").alias("trigger_class")), "trigger")
    weakest = F.least(*(F.coalesce(lattice.rank(F.col(c)), F.lit(0)) for c in ("trigger_class", "path_class", "fact_class")))
    made = met.select(stable_id("effect", F.col("trigger"), F.col("function"), F.col("kind"), F.col("target")).alias("effect"), "source", "trigger", "function", "kind", "operation", "target", lattice.label(weakest).alias("classification"))
    last = Window.partitionBy("effect").orderBy(F.desc("source"), "operation", "classification")
    return made.withColumn("last", F.row_number().over(last)).where("last = 1").drop("last", "source")


def histogram_columns(column: str, domain: tuple[str, ...]) -> list[Column]:
    """E1, E14 as aggregates: one count a value of a domain."""
    return [F.count_if(F.col(column) == v).alias(f"n_{v}") for v in domain]
