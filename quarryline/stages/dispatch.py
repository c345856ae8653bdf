"""Dispatch: which method a message call reaches, from the evidence around its call site."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import rules
from quarryline.functions.ids import stable_id, symbol_fragment
from quarryline.operators.aggs import zero_filled
from quarryline.operators.dispatch import resolve
from quarryline.operators.hierarchy import one_architecture
from quarryline.operators.windows import window_ids
from quarryline.stages.artifact import Artifact

#: Classes of a call site, and receiver kinds that the text of a call can prove.
CLASSES = ["resolved", "candidate_set", "unresolved"]
PROVEN, OPEN = ("class_object", "self"), ("self", "typed_instance")


def dispatch_sites(edges: DataFrame) -> DataFrame:
    """(edge, caller, site, variant, is_super) of the edges that call the message runtime."""
    told = edges.withColumn("v", rules.runtime_variant(F.col("target_name"), F.col("thunk_name"))).where("v is not null")
    return told.select("edge", "caller", "site", "v.variant", "v.is_super")


def window_evidence(sites: DataFrame, references: DataFrame) -> DataFrame:
    """(edge, selectors, classes): what is referenced after the caller's previous site and up to this one.

    references is (caller, address, selector, class_name), either of the two NULL.
    """
    every = sites.select("caller", F.col("site").alias("address"), "edge").unionByName(references.select("caller", "address", "selector", "class_name"), allowMissingColumns=True)
    grouped = window_ids(every, "caller", ["address", F.col("edge").isNotNull(), "edge"], F.col("edge").isNotNull())
    out = grouped.groupBy("caller", "grp").agg(F.max("edge").alias("edge"), F.array_sort(F.collect_set("selector")).alias("selectors"), F.array_sort(F.collect_set("class_name")).alias("classes"))
    return out.where("edge is not null").select("edge", "selectors", "classes")


def class_symbols(classes: DataFrame) -> DataFrame:
    """O3: (symbol, class_name): classes by their names and by the names as parts of symbols."""
    return classes.select(F.explode(F.array("class_name", symbol_fragment(F.col("class_name")))).alias("symbol"), "class_name").distinct()


def typed_variables(texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """O3: (function, variable, classes) of declarations of pointers to classes in function texts (function, text)."""
    form = r"(?m)^\s*(?:struct\s+)?([A-Za-z_$][A-Za-z0-9_$]*)\s*\*\s*([A-Za-z_$][A-Za-z0-9_$]*)\s*(?:;|=)"
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(form), F.lit(1)).alias("symbol"), F.regexp_extract_all("text", F.lit(form), F.lit(2)).alias("variable"))
    rows = texts.select("function", F.explode(found).alias("d")).select("function", "d.variable", "d.symbol")
    return rows.join(symbols, "symbol").groupBy("function", "variable").agg(F.array_sort(F.collect_set("class_name")).alias("classes"))


def self_names(texts: DataFrame) -> DataFrame:
    """O3: (function, name): the first parameter of each function's head."""
    head = F.regexp_extract(F.trim(F.substring_index("text", "{", 1)), r"(?s)\(([^()]*)\)\s*$", 1)
    first = F.trim(F.get(F.split(head, ","), F.lit(0)))
    name = F.regexp_extract(first, r"([A-Za-z_$][A-Za-z0-9_$]*)\s*$", 1)
    return texts.select("function", F.when(~first.isin("", "void") & (name != ""), name).alias("name"))


def contexts(occurrences: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """O2: (edge, selector, receiver_kind, class_names) of the calls that texts show: occurrences is (edge, function, selector, receiver).

    A receiver that names a class is that class, the first parameter is self, a declared variable what it was declared as.
    """
    symbols = class_symbols(classes)
    own, typed = self_names(texts), typed_variables(texts, symbols)
    named = occurrences.withColumn("symbol", rules.explicit_class(F.col("receiver"))).join(symbols.groupBy("symbol").agg(F.array_sort(F.collect_set("class_name")).alias("object_of")), "symbol", "left")
    met = named.join(own.withColumnRenamed("name", "self_name"), "function", "left").join(typed.select("function", F.col("variable").alias("receiver"), F.col("classes").alias("typed_as")), ["function", "receiver"], "left")
    kind = F.when(F.col("object_of").isNotNull(), "class_object").when(F.col("receiver") == F.col("self_name"), "self").when(F.col("typed_as").isNotNull(), "typed_instance").otherwise("unknown")
    return met.select("edge", "selector", kind.alias("receiver_kind"), F.coalesce("object_of", "typed_as", F.array().cast("array<string>")).alias("class_names"))


def receivers(sites: DataFrame, methods: DataFrame, shown: DataFrame, evidence: DataFrame) -> DataFrame:
    """O2: (edge, ..., selector, receiver_kind, class_names, status): super by the caller's one method context, else what
    the text shows, else the classes referenced in the window, which prove no position."""
    context = methods.where("function_id is not null and kind in ('instance', 'class')").select(F.col("function_id").alias("caller"), F.struct("class_name", "kind").alias("c")).groupBy("caller").agg(F.count_distinct("c").alias("n_contexts"), F.min("c").alias("context"))
    met = sites.join(context, "caller", "left").join(shown.withColumnsRenamed({"selector": "shown_selector", "receiver_kind": "shown_kind", "class_names": "shown_classes"}), "edge", "left").join(evidence, "edge", "left")
    is_super = F.col("is_super") & (F.col("n_contexts") == 1)
    text = F.col("shown_kind").isNotNull() & (F.col("shown_kind") != "unknown")
    none = F.array().cast("array<string>")
    caller_class = F.when(F.col("n_contexts") == 1, F.col("context.class_name"))
    kind = F.when(is_super, "super").when(text, F.col("shown_kind")).otherwise("unknown")
    names = F.when(is_super, F.array("context.class_name")).when(text & (F.col("shown_kind") == "self") & (F.size("shown_classes") == 0) & caller_class.isNotNull(), F.array(caller_class)).when(text, F.col("shown_classes")).otherwise(F.coalesce("classes", none))
    selector = F.coalesce("shown_selector", F.when(F.size("selectors") == 1, F.get("selectors", F.lit(0))))
    status = F.when(is_super | F.col("shown_kind").isin(*PROVEN), "resolved").when(text | (F.size(F.coalesce("classes", none)) > 0), "candidate_set").otherwise("unresolved")
    return met.select("edge", "caller", "site", "variant", "is_super", selector.alias("selector"), kind.alias("receiver_kind"), names.alias("class_names"), caller_class.alias("caller_class"), status.alias("receiver_status"))


def resolve_dispatch(spark: SparkSession, tables: dict[str, DataFrame]) -> Artifact:
    """Tables in: functions (function), edges, methods (method_id, function_id, arch, class_name, kind, selector), classes (arch, class_name,
    superclass), references, texts, occurrences. Facts: callsites, classes (a histogram); hypotheses: edges to possible targets; errors: reasons."""
    methods, classes = tables["methods"], tables["classes"]
    sites = dispatch_sites(tables["edges"])
    shown = contexts(tables["occurrences"], tables["texts"], classes)
    told = receivers(sites, methods, shown, window_evidence(sites, tables["references"]))
    arch = one_architecture(tables["functions"], methods.select(F.col("function_id").alias("function"), "arch"), classes)
    told = told.join(arch.withColumnRenamed("function", "caller"), "caller", "left")
    asked = told.select(F.col("edge").alias("site"), "arch", "selector", F.when(F.col("receiver_kind") != "unknown", F.col("receiver_kind")).alias("receiver_kind"), F.get("class_names", F.lit(0)).alias("receiver_class"), "caller_class")
    judged = resolve(asked, classes, methods).withColumnRenamed("site", "edge")
    callsites = told.join(judged, "edge").withColumn("callsite_id", stable_id("objc-callsite", F.col("caller"), F.col("site"), F.col("edge")))
    targets = callsites.where("n_targets > 0").select("callsite_id", F.explode(F.split("target_ids", ",")).alias("target"))
    hypotheses = targets.select(F.lit("dispatch_edge").alias("kind"), F.col("callsite_id").alias("subject"), F.col("target").alias("detail"))
    errors = callsites.where("failure_reasons <> ''").select(F.explode(F.split("failure_reasons", ",")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).select("code", F.lit("callsites").alias("subject"), "n")
    return Artifact("dispatch", {"callsites": callsites, "classes": zero_filled(callsites, "classification", CLASSES)}, hypotheses, errors)
