"""Aggregation, window, set, ranking and classification queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.functions import lattice
from quarryline.operators import aggs, joins, ranking
from quarryline.plans.registry import Query, registrar
from quarryline.tables import table

QUERIES: dict[str, Query] = {}
query = registrar(QUERIES)

#: Order status as classification, and the domain of the histogram.
STATUS = {"F": "exact", "O": "candidate_set", "P": "unresolved"}
DOMAIN = ["F", "O", "P", "X"]
_CLASS = "CASE o_orderstatus WHEN 'F' THEN 'exact' WHEN 'O' THEN 'candidate_set' WHEN 'P' THEN 'unresolved' ELSE o_orderstatus END"


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_orderstatus")
    for status, label in STATUS.items():
        c = F.when(F.col("o_orderstatus") == status, label).otherwise(c)
    return table(spark, sf_dir, "orders").withColumn("classification", c)


@query("WITH d(o_orderstatus) AS (VALUES ('F'), ('O'), ('P'), ('X')) SELECT d.o_orderstatus, count(o.o_orderkey) AS n FROM d LEFT JOIN orders o USING (o_orderstatus) GROUP BY d.o_orderstatus")
def zero_filled_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1."""
    return aggs.zero_filled(table(spark, sf_dir, "orders"), "o_orderstatus", DOMAIN)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def observed_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH r AS (SELECT unnest(list_filter([CASE WHEN o_orderstatus <> 'F' THEN 'not_final' END, CASE WHEN o_totalprice > 200000 THEN 'large_total' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'urgent' END], lambda x: x IS NOT NULL)) AS reason FROM orders)
SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def failure_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's list of reasons, exploded and counted."""
    reasons = F.array_compact(F.array(F.when(F.col("o_orderstatus") != "F", "not_final"), F.when(F.col("o_totalprice") > 200000, "large_total"), F.when(F.col("o_orderpriority").startswith("1"), "urgent")))
    return table(spark, sf_dir, "orders").select(F.explode(F.array_sort(reasons)).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT lang, count(*) AS n, count(l.doc_id) AS n_labelled, count(*) FILTER (quality = 1) AS n_good, (1000000 * count(l.doc_id)) // count(*) AS coverage_ppm
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang""")
def success_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts and a ratio, in millionths so that it is exact."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(1).alias("known"))
    met = docs.join(labels, "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("n_labelled"), F.count_if(F.col("quality") == 1).alias("n_good"))
    return met.withColumn("coverage_ppm", F.expr("(1000000 * n_labelled) div n"))


@query("""
WITH e AS (SELECT unnest([struct_pack(dimension := 'p_brand', "key" := p_brand), struct_pack(dimension := 'p_type', "key" := p_type), struct_pack(dimension := 'p_size', "key" := p_size::VARCHAR)]) AS e, p_partkey FROM part)
SELECT e.dimension AS dimension, e."key" AS "key", count(DISTINCT p_partkey) AS n_members FROM e GROUP BY ALL""")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three dimensions of one scan."""
    return aggs.inverted_index(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"], "p_partkey")


@query("SELECT p_brand, p_size, grouping(p_brand, p_size)::INT AS level, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), (p_brand, p_size))")
def index_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6 as grouping sets."""
    part = table(spark, sf_dir, "part").select("p_brand", "p_size")
    return part.groupingSets([["p_brand"], ["p_size"], ["p_brand", "p_size"]], "p_brand", "p_size").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"))


@query("""
WITH o AS (SELECT l_suppkey, l_linenumber, count(DISTINCT l_quantity) AS widths, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_suppkey, count(*) AS n_offsets, count(*) FILTER (widths > 1) AS n_conflicts, sum(n)::BIGINT AS n_accesses,
       CASE WHEN count(*) FILTER (widths > 1) = 0 THEN 'exact' WHEN count(*) FILTER (widths > 1) < count(*) THEN 'candidate_set' ELSE 'unresolved' END AS classification FROM o GROUP BY l_suppkey""")
def layout_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets within layouts, conflicts where an offset has several widths."""
    offsets = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count_distinct("l_quantity").alias("widths"), F.count(F.lit(1)).alias("n"))
    rolled = offsets.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_offsets"), F.count_if(F.col("widths") > 1).alias("n_conflicts"), F.sum("n").alias("n_accesses"))
    return rolled.withColumn("classification", F.when(F.col("n_conflicts") == 0, "exact").when(F.col("n_conflicts") < F.col("n_offsets"), "candidate_set").otherwise("unresolved"))


@query("""
SELECT user_id, count(DISTINCT json_extract_string(props, '$.k')) FILTER (event_type = 'view') AS n_read, count(DISTINCT json_extract_string(props, '$.k')) FILTER (event_type = 'click') AS n_written,
       count(*) FILTER (event_type = 'purchase') AS n_sites FROM events GROUP BY user_id""")
def state_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers and writers of each state."""
    k = F.get_json_object("props", "$.k")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", k.alias("k"))
    return e.groupBy("user_id").agg(
        F.count_distinct(F.when(F.col("event_type") == "view", F.col("k"))).alias("n_read"), F.count_distinct(F.when(F.col("event_type") == "click", F.col("k"))).alias("n_written"),
        F.count_if(F.col("event_type") == "purchase").alias("n_sites"),
    )


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS occurrence_count, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY text")
def merge_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts become one row; the digest stands for the text in the shuffle."""
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id", "lang")
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("occurrence_count"), aggs.joined_set(F.col("lang")).alias("langs"))


@query("""
SELECT l_orderkey, l_linenumber, sum(l_quantity::BIGINT) OVER w::BIGINT AS running, sum(l_quantity::BIGINT) OVER w <= 100 AS within_cap FROM lineitem
WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice ROWS UNBOUNDED PRECEDING)""")
def running_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals against a cap."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum(F.col("l_quantity").cast("long")).over(w)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", running.alias("running"), (running <= 100).alias("within_cap"))


@query("SELECT s_nationkey, s_suppkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::BIGINT AS position FROM supplier")
def row_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0-based place in a canonical order."""
    placed = joins.numbered(table(spark, sf_dir, "supplier"), ["s_nationkey"], ["s_suppkey"])
    return placed.select("s_nationkey", "s_suppkey", (F.col("place") - 1).cast("long").alias("position"))


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6."""
    return joins.first_of(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7."""
    return joins.first_of(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderpriority, o_orderkey) AS rank,
       row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderkey) AS place, count(*) OVER (PARTITION BY o_orderstatus) AS total FROM orders""")
def implementation_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense global rank without a single-partition window, places and totals within a scope."""
    phase = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return ranking.global_rank(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", phase.alias("phase")), "o_orderstatus", "phase", ["o_orderpriority", "o_orderkey"]).select("o_orderkey", "rank", "place", "total")


@query("""
WITH d AS (SELECT DISTINCT o_custkey, o_orderkey FROM orders)
SELECT o_custkey, array_to_string(list_slice(list_sort(list(o_orderkey)), 1, 3), ',') AS ids, greatest(count(*) - 3, 0)::BIGINT AS overflow FROM d GROUP BY o_custkey""")
def topk_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three smallest orders of a customer, and how many more."""
    return aggs.top_k_overflow(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 3)


@query(f"""
WITH c AS (SELECT o_custkey, CASE {_CLASS} WHEN 'exact' THEN 2 WHEN 'candidate_set' THEN 1 WHEN 'unresolved' THEN 0 END AS r FROM orders)
SELECT o_custkey, CASE coalesce(min(r), 2) WHEN 2 THEN 'exact' WHEN 1 THEN 'candidate_set' ELSE 'unresolved' END AS classification FROM c GROUP BY o_custkey""")
def classification_meet_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1."""
    return classified(spark, sf_dir).groupBy("o_custkey").agg(lattice.meet_lenient(F.col("classification")).alias("classification"))


@query(f"""
WITH c AS (SELECT o_custkey, CASE WHEN o_totalprice > 300000 THEN 0 ELSE CASE {_CLASS} WHEN 'exact' THEN 2 WHEN 'candidate_set' THEN 1 ELSE 0 END END AS r FROM orders)
SELECT o_custkey, CASE coalesce(min(r), 0) WHEN 2 THEN 'exact' WHEN 1 THEN 'candidate_set' ELSE 'unresolved' END AS classification,
       CASE coalesce(min(r), 0) WHEN 2 THEN 'candidate_set' WHEN 1 THEN 'candidate_set' ELSE 'unresolved' END AS demoted, CASE coalesce(min(r), 0) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM c GROUP BY o_custkey""")
def classification_meet_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K3, K4: large totals count as an invalid class here, which K2 takes for unresolved."""
    rows = classified(spark, sf_dir).withColumn("classification", F.when(F.col("o_totalprice") > 300000, "?").otherwise(F.col("classification")))
    met = rows.groupBy("o_custkey").agg(lattice.meet_strict(F.col("classification")).alias("classification"))
    return met.select("*", lattice.demote(F.col("classification")).alias("demoted"), lattice.confidence(F.col("classification")).alias("confidence"))


@query("""
WITH s AS (SELECT user_id, list_sort(list(DISTINCT json_extract_string(props, '$.k')) FILTER (event_type = 'click')) AS a, list_sort(list(DISTINCT json_extract_string(props, '$.k')) FILTER (event_type = 'view')) AS b FROM events GROUP BY user_id)
SELECT user_id, coalesce(a, []) <> coalesce(b, []) AS changed FROM s""")
def refinement_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7: whether a set differs from its baseline."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    sets = e.groupBy("user_id").agg(*(F.array_sort(F.collect_set(F.when(F.col("event_type") == t, F.col("k")))).alias(n) for t, n in (("click", "a"), ("view", "b"))))
    return sets.select("user_id", (F.col("a") != F.col("b")).alias("changed"))


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def protocol_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5: customers that ordered with every priority."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").distinct()
    wanted = F.broadcast(orders.agg(F.count_distinct("o_orderpriority").alias("wanted")))  # one row
    return orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).join(wanted, F.col("n") == F.col("wanted")).select("o_custkey")


@query("SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).union(table(spark, sf_dir, "customer").select("c_custkey")).distinct()


@query("SELECT o_custkey AS id FROM orders INTERSECT SELECT user_id FROM events")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).intersect(table(spark, sf_dir, "events").select("user_id"))


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT user_id FROM events")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).subtract(table(spark, sf_dir, "events").select("user_id"))


@query("""
WITH a AS (SELECT l_suppkey, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, flags = ['A', 'N', 'R'] AS complete FROM a""")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6: whether an observed set is the expected one."""
    flags = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    return flags.select("l_suppkey", (F.col("flags") == F.array(*map(F.lit, "ANR"))).alias("complete"))


@query("""
WITH u AS (SELECT 'order' AS kind, o_orderstatus AS status FROM orders UNION ALL SELECT 'line', l_linestatus FROM lineitem UNION ALL SELECT 'event', event_type FROM events)
SELECT kind, status, count(*) AS n FROM u GROUP BY ALL""")
def heterogeneous_union_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2: each branch is counted where it is read; only counts are shuffled."""
    tagged = [table(spark, sf_dir, t).select(F.lit(k).alias("kind"), F.col(c).alias("status")) for t, k, c in (("orders", "order", "o_orderstatus"), ("lineitem", "line", "l_linestatus"), ("events", "event", "event_type"))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_type FROM (SELECT *, max(CASE WHEN p_size > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand) AS has_specific FROM part) WHERE p_size > 10 OR has_specific = 0")
def subsumption_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generic members of a group go when a specific one is there."""
    specific = F.max(F.when(F.col("p_size") > 10, 1).otherwise(0)).over(Window.partitionBy("p_brand"))
    return table(spark, sf_dir, "part").withColumn("has_specific", specific).where("p_size > 10 or has_specific = 0").select("p_partkey", "p_type")


@query("""
SELECT count(*) AS n_orders, count(*) FILTER (o_orderstatus = 'F') AS n_exact, count(DISTINCT o_custkey) AS n_customers, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order FROM orders""")
def summary_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counts and ranges."""
    return table(spark, sf_dir, "orders").agg(
        F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_exact"), F.count_distinct("o_custkey").alias("n_customers"), F.min("o_orderkey").alias("first_order"), F.max("o_orderkey").alias("last_order")
    )


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def display_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 of a total order; the limit is the feature."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200).select("o_orderkey", "o_custkey")


@query("""
SELECT l_orderkey, bool_and(l_returnflag = 'N') AS all_n, CASE WHEN count(DISTINCT l_suppkey) = 1 AND min(l_quantity) >= 10 THEN 'exact' WHEN count(DISTINCT l_suppkey) >= 1 THEN 'candidate_set' ELSE 'unresolved' END AS classification FROM lineitem GROUP BY l_orderkey""")
def atom_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact only with one atom and enough confidence."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag") == "N").alias("all_n"), F.count_distinct("l_suppkey").alias("atoms"), F.min("l_quantity").alias("least"))
    return g.select("l_orderkey", "all_n", F.when((F.col("atoms") == 1) & (F.col("least") >= 10), "exact").when(F.col("atoms") >= 1, "candidate_set").otherwise("unresolved").alias("classification"))
