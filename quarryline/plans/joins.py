"""Join queries over the driver tables read as evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import joins, windows
from quarryline.operators.aggs import joined_set
from quarryline.plans.registry import Query, registrar
from quarryline.tables import table

QUERIES: dict[str, Query] = {}
query = registrar(QUERIES)


def event_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the referenced symbol and a UTC microsecond clock."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
    )


@query("""
WITH e AS (SELECT event_id, user_id, event_type, json_extract_string(props, '$.k') AS k, epoch_us(ts) AS at_us FROM events),
g AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (
        PARTITION BY user_id ORDER BY at_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM e),
s AS (SELECT event_id, user_id, grp FROM g WHERE event_type = 'purchase'),
r AS (SELECT user_id, grp, k FROM g WHERE event_type = 'click')
SELECT s.event_id, s.user_id, count(DISTINCT r.k)::BIGINT AS n_candidates,
       CASE WHEN count(DISTINCT r.k) = 0 THEN 'unresolved' WHEN count(DISTINCT r.k) = 1 THEN 'exact' ELSE 'candidate_set' END AS status
FROM s LEFT JOIN r ON s.user_id = r.user_id AND s.grp = r.grp GROUP BY s.event_id, s.user_id
""")
def evidence_window_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References since the previous site of the same user decide how a site resolves."""
    return windows.resolve_in_window(
        event_evidence(spark, sf_dir), owner="user_id", order=["at", "event_id"], site=F.col("event_type") == "purchase",
        reference=F.col("event_type") == "click", value="k", site_id="event_id",
    )


_EVENTS = "e AS (SELECT event_id, user_id, event_type, json_extract_string(props, '$.k') AS k, epoch_us(ts) AS at_us FROM events)"
_GROUPED = _EVENTS + """,
g AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (
        PARTITION BY user_id ORDER BY at_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM e)"""


@query(f"""
WITH {_GROUPED}, s AS (SELECT event_id, user_id, grp FROM g WHERE event_type = 'purchase'), r AS (SELECT user_id, grp, k FROM g WHERE event_type = 'click')
SELECT s.event_id, s.user_id, max(r.k) AS k FROM s JOIN r USING (user_id, grp) GROUP BY s.event_id, s.user_id HAVING count(*) = 1""")
def window_exactly_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites whose window holds exactly one reference, with it."""
    found = windows.windowed_values(
        event_evidence(spark, sf_dir), owner="user_id", order=["at", "event_id"], site=F.col("event_type") == "purchase",
        reference=F.col("event_type") == "click", value="k", site_id="event_id",
    )
    return found.where("n_references = 1").select("event_id", "user_id", F.col("last_value").alias("k"))


@query(f"""
WITH {_EVENTS}, v AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e WHERE event_type = 'view'),
c AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e WHERE event_type = 'click')
SELECT v.event_id, v.user_id, c.event_id AS click_id FROM v LEFT JOIN c ON v.user_id = c.user_id AND v.i = c.i AND v.n = c.n""")
def guarded_positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-th view with k-th click of a user, only where the user has as many of either."""
    e = event_evidence(spark, sf_dir)
    clicks = e.where("event_type = 'click'").select("user_id", "at", F.col("event_id").alias("click_id"))
    views = e.where("event_type = 'view'").select("user_id", "at", "event_id")
    return joins.guarded_zip(views, clicks, ["user_id"], ["at", "event_id"], ["at", "click_id"], ["click_id"]).select("event_id", "user_id", "click_id")


@query(f"""
WITH {_EVENTS}, a AS (SELECT user_id, count(*) AS n_left FROM e WHERE event_type = 'view' GROUP BY user_id),
b AS (SELECT user_id, count(*) AS n_right, count(DISTINCT k) AS d, min(k) AS one FROM e WHERE event_type = 'click' GROUP BY user_id)
SELECT a.user_id, n_left, coalesce(n_right, 0) AS n_right, CASE WHEN n_left = n_right AND d = 1 THEN one END AS identity, coalesce(n_left = n_right AND d = 1, false) AS associated
FROM a LEFT JOIN b USING (user_id)""")
def group_identity_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's views and clicks belong together when they are as many and the clicks name one symbol."""
    e = event_evidence(spark, sf_dir)
    return joins.match_groups(e.where("event_type = 'view'"), e.where("event_type = 'click'"), ["user_id"], "k")


@query("""
WITH a AS (SELECT o_custkey AS owner, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey HAVING count(*) = 1),
b AS (SELECT user_id AS owner, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' AND value > 60 GROUP BY user_id HAVING count(*) = 1)
SELECT owner, o_orderkey, event_id FROM a JOIN b USING (owner)""")
def one_to_one_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a single pending order and a single large purchase event."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("owner"), "o_orderkey")
    events = table(spark, sf_dir, "events").where("event_type = 'purchase' and value > 60").select(F.col("user_id").alias("owner"), "event_id")
    return joins.one_to_one(orders, events, ["owner"])


@query("""
WITH a AS (SELECT l_suppkey, l_returnflag, count(*) AS n_left FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL),
b AS (SELECT l_suppkey, l_returnflag, count(*) AS n_right, count(DISTINCT l_linestatus) AS d, min(l_linestatus) AS one FROM lineitem WHERE l_linenumber = 2 GROUP BY ALL)
SELECT a.l_suppkey, a.l_returnflag, n_left, coalesce(n_right, 0) AS n_right, CASE WHEN n_left = n_right AND d = 1 THEN one END AS identity, coalesce(n_left = n_right AND d = 1, false) AS associated
FROM a LEFT JOIN b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = b.l_returnflag""")
def count_match_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and second lines of a supplier and flag, associated by equal counts and one status."""
    items = table(spark, sf_dir, "lineitem")
    return joins.match_groups(items.where("l_linenumber = 1"), items.where("l_linenumber = 2"), ["l_suppkey", "l_returnflag"], "l_linestatus")


@query("""
WITH s AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier WHERE s_nationkey = 3)
SELECT l_orderkey, l_linenumber, s_suppkey, coalesce(s_name, 'unresolved') AS target FROM lineitem LEFT JOIN s ON l_linenumber = n""")
def ordinal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line number as 1-based index into the suppliers of one nation."""
    nation = table(spark, sf_dir, "supplier").where("s_nationkey = 3")
    # an ordinal is one byte: each task passes on as many rows of a list, so a long list is no single task's sort
    listed = joins.numbered(nation, ["s_nationkey"], ["s_suppkey"], "l_linenumber").where("l_linenumber <= 255").select("l_linenumber", "s_suppkey", "s_name")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return lines.join(listed, "l_linenumber", "left").select("l_orderkey", "l_linenumber", "s_suppkey", F.coalesce("s_name", F.lit("unresolved")).alias("target"))


@query("""
WITH b AS (SELECT p_brand AS band_id, min(p_size) AS lo, min(p_size) + 5 AS hi FROM part GROUP BY p_brand)
SELECT p.p_partkey, min(b.band_id) AS band_id FROM part p LEFT JOIN b ON p.p_size >= b.lo AND p.p_size < b.hi GROUP BY p.p_partkey""")
def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first interval that contains a value. Intervals are cut into unit buckets, so the join is an equi-join."""
    part = table(spark, sf_dir, "part")
    starts = part.groupBy(F.col("p_brand").alias("band_id")).agg(F.min("p_size").alias("lo"))
    bands = starts.select("band_id", F.explode(F.sequence("lo", F.col("lo") + 4)).alias("p_size"))
    first = bands.groupBy("p_size").agg(F.min("band_id").alias("band_id"))
    return part.select("p_partkey", "p_size").join(first, "p_size", "left").select("p_partkey", "band_id")


@query(f"""
WITH {_EVENTS}, d AS (SELECT DISTINCT user_id, at_us FROM e)
SELECT user_id, at_us AS start_us, coalesce(lead(at_us) OVER (PARTITION BY user_id ORDER BY at_us), 4102444800000000) AS end_us FROM d""")
def next_symbol_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct time of a user runs to the next, the last to the end of the section."""
    found = joins.next_greater(event_evidence(spark, sf_dir), "user_id", "at", F.lit(4102444800000000))
    return found.select("user_id", F.col("at").alias("start_us"), F.col("next").alias("end_us"))


@query(f"""
WITH {_EVENTS}, s AS (SELECT event_id, user_id, at_us FROM e WHERE event_type = 'purchase'), f AS (SELECT user_id, at_us, max(event_id) AS f_id FROM e WHERE event_type = 'view' GROUP BY ALL)
SELECT s.event_id, s.user_id, f.f_id AS view_id FROM s ASOF LEFT JOIN f ON s.user_id = f.user_id AND s.at_us >= f.at_us""")
def preceding_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view at or before each purchase."""
    e = event_evidence(spark, sf_dir)
    found = joins.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "at"), e.where("event_type = 'view'").select("user_id", "at", F.col("event_id").alias("view")), "user_id", "at", "view")
    return found.select("event_id", "user_id", F.col("found").alias("view_id"))


@query("""
SELECT l_orderkey, count(*) AS n_lines, array_to_string(list_sort(list(DISTINCT p_brand) FILTER (p_brand IS NOT NULL)), ',') AS brands,
       array_to_string(list_sort(list(DISTINCT s_name) FILTER (s_name IS NOT NULL)), ',') AS suppliers
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey""")
def address_lookup_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines looked up in two dimensions, names collected per order."""
    part, supplier = table(spark, sf_dir, "part").select("p_partkey", "p_brand"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    met = lines.join(part, F.col("l_partkey") == F.col("p_partkey"), "left").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return met.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), joined_set(F.col("p_brand")).alias("brands"), joined_set(F.col("s_name")).alias("suppliers"))


@query("""
WITH a AS (SELECT DISTINCT source AS full_name FROM documents), p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS base FROM pages)
SELECT DISTINCT p.page_id, a.full_name AS asset FROM p JOIN a ON a.full_name = p.url OR substr(a.full_name, 4) = regexp_extract(p.url, '/([0-9]+)', 1)""")
def multi_key_asset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: a page matches a source by its full address or by the number in its path: two equi-joins, deduplicated."""
    assets = table(spark, sf_dir, "documents").select(F.col("source").alias("asset")).distinct()
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "/([0-9]+)", 1).alias("number"))
    full = pages.join(assets, F.col("url") == F.col("asset")).select("page_id", "asset")
    base = pages.join(assets.withColumn("tail", F.expr("substring(asset, 4)")), F.col("number") == F.col("tail")).select("page_id", "asset")
    return full.union(base).distinct()


@query("""
WITH a AS (SELECT o_custkey AS owner, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
b AS (SELECT user_id AS owner, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'purchase')
SELECT coalesce(a.owner, b.owner) AS owner, o_orderkey, event_id, CASE WHEN o_orderkey IS NULL THEN 'right' WHEN event_id IS NULL THEN 'left' ELSE 'both' END AS side
FROM a FULL JOIN b ON a.owner = b.owner AND a.k = b.k""")
def consume_once_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders use up a customer's purchase events one by one; leftovers of either side stay."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), "o_orderkey")
    events = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("owner"), "event_id")
    return joins.consume_once(orders, events, ["owner"], ["o_orderkey"], ["event_id"], ["event_id"]).select("owner", "o_orderkey", "event_id", "side")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def mapped_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the label table knows."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def unmapped_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without pending orders."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_anti")


#: Fixed values of the example catalog: event type, category.
CATALOG = (("view", "ui"), ("click", "ui"), ("purchase", "commerce"))


@query("""
WITH c(event_type, category) AS (VALUES ('view', 'ui'), ('click', 'ui'), ('purchase', 'commerce'))
SELECT event_id, coalesce(category, CASE WHEN value >= 50 THEN 'large' END) AS effect FROM events LEFT JOIN c USING (event_type) WHERE coalesce(category, CASE WHEN value >= 50 THEN 'large' END) IS NOT NULL""")
def catalog_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog first, a fallback by value next, else the row goes. The catalog is a constant of three rows."""
    catalog = spark.createDataFrame(list(CATALOG), "event_type string, category string")
    found = table(spark, sf_dir, "events").join(F.broadcast(catalog), "event_type", "left")
    return found.select("event_id", F.coalesce("category", F.when(F.col("value") >= 50, "large")).alias("effect")).where("effect is not null")


@query("""
WITH k AS (SELECT p_partkey AS part_id, p_name, p_brand, p_type FROM part WHERE p_size > 40), t AS (SELECT p_partkey AS candidate, p_name, p_brand, p_type FROM part WHERE p_size <= 10),
m AS (SELECT part_id, candidate, 0 AS level FROM k JOIN t USING (p_name) UNION SELECT part_id, candidate, 1 FROM k JOIN t ON k.p_brand = t.p_brand AND k.p_type = t.p_type UNION SELECT part_id, candidate, 2 FROM k JOIN t USING (p_type)),
b AS (SELECT part_id, min(level) AS level FROM m GROUP BY part_id)
SELECT k.part_id, b.level, count(m.candidate) AS n_candidates, min(m.candidate) AS first_candidate FROM k LEFT JOIN b USING (part_id) LEFT JOIN m ON m.part_id = b.part_id AND m.level = b.level GROUP BY k.part_id, b.level""")
def cascading_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by name, else by brand and type, else by type."""
    part = table(spark, sf_dir, "part")
    keys = part.where("p_size > 40").select(F.col("p_partkey").alias("part_id"), "p_name", "p_brand", "p_type")
    targets = part.where("p_size <= 10").select(F.col("p_partkey").alias("candidate"), "p_name", "p_brand", "p_type")
    return joins.cascade_summaries(keys, targets, [["p_name"], ["p_brand", "p_type"], ["p_type"]], "part_id", "candidate")


@query("""
SELECT o_orderkey, array_to_string(list_sort(list(DISTINCT r_name)), ',') AS regions FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY o_orderkey""")
def bridge_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order to region over three bridges."""
    customer, nation, region = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), table(spark, sf_dir, "region")
    met = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    met = met.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return met.groupBy("o_orderkey").agg(joined_set(F.col("r_name")).alias("regions"))


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line keys that an inventory lacks."""
    inventory = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().join(inventory, "l_orderkey", "left_anti")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are not unique."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT p_partkey, b AS scope FROM part LEFT JOIN LATERAL (SELECT unnest(CASE WHEN p_size > 25 THEN [p_brand, p_type] ELSE [] END) AS b) ON true")
def scope_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per scope, one with NULL where there is none."""
    scopes = F.when(F.col("p_size") > 25, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode_outer(scopes).alias("scope"))
