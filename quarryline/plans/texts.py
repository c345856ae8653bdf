"""Identifier, text and markup queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import ids, text
from quarryline.operators.aggs import joined_set
from quarryline.operators.pack import next_fit
from quarryline.plans.registry import Query, registrar
from quarryline.tables import table

QUERIES: dict[str, Query] = {}
query = registrar(QUERIES)


@query("""
SELECT o_orderkey, 'order:' || substr(sha256('order' || chr(0) || o_orderkey::VARCHAR || chr(0) || coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END, 'None')), 1, 20) AS id FROM orders""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, an absent part included."""
    part = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", ids.stable_id("order", F.col("o_orderkey"), part).alias("id"))


@query("SELECT l_orderkey, l_linenumber, printf('0x%08x', l_partkey) AS address, printf('0x%08x', l_partkey & ~1) AS canonical, l_partkey & 1 = 1 AS flagged FROM lineitem")
def address_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2, C3."""
    a = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ids.address(a).alias("address"), ids.address(ids.clear_low_bit(a)).alias("canonical"), (a.bitwiseAND(F.lit(1)) == 1).alias("flagged"))


@query(r"""
WITH f AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS b,
  substr(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[. ]+|[. ]+$', '', 'g'), 1, 100) AS stem FROM pages)
SELECT page_id, substr(CASE WHEN regexp_matches(b, '^[0-9]') THEN 'n_' || b ELSE b END, 1, 180) AS fragment, CASE WHEN lower(stem) IN ('con', 'prn', 'aux', 'nul', '') THEN '_' || stem ELSE stem END AS stem FROM f""")
def symbol_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3, J4."""
    return table(spark, sf_dir, "pages").select("page_id", ids.symbol_fragment(F.col("url")).alias("fragment"), ids.file_stem(F.col("url")).alias("stem"))


@query(r"""
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([a-z][a-z])/', 1) AS locale,
  coalesce(TRY_CAST(nullif(regexp_extract(url, '[?&]page=([0-9]{1,9})', 1), '') AS INTEGER), 1) AS scale FROM pages""")
def locale_and_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a path."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(u, "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract(u, "^[a-z]+://([^/:?#]+)", 1).alias("host"), F.regexp_extract(u, "^[a-z]+://[^/]+/([a-z][a-z])/", 1).alias("locale"),
        F.coalesce(F.regexp_extract(u, "[?&]page=([0-9]{1,9})", 1).try_cast("int"), F.lit(1)).alias("scale"),
    )


@query(r"""
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM conversations),
m AS (SELECT conv_id, turn, line_no, unnest(regexp_extract_all(line, '\b(the|of|and) ([a-z]+)', 2)) AS guard, generate_subscripts(regexp_extract_all(line, '\b(the|of|and) ([a-z]+)', 2), 1) AS o FROM l)
SELECT conv_id, turn, line_no, (o - 1)::BIGINT AS ordinal, guard FROM m""")
def branch_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered matches of numbered lines."""
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("k", "line")).withColumn("line_no", F.col("k").cast("long") + 1)
    found = text.matches(talk, ["conv_id", "turn", "line_no"], "line", r"\b(the|of|and) ([a-z]+)", 2)
    return found.select("conv_id", "turn", "line_no", F.col("ordinal").cast("long").alias("ordinal"), F.col("match").alias("guard"))


@query("""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS c FROM documents) SELECT doc_id, count(*) AS n, count(DISTINCT c) AS n_distinct, min(c) AS least FROM m GROUP BY doc_id""")
def constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a text."""
    found = text.matches(table(spark, sf_dir, "documents"), ["doc_id"], "text", "[0-9]+")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("match").alias("n_distinct"), F.min("match").alias("least"))


@query(r"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) SELECT page_id, tag, count(*) AS n FROM t GROUP BY ALL""")
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """element names of a page, counted; a tag expression, no tree."""
    return text.matches(table(spark, sf_dir, "pages"), ["page_id"], "html", "<([a-z][a-z0-9]*)", 1).groupBy("page_id", F.col("match").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) SELECT page_id, count(*) AS n_links, array_to_string(list_sort(list(DISTINCT link)), ' ') AS links FROM t GROUP BY page_id""")
def page_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute values of a page, as a set."""
    found = text.matches(table(spark, sf_dir, "pages"), ["page_id"], "html", 'href="([^"]*)"', 1)
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), joined_set(F.col("match"), " ").alias("links"))


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 200) || '...' || substr(sha256(text), 1, 12) END AS short FROM documents")
def bounded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8, J30; the bound is the feature, the digest covers the whole text."""
    return table(spark, sf_dir, "documents").select("doc_id", text.bounded(F.col("text"), 200).alias("short"))


@query("SELECT doc_id, strlen(text)::BIGINT AS size, sha256(text) AS sha256 FROM documents")
def source_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, J26."""
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))


@query(r"""
SELECT event_id, CASE WHEN event_type = 'purchase' AND value > 50 THEN 'message_super' WHEN event_type = 'purchase' THEN 'message' WHEN event_type IN ('click', 'view') THEN 'reference' ELSE 'other' END AS family,
  event_type IN ('purchase', 'click') AS resolved, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'external' END AS unresolved_reason FROM events""")
def runtime_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules as one CASE over event types; the rules themselves are in ``plans.rules``."""
    t = F.col("event_type")
    family = F.when((t == "purchase") & (F.col("value") > 50), "message_super").when(t == "purchase", "message").when(t.isin("click", "view"), "reference").otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", family.alias("family"), t.isin("purchase", "click").alias("resolved"), F.when(t == "error", "failed").when(t == "signup", "external").alias("unresolved_reason"))


@query("SELECT p_partkey, (p_size >> 3)::VARCHAR || '.' || ((p_size >> 1) & 3)::VARCHAR || '.' || (p_size & 1)::VARCHAR AS version, regexp_matches(p_name, '^new([^a-z]|$)') AS new_family, upper(p_brand) || '/' || replace(p_type, ' ', '_') AS path FROM part")
def scalar_decodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits, prefixes and safe text; J21 in the packing of a part's size."""
    s = F.col("p_size")
    version = F.concat_ws(".", F.shiftright(s, 3).cast("string"), F.shiftright(s, 1).bitwiseAND(F.lit(3)).cast("string"), s.bitwiseAND(F.lit(1)).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", version.alias("version"), text.is_new_family(F.col("p_name")).alias("new_family"), F.concat(F.upper("p_brand"), F.lit("/"), F.replace("p_type", F.lit(" "), F.lit("_"))).alias("path"))


@query()
def argument_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level parts of nested property texts; brackets do not form a regular language, hence an Arrow function."""
    made = F.concat(F.lit("f("), F.col("props"), F.lit(", "), F.col("event_type"), F.lit(")"))
    found = table(spark, sf_dir, "events").select("event_id", F.explode(text.calls(made)).alias("call"))
    return found.select("event_id", F.col("call.name").alias("name"), F.size("call.arguments").cast("long").alias("n_arguments"), F.col("call.arguments")[0].alias("first"))


@query()
def packet_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's lines in packets of at most 32 rows and 600 units, in order."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("quantity"))
    return next_fit(rows, "l_suppkey", ["l_orderkey", "l_linenumber", "quantity"], "quantity", 32, 600)
