"""Decoding queries: names, encodings and values that small grammars take apart, held against tables of known answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import grammar, ids, native, text
from quarryline.plans.registry import Query, registrar
from quarryline.plans.rules import _sql, picked
from quarryline.sources import bundles, executables, sinks
from quarryline.sources.files import asset_category, resolve_link
from quarryline.tables import table

QUERIES: dict[str, Query] = {}
query = registrar(QUERIES)

ENCODINGS = ["v12@0:4@8", "@\"NSString\"8@0:4", "{CGRect=ff}16@0:4", "^{Node}8@0:4", "B8@0:4", "[4i]8", "z9", "@?8@0:4", "b3"]


@query(f"""
WITH e(encoding, types) AS (VALUES ('v12@0:4@8', 'void|id|SEL|id'), ('@"NSString"8@0:4', 'NSString|id|SEL'), ('{{CGRect=ff}}16@0:4', 'struct CGRect|id|SEL'), ('^{{Node}}8@0:4', 'struct Node *|id|SEL'), ('B8@0:4', 'bool|id|SEL'),
  ('[4i]8', 'int[4]'), ('@?8@0:4', 'block|id|SEL'), ('b3', 'bits:3'))
SELECT p_partkey, types FROM part LEFT JOIN e ON encoding = {_sql(ENCODINGS, "p_partkey")}""")
def method_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16."""
    rows = table(spark, sf_dir, "part").select("p_partkey", picked(ENCODINGS, F.col("p_partkey")).alias("encoding"))
    return rows.select("p_partkey", F.array_join(grammar.encoding_types(F.col("encoding")), "|").alias("types"))


HEADS = ["int f(int a, char *b)", "void g(void)", "struct Node * make(const char *name, int (*f)(int, int))", "no head here", "long h(unsigned int x, double y[3])"]


@query(f"""
WITH h(head, name, result, parameters) AS (VALUES ('int f(int a, char *b)', 'f', 'int', 'int a|char * b'), ('void g(void)', 'g', 'void', ''), ('struct Node * make(const char *name, int (*f)(int, int))', 'make', 'struct Node *', 'const char * name|int (*f)(int, int)'),
  ('long h(unsigned int x, double y[3])', 'h', 'long', 'unsigned int x|double[3] y'))
SELECT p_partkey, name, result, parameters FROM part LEFT JOIN h ON head = {_sql(HEADS, "p_partkey")}""")
def function_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9."""
    rows = table(spark, sf_dir, "part").select("p_partkey", grammar.heads(picked(HEADS, F.col("p_partkey"))).alias("h"))
    shown = F.array_join(F.transform("h.parameters", lambda p: F.concat_ws(" ", p["type"], p["name"])), "|")
    return rows.select("p_partkey", "h.name", "h.result", shown.alias("parameters"))


BODIES = ["{\n int a;\n char *b = x;\n a = 1;\n int late;\n}", "{\n return 3;\n}", "{\n unsigned int n[4];\n\n if (n) {\n}"]


@query(f"""
WITH b(i, declared) AS (VALUES (0, 'int a|char * b'), (1, ''), (2, 'unsigned int[4] n')) SELECT p_partkey, declared FROM part JOIN b ON i = p_partkey % {len(BODIES)}""")
def local_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations up to the first other statement."""
    rows = table(spark, sf_dir, "part").select("p_partkey", grammar.local_declarations(picked(BODIES, F.col("p_partkey"))).alias("d"))
    return rows.select("p_partkey", F.array_join(F.transform("d", lambda p: F.concat_ws(" ", p["type"], p["name"])), "|").alias("declared"))


STATEMENTS = ["x = f(1);\n *p = y;", "if (a == b) {}", "total = a + b;\nname = \"q\";"]


@query(f"""
WITH s(i, target, value) AS (VALUES (0, 'x', 'f(1)'), (0, 'p', 'y'), (2, 'total', 'a + b'), (2, 'name', '"q"')) SELECT p_partkey, target, value FROM part JOIN s ON i = p_partkey % {len(STATEMENTS)}""")
def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode_outer(grammar.assignments(picked(STATEMENTS, F.col("p_partkey")))).alias("a")).where("a is not null")
    return rows.select("p_partkey", "a.target", "a.value")


NAMES = ["4Node", "N3foo3barE", "3ab", "main", "5Trees"]


@query(f"WITH n(name, parts) AS (VALUES ('4Node', 'Node'), ('N3foo3barE', 'foo|bar'), ('5Trees', 'Trees')) SELECT p_partkey, parts FROM part LEFT JOIN n ON name = {_sql(NAMES, 'p_partkey')}")
def prefixed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J18."""
    rows = table(spark, sf_dir, "part").select("p_partkey", picked(NAMES, F.col("p_partkey")).alias("name"))
    return rows.select("p_partkey", F.array_join(grammar.names_of(F.col("name")), "|").alias("parts"))


CASTS = ["(char *)x", "(int)(unsigned long) y + 1", "z", "(const struct Node *)f(a)"]


@query(f"WITH c(e, bare) AS (VALUES ('(char *)x', 'x'), ('(int)(unsigned long) y + 1', 'y + 1'), ('z', 'z'), ('(const struct Node *)f(a)', 'f(a)')) SELECT p_partkey, bare FROM part JOIN c ON e = {_sql(CASTS, 'p_partkey')}")
def stripped_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8."""
    return table(spark, sf_dir, "part").select("p_partkey", text.strip_casts(picked(CASTS, F.col("p_partkey"))).alias("bare"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey >> 16) || '.' || ((l_partkey >> 8) & 255) || '.' || (l_partkey & 255) AS version FROM lineitem""")
def packed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J21."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.version_of(F.col("l_partkey").cast("int")).alias("version"))


CALLS = ["f(a, g(b, c), \"x, y\")", "h()", "k((1, 2), [3, 4])", "open(a, b"]


@query(f"""
WITH c(i, name, n, first) AS (VALUES (0, 'f', 3, 'a'), (0, 'g', 2, 'b'), (1, 'h', 0, NULL), (2, 'k', 2, '(1, 2)')) SELECT p_partkey, name, n::BIGINT AS n_arguments, first FROM part JOIN c ON i = p_partkey % {len(CALLS)}""")
def nested_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls within calls, with their top-level arguments."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode_outer(text.calls(picked(CALLS, F.col("p_partkey")))).alias("c")).where("c is not null")
    return rows.select("p_partkey", "c.name", F.size("c.arguments").cast("long").alias("n_arguments"), F.get("c.arguments", F.lit(0)).alias("first"))


FILES = ["a/b.PNG", "x.strings", "Main.storyboard", "noext", "y.tar.gz", "s.caf", "f.ttf", "z.plist"]


@query(f"""
WITH f(path, category) AS (VALUES ('a/b.PNG', 'image'), ('x.strings', 'localization'), ('Main.storyboard', 'interface'), ('noext', 'other'), ('y.tar.gz', 'other'), ('s.caf', 'audio'), ('f.ttf', 'font'), ('z.plist', 'property_list'))
SELECT p_partkey, category FROM part JOIN f ON path = {_sql(FILES, "p_partkey")}""")
def asset_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8."""
    return table(spark, sf_dir, "part").select("p_partkey", asset_category(picked(FILES, F.col("p_partkey"))).alias("category"))


LINKS = ["../b/c", "x", "/abs", "../../..", "./y/../z"]


@query(f"WITH l(target, resolved) AS (VALUES ('../b/c', 'b/c'), ('x', 'a/x'), ('./y/../z', 'a/z')) SELECT p_partkey, resolved FROM part LEFT JOIN l ON target = {_sql(LINKS, 'p_partkey')}")
def link_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: one step of a link from a/link."""
    return table(spark, sf_dir, "part").select("p_partkey", resolve_link(F.lit("a/link"), picked(LINKS, F.col("p_partkey"))).alias("resolved"))


@query("""
SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'launch_storyboard=' || p_brand || '|main_nib=' || p_type WHEN 1 THEN 'main_storyboard=' || p_brand ELSE '' END AS points FROM part""")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a property list's scalars name as entry points."""
    kind = F.col("p_size") % 3
    none = F.create_map(F.lit("CFBundleName"), F.lit("x"))
    lists = F.when(kind == 0, F.create_map(F.lit("UILaunchStoryboardName"), "p_brand", F.lit("NSMainNibFile~ipad"), "p_type")).when(kind == 1, F.create_map(F.lit("UIMainStoryboardFile"), "p_brand", F.lit("UIMainStoryboardFile~ipad"), "p_brand")).otherwise(none)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(bundles.entry_points(lists), lambda r: F.concat_ws("=", r["kind"], r["name"])), "|").alias("points"))


@query("""
SELECT a.l_partkey AS address, CASE WHEN a.l_partkey % 1000 < 600 AND a.l_partkey < 3000 THEN a.l_partkey % 1000 + 64 * (a.l_partkey // 1000) ELSE NULL END AS "offset" FROM (SELECT DISTINCT l_partkey FROM lineitem) a""")
def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as addresses in three segments of 1000 bytes, of which 600 are in the file."""
    columns = ("'f' as path", "0 as slice")
    segments = spark.range(3).selectExpr(*columns, "'segment' as kind", "id * 1000 as vm_start", "cast(1000 as long) as vm_size", "id * 64 as file_offset", "cast(600 as long) as file_size")
    asked = table(spark, sf_dir, "lineitem").select("l_partkey").distinct().selectExpr(*columns, "l_partkey as address")
    return executables.file_offset(asked, segments).select("address", "offset")


@query("""
SELECT c_custkey, replace(replace(replace(c_name || '=%', '%', '%25'), chr(10), '%0A'), '=', '%3D') || '=' || replace(replace(c_mktsegment || chr(10) || '=', chr(10), '%0A'), '=', '%3D') AS line FROM customer""")
def state_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and values with marks that a state file escapes."""
    return table(spark, sf_dir, "customer").select("c_custkey", sinks.state_line(F.concat("c_name", F.lit("=%")), F.concat("c_mktsegment", F.lit("\n="))).alias("line"))


@query("""
SELECT p_partkey, replace(replace(p_name || ' | ' || p_type || chr(10) || '*/', chr(10), ' '), '*/', '* /') AS comment, replace(replace(replace(p_name || ' | ' || p_type || chr(10) || '*/', chr(10), ' '), '*/', '* /'), '|', chr(92) || '|') AS cell FROM part""")
def safe_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text as it can stand in a comment and in a table."""
    raw = F.concat("p_name", F.lit(" | "), "p_type", F.lit("\n*/"))
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.regexp_replace(raw, r"[\r\n]+", " "), r"\*/", "* /").alias("comment"), sinks.cell(raw).alias("cell"))


@query("""
SELECT o_orderkey, 'order:' || substr(sha256('order' || chr(0) || o_orderkey || chr(0) || o_custkey), 1, 20) AS id FROM orders""")
def composite_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of two numbers."""
    return table(spark, sf_dir, "orders").select("o_orderkey", ids.stable_id("order", F.col("o_orderkey"), F.col("o_custkey")).alias("id"))


CODE = ["  *(int *)(p + 0x10) = *(char *)((int)q - 4);", "x = p->field0_0x0[3] + p->field_0x1c;", "return p->field0_0x8 == 1;", "(**(code **)(*(int *)r + 8))(r); (**(code **)*s)(s);", "(**(code **)(r + 6))();", "plain;"]
_ACCESSED = """a(i, ordinal, form, base, "offset", width, type, access) AS (VALUES (0, 0, 'pointer', 'p', 16, 4, 'int', 'write'), (0, 1, 'pointer', 'q', -4, 1, 'char', 'read'), (1, 0, 'array', 'p', 12, 4, NULL, 'read'), (1, 1, 'member', 'p', 28, NULL, NULL, 'read'),
  (2, 0, 'member', 'p', 8, NULL, NULL, 'write')), r AS (SELECT p_partkey AS function, ordinal, form, base, "offset"::BIGINT AS "offset", width, type, access FROM part JOIN a ON i = p_partkey % 6)"""


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("function"), picked(CODE, F.col("p_partkey")).alias("text"))


@query(f"""WITH {_ACCESSED} SELECT * FROM r""")
def field_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An equal sign anywhere in the line decides, as in a comparison."""
    return native.field_accesses(code(spark, sf_dir), 4).drop("line_no")


@query("""
WITH c(i, ordinal, form, receiver, slot) AS (VALUES (3, 0, 'byte_offset', 'r', 2), (3, 1, 'zero_offset', 's', 0), (1, 0, 'array_index', 'p', 3)) SELECT p_partkey AS function, ordinal, form, receiver, slot::BIGINT AS slot FROM part JOIN c ON i = p_partkey % 6""")
def virtual_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A byte place that is no slot is no call."""
    return native.virtual_calls(code(spark, sf_dir), 4).drop("line_no")


@query(f"""
WITH {_ACCESSED}, k AS (SELECT r.*, p_size % 3 = 0 AND base = 'p' AS sure, CASE WHEN p_size % 3 = 0 AND base = 'p' THEN 'class:' || p_brand ELSE 'anonymous:' || function || ':' || base END AS owner FROM r JOIN part ON p_partkey = function),
f AS (SELECT owner, sure, "offset", count(*) AS n, count(DISTINCT width) AS w, count(DISTINCT type) AS t FROM k GROUP BY ALL)
SELECT owner, "offset", n, CASE WHEN sure AND w = 1 AND t = 1 THEN 'exact' WHEN w > 0 OR t > 0 THEN 'candidate_set' ELSE 'unresolved' END AS classification,
  array_to_string(list_sort(list_filter([CASE WHEN w = 0 THEN 'no_width' END, CASE WHEN t = 0 THEN 'no_type' END, CASE WHEN NOT sure THEN 'owner_not_exact' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM f""")
def native_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of every third size have receivers of one sure class, their brand."""
    receivers = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("function"), F.lit("p").alias("base"), F.array("p_brand").alias("classes"), (F.col("p_size") % 3 == 0).alias("exact"))
    fields, _ = native.layouts(native.field_accesses(code(spark, sf_dir), 4), receivers)
    return fields.select("owner", "offset", "n", "classification", "reasons")
