"""Rule queries: columns of the driver tables stand in for names, edges and candidates; the rules are those of ``functions.rules``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import rules
from quarryline.operators.aggs import joined_set
from quarryline.plans.registry import Query, registrar
from quarryline.tables import table

QUERIES: dict[str, Query] = {}
query = registrar(QUERIES)


def picked(values: list[str | None], place: Column) -> Column:
    """One of some values, by a number modulo their count."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (place % len(values) + 1).cast("int"))


def _sql(values: list[str | None], place: str) -> str:
    """The same in SQL."""
    quoted = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[{place} % {len(values)} + 1]"


SYMBOLS = ["_objc_msgSend", "_objc_msgSendSuper2", "objc_msgSend_stret", "_objc_msgSendSuper_stret", "objc_msgLookup", "_objc_msgLookupSuper2", "objc_msgSend_fpret", "_printf", "objc_msgSendSuper2_stret", "objc_msgSendSuper", None]


@query(f"""
WITH v(name, variant, is_super, structure_return, floating_return) AS (VALUES ('_objc_msgSend', 'objc_msgSend', false, false, false), ('_objc_msgSendSuper2', 'objc_msgSendSuper2', true, false, false),
  ('objc_msgSend_stret', 'objc_msgSend_stret', false, true, false), ('_objc_msgSendSuper_stret', 'objc_msgSendSuper_stret', true, true, false), ('objc_msgLookup', 'objc_msgLookup', false, false, false),
  ('_objc_msgLookupSuper2', 'objc_msgLookupSuper', true, false, false), ('objc_msgSend_fpret', 'objc_msgSend_fpret', false, false, true), ('objc_msgSendSuper2_stret', 'objc_msgSendSuper2_stret', true, true, false),
  ('objc_msgSendSuper', 'objc_msgSendSuper', true, false, false)),
p AS (SELECT p_partkey, {_sql(SYMBOLS, "p_partkey")} AS target, {_sql(SYMBOLS, "p_size")} AS thunk FROM part)
SELECT p_partkey, v.variant, v.is_super, v.structure_return, v.floating_return FROM p LEFT JOIN v a ON a.name = target JOIN v ON v.name = coalesce(a.name, thunk)""")
def runtime_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the message runtime by target, else by thunk, with the variant that the name tells."""
    calls = table(spark, sf_dir, "part").select("p_partkey", rules.runtime_variant(picked(SYMBOLS, F.col("p_partkey")), picked(SYMBOLS, F.col("p_size"))).alias("v"))
    return calls.where("v is not null").select("p_partkey", "v.*")


@query("""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, s.s_suppkey IS NOT NULL AS known, s.s_suppkey IS NOT NULL AND l_linenumber % 4 <> 0 AND l_returnflag <> 'R' AS semantic,
  CASE WHEN l_linenumber % 4 = 0 THEN 'dynamic_dispatch' WHEN s.s_suppkey IS NOT NULL THEN NULL WHEN l_returnflag = 'R' THEN 'indirect' ELSE 'unknown_function' END AS reason
FROM lineitem l LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 1000) s ON s.s_suppkey = l.l_suppkey""")
def edge_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as calls of suppliers, of which those with a balance are known functions."""
    known = table(spark, sf_dir, "supplier").where("s_acctbal > 1000").select(F.col("s_suppkey").alias("function"))
    met = table(spark, sf_dir, "lineitem").join(known, F.col("l_suppkey") == F.col("function"), "left").withColumn("known", F.col("function").isNotNull())
    state = rules.edge_state(F.col("l_linenumber") % 4 == 0, F.col("l_returnflag") == "R", F.col("known"))
    return met.select("l_orderkey", "l_linenumber", "l_partkey", "known", state.alias("s")).select("l_orderkey", "l_linenumber", "l_partkey", "known", "s.*")


@query("""
SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 'objective_c_method' WHEN c_mktsegment = 'BUILDING' THEN 'external_function' WHEN c_acctbal < 0 THEN 'thunk'
  ELSE 'native_internal_function' END AS kind FROM customer""")
def function_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7."""
    methods = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("owner")).distinct()
    met = table(spark, sf_dir, "customer").join(methods, F.col("c_custkey") == F.col("owner"), "left")
    return met.select("c_custkey", rules.function_class(F.col("owner").isNotNull(), F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") < 0).alias("kind"))


FIELDS = ["view.backgroundImage", "a.title[0]", "root.Label.text", "x[2].fontName", "style.tintColor", "prompt", "frame.width", "button.image-Name", "b.attributedTitle", "hint.Placeholder"]


@query(f"""
WITH r(path, role) AS (VALUES ('view.backgroundImage', 'image'), ('root.Label.text', 'text'), ('x[2].fontName', 'font'), ('style.tintColor', 'color'), ('prompt', 'text'), ('b.attributedTitle', 'text'), ('hint.Placeholder', 'text'))
SELECT p_partkey, role FROM part LEFT JOIN r ON path = {_sql(FIELDS, "p_partkey")}""")
def field_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C13."""
    return table(spark, sf_dir, "part").select("p_partkey", rules.field_role(picked(FIELDS, F.col("p_partkey"))).alias("role"))


EFFECTS = ["state_read", "navigation", "ui_update", "persistence_write", "network_request", "timer_schedule", "platform_api", "unknown_effect"]
_CATEGORIES = "list_filter([CASE WHEN l_linenumber % 3 = 0 THEN 'networking' END, CASE WHEN l_quantity > 25 THEN 'persistence' END], lambda x: x IS NOT NULL)"


@query(f"""
WITH k(effect, item) AS (VALUES ('state_read', 'state'), ('navigation', 'navigation'), ('ui_update', 'component'), ('persistence_write', 'persistence'), ('persistence_access', 'persistence'), ('network_request', 'networking'),
  ('timer_schedule', 'platform_dependency'), ('platform_api', 'platform_dependency')),
c AS (SELECT p_partkey, {_sql(EFFECTS, "p_size")} AS found FROM part WHERE p_size > 30),
e AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN found IS NOT NULL THEN found WHEN l_linenumber % 3 = 0 THEN 'network_request' WHEN l_quantity > 25 THEN 'persistence_access' WHEN l_returnflag IN ('A', 'R') THEN 'platform_api' END AS effect
  FROM lineitem LEFT JOIN c ON p_partkey = l_partkey)
SELECT l_orderkey, l_linenumber, l_partkey, e.effect, item FROM e LEFT JOIN k ON k.effect = e.effect WHERE e.effect IS NOT NULL""")
def effect_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of large parts first, then categories, then the status; rows without any of them go."""
    catalogue = table(spark, sf_dir, "part").where("p_size > 30").select("p_partkey", picked(EFFECTS, F.col("p_size")).alias("found"))
    met = table(spark, sf_dir, "lineitem").join(catalogue, F.col("l_partkey") == F.col("p_partkey"), "left")
    categories = F.array_compact(F.array(F.when(F.col("l_linenumber") % 3 == 0, "networking"), F.when(F.col("l_quantity") > 25, "persistence")))
    status = F.when(F.col("l_returnflag") == "A", "external_exact").when(F.col("l_returnflag") == "R", "external_candidate").otherwise("unresolved")
    effects = met.select("l_orderkey", "l_linenumber", "l_partkey", rules.effect_kind(F.col("found"), categories, status).alias("effect")).where("effect is not null")
    return effects.withColumn("item", rules.item_kind(F.col("effect")))


IMPORTS = ["_OBJC_CLASS_$_Widget", "_OBJC_METACLASS_$_Widget", "_OBJC_PROTOCOL_$_Thing", "_memcpy", "OBJC_CLASS_$_Not", "_OBJC_CLASS_$_"]
THUNKS = ["<EXTERNAL>::_objc_retain", "plain", None, "<EXTERNAL>::"]


@query(f"""
WITH k(symbol, kind, class_name) AS (VALUES ('_OBJC_CLASS_$_Widget', 'objective_c_class', 'Widget'), ('_OBJC_METACLASS_$_Widget', 'objective_c_metaclass', 'Widget'), ('_OBJC_PROTOCOL_$_Thing', 'objective_c_protocol', NULL),
  ('_memcpy', 'unknown', NULL), ('OBJC_CLASS_$_Not', 'unknown', NULL), ('_OBJC_CLASS_$_', 'objective_c_class', '')), t(thunk, external) AS (VALUES ('<EXTERNAL>::_objc_retain', '_objc_retain'), ('<EXTERNAL>::', ''))
SELECT p_partkey, kind, class_name, external FROM part JOIN k ON symbol = {_sql(IMPORTS, "p_partkey")} LEFT JOIN t ON thunk = {_sql(THUNKS, "p_size")}""")
def import_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17, O18."""
    found = table(spark, sf_dir, "part").select("p_partkey", rules.import_kind(picked(IMPORTS, F.col("p_partkey"))).alias("k"), rules.external_symbol(picked(THUNKS, F.col("p_size"))).alias("external"))
    return found.select("p_partkey", "k.*", "external")


@query("""
WITH s AS (SELECT o_custkey, count(*) AS n, bool_and(o_orderstatus = 'F') AS sure FROM orders WHERE o_totalprice > 250000 GROUP BY o_custkey)
SELECT c_custkey, coalesce(n, 0) AS n_screens, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 AND sure THEN 'exact' ELSE 'candidate_set' END AS classification FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def screen_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large orders as screens of a customer."""
    screens = table(spark, sf_dir, "orders").where("o_totalprice > 250000").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("o_orderstatus") == "F").alias("sure"))
    met = table(spark, sf_dir, "customer").join(screens, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("n_screens", F.coalesce("n", F.lit(0)))
    return met.select("c_custkey", "n_screens", rules.screen_class(F.col("n_screens"), F.coalesce("sure", F.lit(False))).alias("classification"))


@query("""
WITH c AS (SELECT l_orderkey, count(DISTINCT l_suppkey) FILTER (l_returnflag = 'A') AS e, count(DISTINCT l_suppkey) FILTER (l_returnflag = 'N') AS n, bool_or(l_linenumber = 1) AS proven FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN e > 0 THEN CASE WHEN e = 1 AND proven THEN 'external_exact' ELSE 'external_candidate' END WHEN n > 0 THEN 'application_local' ELSE 'unresolved' END AS status,
  CASE WHEN e > 0 THEN CASE WHEN e = 1 AND proven THEN 'exact' ELSE 'candidate_set' END WHEN n > 0 THEN 'exact' ELSE 'unresolved' END AS classification FROM c""")
def platform_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K13."""
    of = lambda flag: F.count_distinct(F.when(F.col("l_returnflag") == flag, F.col("l_suppkey")))
    sites = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(of("A").alias("e"), of("N").alias("n"), F.bool_or(F.col("l_linenumber") == 1).alias("proven"))
    return sites.select("l_orderkey", rules.platform_status(F.col("e"), F.col("proven"), F.col("n")).alias("s")).select("l_orderkey", "s.*")


@query("""
WITH a AS (SELECT l_orderkey, count(DISTINCT l_suppkey) FILTER (l_quantity > 10) AS n, coalesce(bool_or(l_returnflag = 'R') FILTER (l_quantity > 10), false) AS h, min(l_linenumber % 3 + 1) FILTER (l_quantity > 10) AS c FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN n = 0 THEN 'unresolved' WHEN n = 1 AND NOT h THEN 'exact' ELSE 'candidate_set' END AS type_class, CASE WHEN n = 0 THEN 'unresolved' WHEN n = 1 AND NOT h AND c = 3 THEN 'exact' ELSE 'candidate_set' END AS native_class FROM a""")
def value_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that reach a value, some of them by hypothesis, with the weakest confidence."""
    reached = lambda c: F.when(F.col("l_quantity") > 10, c)
    values = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count_distinct(reached(F.col("l_suppkey"))).alias("n"), F.coalesce(F.bool_or(reached(F.col("l_returnflag") == "R")), F.lit(False)).alias("h"), F.min(reached(F.col("l_linenumber") % 3 + 1)).alias("c")
    )
    return values.select("l_orderkey", rules.type_class(F.col("n"), F.col("h")).alias("type_class"), rules.native_class(F.col("n"), F.col("h"), F.coalesce("c", F.lit(0))).alias("native_class"))


TYPES = ["const char *", "unsigned int", "struct Node **", "long", "SEL", "id", "Class", "code", "void", "undefined4", "MyType", "  volatile  double ", "unknown", "code *", "bool"]


@query(f"""
WITH t(text, kind, name, depth, width) AS (VALUES ('const char *', 'native_pointer', 'char *', 1, 4), ('unsigned int', 'scalar', 'unsigned int', 0, 4), ('struct Node **', 'native_pointer', 'Node **', 2, 4), ('long', 'scalar', 'long', 0, 4),
  ('SEL', 'selector', 'SEL', 0, 4), ('id', 'objective_c_id', 'id', 1, 4), ('Class', 'objective_c_class_object', 'Class', 1, 4), ('code', 'function_pointer', 'code *', 1, 4), ('undefined4', 'scalar', 'undefined4', 0, 4),
  ('MyType', 'named_native_type', 'MyType', 0, NULL), ('  volatile  double ', 'scalar', 'double', 0, 8), ('code *', 'function_pointer', 'code *', 1, 4), ('bool', 'scalar', 'bool', 0, 1))
SELECT p_partkey, kind, name, depth, width FROM part LEFT JOIN t ON text = {_sql(TYPES, "p_partkey")}""")
def native_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17."""
    return table(spark, sf_dir, "part").select("p_partkey", rules.native_type(picked(TYPES, F.col("p_partkey")), 4).alias("t")).select("p_partkey", "t.*")


LINES = ["self->count = 3;", "if (self->count == 3) {", "x = self->count;", "self->count <= 4", "return 0;", "y != self->count; self->z = 1"]


@query(f"""
WITH l(line, access) AS (VALUES ('self->count = 3;', 'write'), ('if (self->count == 3) {{', 'read'), ('x = self->count;', 'read'), ('self->count <= 4', 'read'), ('y != self->count; self->z = 1', 'write'))
SELECT p_partkey, access FROM part LEFT JOIN l ON line = {_sql(LINES, "p_partkey")}""")
def member_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15."""
    return table(spark, sf_dir, "part").select("p_partkey", rules.access_kind(picked(LINES, F.col("p_partkey")), F.lit("self->count")).alias("access"))


ARGUMENTS = ['"plain"', '"a\\tb"', ' "q\\"x\\\\" ', '"\\u00e9\\x41"', "12.5", " -3 ", "name", '"open', '""']


@query("""
WITH a(place, text, number) AS (VALUES (0, 'plain', NULL), (1, 'a' || chr(9) || 'b', NULL), (2, 'q"x' || chr(92), NULL), (3, 'éA', NULL), (4, NULL, '12.5'), (5, NULL, '-3'), (8, '', NULL))
SELECT p_partkey, text, number FROM part LEFT JOIN a ON place = p_size - 3""")
def argument_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The argument that stands three places before a part's size."""
    listed = F.array(*map(F.lit, ARGUMENTS))
    return table(spark, sf_dir, "part").select("p_partkey", rules.argument_at(listed, F.col("p_size") - 3).alias("a")).select("p_partkey", "a.*")


EXPRESSIONS = ["(char *)node", "&node", "node + 1", "other->node", "node + left", "(int)(left)", "none", "* & left"]


@query(f"""
WITH e(expression, variable) AS (VALUES ('(char *)node', 'node'), ('&node', 'node'), ('node + 1', 'node'), ('other->node', 'node'), ('(int)(left)', 'left'), ('* & left', 'left'))
SELECT p_partkey, variable FROM part LEFT JOIN e ON expression = {_sql(EXPRESSIONS, "p_partkey")}""")
def expression_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known are node and left."""
    return table(spark, sf_dir, "part").select("p_partkey", rules.variable_of(picked(EXPRESSIONS, F.col("p_partkey")), F.array(F.lit("node"), F.lit("left"))).alias("variable"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber::DOUBLE AS x, -2.5::DOUBLE AS y, (l_suppkey % 50)::DOUBLE AS width, 1000.0::DOUBLE AS height FROM lineitem WHERE l_linenumber < 5
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, NULL, NULL, NULL, NULL FROM lineitem WHERE l_linenumber >= 5""")
def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """{{x, y}, {width, height}} as text; a row with three numbers, or one out of range, has none."""
    whole = F.concat(F.lit("0 {{"), F.col("l_linenumber").cast("string"), F.lit(", -2.5}, {"), (F.col("l_suppkey") % 50).cast("string"), F.lit(", 1e3}}"))
    text = F.when(F.col("l_linenumber") < 5, whole).when(F.col("l_linenumber") == 5, "{1, 2, 3}").otherwise("1 2 3 4e12")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rules.rectangle(text).alias("r")).select("l_orderkey", "l_linenumber", "l_partkey", "r.x", "r.y", "r.width", "r.height")


ADDRESSES = ["0x00FF", "0x1000", "zeta", None, "0x0a", "alpha", "0X20"]


@query(f"""
WITH a AS (SELECT p_partkey, p_size, {_sql(ADDRESSES, "p_partkey")} AS address FROM part), k(address, other, key) AS (VALUES ('0x00FF', 0, '00000000000000ff'), ('0x1000', 0, '0000000000001000'), ('zeta', 1, 'zeta'), ('0x0a', 0, '000000000000000a'),
  ('alpha', 1, 'alpha'), ('0X20', 0, '0000000000000020'))
SELECT p_partkey, address, row_number() OVER (PARTITION BY p_size ORDER BY coalesce(other, 1), coalesce(key, ''), p_partkey) AS place FROM a LEFT JOIN k USING (address)""")
def address_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: places by address within parts of one size."""
    from quarryline.operators.joins import numbered

    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", picked(ADDRESSES, F.col("p_partkey")).alias("address"))
    return numbered(parts.withColumn("key", rules.address_order(F.col("address"))), ["p_size"], ["key", "p_partkey"]).select("p_partkey", "address", F.col("place").cast("long").alias("place"))


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(name), name, c_custkey) AS place FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS name FROM customer)")
def folded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order that case decides only between equal names."""
    from quarryline.operators.joins import numbered

    name = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", name.alias("name"))
    return numbered(rows, ["c_nationkey"], [F.lower("name"), "name", "c_custkey"]).select("c_custkey", F.col("place").cast("long").alias("place"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN l_partkey & ~1 ELSE l_partkey END AS address, l_returnflag = 'A' AND l_partkey & 1 = 1 AS flagged FROM lineitem""")
def mode_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only 32-bit ARM keeps a mode in the lowest bit."""
    arch = F.when(F.col("l_returnflag") == "A", "armv7").when(F.col("l_returnflag") == "N", "arm64").otherwise("x86_64")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rules.canonical_address(F.col("l_partkey"), arch).alias("a")).select("l_orderkey", "l_linenumber", "l_partkey", "a.*")


MANGLED = ["__ZTI4Node", "__ZTV4Tree", "__ZTI", "_main", None]


@query(f"WITH m(symbol, info, vtable) AS (VALUES ('__ZTI4Node', '4Node', NULL), ('__ZTV4Tree', NULL, '4Tree')) SELECT p_partkey, info, vtable FROM part LEFT JOIN m ON symbol = {_sql(MANGLED, 'p_partkey')}")
def symbol_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type infos and vtables by their mangled symbols."""
    s = picked(MANGLED, F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", rules.encoding_of(s, "TI").alias("info"), rules.encoding_of(s, "TV").alias("vtable"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'exact' || p_brand WHEN p_size % 3 = 1 THEN p_type END AS value FROM part""")
def attribute_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key itself in any case, else the first key that holds it, else NULL."""
    size = F.col("p_size") % 3
    attributes = F.when(size == 0, F.create_map(F.lit("IMAGE"), F.concat(F.lit("exact"), "p_brand"), F.lit("aImageName"), "p_type")).when(size == 1, F.create_map(F.lit("zImage"), "p_brand", F.lit("anImageName"), "p_type")).otherwise(F.create_map(F.lit("text"), "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", rules.attribute_value(attributes, ("image",)).alias("value"))


RECEIVERS = ["&objc::class_t::Foo", "_OBJC_CLASS___Bar", "& _OBJC_CLASS_$_Baz", "self", "objc::class_t::9x", None]


@query(f"WITH r(text, class_name) AS (VALUES ('&objc::class_t::Foo', 'Foo'), ('_OBJC_CLASS___Bar', 'Bar'), ('& _OBJC_CLASS_$_Baz', 'Baz')) SELECT p_partkey, class_name FROM part LEFT JOIN r ON text = {_sql(RECEIVERS, 'p_partkey')}")
def explicit_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receivers that name a class outright."""
    return table(spark, sf_dir, "part").select("p_partkey", rules.explicit_class(picked(RECEIVERS, F.col("p_partkey"))).alias("class_name"))


@query("""
SELECT o_orderkey, 'analysis/orders.json' AS path, '/facts/' || (o_orderkey % 100) AS pointer, CASE o_orderstatus WHEN 'F' THEN 'exact' WHEN 'O' THEN 'candidate_set' ELSE 'unresolved' END AS classification, sha256(o_orderkey::VARCHAR) AS sha256 FROM orders""")
def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to records; what is no class counts as unresolved."""
    c = F.when(F.col("o_orderstatus") == "F", "exact").when(F.col("o_orderstatus") == "O", "candidate_set").otherwise(F.col("o_orderstatus"))
    key = F.col("o_orderkey").cast("string")
    link = rules.document_link(F.lit("orders"), F.concat(F.lit("/facts/"), (F.col("o_orderkey") % 100).cast("string")), key, c, F.sha2(key, 256))
    return table(spark, sf_dir, "orders").select("o_orderkey", link.alias("l")).select("o_orderkey", "l.path", "l.pointer", "l.classification", "l.sha256")


@query("""
WITH p AS (SELECT l_orderkey, l_suppkey, l_returnflag = 'A' AS ui, l_linenumber % 3 = 0 AS framework FROM lineitem), k AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)
SELECT l_orderkey, count(*) AS n, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS selectors FROM p WHERE l_suppkey % 2 = 0 AND (framework OR ui OR l_suppkey IN (SELECT s_suppkey FROM k)) GROUP BY l_orderkey""")
def interface_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites whose selector is catalogued and whose framework, category or class speaks for the interface."""
    classes = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("class_id"))
    selectors = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    sites = table(spark, sf_dir, "lineitem").join(selectors, "l_suppkey", "left_semi").join(classes, F.col("l_suppkey") == F.col("class_id"), "left")
    mine = sites.where((F.col("l_linenumber") % 3 == 0) | (F.col("l_returnflag") == "A") | F.col("class_id").isNotNull())
    return mine.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), joined_set(F.col("l_suppkey")).alias("selectors"))
