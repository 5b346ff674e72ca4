"""Registered queries of filters, joins, aggregates, ordering, names and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import qname as Q
from lodestone.functions.text import listed, percent, slug, strip
from lodestone.operators.number import numbered
from lodestone.operators import catalog, prose
from lodestone.operators.graph import in_profile
from lodestone.plans.derived import sql, tables
from lodestone.plans.prose_queries import table
from lodestone.plans.registry import register
from lodestone.sources.files import manifest_rows


@register("flt1_equality", "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#7' AND p_type = 'PROMO'")
def equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where((F.col("p_brand") == "Brand#7") & (F.col("p_type") == "PROMO")).select("p_partkey", "p_name")


@register("flt2_nulls", sql("SELECT count(*) FILTER (WHERE parent_symbol_id IS NULL) AS top_level, count(*) FILTER (WHERE parent_symbol_id IS NOT NULL) AS inline_, count(type_ref) AS typed FROM symbols", "symbols"))
def nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.col("parent_symbol_id")
    return tables(spark, sf_dir, "symbols")["symbols"].agg(F.count_if(parent.isNull()).alias("top_level"), F.count_if(parent.isNotNull()).alias("inline_"), F.count("type_ref").alias("typed"))


@register("flt6_ilike", sql("SELECT id, uri FROM namespaces WHERE uri ILIKE '%bRAND#_1%'", "namespaces"))
def ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "namespaces")["namespaces"].where(F.col("uri").ilike("%bRAND#_1%"))


@register("flt7_any_field", "SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'ring brand#2')")
def any_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(prose.matches_any([F.col("p_name"), F.col("p_brand"), F.col("p_type")], "RING Brand#2")).select("p_partkey")


@register("flt8_array_key", "SELECT p_brand, list_sort(list(DISTINCT p_type)) AS kinds FROM part WHERE p_retailprice > 950 GROUP BY 1 HAVING list_contains(list(DISTINCT p_type), 'PROMO')")
def array_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").where("p_retailprice > 950").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_type")).alias("kinds"))
    return found.where(F.array_contains("kinds", "PROMO"))


@register("flt9_one_to_many", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 7")
def one_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_nationkey = 7").select("s_suppkey", "s_name")


@register("flt10_in_subquery", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi")


@register("jn6_semi_anti", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS ordered FROM customer")
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders")
    same = F.col("c_custkey") == F.col("o_custkey")
    yes = customers.join(orders, same, "left_semi").withColumn("ordered", F.lit(True))
    return yes.union(customers.join(orders, same, "left_anti").withColumn("ordered", F.lit(False)))


@register("prj1_projection", "SELECT p_partkey AS part_key, p_name AS name, p_retailprice AS retail_price FROM part")
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("retail_price"))


@register("prj3_tags_so2_set1_union", sql("""SELECT 'element' AS entry, id, order_index, CAST(NULL AS INT) AS nested FROM child_edges
UNION ALL SELECT 'group', id, order_index, NULL FROM group_edges UNION ALL SELECT 'compositor', NULL, order_index, id FROM compositors""", "child_edges", "group_edges", "compositors"))  # fmt: skip
def tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables(spark, sf_dir, "child_edges", "group_edges", "compositors")
    tag = lambda name, *cols: g[name].select(F.lit({"child_edges": "element", "group_edges": "group", "compositors": "compositor"}[name]).alias("entry"), *cols, "order_index")
    out = tag("child_edges", "id").unionByName(tag("group_edges", "id")).unionByName(tag("compositors", F.col("id").alias("nested")), allowMissingColumns=True)
    return out.select("entry", "id", "order_index", "nested")


@register("prj4_defaults", sql("SELECT id, coalesce(type_ref, '(unknown)') AS type_ref FROM symbols", "symbols"))
def defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "symbols")["symbols"].select("id", F.coalesce("type_ref", F.lit("(unknown)")).alias("type_ref"))


@register("prj7_stage_rows", sql("SELECT part_number, section_id, title, content_type, page_number, 1 AS source_id FROM spec_content", "spec_content"))
def stage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "spec_content")["spec_content"].select("part_number", "section_id", "title", "content_type", "page_number", F.lit(1).alias("source_id"))


_CORE = ("symbols", "profiles", "namespaces", "symbol_profiles", "reference_sources")


@register("jn1_four_way", sql("SELECT s.id, n.uri, p.name AS profile, r.name AS source FROM symbols s JOIN symbol_profiles m ON m.symbol_id = s.id JOIN namespaces n ON n.id = m.namespace_id JOIN profiles p ON p.id = m.profile_id LEFT JOIN reference_sources r ON r.id = m.source_id", *_CORE))
def four_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables(spark, sf_dir, *_CORE)
    out = g["symbols"].select(F.col("id").alias("symbol_id")).join(g["symbol_profiles"].drop("id"), "symbol_id")
    for name, key, col, how in (("namespaces", "namespace_id", "uri", "inner"), ("profiles", "profile_id", "profile", "inner"), ("reference_sources", "source_id", "source", "left")):
        out = out.join(g[name].toDF(key, col), key, how)
    return out.select(F.col("symbol_id").alias("id"), "uri", "profile", "source")


@register("jn2_compound_left", sql("SELECT e.id, m.namespace_id FROM child_edges e LEFT JOIN symbol_profiles m ON m.symbol_id = e.child_symbol_id AND m.profile_id = e.profile_id + e.id % 2", "child_edges", "symbol_profiles"))
def compound_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables(spark, sf_dir, "child_edges", "symbol_profiles")
    e, m = g["child_edges"], g["symbol_profiles"].select("symbol_id", F.col("profile_id").alias("p"), "namespace_id")
    return e.join(m, (m.symbol_id == e.child_symbol_id) & (m.p == e.profile_id + e.id % 2), "left").select(e.id, "namespace_id")


@register("jn3_edges_by_profile", sql("SELECT s.kind, e.relation, count(*) AS n FROM inheritance_edges e JOIN symbols s ON s.id = e.symbol_id JOIN profiles p ON p.id = e.profile_id WHERE p.name = 'transitional' GROUP BY 1, 2", "inheritance_edges", "symbols", "profiles"))
def edges_by_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables(spark, sf_dir, "inheritance_edges", "symbols", "profiles")
    kinds = g["symbols"].select(F.col("id").alias("symbol_id"), "kind")
    return in_profile(g, "inheritance_edges", "transitional").join(kinds, "symbol_id").groupBy("kind", "relation").agg(F.count("*").alias("n"))


@register("jn4_self_join", sql("SELECT s.id, p.local_name AS owner FROM symbols s JOIN symbols p ON p.id = s.parent_symbol_id", "symbols"))
def self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables(spark, sf_dir, "symbols")["symbols"]
    owners = s.select(F.col("id").alias("owner_id"), F.col("local_name").alias("owner"))
    return s.join(owners, F.col("parent_symbol_id") == F.col("owner_id")).select("id", "owner")


@register("jn7_priority_lookup", sql("SELECT local_name, id, kind FROM (SELECT *, row_number() OVER (PARTITION BY local_name ORDER BY CASE kind WHEN 'complexType' THEN 1 WHEN 'simpleType' THEN 2 WHEN 'element' THEN 3 WHEN 'group' THEN 4 WHEN 'attributeGroup' THEN 5 ELSE 6 END, id) AS rn FROM symbols) WHERE rn = 1", "symbols"))
def priority_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, ("complexType", "simpleType", "element", "group", "attributeGroup", "attribute"))), F.col("kind"))
    by = Window.partitionBy("local_name").orderBy(rank, "id")
    s = tables(spark, sf_dir, "symbols")["symbols"]
    return s.withColumn("rn", F.row_number().over(by)).where("rn = 1").select("local_name", "id", "kind")


@register("jn9_declaration_defaults", sql("SELECT a.id, coalesce(a.default_value, g.default_value) AS default_value, g.attr_use AS declared_use, a.attr_use FROM attr_edges a LEFT JOIN (SELECT local_name, min_by(default_value, id) AS default_value, min_by(attr_use, id) AS attr_use FROM attr_edges WHERE default_value IS NOT NULL GROUP BY 1) g ON g.local_name = a.local_name", "attr_edges"))
def declaration_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = tables(spark, sf_dir, "attr_edges")["attr_edges"]
    g = a.where("default_value IS NOT NULL").groupBy("local_name").agg(F.min_by("default_value", "id").alias("d"), F.min_by("attr_use", "id").alias("declared_use"))
    return a.join(g, "local_name", "left").select("id", F.coalesce("default_value", "d").alias("default_value"), "declared_use", "attr_use")


@register("jn12_dimension_default", "SELECT s_suppkey, CASE WHEN s_nationkey < 10 THEN 'NATION_' || s_nationkey ELSE 'Part ' || s_nationkey END AS label FROM supplier")
def dimension_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, sf_dir, "supplier").join(names, "s_nationkey", "left").select("s_suppkey", F.coalesce("n_name", F.concat(F.lit("Part "), F.col("s_nationkey").cast("string"))).alias("label"))


@register("ag9_group_lists", "SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def group_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(pairs, lambda x: x["n_name"]).alias("names"))


@register("ag10_bucket_index", "SELECT p_type, list(p_partkey ORDER BY p_partkey) AS parts FROM part GROUP BY 1")
def bucket_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.sort_array(F.collect_list("p_partkey")).alias("parts"))


@register("ag8_table_counts", "SELECT 'part' AS counter, count(*) AS n FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'orders', count(*) FROM orders")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t: table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("counter"), "n")
    return one("part").union(one("supplier")).union(one("orders"))


@register("ds2_first_occurrence", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("p_name").orderBy("p_partkey")
    return table(spark, sf_dir, "part").withColumn("rn", F.row_number().over(by)).where("rn = 1").select("p_name", "p_partkey")


@register("ds3_first_declaration", sql("SELECT vocabulary_id, local_name, kind, min(id) AS id FROM symbols GROUP BY 1, 2, 3", "symbols"))
def first_declaration(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("vocabulary_id", "local_name", "kind").orderBy("id")
    return tables(spark, sf_dir, "symbols")["symbols"].withColumn("rn", F.row_number().over(by)).where("rn = 1").select("vocabulary_id", "local_name", "kind", "id")


@register("so1_nulls_last", sql("SELECT id, section_id, row_number() OVER (ORDER BY section_id NULLS LAST, id) - 1 AS place FROM spec_content", "spec_content"))
def nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its place, from 0; nulls come last."""
    rows = tables(spark, sf_dir, "spec_content")["spec_content"].select("id", "section_id")
    return numbered(rows, [F.col("section_id").isNull(), F.asc_nulls_last("section_id"), F.asc("id")], "place")


@register("so3_text_order", sql("SELECT section_id, CAST(row_number() OVER (ORDER BY section_id) AS INT) AS place FROM (SELECT DISTINCT section_id FROM spec_content WHERE section_id IS NOT NULL)", "spec_content"))
def text_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables(spark, sf_dir, "spec_content")["spec_content"].where("section_id IS NOT NULL").select("section_id").distinct()
    return numbered(found, [F.asc("section_id")], "place").withColumn("place", (F.col("place") + 1).cast("int"))


@register("lm2_single_row", "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#3' ORDER BY p_partkey LIMIT 1")
def single_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_brand = 'Brand#3'").orderBy("p_partkey").limit(1).select("p_partkey", "p_name")


@register("set4_union_of_sets", sql("SELECT list_sort(list(DISTINCT vocabulary_id)) AS vocabularies FROM symbols", "symbols"))
def union_of_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = tables(spark, sf_dir, "symbols")["symbols"].groupBy("kind").agg(F.collect_set("vocabulary_id").alias("v"))
    return per.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("v")))).alias("vocabularies"))


@register("set5_difference", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 1)")
def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return customers.join(table(spark, sf_dir, "orders").where("o_orderkey % 50 = 1").select(F.col("o_custkey").alias("k")), "k", "left_anti")


_RAW = "CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'w:' || p_name WHEN 2 THEN '{urn:x}' || p_name WHEN 3 THEN '{urn:x}' WHEN 4 THEN '{urn' WHEN 5 THEN 'q:' || p_name ELSE p_name END"


def _raw() -> object:
    k, name = F.col("p_partkey") % 7, F.col("p_name")
    return F.when(k == 0, "").when(k == 1, F.concat(F.lit("w:"), name)).when(k == 2, F.concat(F.lit("{urn:x}"), name)).when(k == 3, "{urn:x}").when(k == 4, "{urn").when(k == 5, F.concat(F.lit("q:"), name)).otherwise(name)


@register("fn1_parse_qname", f"""SELECT p_partkey, p_partkey % 7 IN (1, 2, 6) AS ok, CASE p_partkey % 7 WHEN 1 THEN '{Q.DEFAULT_NAMESPACE}' WHEN 2 THEN 'urn:x' WHEN 6 THEN '{Q.DEFAULT_NAMESPACE}' END AS namespace,
  CASE WHEN p_partkey % 7 IN (1, 2, 6) THEN p_name END AS local_name, CASE WHEN p_partkey % 7 = 1 THEN 'w' END AS prefix,
  CASE p_partkey % 7 WHEN 0 THEN 'blank' WHEN 3 THEN 'no_name' WHEN 4 THEN 'open_brace' WHEN 5 THEN 'prefix' END AS code FROM part""")  # fmt: skip
def parse_qname(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").select("p_partkey", Q.parse_qname(_raw()).alias("q"))
    return found.select("p_partkey", "q.ok", "q.namespace", "q.local_name", "q.prefix", "q.code")


@register("fn2_known_prefixes", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'w' WHEN 1 THEN 'a' WHEN 2 THEN 'r' WHEN 3 THEN 'zz' ELSE 'W' END AS prefix, p_partkey % 5 < 3 AS known FROM part")
def known_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'w' WHEN 1 THEN 'a' WHEN 2 THEN 'r' WHEN 3 THEN 'zz' ELSE 'W' END")
    return table(spark, sf_dir, "part").select("p_partkey", prefix.alias("prefix"), F.array_contains(Q.known_prefixes(), prefix).alias("known"))


@register("fn3_clark_parts", f"SELECT p_partkey, regexp_extract(r, '^\\{{([^}}]*)\\}}(.*)$', 1) AS namespace, regexp_extract(r, '^\\{{([^}}]*)\\}}(.*)$', 2) AS local_name FROM (SELECT p_partkey, {_RAW} AS r FROM part) WHERE regexp_matches(r, '^\\{{[^}}]*\\}}')")
def clark_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").select("p_partkey", Q.clark_parts(_raw()).alias("q")).where("q IS NOT NULL")
    return found.select("p_partkey", "q.namespace", "q.local_name")


@register("fn4_resolve_qname", f"""SELECT p_partkey, CASE WHEN position(':' IN r) = 0 THEN true ELSE r LIKE 'w:%' OR r LIKE '{{{{urn:%' AND false END AS resolved,
  CASE WHEN position(':' IN r) = 0 THEN 'urn:own' WHEN r LIKE 'w:%' THEN 'urn:w' END AS namespace, CASE WHEN position(':' IN r) = 0 THEN r ELSE substr(r, position(':' IN r) + 1) END AS local_name
FROM (SELECT p_partkey, {_RAW} AS r FROM part)""".replace("{{", "{"))  # fmt: skip
def resolve_qname(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = F.create_map(F.lit("w"), F.lit("urn:w"))
    found = table(spark, sf_dir, "part").select("p_partkey", Q.resolve_qname(_raw(), prefixes, F.lit("urn:own")).alias("q"))
    return found.select("p_partkey", "q.resolved", "q.namespace", "q.local_name")


@register("fn5_keys", sql("SELECT id, '{urn:x}' || kind || ':' || local_name AS declaration, vocabulary_id || '|' || local_name || '|' || kind || '|' || coalesce(CAST(parent_symbol_id AS VARCHAR), '') AS symbol FROM symbols", "symbols"))
def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return tables(spark, sf_dir, "symbols")["symbols"].select("id", Q.declaration_key(F.lit("urn:x"), c("kind"), c("local_name")).alias("declaration"), Q.symbol_key(c("vocabulary_id"), c("local_name"), c("kind"), c("parent_symbol_id")).alias("symbol"))


@register("fn6_vocabulary", f"SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'wml-main' END AS vocabulary FROM nation")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.when(F.col("n_nationkey") % 2 == 0, Q.DEFAULT_NAMESPACE).otherwise(F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", Q.vocabulary_of(uri).alias("vocabulary"))


@register("fn7_strip_prefix", "SELECT event_id, regexp_replace(event_type || ':' || event_id || ':x', '^[^:]*:', '') AS local FROM events")
def strip_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", Q.strip_prefix(F.concat_ws(":", "event_type", F.col("event_id").cast("string"), F.lit("x"))).alias("local"))


@register("fn8_occurs", sql("SELECT id, min_occurs || '..' || coalesce(CAST(max_occurs AS VARCHAR), 'unbounded') AS occurs FROM child_edges", "child_edges"))
def occurs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "child_edges")["child_edges"].select("id", Q.format_occurs(F.col("min_occurs"), F.col("max_occurs")).alias("occurs"))


_OCC = "CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'unbounded' WHEN 2 THEN ' 12abc' WHEN 3 THEN 'x1' WHEN 4 THEN '-3' ELSE CAST(o_orderkey % 100 AS STRING) END"


@register("fn9_parse_occurs", f"SELECT o_orderkey, coalesce(TRY_CAST(regexp_extract(r, '^\\s*([+-]?\\d+)', 1) AS INT), 1) AS least, CASE WHEN r = 'unbounded' THEN NULL ELSE coalesce(TRY_CAST(regexp_extract(r, '^\\s*([+-]?\\d+)', 1) AS INT), 1) END AS most FROM (SELECT o_orderkey, {_OCC} AS r FROM orders)")
def parse_occurs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_OCC).alias("r"))
    return raw.select("o_orderkey", Q.parse_min_occurs(F.col("r")).alias("least"), Q.parse_max_occurs(F.col("r")).alias("most"))


@register("fn10_attribute_use", "SELECT event_id, CASE WHEN u IN ('required', 'prohibited', 'optional') THEN u ELSE 'optional' END AS attr_use FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'required' WHEN 1 THEN 'prohibited' WHEN 2 THEN event_type END AS u FROM events)")
def attribute_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    raw = F.when(k == 0, "required").when(k == 1, "prohibited").when(k == 2, F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", Q.attribute_use(raw).alias("attr_use"))


@register("fn11_last_segment", "SELECT page_id, CASE WHEN length(s) >= 3 THEN s END AS segment FROM (SELECT page_id, regexp_extract(url || '//', '([^/]*)/*$', 1) AS s FROM pages)")
def last_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", Q.last_segment(F.concat("url", F.lit("//"))).alias("segment"))


@register("fn12_trim", "SELECT page_id, trim('  ' || url || ' ') AS url FROM pages")
def trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", strip(F.concat(F.lit("  "), "url", F.lit(" "))).alias("url"))


@register("fn14_slug", "SELECT p_partkey, regexp_replace(lower(p_name || '  ' || p_type), '\\s+', '-', 'g') AS slug FROM part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", slug(F.concat("p_name", F.lit("  "), "p_type")).alias("slug"))


@register("fn15_percent", "SELECT o_orderkey, printf('%.1f', round(o_orderkey % 997 / 997.0 * 100, 1)) AS percent FROM orders")
def percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", percent(F.col("o_orderkey") % 997 / F.lit(997.0)).alias("percent"))


@register("fn27_sha256", "SELECT item_id, sha256(text) AS digest FROM benchmark")
def sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("digest"))


@register("fn29_scalar_or_array", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN [p_brand, p_type] WHEN 1 THEN [p_type] WHEN 2 THEN [p_partkey::VARCHAR] ELSE [] END AS kinds FROM part")
def scalar_or_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON field that holds an array, a string, a number or null."""
    k = F.col("p_partkey") % 4
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    raw = F.when(k == 0, F.to_json(F.array("p_brand", "p_type"))).when(k == 1, quoted("p_type")).when(k == 2, F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", listed(raw).alias("kinds"))


@register("src13_table_scan", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_suppkey = 7")
def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_linestatus = 'F' AND l_suppkey = 7").select("l_orderkey", "l_partkey")


@register("src14_catalog_scan", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 7 WHEN 1 THEN 1 WHEN 2 THEN 1 END AS n, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 1 END AS families, CASE p_partkey % 4 WHEN 0 THEN 'Image Part' WHEN 1 THEN 'Workbook Part' WHEN 2 THEN 'Slide Part' END AS name FROM part")
def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row names a key of the catalog, or one that is not there."""
    key = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'sml-workbook' WHEN 2 THEN 'pml-slide' ELSE 'none' END")
    known = catalog.parts(spark).select("key", F.size("content_types").alias("n"), F.size("families").alias("families"), "name")
    return table(spark, sf_dir, "part").select("p_partkey", key.alias("key")).join(F.broadcast(known), "key", "left").select("p_partkey", "n", "families", "name")


@register("src10_manifest", "SELECT CAST(p_partkey AS VARCHAR) AS name, p_name AS url, sha256(p_type) AS sha256 FROM part")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest is one JSON document with an array of sources, here one for every brand, which the reader takes apart."""
    own = F.struct(F.col("p_partkey").cast("string").alias("name"), F.col("p_name").alias("url"), F.sha2("p_type", 256).alias("sha256"))
    whole = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list(own).alias("sources"))).alias("value")).select("value")
    return manifest_rows(whole).select("name", "url", "sha256")
