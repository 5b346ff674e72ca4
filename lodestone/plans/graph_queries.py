"""Registered queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.plans.derived import GRAPH, sql, tables
from lodestone.plans.registry import register

ALL = tuple(v for v in GRAPH if v not in ("named", "owners", "pairs", "flags"))
BASE = ("symbols", "profiles", "namespaces", "symbol_profiles", "reference_sources")
#: What a content model and the names of its owners are made from.
CONTENT = (*BASE, "inheritance_edges", "compositors", "child_edges", "group_edges")
PROFILE = "transitional"

_MEMBER = """
  members AS (SELECT s.id, s.vocabulary_id, s.local_name, s.kind, s.type_ref, s.parent_symbol_id, n.uri AS namespace_uri, r.name AS source_name
    FROM symbols s JOIN symbol_profiles m ON m.symbol_id = s.id JOIN namespaces n ON n.id = m.namespace_id
    JOIN profiles p ON p.id = m.profile_id LEFT JOIN reference_sources r ON r.id = m.source_id WHERE p.name = 'transitional')"""
_TYPES = """
  types AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY namespace_uri, local_name ORDER BY kind, id) AS rn
    FROM members WHERE parent_symbol_id IS NULL AND kind IN ('complexType', 'simpleType')) WHERE rn = 1)"""


@register("gr1_lookup_symbol", sql(f"WITH {_MEMBER} SELECT * FROM members WHERE parent_symbol_id IS NULL", *BASE))
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.lookup(tables(spark, sf_dir, *BASE), PROFILE)


@register("gr2_lookup_element", sql(f"WITH {_MEMBER} SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY namespace_uri, local_name ORDER BY id) AS rn FROM members WHERE parent_symbol_id IS NULL AND kind = 'element') WHERE rn = 1", *BASE))
def lookup_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.elements(tables(spark, sf_dir, *BASE), PROFILE)


@register("gr3_lookup_type", sql(f"WITH {_MEMBER}, {_TYPES} SELECT * EXCLUDE (rn) FROM types", *BASE))
def lookup_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.types(tables(spark, sf_dir, *BASE), PROFILE)


@register("gr4_dereference", sql(f"""WITH {_MEMBER}, {_TYPES}
SELECT s.id, s.type_ref, t.id AS type_id, t.kind AS type_kind FROM symbols s
LEFT JOIN types t ON s.type_ref = '{{' || t.namespace_uri || '}}' || t.local_name WHERE s.kind = 'element'""", *BASE))  # fmt: skip
def dereference(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = tables(spark, sf_dir, *BASE)
    refs = graph["symbols"].where("kind = 'element'").select("id", "type_ref")
    return G.dereference(graph, PROFILE, refs)


_CHAIN = """
  chain(root, type, depth, path) AS (
    SELECT id, id, 0, [id] FROM symbols
    UNION ALL SELECT c.root, e.base_symbol_id, c.depth + 1, list_append(c.path, e.base_symbol_id)
    FROM chain c JOIN inheritance_edges e ON e.symbol_id = c.type WHERE {more} NOT list_contains(c.path, e.base_symbol_id))"""


@register("gr7_inheritance_chain", sql("WITH " + _CHAIN.format(more="") + " SELECT root, type, depth FROM chain", "symbols", "profiles", "inheritance_edges"))
def inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.base_chain(tables(spark, sf_dir, "symbols", "profiles", "inheritance_edges"), PROFILE, extension_only=False)


_TREE = """
  tree(owner, compositor_id, kind, place, path) AS (
    SELECT parent_symbol_id, id, kind, [order_index, 2, id], [kind || '(' || min_occurs || '..' || coalesce(CAST(max_occurs AS VARCHAR), 'unbounded') || ')'] FROM compositors WHERE parent_symbol_id IS NOT NULL
    UNION ALL SELECT t.owner, c.id, c.kind, t.place || [c.order_index, 2, c.id], list_append(t.path, c.kind || '(' || c.min_occurs || '..' || coalesce(CAST(c.max_occurs AS VARCHAR), 'unbounded') || ')')
    FROM tree t JOIN compositors c ON c.parent_compositor_id = t.compositor_id)"""


@register("gr6_compositor_tree", sql("WITH " + _TREE + " SELECT owner, compositor_id, kind, path FROM tree", "compositors", "profiles"))
def compositor_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.compositor_tree(tables(spark, sf_dir, "compositors", "profiles"), PROFILE).drop("place")


_LEAVES = """
  leaves AS (
    SELECT t.owner, 1 AS phase, t.place || [e.order_index, 0, e.id] AS place, 'element' AS entry, e.child_symbol_id AS child, n.uri, e.min_occurs, e.max_occurs, e.order_index, t.kind AS compositor_kind, t.path
    FROM tree t JOIN child_edges e ON e.compositor_id = t.compositor_id
    LEFT JOIN symbol_profiles m ON m.symbol_id = e.child_symbol_id AND m.profile_id = e.profile_id LEFT JOIN namespaces n ON n.id = m.namespace_id
    UNION ALL
    SELECT t.owner, 1, t.place || [g.order_index, 1, g.id], 'group', g.group_symbol_id, NULL, g.min_occurs, g.max_occurs, g.order_index, t.kind, t.path
    FROM tree t JOIN group_edges g ON g.compositor_id = t.compositor_id WHERE g.ref_kind = 'group'
    UNION ALL
    SELECT parent_symbol_id, 2, [order_index, 1, id], 'group', group_symbol_id, NULL, min_occurs, max_occurs, order_index, NULL, []
    FROM group_edges WHERE ref_kind = 'group' AND compositor_id IS NULL)"""
_MODEL = """SELECT c.root, CAST(row_number() OVER (PARTITION BY c.root ORDER BY c.depth DESC, l.phase, l.place) AS INT) AS ordinal, l.entry, s.local_name, s.vocabulary_id, l.uri AS namespace_uri,
  l.min_occurs, l.max_occurs, l.order_index, l.compositor_kind, l.path AS compositor_path, CASE WHEN c.depth = 0 THEN 'self' ELSE 'inherited' END AS source, o.local_name AS owner_name
FROM chain c JOIN leaves l ON l.owner = c.type JOIN symbols s ON s.id = l.child JOIN symbols o ON o.id = c.type"""


@register("gr5_content_model", sql("WITH " + _CHAIN.format(more="e.relation = 'extension' AND") + "," + _TREE + "," + _LEAVES + "\n" + _MODEL, *ALL))
def content_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.content_model(tables(spark, sf_dir, *CONTENT), PROFILE)


_WALK = """
  edges AS (SELECT parent_symbol_id AS src, group_symbol_id AS dst, true AS g, [1, order_index, id] AS step FROM group_edges WHERE ref_kind = 'attributeGroup'
    UNION ALL SELECT symbol_id, base_symbol_id, false, [2, 0, 0] FROM inheritance_edges),
  walk(root, node, g, place, seen) AS (
    SELECT id, id, false, CAST([] AS INT[]), [id] FROM symbols
    UNION ALL SELECT w.root, e.dst, e.g, w.place || e.step, list_append(w.seen, e.dst)
    FROM walk w JOIN edges e ON e.src = w.node WHERE (e.g OR NOT w.g) AND NOT list_contains(w.seen, e.dst)),
  found AS (SELECT w.root, w.node, w.g, a.*, w.place || [0, a.order_index, a.id] AS spot FROM walk w JOIN attr_edges a ON a.symbol_id = w.node),
  kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root, local_name ORDER BY spot) AS rn FROM found) WHERE rn = 1)"""


_ATTRIBUTES = """SELECT k.root, CAST(row_number() OVER (PARTITION BY k.root ORDER BY k.spot) AS INT) AS ordinal, k.local_name, k.attr_use, k.default_value, k.fixed_value, k.type_ref,
  CASE WHEN k.g THEN 'attributeGroup' WHEN k.node = k.root THEN 'self' ELSE 'inherited' END AS source, o.local_name AS owner_name
FROM kept k JOIN symbols o ON o.id = k.node"""


@register("gr8_attributes", sql("WITH " + _WALK + "\n" + _ATTRIBUTES, "symbols", "profiles", "group_edges", "inheritance_edges", "attr_edges"))
def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.attributes(tables(spark, sf_dir, "symbols", "profiles", "group_edges", "inheritance_edges", "attr_edges"), PROFILE)


@register("gr9_attribute_groups", sql("WITH " + _WALK + """
SELECT k.root, CAST(count(*) AS INT) AS n, list_sort(list(k.local_name)) AS names FROM kept k JOIN symbols s ON s.id = k.root WHERE s.kind = 'attributeGroup' GROUP BY k.root""", "symbols", "profiles", "group_edges", "inheritance_edges", "attr_edges"))  # fmt: skip
def attribute_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = tables(spark, sf_dir, "symbols", "profiles", "group_edges", "inheritance_edges", "attr_edges")
    found = G.attributes(graph, PROFILE, graph["symbols"].where("kind = 'attributeGroup'"))
    return found.groupBy("root").agg(F.count("*").cast("int").alias("n"), F.sort_array(F.collect_list("local_name")).alias("names"))


@register("gr10_enums", sql("SELECT symbol_id, CAST(row_number() OVER (PARTITION BY symbol_id ORDER BY order_index, id) AS INT) AS ordinal, value FROM enums", "enums"))
def enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.enums(tables(spark, sf_dir, "enum_uses", "enum_values", "profiles"), PROFILE)


_SPACES = """
  counted AS (SELECT n.uri, p.name, CAST(count(*) AS INT) AS symbol_count, list(DISTINCT s.vocabulary_id) AS v
    FROM symbol_profiles m JOIN namespaces n ON n.id = m.namespace_id JOIN profiles p ON p.id = m.profile_id JOIN symbols s ON s.id = m.symbol_id {where} GROUP BY 1, 2)
SELECT uri, list_sort(list_distinct(flatten(list(v)))) AS vocabularies, list_sort(list(name || '=' || symbol_count)) AS profiles FROM counted GROUP BY uri"""


def _flat(df: DataFrame) -> DataFrame:
    """profiles as name=count strings."""
    pairs = F.transform("profiles", lambda p: F.concat(p["name"], F.lit("="), p["symbol_count"].cast("string")))
    return df.withColumn("profiles", pairs)


_FOUR = ("symbols", "profiles", "namespaces", "symbol_profiles")


@register("gr11_namespace_info", sql("WITH " + _SPACES.format(where="WHERE n.uri = 'urn:Brand#7'"), *_FOUR))
def namespace_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(G.namespaces(tables(spark, sf_dir, *_FOUR), uri="urn:Brand#7"))


@register("gr12_namespace_list", sql("WITH " + _SPACES.format(where="WHERE n.uri ILIKE '%brand#1%'"), *_FOUR))
def namespace_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(G.namespaces(tables(spark, sf_dir, *_FOUR), query=" BRAND#1 "))


@register("ag2_namespaces_all", sql("WITH " + _SPACES.format(where=""), *_FOUR))
def namespaces_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(G.namespaces(tables(spark, sf_dir, *_FOUR)))


@register("ag1_symbols_by_profile", sql("SELECT p.name AS profile, CAST(count(*) AS INT) AS symbol_count, list_sort(list(DISTINCT s.vocabulary_id)) AS vocabularies FROM symbol_profiles m JOIN profiles p ON p.id = m.profile_id JOIN symbols s ON s.id = m.symbol_id GROUP BY 1", *_FOUR))
def symbols_by_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tables(spark, sf_dir, *_FOUR)
    rows = g["symbol_profiles"].join(g["profiles"].select(F.col("id").alias("profile_id"), F.col("name").alias("profile")), "profile_id").join(g["symbols"].select(F.col("id").alias("symbol_id"), "vocabulary_id"), "symbol_id")
    return rows.groupBy("profile").agg(F.count("*").cast("int").alias("symbol_count"), F.sort_array(F.collect_set("vocabulary_id")).alias("vocabularies"))


@register("gr13_did_you_mean", sql(f"WITH {_MEMBER} SELECT DISTINCT vocabulary_id, local_name, kind, namespace_uri FROM members WHERE parent_symbol_id IS NULL AND local_name = (SELECT min(local_name) FROM symbols) ORDER BY 1, 3, 4 LIMIT 10", *BASE))
def did_you_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = tables(spark, sf_dir, *BASE)
    name = graph["symbols"].agg(F.min("local_name")).first()[0]
    return G.elsewhere(graph, PROFILE, name)


@register("gr14_local_elements", sql(f"WITH {_MEMBER} SELECT m.id, m.namespace_uri, m.local_name, m.vocabulary_id, m.type_ref, o.kind AS owner_kind, o.local_name AS owner_name FROM members m JOIN symbols o ON o.id = m.parent_symbol_id WHERE m.kind = 'element'", *BASE))
def local_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.local_elements(tables(spark, sf_dir, *BASE), PROFILE)


@register("gr15_local_resolution", sql(f"""WITH {_MEMBER}, {_TYPES},
  l AS (SELECT m.namespace_uri, m.local_name, count(*) AS n, count(m.type_ref) AS typed, count(DISTINCT m.type_ref) AS kinds, min(m.type_ref) AS type_ref
    FROM members m JOIN symbols o ON o.id = m.parent_symbol_id WHERE m.kind = 'element' GROUP BY 1, 2),
  j AS (SELECT l.*, t.id IS NOT NULL AND kinds = 1 AND typed = n AS single FROM l LEFT JOIN types t ON l.type_ref = '{{' || t.namespace_uri || '}}' || t.local_name)
SELECT namespace_uri, local_name, CASE WHEN single THEN 'single' ELSE 'ambiguous' END AS outcome, CASE WHEN single THEN type_ref END AS type_ref, CAST(n AS INT) AS owners FROM j""", *BASE))  # fmt: skip
def local_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.local_resolution(tables(spark, sf_dir, *BASE), PROFILE)


_IMPORTS = "SELECT 'd' || n_nationkey AS document, 'd' || (n_nationkey * 3 + n_regionkey) % 25 AS target FROM nation UNION ALL SELECT 'd' || n_nationkey, 'd' || (n_nationkey + 7) % 25 FROM nation WHERE n_nationkey % 2 = 0"


@register("gr16_import_closure", f"""WITH RECURSIVE edges AS ({_IMPORTS}),
  r(path, hops) AS (SELECT 'd1', 0 UNION SELECT e.target, r.hops + 1 FROM r JOIN edges e ON e.document = r.path WHERE r.hops < 30)
SELECT path, CAST(min(hops) AS INT) AS hops FROM r GROUP BY path""")  # fmt: skip
def import_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    name = lambda x: F.concat(F.lit("d"), x.cast("string"))
    a = n.select(name(F.col("n_nationkey")).alias("document"), name((F.col("n_nationkey") * 3 + F.col("n_regionkey")) % 25).alias("target"))
    b = n.where("n_nationkey % 2 = 0").select(name(F.col("n_nationkey")).alias("document"), name((F.col("n_nationkey") + 7) % 25).alias("target"))
    return G.import_closure(a.union(b), ["d1"])
