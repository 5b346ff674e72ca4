"""Registered queries of loads, mutations and integrity rules: each gives the table after the change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import model
from lodestone.operators import merge
from lodestone.plans.derived import sql, tables
from lodestone.plans.prose_queries import table
from lodestone.plans.registry import register


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One incoming row per key from orders: every third without a segment, some keys unknown."""
    o = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") * 2).alias("c_custkey")).agg(F.max("o_orderpriority").alias("p"))
    return o.select("c_custkey", F.concat(F.lit("new "), F.col("c_custkey").cast("string")).alias("c_name"), F.when(F.col("c_custkey") % 3 != 0, F.col("p")).alias("c_mktsegment"))


_NEW = "n AS (SELECT k AS c_custkey, 'new ' || k AS c_name, CASE WHEN k % 3 <> 0 THEN p END AS c_mktsegment FROM (SELECT o_custkey * 2 AS k, max(o_orderpriority) AS p FROM orders GROUP BY 1))"


@register("snk5_upsert_sources", f"""WITH {_NEW} SELECT coalesce(n.c_custkey, c.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_name ELSE c.c_name END AS c_name,
  coalesce(n.c_mktsegment, c.c_mktsegment) AS c_mktsegment FROM customer c FULL JOIN n ON n.c_custkey = c.c_custkey""")  # fmt: skip
def upsert_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.upsert(_customers(spark, sf_dir), _names(spark, sf_dir), ["c_custkey"], keep_if_null=("c_mktsegment",))


@register("snk6_upsert_symbols", sql("""WITH o AS (SELECT vocabulary_id, local_name, kind, parent_symbol_id, min(type_ref) AS type_ref FROM symbols WHERE id % 3 <> 0 GROUP BY 1, 2, 3, 4),
  n AS (SELECT vocabulary_id, local_name, kind, parent_symbol_id, min(CASE WHEN id % 5 = 0 THEN 'fixed' END) AS type_ref FROM symbols WHERE id % 2 = 0 GROUP BY 1, 2, 3, 4)
SELECT coalesce(o.vocabulary_id, n.vocabulary_id) AS vocabulary_id, coalesce(o.local_name, n.local_name) AS local_name, coalesce(o.kind, n.kind) AS kind,
  coalesce(o.parent_symbol_id, n.parent_symbol_id) AS parent_symbol_id, coalesce(n.type_ref, o.type_ref) AS type_ref, o.kind IS NULL AS inserted
FROM o FULL JOIN n ON o.vocabulary_id = n.vocabulary_id AND o.local_name = n.local_name AND o.kind = n.kind AND o.parent_symbol_id IS NOT DISTINCT FROM n.parent_symbol_id""", "symbols"))  # fmt: skip
def upsert_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables(spark, sf_dir, "symbols")["symbols"]
    keys = ["vocabulary_id", "local_name", "kind", "parent_symbol_id"]
    old = s.where("id % 3 <> 0").groupBy(*keys).agg(F.min("type_ref").alias("type_ref"))
    new = s.where("id % 2 = 0").groupBy(*keys).agg(F.min(F.when(F.col("id") % 5 == 0, "fixed")).alias("type_ref"))
    return merge.upsert(old, new, keys, keep_if_null=("type_ref",), flag=True)


@register("snk7_insert_absent", f"WITH {_NEW} SELECT c_custkey, c_name, c_mktsegment FROM customer UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.insert_absent(_customers(spark, sf_dir), _names(spark, sf_dir), ["c_custkey"])


@register("snk8_get_or_create", "SELECT CAST(n_nationkey AS INT) AS id, n_name AS name FROM nation UNION ALL SELECT CAST(24 + row_number() OVER (ORDER BY name) AS INT), name FROM (SELECT DISTINCT p_brand AS name FROM part)")
def get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"))
    return merge.get_or_create(old, table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")), "name")


@register("snk3_update_embedding", "SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN vec_id * 2 ELSE label END AS label FROM embeddings")
def update_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    changes = rows.where("vec_id % 10 = 0").select("vec_id", (F.col("vec_id") * 2).alias("label"))
    return merge.update_column(rows, changes, "vec_id", "label")


@register("snk9_backfill_source", sql("SELECT id, coalesce(source_id, part_number * 100) AS source_id FROM (SELECT id, part_number, CASE WHEN id % 4 = 0 THEN 1 END AS source_id FROM spec_content)", "spec_content"))
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables(spark, sf_dir, "spec_content")["spec_content"].select("id", "part_number", F.when(F.col("id") % 4 == 0, 1).alias("source_id"))
    sources = spark.range(1, 5).select(F.col("id").cast("int").alias("part_number"), (F.col("id") * 100).cast("int").alias("source_id"))
    return merge.update_column(rows, sources, "part_number", "source_id", only_null=True).select("id", "source_id")


@register("snk10_fill_type_ref", sql("SELECT id, coalesce(type_ref, CASE WHEN id % 2 = 0 THEN 'later' END) AS type_ref FROM symbols", "symbols"))
def fill_type_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables(spark, sf_dir, "symbols")["symbols"].select("id", "type_ref")
    later = s.where("id % 2 = 0").select("id", F.lit("later").alias("type_ref"))
    return merge.update_column(s, later, "id", "type_ref", only_null=True)


@register("snk2_replace_part", sql("SELECT id, part_number, content_type FROM spec_content WHERE part_number <> 2 UNION ALL SELECT id + 1000000, 2, 'new' FROM spec_content WHERE part_number = 3", "spec_content"))
def replace_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables(spark, sf_dir, "spec_content")["spec_content"].select("id", "part_number", "content_type")
    new = rows.where("part_number = 3").select((F.col("id") + 1000000).alias("id"), F.lit(2).alias("part_number"), F.lit("new").alias("content_type"))
    return merge.replace_part(rows, new, 2)


@register("snk12_rewrite_profile", sql("SELECT id, symbol_id, profile_id FROM symbol_profiles WHERE profile_id <> 2 UNION ALL SELECT (SELECT max(id) FROM symbol_profiles WHERE profile_id <> 2) + row_number() OVER (ORDER BY symbol_id), symbol_id, 2 FROM symbol_profiles WHERE profile_id = 1 AND symbol_id % 3 = 0", "symbol_profiles"))
def rewrite_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile's rows go, and new ones take their place with ids that go on."""
    members = tables(spark, sf_dir, "symbol_profiles")["symbol_profiles"].select("id", "symbol_id", "profile_id")
    new = members.where("profile_id = 1 AND symbol_id % 3 = 0").select("symbol_id", F.lit(2).alias("profile_id"))
    return merge.rewrite(members, new, "profile_id", 2, ["symbol_id"]).withColumn("id", F.col("id").cast("long"))


@register("snk1_insert", sql("SELECT id, section_id FROM spec_content WHERE id % 2 = 0 UNION ALL SELECT (SELECT max(id) FROM spec_content WHERE id % 2 = 0) + row_number() OVER (ORDER BY section_id NULLS FIRST, id), section_id FROM spec_content WHERE id % 2 = 1", "spec_content"))
def insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables(spark, sf_dir, "spec_content")["spec_content"].select(F.col("id").cast("long").alias("id"), "section_id")
    old, new = rows.where("id % 2 = 0"), rows.where("id % 2 = 1").withColumnRenamed("id", "was")
    return old.unionByName(merge.insert(old, new, ["section_id", "was"]))


@register("snk16_apply_migrations", """SELECT p_name AS name, max(p_type) AS checksum, bool_or(p_partkey % 3 = 0) AS was_applied FROM part GROUP BY 1""")
def apply_migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Afterwards every file is recorded; those that were keep their time."""
    part = table(spark, sf_dir, "part")
    every = part.groupBy(F.col("p_name").alias("name")).agg(F.max("p_type").alias("checksum"))
    old = F.lit("2020-01-01").cast("timestamp")
    applied = every.join(part.where("p_partkey % 3 = 0").select(F.col("p_name").alias("name")).distinct(), "name", "left_semi").withColumn("applied_at", old)
    done = merge.record_migrations(applied, merge.pending_migrations(every, applied), F.lit("2021-01-01").cast("timestamp"))
    return done.select("name", "checksum", (F.col("applied_at") == old).alias("was_applied"))


_GRAPH = ("symbols", "symbol_profiles", "compositors", "child_edges", "attr_edges", "group_edges", "inheritance_edges", "enums")
_GONE = """g AS (SELECT symbol_id AS id FROM symbol_profiles WHERE source_id = 2),
  gone AS (SELECT id FROM g UNION SELECT s.id FROM symbols s JOIN g ON s.parent_symbol_id = g.id),
  tops AS (SELECT id FROM compositors WHERE parent_symbol_id IS NOT NULL AND parent_symbol_id NOT IN (SELECT id FROM gone)),
  live AS (SELECT id FROM tops UNION ALL SELECT c.id FROM live JOIN compositors c ON c.parent_compositor_id = live.id)"""


@register("snk11_snk14_purge_cascade", sql(f"""WITH {_GONE}
SELECT 'symbols' AS t, count(*) AS n FROM symbols WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'symbol_profiles', count(*) FROM symbol_profiles WHERE symbol_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'compositors', count(*) FROM live
UNION ALL SELECT 'child_edges', count(*) FROM child_edges WHERE parent_symbol_id NOT IN (SELECT id FROM gone) AND child_symbol_id NOT IN (SELECT id FROM gone) AND compositor_id IN (SELECT id FROM live)
UNION ALL SELECT 'attr_edges', count(*) FROM attr_edges WHERE symbol_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'group_edges', count(*) FROM group_edges WHERE parent_symbol_id NOT IN (SELECT id FROM gone) AND group_symbol_id NOT IN (SELECT id FROM gone) AND (compositor_id IS NULL OR compositor_id IN (SELECT id FROM live))
UNION ALL SELECT 'inheritance_edges', count(*) FROM inheritance_edges WHERE symbol_id NOT IN (SELECT id FROM gone) AND base_symbol_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'enums', count(*) FROM enums WHERE symbol_id NOT IN (SELECT id FROM gone)""", *_GRAPH))  # fmt: skip
def purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = merge.purge_source(tables(spark, sf_dir, *_GRAPH), 2)
    out = None
    for name in _GRAPH:
        row = left[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
        out = row if out is None else out.union(row)
    return out


_DEEP = {"symbols": "deep_symbols", "symbol_profiles": "deep_members", "compositors": "deep_compositors", "child_edges": "deep_children", "group_edges": "deep_groups", "inheritance_edges": "deep_bases", "behavior_notes": "deep_notes"}


@register("snk14_deep_cascade", sql("""WITH gone(id) AS (SELECT symbol_id FROM deep_members WHERE source_id = 2 UNION SELECT s.id FROM gone JOIN deep_symbols s ON s.parent_symbol_id = gone.id),
  lost(id) AS (SELECT id FROM deep_compositors WHERE parent_symbol_id IN (SELECT id FROM gone) UNION SELECT c.id FROM lost JOIN deep_compositors c ON c.parent_compositor_id = lost.id)
SELECT 'symbols' AS t, id FROM deep_symbols WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'symbol_profiles', id FROM deep_members WHERE symbol_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'compositors', id FROM deep_compositors WHERE id NOT IN (SELECT id FROM lost)
UNION ALL SELECT 'child_edges', id FROM deep_children WHERE parent_symbol_id NOT IN (SELECT id FROM gone) AND child_symbol_id NOT IN (SELECT id FROM gone) AND compositor_id NOT IN (SELECT id FROM lost)
UNION ALL SELECT 'group_edges', id FROM deep_groups WHERE parent_symbol_id NOT IN (SELECT id FROM gone) AND group_symbol_id NOT IN (SELECT id FROM gone) AND (compositor_id IS NULL OR compositor_id NOT IN (SELECT id FROM lost))
UNION ALL SELECT 'inheritance_edges', id FROM deep_bases WHERE symbol_id NOT IN (SELECT id FROM gone) AND base_symbol_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'behavior_notes', id FROM deep_notes WHERE symbol_id IS NULL OR symbol_id NOT IN (SELECT id FROM gone)""", *_DEEP.values()))  # fmt: skip
def deep_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's symbols go, with what lies in them at any depth; every row that is left."""
    views = tables(spark, sf_dir, *_DEEP.values())
    left = merge.purge_source({name: views[view] for name, view in _DEEP.items()}, 2)
    return reduce(DataFrame.union, [df.select(F.lit(name).alias("t"), "id") for name, df in left.items()])


@register("flt11_delete_unreferenced", "SELECT c_custkey FROM customer WHERE NOT (c_mktsegment = 'MACHINERY' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))")
def delete_unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return merge.delete_unreferenced(_customers(spark, sf_dir), F.col("c_mktsegment") == "MACHINERY", orders, "c_custkey", "o_custkey").select("c_custkey")


@register("snk16_pending_migrations", "SELECT 'm' || p_partkey AS name, md5(p_name) AS checksum FROM part WHERE p_partkey % 3 = 0")
def pending_migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("name"), F.md5(F.col("p_name").cast("binary")).alias("checksum"), "p_partkey")
    return merge.pending_migrations(every, every.where("p_partkey % 3 <> 0"))


@register("flt12_ddl3_domains", "SELECT count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS outside FROM orders")
def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.outside_domain(table(spark, sf_dir, "orders"), "o_orderstatus", ("F", "O")).agg(F.count("*").alias("outside"))


@register("ddl1_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.duplicate_keys(table(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"))


@register("ddl2_dangling", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.dangling(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").where("c_nationkey < 20"), "c_custkey").select("o_orderkey")


_CHECKED = ("symbols", "profiles", "namespaces", "symbol_profiles", "compositors", "attr_edges", "group_edges", "inheritance_edges")


_RULES = {
    "unique": {"profiles": ["name"], "namespaces": ["uri"], "symbols": ["vocabulary_id", "local_name", "kind", "parent_symbol_id"], "symbol_profiles": ["symbol_id", "profile_id"], "inheritance_edges": ["symbol_id", "profile_id"]},
    "domain": {("compositors", "kind"): "'sequence', 'choice', 'all'", ("attr_edges", "attr_use"): "'required', 'optional', 'prohibited'", ("group_edges", "ref_kind"): "'group', 'attributeGroup'", ("inheritance_edges", "relation"): "'extension', 'restriction'"},
    "reference": {
        "symbols": {"parent_symbol_id": "symbols"},
        "symbol_profiles": {"symbol_id": "symbols", "profile_id": "profiles", "namespace_id": "namespaces"},
        "compositors": {"parent_symbol_id": "symbols", "parent_compositor_id": "compositors", "profile_id": "profiles"},
        "attr_edges": {"symbol_id": "symbols", "attr_symbol_id": "symbols", "profile_id": "profiles"},
        "group_edges": {"parent_symbol_id": "symbols", "compositor_id": "compositors", "group_symbol_id": "symbols", "profile_id": "profiles"},
        "inheritance_edges": {"symbol_id": "symbols", "base_symbol_id": "symbols", "profile_id": "profiles"},
    },
}
_RULES_SQL = " UNION ALL ".join([
    *[f"SELECT '{t}' AS \"table\", 'unique {', '.join(k)}' AS rule, (SELECT count(*) FROM (SELECT 1 FROM {t} GROUP BY {', '.join(k)} HAVING count(*) > 1)) AS n" for t, k in _RULES["unique"].items()],
    *[f"SELECT '{t}', 'domain of {c}', (SELECT count(*) FROM {t} WHERE {c} IS NULL OR {c} NOT IN ({d}))" for (t, c), d in _RULES["domain"].items()],
    "SELECT 'compositors', 'one parent', (SELECT count(*) FROM compositors WHERE (parent_symbol_id IS NULL) = (parent_compositor_id IS NULL))",
    *[f"SELECT '{t}', '{c} in {of}', (SELECT count(*) FROM {t} x WHERE x.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {of} y WHERE y.id = x.{c}))" for t, refs in _RULES["reference"].items() for c, of in refs.items()],
])


@register("ddl_all_rules", sql(_RULES_SQL, *_CHECKED))
def all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.violations(tables(spark, sf_dir, *_CHECKED))


_SCHEMA = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns="%s" targetNamespace="%s">%s</xs:schema>'


def _schema_documents(region: DataFrame, nation: DataFrame, first: str = "") -> DataFrame:
    """(path, xml): a document per region and per nation from their text (column x); the first one imports the regions', which import their nations'."""
    from lodestone.functions.qname import DEFAULT_NAMESPACE

    whole = lambda x: F.format_string(_SCHEMA, F.lit(DEFAULT_NAMESPACE), F.lit(DEFAULT_NAMESPACE), x)
    load = lambda kind, key: F.format_string(f'<xs:import schemaLocation="{kind}%d.xsd"/>', key)
    inside = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.sort_array(F.collect_list(load("nation", "n_nationkey"))), "").alias("more"))
    regions = region.join(inside, "r_regionkey", "left").select(F.format_string("region%d.xsd", "r_regionkey").alias("path"), whole(F.concat(F.coalesce("more", F.lit("")), F.col("x"))).alias("xml"))
    nations = nation.select(F.format_string("nation%d.xsd", "n_nationkey").alias("path"), whole(F.col("x")).alias("xml"))
    top = region.agg(F.array_join(F.sort_array(F.collect_list(load("region", "r_regionkey"))), "").alias("more")).select(F.lit("first.xsd").alias("path"), whole(F.concat("more", F.lit(first))).alias("xml"))
    return top.union(regions).union(nations)


def _schema_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type in each region's document, and one in each nation's that extends it with an element per supplier."""
    region = table(spark, sf_dir, "region").select("r_regionkey", F.format_string('<xs:complexType name="R%d"><xs:attribute name="area" type="xs:string"/></xs:complexType>', "r_regionkey").alias("x"))
    element = F.format_string('<xs:element name="%s" type="R0" minOccurs="%d" maxOccurs="unbounded"/>', "s_name", F.col("s_suppkey") % 2)
    inside = _joined(table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey", "s_suppkey", element)
    body = F.format_string('<xs:complexType name="N%d"><xs:complexContent><xs:extension base="R%d"><xs:sequence>%s</xs:sequence></xs:extension></xs:complexContent></xs:complexType>', "n_nationkey", "n_regionkey", F.coalesce("all", F.lit("")))
    nation = table(spark, sf_dir, "nation").join(inside, "n_nationkey", "left").select("n_nationkey", "n_regionkey", body.alias("x"))
    return _schema_documents(region, nation)


def _ingested(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from lodestone.operators.ingest import ingest
    from lodestone.sources.schema_set import schema_set

    return ingest(schema_set(_schema_files(spark, sf_dir), ["first.xsd"]), "transitional")


@register("gr17_ingest_stats", """SELECT * FROM (VALUES ('namespaces', 1::BIGINT), ('symbols_existing', 0), ('inheritance_unresolved', 0), ('child_edges_unresolved', 0), ('group_refs', 0), ('group_refs_unresolved', 0), ('attr_edges_unresolved', 0), ('attr_group_refs', 0), ('attr_group_refs_unresolved', 0), ('enums', 0)) v(counter, n)
UNION ALL SELECT 'documents', 1 + (SELECT count(*) FROM region) + (SELECT count(*) FROM nation)
UNION ALL SELECT 'symbols', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier)
UNION ALL SELECT 'memberships', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier)
UNION ALL SELECT 'inheritance_edges', count(*) FROM nation UNION ALL SELECT 'compositors', count(*) FROM nation
UNION ALL SELECT 'child_edges', count(*) FROM supplier UNION ALL SELECT 'local_elements', count(*) FROM supplier UNION ALL SELECT 'attr_edges', count(*) FROM region""")  # fmt: skip
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir)["stats"]


@register("gr17_second_profile", """WITH n AS (SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) AS n, (SELECT count(*) FROM nation) AS nations, (SELECT count(*) FROM supplier) AS suppliers)
SELECT 'inserted' AS what, 0 AS n UNION ALL SELECT 'existing', n FROM n UNION ALL SELECT 'symbols', n FROM n UNION ALL SELECT 'memberships', 2 * n FROM n
UNION ALL SELECT 'compositors', 2 * nations FROM n UNION ALL SELECT 'child_edges', 2 * suppliers FROM n UNION ALL SELECT 'symbols of both profiles', n FROM n""")  # fmt: skip
def second_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same schemas under another profile: the symbols are there already, everything else is the profile's own."""
    from lodestone.operators.ingest import ingest
    from lodestone.sources.schema_set import schema_set

    files = schema_set(_schema_files(spark, sf_dir), ["first.xsd"])
    graph = ingest(files, "strict", known=ingest(files, "transitional"))
    stats = graph["stats"].where("counter IN ('symbols', 'symbols_existing')").select(F.when(F.col("counter") == "symbols", "inserted").otherwise("existing").alias("what"), "n")
    rows = [graph[x].agg(F.count("*").alias("n")).select(F.lit(y).alias("what"), "n") for x, y in (("symbols", "symbols"), ("symbol_profiles", "memberships"), ("compositors", "compositors"), ("child_edges", "child_edges"))]
    both = graph["symbol_profiles"].groupBy("symbol_id").agg(F.count_distinct("profile_id").alias("p")).where("p = 2").agg(F.count("*").alias("n")).select(F.lit("symbols of both profiles").alias("what"), "n")
    return reduce(DataFrame.union, [stats, *rows, both])


@register("gr22_ingest_children", "SELECT 'N' || s_nationkey AS owner, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INT) AS ordinal, s_name AS local_name, CAST(s_suppkey % 2 AS INT) AS min_occurs FROM supplier")
def ingest_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators.graph import content_model

    found = content_model(_ingested(spark, sf_dir), "transitional")
    return found.select(F.col("owner_name").alias("owner"), "ordinal", "local_name", "min_occurs")


def _joined(rows: DataFrame, by: str, order: str, text: object) -> DataFrame:
    """(by, all): the texts of each key in order, one after the other."""
    return rows.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), text.alias("_x")))), lambda p: p["_x"]), "").alias("all"))


def _rich_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind over many documents: in each region's a group and an attribute group; in each nation's an enumeration of its
    suppliers, a simple content on it, and a complex content that restricts that; an element and an attribute for all in the first."""
    region = table(spark, sf_dir, "region").select("r_regionkey", F.format_string(
        '<xs:attributeGroup name="A%d"><xs:attribute name="common" type="xs:int" use="required"/></xs:attributeGroup><xs:group name="G%d"><xs:choice minOccurs="0"><xs:element name="g" type="E0"/></xs:choice></xs:group>',
        "r_regionkey", "r_regionkey").alias("x"))
    value = F.format_string('<xs:enumeration value="%s"/>', "s_name")
    values = _joined(table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey", "s_suppkey", value)
    nation = table(spark, sf_dir, "nation").join(values, "n_nationkey", "left")
    n, r = "n_nationkey", "n_regionkey"
    listed = F.format_string('<xs:simpleType name="E%d"><xs:restriction base="xs:string">%s</xs:restriction></xs:simpleType>', n, F.coalesce("all", F.lit("")))
    simple = F.format_string('<xs:complexType name="S%d"><xs:simpleContent><xs:extension base="E%d"><xs:attribute name="unit" type="xs:string" default="d"/><xs:attributeGroup ref="A%d"/></xs:extension></xs:simpleContent></xs:complexType>', n, n, r)
    complex_ = F.format_string('<xs:complexType name="C%d"><xs:complexContent><xs:restriction base="S%d"><xs:sequence><xs:group ref="G%d" minOccurs="0"/><xs:element ref="top" maxOccurs="unbounded"/></xs:sequence><xs:attribute ref="lang"/></xs:restriction></xs:complexContent></xs:complexType>', n, n, r)
    nation = nation.select("n_nationkey", "n_regionkey", F.concat(listed, simple, complex_).alias("x"))
    return _schema_documents(region, nation, '<xs:element name="top" type="C0"/><xs:attribute name="lang" type="xs:string" fixed="f"/>')


def _rich(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from lodestone.operators.ingest import ingest
    from lodestone.sources.schema_set import schema_set

    return ingest(schema_set(_rich_files(spark, sf_dir), ["first.xsd"]), "transitional")


def _named(graph: dict[str, DataFrame], id_col: str, out: str) -> DataFrame:
    return graph["symbols"].select(F.col("id").alias(id_col), F.col("local_name").alias(out))


@register("gr20_inheritance", """SELECT 'E' || n_nationkey AS name, 'string' AS base, 'restriction' AS relation FROM nation
UNION ALL SELECT 'S' || n_nationkey, 'E' || n_nationkey, 'extension' FROM nation UNION ALL SELECT 'C' || n_nationkey, 'S' || n_nationkey, 'restriction' FROM nation""")  # fmt: skip
def inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _rich(spark, sf_dir)
    edges = graph["inheritance_edges"].join(_named(graph, "symbol_id", "name"), "symbol_id").join(_named(graph, "base_symbol_id", "base"), "base_symbol_id")
    return edges.select("name", "base", "relation")


@register("gr24_builtin_types", """SELECT 'string' AS local_name, 'simpleType' AS kind, 'xsd-builtin' AS vocabulary_id
UNION ALL SELECT x.n, x.k, 'wml-main' FROM (SELECT 'A' || r_regionkey AS n, 'attributeGroup' AS k FROM region UNION ALL SELECT 'G' || r_regionkey, 'group' FROM region UNION ALL SELECT 'g', 'element' FROM region
  UNION ALL SELECT 'E' || n_nationkey, 'simpleType' FROM nation UNION ALL SELECT 'S' || n_nationkey, 'complexType' FROM nation UNION ALL SELECT 'C' || n_nationkey, 'complexType' FROM nation
  UNION ALL SELECT 'top', 'element' UNION ALL SELECT 'lang', 'attribute') x""")  # fmt: skip
def builtin_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol; of the built-in types only the one that is a base."""
    return _rich(spark, sf_dir)["symbols"].select("local_name", "kind", "vocabulary_id")


@register("gr21_enum_values", "SELECT 'E' || s_nationkey AS name, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT) AS order_index, s_name AS value FROM supplier")
def enum_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _rich(spark, sf_dir)
    return graph["enums"].join(_named(graph, "symbol_id", "name"), "symbol_id").select("name", "order_index", "value")


@register("gr23_attribute_build", """SELECT 'A' || r_regionkey AS owner, 'common' AS local_name, 'required' AS attr_use, NULL AS default_value, NULL AS fixed_value, '{http://www.w3.org/2001/XMLSchema}int' AS type_ref FROM region
UNION ALL SELECT 'S' || n_nationkey, 'unit', 'optional', 'd', NULL, '{http://www.w3.org/2001/XMLSchema}string' FROM nation
UNION ALL SELECT 'C' || n_nationkey, 'lang', 'optional', NULL, 'f', '{http://www.w3.org/2001/XMLSchema}string' FROM nation""")  # fmt: skip
def attribute_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _rich(spark, sf_dir)
    return graph["attr_edges"].join(_named(graph, "symbol_id", "owner"), "symbol_id").select("owner", "local_name", "attr_use", "default_value", "fixed_value", "type_ref")


@register("gr19_attribute_parents", """SELECT 'S' || n_nationkey AS root, x.ordinal, x.local_name, x.source, CASE x.ordinal WHEN 1 THEN 'S' || n_nationkey ELSE 'A' || n_regionkey END AS owner_name FROM nation, (VALUES (1, 'unit', 'self'), (2, 'common', 'attributeGroup')) x(ordinal, local_name, source)
UNION ALL SELECT 'C' || n_nationkey, x.ordinal, x.local_name, x.source, CASE x.ordinal WHEN 1 THEN 'C' || n_nationkey WHEN 2 THEN 'S' || n_nationkey ELSE 'A' || n_regionkey END FROM nation, (VALUES (1, 'lang', 'self'), (2, 'unit', 'inherited'), (3, 'common', 'attributeGroup')) x(ordinal, local_name, source)""")  # fmt: skip
def attribute_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes found under simple and complex content, through groups and bases."""
    from lodestone.operators.graph import attributes

    graph = _rich(spark, sf_dir)
    roots = graph["symbols"].where("kind = 'complexType'")
    found = attributes(graph, "transitional", roots).withColumnRenamed("root", "root_id")
    return found.join(_named(graph, "root_id", "root"), "root_id").select("root", "ordinal", "local_name", "source", "owner_name")


@register("gr18_content_parents", """SELECT 'C' || n_nationkey AS root, x.ordinal, x.entry, CASE x.entry WHEN 'group' THEN 'G' || n_regionkey ELSE 'top' END AS local_name, x.least AS min_occurs, x.most AS max_occurs, 'sequence(1..1)' AS path
  FROM nation, (VALUES (1, 'group', 0, 1), (2, 'element', 1, NULL)) x(ordinal, entry, least, most)
UNION ALL SELECT 'G' || r_regionkey, 1, 'element', 'g', 1, 1, 'choice(0..1)' FROM region""")  # fmt: skip
def content_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles found under complex content and in groups; simple content has none, and a restriction does not take its base's."""
    from lodestone.operators.graph import content_model

    graph = _rich(spark, sf_dir)
    found = content_model(graph, "transitional").withColumnRenamed("root", "root_id").join(_named(graph, "root_id", "root"), "root_id")
    return found.select("root", "ordinal", "entry", "local_name", "min_occurs", "max_occurs", F.array_join("compositor_path", " > ").alias("path"))


def _linked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per nation in its region's folder, which imports its region's file and one that is not named; and a first file that imports all."""
    from lodestone.functions.qname import DEFAULT_NAMESPACE

    schema = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:own="urn:%s" targetNamespace="' + DEFAULT_NAMESPACE + '">%s</xs:schema>'
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    body = F.format_string('<xs:import namespace="urn:r" schemaLocation="../region%d.xsd"/><xs:import namespace="urn:none"/><xs:element name="twice"/><xs:element name="twice"/><xs:simpleType name="N%d"/>', "n_regionkey", "n_nationkey")
    own = nation.select(F.format_string("r%d/n%d.xsd", "n_regionkey", "n_nationkey").alias("path"), F.format_string(schema, F.col("n_nationkey").cast("string"), body).alias("xml"))
    region = table(spark, sf_dir, "region").select(F.format_string("region%d.xsd", "r_regionkey").alias("path"), F.format_string(schema, F.lit("r"), F.lit("<xs:attribute name='x'/>")).alias("xml"))
    every = nation.agg(F.array_join(F.sort_array(F.collect_list(F.format_string('<xs:import schemaLocation="r%d/n%d.xsd"/>', "n_regionkey", "n_nationkey"))), "").alias("x"))
    return own.union(region).union(every.select(F.lit("first.xsd"), F.format_string(schema, F.lit("first"), F.col("x"))))


def _linked(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from lodestone.sources.schema_set import schema_set

    return schema_set(_linked_files(spark, sf_dir), ["first.xsd"])


@register("src3_prefixes", """SELECT 'r' || n_regionkey || '/n' || n_nationkey || '.xsd' AS doc, 'urn:' || n_nationkey AS own, 'http://www.w3.org/XML/1998/namespace' AS xml FROM nation
UNION ALL SELECT DISTINCT 'region' || n_regionkey || '.xsd', 'urn:r', 'http://www.w3.org/XML/1998/namespace' FROM nation UNION ALL SELECT 'first.xsd', 'urn:first', 'http://www.w3.org/XML/1998/namespace'""")  # fmt: skip
def document_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = lambda x: F.try_element_at("prefixes", F.lit(x)).alias(x)
    return _linked(spark, sf_dir)["documents"].select("doc", prefix("own"), prefix("xml"))


@register("src4_imports", """SELECT 'r' || n_regionkey || '/n' || n_nationkey || '.xsd' AS document, 'urn:r' AS namespace, 'region' || n_regionkey || '.xsd' AS target FROM nation
UNION ALL SELECT 'r' || n_regionkey || '/n' || n_nationkey || '.xsd', 'urn:none', NULL FROM nation UNION ALL SELECT 'first.xsd', NULL, 'r' || n_regionkey || '/n' || n_nationkey || '.xsd' FROM nation""")  # fmt: skip
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets are paths from the folder's top; an import without a location has none."""
    return _linked(spark, sf_dir)["imports"].select("document", "namespace", "target")


@register("src5_declarations", f"""SELECT '{{http://schemas.openxmlformats.org/wordprocessingml/2006/main}}simpleType:N' || n_nationkey AS key, 1 AS n FROM nation
UNION ALL SELECT '{{http://schemas.openxmlformats.org/wordprocessingml/2006/main}}element:twice', 2 * (SELECT count(*) FROM nation)
UNION ALL SELECT '{{http://schemas.openxmlformats.org/wordprocessingml/2006/main}}attribute:x', (SELECT count(DISTINCT n_regionkey) FROM nation)""")  # fmt: skip
def declaration_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.sources.schema_set import declaration_index

    return declaration_index(_linked(spark, sf_dir)["declarations"]).select("key", F.size("declarations").cast("long").alias("n"))
