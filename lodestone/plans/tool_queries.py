"""Registered queries of the tools: each answers for a table of asked names, prefixes or vectors at once."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.operators import catalog, prose, vector, vector_index
from lodestone.plans.derived import sql, tables
from lodestone.plans.graph_queries import _ATTRIBUTES, _CHAIN, _LEAVES, _MEMBER, _MODEL, _TREE, _TYPES, _WALK, ALL, BASE, CONTENT, PROFILE
from lodestone.plans.prose_queries import _COSINE, _first_vector, content, table
from lodestone.plans.registry import register
from lodestone.staging import shared

_RESOLVED = f"""{_MEMBER}, {_TYPES},
  asked AS (SELECT DISTINCT namespace_uri, local_name FROM members UNION SELECT 'urn:none', local_name FROM members WHERE id % 2 = 0),
  tops AS (SELECT namespace_uri, local_name, min(id) AS id, first(type_ref ORDER BY id) AS type_ref FROM members WHERE parent_symbol_id IS NULL AND kind = 'element' GROUP BY 1, 2),
  grouped AS (SELECT namespace_uri, local_name, min(id) AS id FROM members WHERE parent_symbol_id IS NULL AND kind = 'group' GROUP BY 1, 2),
  inline AS (SELECT m.namespace_uri, m.local_name, count(*) = count(m.type_ref) AND count(DISTINCT m.type_ref) = 1 AS agreed, min(m.type_ref) AS type_ref
    FROM members m JOIN symbols o ON o.id = m.parent_symbol_id WHERE m.kind = 'element' GROUP BY 1, 2),
  resolved AS (SELECT a.namespace_uri, a.local_name, e.id AS element_id, e.type_ref AS top_ref, i.type_ref AS inline_ref, it.id AS inline_id, i.local_name IS NOT NULL AS is_inline, t.id AS own_id, et.id AS top_id, g.id AS group_id
    FROM asked a LEFT JOIN types t USING (namespace_uri, local_name) LEFT JOIN tops e USING (namespace_uri, local_name) LEFT JOIN grouped g USING (namespace_uri, local_name) LEFT JOIN inline i USING (namespace_uri, local_name)
    LEFT JOIN types et ON e.type_ref = '{{' || et.namespace_uri || '}}' || et.local_name LEFT JOIN types it ON i.agreed AND i.type_ref = '{{' || it.namespace_uri || '}}' || it.local_name),
  owned AS (SELECT namespace_uri, local_name, is_inline, coalesce(own_id, top_id, CASE WHEN {{groups}} AND element_id IS NULL THEN group_id END, inline_id) AS owner_id,
    CASE WHEN own_id IS NOT NULL THEN 'type' WHEN top_id IS NOT NULL THEN 'element' WHEN {{groups}} AND element_id IS NULL AND group_id IS NOT NULL THEN 'group' WHEN inline_id IS NOT NULL THEN 'local' END AS via FROM resolved)"""
_OUTCOME = "CASE WHEN w.owner_id IS NOT NULL THEN 'found' WHEN w.is_inline THEN 'ambiguous' ELSE 'none' END AS outcome"


def _resolved(groups: bool) -> str:
    return _RESOLVED.replace("{groups}", str(groups).lower())


def _asked(graph: G.Graph) -> DataFrame:
    """Every name of the profile, and half of them once more in a namespace that does not exist."""
    names = G.named(graph, PROFILE)
    return names.select("namespace_uri", "local_name").union(names.where("id % 2 = 0").select(F.lit("urn:none"), "local_name")).distinct()


@register("tool_element", sql(f"""WITH {_resolved(False)} SELECT namespace_uri, local_name,
  CASE WHEN element_id IS NOT NULL THEN 'declared' WHEN inline_id IS NOT NULL THEN 'single' WHEN is_inline THEN 'ambiguous' ELSE 'none' END AS outcome,
  CASE WHEN element_id IS NOT NULL THEN top_ref WHEN inline_id IS NOT NULL THEN inline_ref END AS type_ref FROM resolved""", *BASE))  # fmt: skip
def element(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = tables(spark, sf_dir, *BASE)
    found = G.owners(graph, PROFILE, _asked(graph))
    return found.select("namespace_uri", "local_name", F.col("element_outcome").alias("outcome"), F.col("element_type").alias("type_ref"))


@register("tool_type", sql(f"""WITH {_resolved(False)},
  others AS (SELECT *, row_number() OVER (PARTITION BY local_name ORDER BY vocabulary_id, kind, namespace_uri) AS place FROM (SELECT DISTINCT local_name, vocabulary_id, kind, namespace_uri FROM members WHERE parent_symbol_id IS NULL)),
  listed AS (SELECT local_name, list(vocabulary_id || ', ' || kind || ', ' || namespace_uri ORDER BY place) AS others FROM others WHERE place <= 10 GROUP BY 1)
SELECT r.namespace_uri, r.local_name, t.kind, CASE WHEN t.kind IS NULL THEN coalesce(l.others, []) END AS others FROM resolved r LEFT JOIN types t ON t.id = r.own_id LEFT JOIN listed l ON l.local_name = r.local_name""", *BASE))  # fmt: skip
def type_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of every type, and for a name that is none what it may have meant."""
    graph = tables(spark, sf_dir, *BASE)
    asked = _asked(graph)
    line = F.concat_ws(", ", "vocabulary_id", "kind", "namespace_uri")
    listed = G.suggestions(graph, PROFILE, asked).groupBy("local_name").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))["line"].alias("others"))
    types = G.types(graph, PROFILE).select("namespace_uri", "local_name", "kind")
    found = asked.join(types, ["namespace_uri", "local_name"], "left").join(listed, "local_name", "left")
    return found.select("namespace_uri", "local_name", "kind", F.when(F.col("kind").isNull(), F.coalesce("others", F.array().cast("array<string>"))).alias("others"))


def _listed(graph: G.Graph, owners: DataFrame, rows: DataFrame, line: Column) -> DataFrame:
    """owners with the lines of their root's rows, in order."""
    lines = rows.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line"))))["line"].alias("lines"))
    found = owners.join(lines, F.col("owner_id") == F.col("root"), "left")
    return found.select("namespace_uri", "local_name", "outcome", "via", "owner_id", F.when(F.col("outcome") == "found", F.coalesce("lines", F.array().cast("array<string>"))).alias("lines"))


@register("tool_children", sql("WITH " + _resolved(True) + "," + _CHAIN.format(more="e.relation = 'extension' AND") + "," + _TREE + "," + _LEAVES + f""", model AS ({_MODEL}),
  listed AS (SELECT root, list(entry || ' ' || local_name || ' ' || min_occurs || '..' || coalesce(CAST(max_occurs AS VARCHAR), 'unbounded') || ' ' || source || ' ' || owner_name ORDER BY ordinal) AS lines FROM model GROUP BY 1)
SELECT w.namespace_uri, w.local_name, {_OUTCOME}, w.via, w.owner_id, CASE WHEN w.owner_id IS NOT NULL THEN coalesce(l.lines, []) END AS lines FROM owned w LEFT JOIN listed l ON l.root = w.owner_id""", *ALL))  # fmt: skip
def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = tables(spark, sf_dir, *CONTENT)
    owners = G.owners(graph, PROFILE, _asked(graph), groups=True)
    roots = owners.where("owner_id IS NOT NULL").select(F.col("owner_id").alias("id")).distinct()
    occurs = F.concat(F.col("min_occurs").cast("string"), F.lit(".."), F.coalesce(F.col("max_occurs").cast("string"), F.lit("unbounded")))
    return _listed(graph, owners, G.content_model(graph, PROFILE, roots), F.concat_ws(" ", "entry", "local_name", occurs, "source", "owner_name"))


@register("tool_attributes", sql("WITH " + _resolved(False) + "," + _WALK + f""", listing AS ({_ATTRIBUTES}),
  listed AS (SELECT root, list(concat_ws(' ', local_name, attr_use, default_value, source, owner_name) ORDER BY ordinal) AS lines FROM listing GROUP BY 1)
SELECT w.namespace_uri, w.local_name, {_OUTCOME}, w.via, w.owner_id, CASE WHEN w.owner_id IS NOT NULL THEN coalesce(l.lines, []) END AS lines FROM owned w LEFT JOIN listed l ON l.root = w.owner_id""", *BASE, "group_edges", "inheritance_edges", "attr_edges"))  # fmt: skip
def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = tables(spark, sf_dir, *BASE, "group_edges", "inheritance_edges", "attr_edges")
    owners = G.owners(graph, PROFILE, _asked(graph))
    roots = owners.where("owner_id IS NOT NULL").select(F.col("owner_id").alias("id")).distinct()
    return _listed(graph, owners, G.attributes(graph, PROFILE, roots), F.concat_ws(" ", "local_name", "attr_use", "default_value", "source", "owner_name"))


@register("tool_enum", sql(f"""WITH {_resolved(False)}, listed AS (SELECT symbol_id, list(value ORDER BY order_index, id) AS lines FROM enums GROUP BY 1)
SELECT r.namespace_uri, r.local_name, t.kind IS NOT NULL AS found, CASE WHEN t.kind IS NOT NULL THEN coalesce(l.lines, []) END AS lines
FROM resolved r LEFT JOIN types t ON t.id = r.own_id AND t.kind = 'simpleType' LEFT JOIN listed l ON l.symbol_id = t.id""", *BASE, "enums"))  # fmt: skip
def enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = tables(spark, sf_dir, *BASE, "enum_uses", "enum_values")
    types = G.types(graph, PROFILE).where("kind = 'simpleType'").select("namespace_uri", "local_name", F.col("id").alias("symbol_id"))
    uses, lists = G.enum_lists(graph, PROFILE)
    # The lists come last: names travel with the number of their list, not with its values.
    found = _asked(graph).join(types, ["namespace_uri", "local_name"], "left").join(uses, "symbol_id", "left").join(lists, "list_id", "left")
    known = F.col("symbol_id").isNotNull()
    return found.select("namespace_uri", "local_name", known.alias("found"), F.when(known, F.coalesce("values", F.array().cast("array<string>"))).alias("lines"))


_FOUR = ("symbols", "profiles", "namespaces", "symbol_profiles")


@register("tool_namespace", sql("""WITH counted AS (SELECT n.uri, p.name, count(*) AS c FROM symbol_profiles m JOIN namespaces n ON n.id = m.namespace_id JOIN profiles p ON p.id = m.profile_id GROUP BY 1, 2),
  words AS (SELECT n.uri, list_sort(list(DISTINCT s.vocabulary_id)) AS v FROM symbol_profiles m JOIN namespaces n ON n.id = m.namespace_id JOIN symbols s ON s.id = m.symbol_id GROUP BY 1),
  known AS (SELECT w.uri, w.v, (SELECT string_agg(name || ' ' || c, ', ' ORDER BY name) FROM counted c WHERE c.uri = w.uri) AS counts FROM words w),
  asked AS (SELECT uri AS asked, NULL AS seg FROM namespaces UNION SELECT DISTINCT 'http://x/' || lower(p_brand) || '//', lower(p_brand) FROM part UNION SELECT 'http://x/nowhere' || p_size, 'nowhere' || p_size FROM part)
SELECT a.asked, CASE WHEN k.uri IS NULL THEN 'none' WHEN k.uri = a.asked THEN 'found' ELSE 'like' END AS outcome, k.uri, k.v AS vocabularies, k.counts AS profiles
FROM asked a LEFT JOIN known k ON k.uri = a.asked OR (a.seg IS NOT NULL AND contains(lower(k.uri), a.seg))""", *_FOUR))  # fmt: skip
def namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every namespace, and URIs that are unknown: those whose last segment a namespace holds, and those of which none does."""
    graph, part = tables(spark, sf_dir, *_FOUR), table(spark, sf_dir, "part")
    near = part.select(F.concat(F.lit("http://x/"), F.lower("p_brand"), F.lit("//")).alias("asked"))
    far = part.select(F.concat(F.lit("http://x/nowhere"), F.col("p_size").cast("string")))
    found = G.namespace_answers(graph, graph["namespaces"].select(F.col("uri").alias("asked")).union(near).union(far))
    counts = F.array_join(F.transform("profiles", lambda p: F.concat_ws(" ", p["name"], p["symbol_count"].cast("string"))), ", ")
    return found.select("asked", "outcome", "uri", "vocabularies", counts.alias("profiles"))


@register("tool_search", sql("""SELECT query_id, CAST(place AS INT) AS place, id, coalesce(section_id, 'Section') || ': ' || coalesce(title, 'Untitled') AS head, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place
  FROM (SELECT q.vec_id AS query_id, s.id, s.section_id, s.title, list_cosine_similarity(CAST(s.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score
    FROM spec_content s, embeddings q WHERE q.vec_id % 20 = 0 AND s.embedding IS NOT NULL AND s.part_number = 3)) WHERE place <= 5""", "spec_content"))  # fmt: skip
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of many queries at once: every twentieth vector asks a part for its nearest sections."""
    rows = content(spark, sf_dir)
    queries = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vector.search_many(rows, queries, vector.clamp_limit(None), part=3)
    head = F.concat(F.coalesce("section_id", F.lit("Section")), F.lit(": "), F.coalesce("title", F.lit("Untitled")))
    return found.join(rows.select("id", head.alias("head")), "id").select("query_id", "place", F.col("id").cast("int").alias("id"), "head", F.round("score", 6).alias("score"))


@register("tool_section", sql("""WITH asked AS (SELECT DISTINCT split_part(section_id, '.', 1) AS prefix FROM spec_content WHERE section_id IS NOT NULL UNION SELECT DISTINCT '_.' || part_number FROM spec_content UNION SELECT '1%2'),
  hits AS (SELECT a.prefix, s.*, row_number() OVER (PARTITION BY a.prefix ORDER BY s.section_id, s.id) AS place, count(*) OVER (PARTITION BY a.prefix) AS n FROM asked a JOIN spec_content s ON s.section_id LIKE a.prefix || '%')
SELECT prefix, CAST(place AS INT) AS place, id, section_id, md5(content) AS digest, CASE WHEN n > 50 AND place = 50 THEN section_id || '#' || id END AS after FROM hits WHERE place <= 50""", "spec_content"))  # fmt: skip
def section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of every chapter, and of prefixes with wildcards."""
    rows = content(spark, sf_dir).drop("embedding")
    chapters = rows.where("section_id IS NOT NULL").select(F.substring_index("section_id", ".", 1).alias("prefix"))
    wild = rows.select(F.concat(F.lit("_."), F.col("part_number").cast("string"))).union(rows.limit(1).select(F.lit("1%2")))
    found = prose.sections_of(rows, chapters.union(wild))
    return found.select("prefix", "place", "id", "section_id", F.md5(F.col("content").cast("binary")).alias("digest"), "after")


@register("tool_parts", sql("""WITH s AS (SELECT DISTINCT part_number, section_id, title FROM spec_content WHERE title IS NOT NULL AND section_id IS NOT NULL),
  r AS (SELECT *, row_number() OVER (PARTITION BY part_number ORDER BY section_id, title) AS place, count(*) OVER (PARTITION BY part_number) AS n FROM s)
SELECT part_number, list('- **' || section_id || '**: ' || title ORDER BY place) AS lines, CAST(greatest(max(n) - 50, 0) AS INT) AS more FROM r WHERE place <= 50 GROUP BY 1""", "spec_content"))  # fmt: skip
def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of every part."""
    return prose.listed_parts(content(spark, sf_dir))


_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
# What parts of the given table ask the catalog for, and, in the SQL, what it should say.
_ASKED_TYPE = "CASE p_partkey % 7 WHEN 0 THEN 'image/png' WHEN 1 THEN 'application/xml' WHEN 2 THEN 'application/vnd.openxmlformats-officedocument.theme+xml' WHEN 3 THEN 'image/none' WHEN 4 THEN 'image/x-emf' END"
_ASKED_RELATION = f"CASE p_partkey % 7 WHEN 0 THEN '{_OFFICE}' WHEN 5 THEN '{_OFFICE}' WHEN 6 THEN 'urn:none' END"


@register("tool_package_part", "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'image' WHEN 1 THEN 'custom-xml-data' WHEN 2 THEN 'theme' WHEN 4 THEN 'image' WHEN 5 THEN 'wml-document, sml-workbook, pml-presentation' END AS keys FROM part")
def package_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part asks for a content type or a relationship; if for both, the content type decides."""
    asked = table(spark, sf_dir, "part").select("p_partkey", F.expr(_ASKED_TYPE).alias("content_type"), F.expr(_ASKED_RELATION).alias("relationship_type"))
    return catalog.answers(asked, catalog.parts(spark)).select("p_partkey", F.array_join("keys", ", ").alias("keys"))


@register("tool_preset_shape", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ['adj', 'hf', 'vf'] WHEN 1 THEN [] WHEN 3 THEN ['adj1', 'adj2'] WHEN 4 THEN ['adj'] END AS guides FROM part")
def preset_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with blanks, in the wrong case, of shapes without guides, and of no shape."""
    asked = table(spark, sf_dir, "part").select("p_partkey", F.expr("CASE p_partkey % 6 WHEN 0 THEN ' star5 ' WHEN 1 THEN 'rect' WHEN 2 THEN 'Rect' WHEN 3 THEN 'wave' WHEN 4 THEN 'sun ' ELSE p_name END").alias("shape"))
    return catalog.guides_of(asked, catalog.shapes(spark)).select("p_partkey", "guides")


@register("vec2_index_search", f"SELECT vec_id, label, round({_COSINE}, 6) AS score FROM embeddings ORDER BY {_COSINE} DESC, vec_id LIMIT 20")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is built over all vectors, then asked for the neighbours of the first."""
    folder = f"{shared(spark)}/vectors-{uuid4().hex}"
    vector_index.build(table(spark, sf_dir, "embeddings"), folder, 64, "vec_id")
    asked = _first_vector(spark, sf_dir).first()["embedding"]
    return vector_index.search(spark, folder, asked, vector.clamp_limit(99), id_col="vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))
