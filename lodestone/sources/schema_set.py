"""A set of XML schemas as tables: documents, prefixes, imports and top-level declarations."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.qname import declaration_key, strip_prefix, vocabulary_of
from lodestone.operators.graph import import_closure
from lodestone.operators.number import numbered
from lodestone.sources.xmlnodes import parse
from lodestone.staging import saved

KINDS = ("complexType", "simpleType", "element", "group", "attributeGroup", "attribute")
XML_NAMESPACE = "http://www.w3.org/XML/1998/namespace"


def relative_path(base: str, path: str) -> str:
    """`path` as seen from the folder `base`; an error if it lies outside."""
    found = posixpath.relpath(path, base)
    if found.startswith("..") or posixpath.isabs(found):
        raise ValueError(f"{path} is outside {base}")
    return found


def path_within(base: Column, path: Column) -> Column:
    """`path` as seen from the folder `base`, both normalised; null if it lies outside or is the folder itself."""
    folder, own = _plain(F.split(base, "/")), _plain(F.split(path, "/"))
    inside = (F.size(own) > F.size(folder)) & (F.slice(own, 1, F.size(folder)) == folder) & (base.startswith("/") == path.startswith("/"))
    return F.when(inside, F.array_join(F.slice(own, F.size(folder) + 1, F.greatest(F.size(own), F.lit(1))), "/"))


def prefix_map(attrs: Column) -> Column:
    """Prefix to namespace from a root's attributes; the default namespace has the empty prefix, `xml` is always there."""
    own = F.map_filter(attrs, lambda k, _: (k == "xmlns") | k.startswith("xmlns:"))
    cut = F.transform_keys(own, lambda k, _: F.when(k == "xmlns", F.lit("")).otherwise(F.substring(k, F.lit(7), F.length(k))))
    rest = F.map_filter(cut, lambda k, _: k != "xml")
    return F.map_concat(rest, F.create_map(F.lit("xml"), F.lit(XML_NAMESPACE)))


def _plain(parts: Column) -> Column:
    """The parts of a path with . and .. worked off."""
    step = lambda out, x: F.when(x.isin("", "."), out).when((x == "..") & (F.size(out) > 0) & (F.element_at(out, -1) != ".."), F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(x)))
    return F.aggregate(parts, F.array().cast("array<string>"), step)


def _resolve(document: Column, location: Column) -> Column:
    """A schemaLocation seen from its document, with . and .. worked off."""
    folder = F.regexp_replace(document, "[^/]*$", "")
    return F.array_join(_plain(F.split(F.concat(folder, location), "/")), "/")


def schema_set(files: DataFrame, entrypoints: list[str]) -> dict[str, DataFrame]:
    """Tables of the documents reached from `entrypoints`: nodes, documents, imports, declarations.

    documents: doc, ordinal (by hops, then path), target_namespace, prefixes.
    imports: document, namespace, target (null without a location).
    declarations: doc, place, key, kind, local_name, namespace, vocabulary_id,
    ordinal, attrs. A document without a schema root or target namespace, a
    missing file, an import that leaves the folder and an unknown target
    namespace are errors.
    """
    # Written once: every table below reads the nodes, and each would parse the files again.
    nodes = saved(parse(files).withColumn("tag", strip_prefix(F.col("tag"))))
    roots = nodes.where(F.size("path") == 0)
    imports = nodes.where((F.size("path") == 1) & (F.col("tag") == "import")).select(
        F.col("doc").alias("document"), F.try_element_at("attrs", F.lit("namespace")).alias("namespace"),
        _resolve(F.col("doc"), F.try_element_at("attrs", F.lit("schemaLocation"))).alias("target"),
    )
    escaped = F.raise_error(F.concat(F.lit("import leaves the schema folder: "), F.col("target")))
    imports = imports.withColumn("target", F.when(F.col("target").startswith("../"), escaped).otherwise(F.col("target")))
    reached = import_closure(imports, entrypoints)
    own = roots.select(F.col("doc").alias("path"), "tag", "attrs")
    root = reached.join(own, "path", "left").withColumnRenamed("path", "doc")
    target = F.try_element_at("attrs", F.lit("targetNamespace"))
    fault = F.when(F.col("tag").isNull(), "no such file: ").when(F.col("tag") != "schema", "no schema root: ").when(target.isNull(), "no targetNamespace: ")
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.col("doc")))).otherwise(target)
    placed = numbered(root.select("doc", "hops", checked.alias("target_namespace"), prefix_map(F.col("attrs")).alias("prefixes")), ["hops", "doc"], "ordinal")
    documents = placed.select("doc", (F.col("ordinal") + 1).cast("int").alias("ordinal"), "target_namespace", "prefixes")
    inside = nodes.join(documents.select("doc", "ordinal", "target_namespace"), "doc")
    local = F.try_element_at("attrs", F.lit("name"))
    top = inside.where((F.size("path") == 1) & F.col("tag").isin(*KINDS) & local.isNotNull())
    declarations = top.select(
        "doc", F.col("path")[0].alias("place"), declaration_key(F.col("target_namespace"), F.col("tag"), local).alias("key"), F.col("tag").alias("kind"), local.alias("local_name"),
        F.col("target_namespace").alias("namespace"), vocabulary_of(F.col("target_namespace"), strict=True).alias("vocabulary_id"), "ordinal", "attrs",
    )
    return {"nodes": inside.drop("ordinal", "target_namespace"), "documents": documents, "imports": imports.join(documents.select(F.col("doc").alias("document")), "document"), "declarations": declarations}


def declaration_index(declarations: DataFrame) -> DataFrame:
    """(key, declarations): every declaration of a key, in document order."""
    one = F.struct("ordinal", "place", "doc")
    return declarations.groupBy("key").agg(F.sort_array(F.collect_list(one)).alias("declarations"))
