"""From a schema set to the symbol graph, with natural keys until ids are dealt out at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.qname import BUILTIN, attribute_use, clark, parse_max_occurs, parse_min_occurs, resolve_qname, vocabulary_of
from lodestone.operators.graph import _recursive
from lodestone.operators.merge import get_or_create
from lodestone.operators.number import numbered, numbered_counted
from lodestone.staging import counted, cut

COMPOSITORS = ("sequence", "choice", "all")
#: The order in which the kinds of a base type are tried.
BASE_KINDS = ("complexType", "simpleType", "element", "group", "attributeGroup", "attribute")


def _attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def _parent(path: Column) -> Column:
    return F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))


def _first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


class Walk:
    """The nodes of a schema set under their declarations."""

    def __init__(self, tables: dict[str, DataFrame]):
        documents = tables["documents"].select("doc", "prefixes")
        declared = tables["declarations"].join(documents, "doc")
        self.declarations = declared
        owner = declared.select("doc", "place", F.col("kind").alias("owner_kind"), F.col("local_name").alias("owner"), F.col("vocabulary_id").alias("owner_vocabulary"), "namespace", "ordinal", "prefixes")
        nodes = tables["nodes"].where(F.size("path") >= 1)
        self.nodes = cut(nodes.withColumn("place", F.col("path")[0]).join(owner, ["doc", "place"]))

    def children(self, parents: DataFrame, *tags: str) -> DataFrame:
        """Child nodes of (doc, path) rows."""
        wanted = self.nodes.where(F.col("tag").isin(*tags)) if tags else self.nodes
        return wanted.withColumn("_parent", _parent(F.col("path"))).join(parents.select("doc", F.col("path").alias("_parent")), ["doc", "_parent"])

    def roots(self, *kinds: str) -> DataFrame:
        return self.nodes.where((F.size("path") == 1) & F.col("owner_kind").isin(*kinds))

    def derivations(self, *wrappers: str) -> DataFrame:
        """extension and restriction nodes within the wrappers of complex types, with every such type's wrapper."""
        wrapped = self.children(self.roots("complexType"), *wrappers)
        return self.children(wrapped, "extension", "restriction"), wrapped

    def parents(self, group_kind: str, *wrappers: str) -> DataFrame:
        """Where the content of complex types and of `group_kind` declarations stands: the node itself or its derivations."""
        inner, wrapped = self.derivations(*wrappers)
        plain = self.roots("complexType").join(wrapped.select("doc", "place"), ["doc", "place"], "left_anti")
        keep = ["doc", "path"]
        return self.roots(group_kind).select(keep).union(plain.select(keep)).union(inner.select(keep))


def _resolved(column: str) -> Column:
    return resolve_qname(_attr(column), F.col("prefixes"), F.col("namespace"))


def _type_ref() -> Column:
    """@type in Clark form, as written if its prefix is unknown, null if there is none."""
    found = _resolved("type")
    return F.when(_attr("type").isNotNull(), F.when(found["resolved"], clark(found["namespace"], found["local_name"])).otherwise(_attr("type")))


_TOP = ["vocabulary_id", "local_name", "kind"]


def _most(known: dict[str, DataFrame], table: str) -> int:
    """The largest id of a known table, 0 if there is none."""
    return known[table].agg(F.max("id")).first()[0] or 0 if table in known else 0


def _identified(rows: DataFrame, old: DataFrame, keys: list[str], order: list[str], above: int) -> tuple[DataFrame, dict[str, int]]:
    """rows with `id`, and how many were inserted and how many existed.

    A row of a known key has its id, and its type where the row has none;
    others go on from `above` in the given order.
    """
    types = old.select(*keys, F.col("id").alias("_id"), F.col("type_ref").alias("_type"))
    found = cut(rows.join(types, keys, "left").withColumn("type_ref", F.coalesce("type_ref", "_type")).drop("_type"))
    fresh = numbered(found.where("_id IS NULL"), order, "id").withColumn("id", (F.col("id") + 1 + above).cast("int"))
    every = found.where("_id IS NOT NULL").withColumn("id", F.col("_id").cast("int")).unionByName(fresh)
    out, n = counted(every, inserted=F.count_if(F.col("_id").isNull()), existing=F.count_if(F.col("_id").isNotNull()))
    return out.drop("_id"), n


def ingest(tables: dict[str, DataFrame], profile: str, source_id: int | None = None, known: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The graph tables of one profile, plus `stats` (counter, n).

    Duplicate declarations share the first one's symbol, and each adds its
    edges. References that name nothing are counted, not fatal; an attribute
    reference into a known vocabulary is kept without a symbol. Ids are dealt
    in the order of the natural keys, top-level symbols first, so a second
    run gives the same tables.

    known: the tables of earlier runs. Their profiles, namespaces and symbols
    keep their ids, so a symbol that another profile has too is the same one;
    memberships and bases that exist stay as they are, and the profile's
    content models, attributes and values are written anew. What is returned
    then holds the known rows as well, and `stats` counts this run's alone.
    The counters are taken while the tables are written.
    """
    known = known or {}
    stats: dict[str, int] = {}
    documents, n = counted(tables["documents"], n=F.count(F.lit(1)))
    stats["documents"] = n["n"]
    walk = Walk(tables | {"documents": documents})
    spark = documents.sparkSession
    vocabulary = lambda x: vocabulary_of(x["namespace"])
    named = {r["name"]: r["id"] for r in known["profiles"].collect()} if "profiles" in known else {}
    profile_id = named.get(profile, max(named.values(), default=0) + 1)
    no_symbols = spark.createDataFrame([], "id int, vocabulary_id string, local_name string, kind string, type_ref string, parent_symbol_id int")
    old = known.get("symbols", no_symbols).select(*no_symbols.columns)

    # Symbols: the first declaration of each key.
    declared = walk.declarations.withColumn("type_ref", F.when(F.col("kind").isin("element", "attribute"), _type_ref()))
    keys = _TOP
    top = _first(declared, keys, "ordinal", "place").select(*keys, "type_ref", "namespace")

    # Inheritance: the first derivation with a base.
    inner, _ = walk.derivations("complexContent", "simpleContent")
    simple = walk.children(walk.roots("simpleType"), "restriction")
    derived = inner.unionByName(simple, allowMissingColumns=True).where(_attr("base").isNotNull())
    derived = _first(derived.withColumn("_path", F.col("path")), ["doc", "place"], "_path")
    base = _resolved("base")
    derived = derived.select("owner_vocabulary", "owner", "owner_kind", "ordinal", "place", F.col("tag").alias("relation"), base["namespace"].alias("base_namespace"), vocabulary(base).alias("base_vocabulary"), base["local_name"].alias("base_name"))
    built = derived.where(F.col("base_vocabulary") == BUILTIN).select(F.col("base_vocabulary").alias("vocabulary_id"), F.col("base_name").alias("local_name"), F.col("base_namespace").alias("namespace")).distinct()
    built = built.join(top.select("vocabulary_id", "local_name"), ["vocabulary_id", "local_name"], "left_anti")
    built = built.select("vocabulary_id", "local_name", F.lit("simpleType").alias("kind"), F.lit(None).cast("string").alias("type_ref"), "namespace")
    every = top.unionByName(built)
    ids, n = _identified(every, old.where("parent_symbol_id IS NULL"), keys, keys, _most(known, "symbols"))
    stats |= {"symbols": n["inserted"], "symbols_existing": n["existing"]}
    id_of = lambda name, *on: ids.select(F.col("id").alias(name), *[F.col(k).alias(o) for k, o in zip(keys, on, strict=True)])
    rank = F.array_position(F.array(*map(F.lit, BASE_KINDS)), F.col("_kind"))
    bases = ids.select(F.col("vocabulary_id").alias("base_vocabulary"), F.col("local_name").alias("base_name"), F.col("kind").alias("_kind"), F.col("id").alias("base_symbol_id"))
    bases = _first(bases.withColumn("_rank", rank), ["base_vocabulary", "base_name"], "_rank").drop("_rank", "_kind")
    linked, n = counted(derived.join(bases, ["base_vocabulary", "base_name"], "left"), lost=F.count_if(F.col("base_symbol_id").isNull()))
    stats["inheritance_unresolved"] = n["lost"]
    inheritance = linked.where("base_symbol_id IS NOT NULL").join(id_of("symbol_id", "owner_vocabulary", "owner", "owner_kind"), ["owner_vocabulary", "owner", "owner_kind"])
    inheritance = _first(inheritance, ["symbol_id"], "ordinal", "place").select("symbol_id", "base_symbol_id", "relation")

    # Content models: compositors by recursion over child nodes, then what hangs in them.
    content = walk.parents("group", "complexContent")
    particle = walk.nodes.where(F.col("tag").isin("element", "group", *COMPOSITORS)).withColumn("_parent", _parent(F.col("path")))
    slim = particle.where(F.col("tag").isin(*COMPOSITORS)).select("doc", "path", "_parent")
    inside = cut(_recursive(
        {"nodes": slim, "tops": content},
        """
        WITH RECURSIVE c(doc, path, parent) AS (
          SELECT n.doc, n.path, CAST(NULL AS ARRAY<INT>) FROM {nodes} n JOIN {tops} t ON n.doc = t.doc AND n._parent = t.path
          UNION ALL
          SELECT n.doc, n.path, c.path FROM c JOIN {nodes} n ON n.doc = c.doc AND n._parent = c.path)
        SELECT doc, path, parent FROM c""",
    ))
    owner = ["owner_vocabulary", "owner", "owner_kind"]
    among = Window.partitionBy("doc", "_parent").orderBy("path")
    # Direct children of all content parents of a declaration share one count.
    direct = walk.children(content, "group", *COMPOSITORS)
    top_order = direct.select("doc", "path", (F.row_number().over(Window.partitionBy("doc", "place").orderBy("path")) - 1).alias("order_index"))
    deep = particle.join(inside.select("doc", F.col("path").alias("_parent")), ["doc", "_parent"])
    deep_order = deep.select("doc", "path", (F.row_number().over(among) - 1).alias("order_index"))
    order = top_order.union(deep_order)
    rows = walk.nodes.join(inside, ["doc", "path"]).join(order, ["doc", "path"]).join(id_of("owner_id", *owner), owner)
    rows, n = numbered_counted(rows, ["ordinal", "doc", "path"], "id", n=F.count(F.lit(1)))
    stats["compositors"] = n["n"]
    rows = cut(rows.withColumn("id", (F.col("id") + 1 + _most(known, "compositors")).cast("int")))
    number = rows.select("doc", F.col("path").alias("_parent"), F.col("id").alias("compositor_id"))
    up = number.withColumnsRenamed({"_parent": "parent", "compositor_id": "parent_compositor_id"})
    occurs = [parse_min_occurs(_attr("minOccurs")).alias("min_occurs"), parse_max_occurs(_attr("maxOccurs")).alias("max_occurs")]
    compositors = rows.join(up, ["doc", "parent"], "left").select("id", F.when(F.col("parent").isNull(), F.col("owner_id")).alias("parent_symbol_id"), "parent_compositor_id", F.col("tag").alias("kind"), *occurs, "order_index")

    held = deep.join(deep_order, ["doc", "path"]).join(number, ["doc", "_parent"]).join(id_of("owner_id", *owner), owner)
    ref = _resolved("ref")
    marked = held.where("tag = 'element'").withColumns({"ref_vocabulary": vocabulary(ref), "ref_name": ref["local_name"], "has_ref": _attr("ref").isNotNull(), "name": _attr("name"), "own_type": _type_ref()})
    local = marked.where("NOT has_ref AND name IS NOT NULL")
    named_type = F.min_by("own_type", F.when(F.col("own_type").isNotNull(), F.struct("ordinal", "doc", "path")))
    local_symbols = local.groupBy("owner_id", "owner_vocabulary", "name", "namespace").agg(named_type.alias("type_ref"))
    inline = old.where("parent_symbol_id IS NOT NULL AND kind = 'element'").select("id", F.col("parent_symbol_id").alias("owner_id"), F.col("vocabulary_id").alias("owner_vocabulary"), F.col("local_name").alias("name"), "type_ref")
    above = max(ids.agg(F.max("id")).first()[0] or 0, _most(known, "symbols"))
    local_symbols, n = _identified(local_symbols, inline, ["owner_id", "owner_vocabulary", "name"], ["owner_id", "name"], above)
    stats |= {"symbols": stats["symbols"] + n["inserted"], "symbols_existing": stats["symbols_existing"] + n["existing"], "local_elements": n["inserted"] + n["existing"]}
    symbols = ids.select("id", *keys, "type_ref", F.lit(None).cast("int").alias("parent_symbol_id")).union(
        local_symbols.select("id", F.col("owner_vocabulary"), F.col("name"), F.lit("element"), "type_ref", "owner_id")
    )
    globals_ = ids.where("kind = 'element'").select(F.col("vocabulary_id").alias("ref_vocabulary"), F.col("local_name").alias("ref_name"), F.col("id").alias("child_symbol_id"))
    by_ref, n = counted(marked.where("has_ref").join(globals_, ["ref_vocabulary", "ref_name"], "left"), lost=F.count_if(F.col("child_symbol_id").isNull()))
    stats["child_edges_unresolved"] = n["lost"]
    by_name = local.join(local_symbols.select("owner_id", "name", F.col("id").alias("child_symbol_id")), ["owner_id", "name"])
    edge = [F.col("owner_id").alias("parent_symbol_id"), "compositor_id", "child_symbol_id", *occurs, "order_index"]
    child_edges = by_ref.where("child_symbol_id IS NOT NULL").select(*edge).union(by_name.select(*edge))

    hung = direct.where("tag = 'group'").join(top_order, ["doc", "path"]).join(id_of("owner_id", *owner), owner).withColumn("compositor_id", F.lit(None).cast("int"))
    refs = held.where("tag = 'group'").unionByName(hung, allowMissingColumns=True).where(_attr("ref").isNotNull())
    refs = refs.withColumn("ref_kind", F.lit("group"))

    # Attributes, attribute groups and enumerations.
    carried = walk.children(walk.parents("attributeGroup", "complexContent", "simpleContent"), "attribute", "attributeGroup").join(id_of("owner_id", *owner), owner)
    target_kind = F.when(F.col("tag") == "attribute", "attribute").otherwise("attributeGroup")
    carried = carried.withColumns({"ref": _attr("ref"), "ref_namespace": ref["namespace"], "ref_vocabulary": vocabulary(ref), "ref_name": ref["local_name"], "target": target_kind})
    targets = id_of("target_id", "ref_vocabulary", "ref_name", "target")
    carried = carried.join(targets, ["ref_vocabulary", "ref_name", "target"], "left")
    lost_attr = (F.col("tag") == "attribute") & F.col("ref").isNotNull() & F.col("ref_vocabulary").isNull()
    lost_group = (F.col("tag") == "attributeGroup") & (F.col("ref").isNull() | F.col("target_id").isNull())
    listed = carried.withColumn("counts", (F.col("tag") == "attribute") | ~lost_group)
    before = Window.partitionBy("doc", "place").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    listed = listed.withColumn("order_index", F.coalesce(F.sum(F.col("counts").cast("int")).over(before), F.lit(0)).cast("int"))
    group = F.col("tag") == "attributeGroup"
    listed, n = counted(listed, lost_attr=F.count_if(lost_attr), used=F.count_if(group & ~lost_group), lost_group=F.count_if(lost_group & F.col("ref").isNotNull()))
    stats |= {"attr_edges_unresolved": n["lost_attr"], "attr_group_refs": n["used"], "attr_group_refs_unresolved": n["lost_group"]}
    attr_decl = _first(declared.where("kind = 'attribute'"), ["namespace", "local_name"], "ordinal", "place").select(
        F.col("namespace").alias("ref_namespace"), F.col("local_name").alias("ref_name"), F.col("type_ref").alias("d_type"), _attr("default").alias("d_default"), _attr("fixed").alias("d_fixed")
    )
    attrs = listed.where((F.col("tag") == "attribute") & ~lost_attr).join(attr_decl, ["ref_namespace", "ref_name"], "left")
    by = F.col("ref").isNotNull()
    attr_edges = attrs.select(
        F.col("owner_id").alias("symbol_id"), F.when(by, F.col("target_id")).alias("attr_symbol_id"), F.when(by, F.col("ref_name")).otherwise(_attr("name")).alias("local_name"),
        attribute_use(_attr("use")).alias("attr_use"), F.coalesce(_attr("default"), F.when(by, F.col("d_default"))).alias("default_value"),
        F.coalesce(_attr("fixed"), F.when(by, F.col("d_fixed"))).alias("fixed_value"), F.when(by, F.col("d_type")).otherwise(_type_ref()).alias("type_ref"), "order_index",
    ).where("local_name IS NOT NULL")
    refs = refs.withColumns({"ref_vocabulary": vocabulary(ref), "ref_name": ref["local_name"]})
    refs = refs.join(id_of("group_symbol_id", "ref_vocabulary", "ref_name", "ref_kind"), ["ref_vocabulary", "ref_name", "ref_kind"], "left")
    refs, n = counted(refs, found=F.count_if(F.col("group_symbol_id").isNotNull()), lost=F.count_if(F.col("group_symbol_id").isNull()))
    stats |= {"group_refs": n["found"], "group_refs_unresolved": n["lost"]}
    columns = [F.col("owner_id").alias("parent_symbol_id"), "compositor_id", "group_symbol_id", "ref_kind"]
    one = F.lit(1)
    used = listed.where(group & ~lost_group)
    group_edges = refs.where("group_symbol_id IS NOT NULL").select(*columns, *occurs, "order_index").union(
        used.select("owner_id", F.lit(None).cast("int"), "target_id", F.lit("attributeGroup"), one, one, "order_index")
    )
    values = walk.children(walk.children(walk.roots("simpleType"), "restriction"), "enumeration").where(_attr("value").isNotNull()).join(id_of("symbol_id", *owner), owner)
    enums = values.select("symbol_id", _attr("value").alias("value"), F.lit(None).cast("string").alias("annotation"), (F.row_number().over(Window.partitionBy("doc", "place").orderBy("path")) - 1).alias("order_index"))

    # Namespaces, memberships and ids.
    spaces, n = counted(documents.select(F.col("target_namespace").alias("uri")).union(built.select("namespace")).distinct(), n=F.count(F.lit(1)))
    stats["namespaces"] = n["n"]
    spaces = cut(get_or_create(known["namespaces"].select("id", "uri") if "namespaces" in known else spark.createDataFrame([], "id int, uri string"), spaces, "uri"))
    own = F.lit(profile_id).alias("profile_id")
    members = ids.select(F.col("id").alias("symbol_id"), "namespace").union(local_symbols.select("id", "namespace"))
    members = members.join(spaces.select(F.col("uri").alias("namespace"), F.col("id").alias("namespace_id")), "namespace")
    members = members.select("symbol_id", own, "namespace_id", F.lit(source_id).cast("int").alias("source_id"))

    def fresh(table: str, df: DataFrame) -> DataFrame:
        """The rows whose (symbol_id, profile_id) is not known."""
        return df.join(known[table].select("symbol_id", "profile_id"), ["symbol_id", "profile_id"], "left_anti") if table in known else df

    def dealt(table: str, df: DataFrame, *order: str) -> DataFrame:
        out, n = numbered_counted(df, [*order], "id", n=F.count(F.lit(1)))
        stats[table] = n["n"]
        rest = [own] if "profile_id" not in df.columns else []
        return out.select((F.col("id") + 1 + _most(known, table)).cast("int").alias("id"), *df.columns, *rest)

    members, n = counted(fresh("symbol_profiles", members), n=F.count(F.lit(1)))
    stats["memberships"] = n["n"]
    bases = fresh("inheritance_edges", inheritance.withColumn("profile_id", F.lit(profile_id)))
    graph = {
        "profiles": spark.createDataFrame([(profile_id, profile, None)], "id int, name string, description string"),
        "namespaces": spaces,
        "symbols": symbols,
        "symbol_profiles": members,
        "compositors": compositors.withColumn("profile_id", F.lit(profile_id)),
        "child_edges": dealt("child_edges", child_edges, "compositor_id", "order_index", "child_symbol_id"),
        "attr_edges": dealt("attr_edges", attr_edges, "symbol_id", "order_index", "local_name"),
        "group_edges": dealt("group_edges", group_edges, "parent_symbol_id", "ref_kind", "compositor_id", "order_index"),
        "inheritance_edges": dealt("inheritance_edges", bases, "symbol_id"),
        "enums": dealt("enums", enums, "symbol_id", "order_index", "value"),
    }
    del stats["group_edges"]  # its two kinds are counted apart
    for table, df in graph.items():
        if table not in known or table == "namespaces":
            continue
        before = known[table].select(*df.columns)
        if table in ("profiles", "symbols"):
            graph[table] = before.join(df.select("id"), "id", "left_anti").unionByName(df)
        elif table in ("symbol_profiles", "inheritance_edges"):
            graph[table] = before.unionByName(df)
        else:
            graph[table] = before.where(F.col("profile_id") != profile_id).unionByName(df)
    return graph | {"stats": spark.createDataFrame(sorted(stats.items()), "counter string, n long")}
