import os

import pytest

from lodestone import model
from lodestone.operators import graph as G
from lodestone.operators import merge
from lodestone.operators.ingest import ingest
from lodestone.plans.tools import METHOD_NOT_FOUND, Engine, ToolError, rpc
from lodestone.sources.schema_set import declaration_index, relative_path, schema_set
from lodestone.staging import cut
from lodestone.sources.xmlnodes import read_files, xml_nodes

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
T = "http://schemas.openxmlformats.org/officeDocument/2006/sharedTypes"
FOLDER = os.path.join(os.path.dirname(__file__), "fixtures", "schemas")


@pytest.fixture(scope="module")
def tables(spark):
    return {k: cut(v) for k, v in schema_set(read_files(spark, FOLDER), ["main.xsd"]).items()}


@pytest.fixture(scope="module")
def graph(tables):
    return {k: cut(v) for k, v in ingest(tables, "transitional").items()}


def root(graph, name, kind="complexType"):
    return graph["symbols"].where(f"local_name = '{name}' AND kind = '{kind}'")


def children(graph, name, kind="complexType"):
    return G.content_model(graph, "transitional", root(graph, name, kind)).orderBy("ordinal").collect()


def attributes(graph, name):
    return G.attributes(graph, "transitional", root(graph, name)).orderBy("ordinal").collect()


def test_nodes_keep_order_and_prefixes():
    rows = xml_nodes('<a:r xmlns:a="u" v="01"><b> x </b><c/><b>y</b></a:r>')
    assert [(r[0], r[1], r[3]) for r in rows] == [([], "a:r", ""), ([0], "b", "x"), ([1], "c", ""), ([2], "b", "y")]
    assert rows[0][2] == {"xmlns:a": "u", "v": "01"}


def test_schema_set(tables):
    docs = {r.doc: r for r in tables["documents"].collect()}
    assert list(sorted(docs)) == ["common/types.xsd", "main.xsd"]
    assert docs["main.xsd"].prefixes[""] == W and docs["main.xsd"].prefixes["t"] == T and "xml" in docs["main.xsd"].prefixes
    assert {(r.document, r.target) for r in tables["imports"].collect()} == {("main.xsd", "common/types.xsd"), ("main.xsd", None), ("common/types.xsd", "main.xsd")}
    counts = {r.kind: r["count"] for r in tables["declarations"].groupBy("kind").count().collect()}
    assert counts == {"complexType": 16, "simpleType": 2, "group": 1, "attributeGroup": 2, "element": 1, "attribute": 1}
    twice = declaration_index(tables["declarations"]).where("size(declarations) > 1").collect()
    assert [r.key for r in twice] == [f"{{{W}}}complexType:Blank"]


def test_paths_stay_inside():
    assert relative_path("/a/b", "/a/b/c/d.xsd") == "c/d.xsd"
    with pytest.raises(ValueError):
        relative_path("/a/b", "/a/c.xsd")


@pytest.mark.parametrize("xml", ['<x:y xmlns:x="http://www.w3.org/2001/XMLSchema"/>', '<x:schema xmlns:x="http://www.w3.org/2001/XMLSchema"/>'])
def test_faulty_documents_fail(spark, xml):
    files = spark.createDataFrame([("f.xsd", xml)], "path string, xml string")
    with pytest.raises(Exception, match="f.xsd"):
        schema_set(files, ["f.xsd"])["documents"].collect()


def test_ingest_counts(graph):
    n = {r.counter: r.n for r in graph["stats"].collect()}
    assert n == {
        "documents": 2, "namespaces": 3, "symbols": 34, "symbols_existing": 0, "memberships": 34, "inheritance_edges": 6, "inheritance_unresolved": 0, "compositors": 12,
        "child_edges": 12, "child_edges_unresolved": 1, "local_elements": 11, "group_refs": 2, "group_refs_unresolved": 0, "attr_edges": 10,
        "attr_edges_unresolved": 1, "attr_group_refs": 2, "attr_group_refs_unresolved": 1, "enums": 3,
    }


def test_ingest_again_is_the_same(tables, graph):
    again = ingest(tables, "transitional")
    for name in ("symbols", "compositors", "child_edges", "attr_edges", "group_edges", "inheritance_edges"):
        assert sorted(map(repr, again[name].collect())) == sorted(map(repr, graph[name].collect())), name


def test_no_rule_is_broken(graph):
    assert [r for r in model.violations({k: v for k, v in graph.items() if k != "stats"}).collect() if r.n] == []


def test_children_in_document_order(graph):
    assert [(c.local_name, c.compositor_path) for c in children(graph, "Ordered")] == [
        ("a", ["sequence(1..1)"]), ("b", ["sequence(1..1)", "choice(1..1)"]), ("c", ["sequence(1..1)", "choice(1..1)"]), ("d", ["sequence(1..1)"]),
    ]
    body = children(graph, "Body")
    assert [(c.entry, c.local_name) for c in body] == [("element", "page"), ("group", "Inline"), ("element", "note")]
    assert body[1].compositor_path[-1] == "choice(0..unbounded)" and body[1].namespace_uri is None
    assert [(c.local_name, c.source, c.owner_name) for c in children(graph, "Extended")] == [("first", "inherited", "Base"), ("second", "self", "Extended")]
    assert children(graph, "Narrow") == [] and children(graph, "BlankPlus") == []
    assert [(c.entry, c.local_name) for c in children(graph, "GroupFirst")] == [("group", "Inline")]
    assert [c.local_name for c in children(graph, "Inline", "group")] == ["run"]


def test_attributes(graph):
    assert [(a.local_name, a.source, a.owner_name) for a in attributes(graph, "Nested")] == [("own", "self", "Nested"), ("wide", "attributeGroup", "Outer"), ("deep", "attributeGroup", "Inner")]
    assert [(a.local_name, a.attr_use, a.source) for a in attributes(graph, "Narrow")] == [("y", "prohibited", "self"), ("x", "optional", "inherited")]
    assert [a.local_name for a in attributes(graph, "Same")] == ["x", "y"]
    linked = attributes(graph, "Linked")[0]
    assert (linked.local_name, linked.attr_use, linked.default_value, linked.type_ref) == ("stamp", "required", "none", "{http://www.w3.org/2001/XMLSchema}string")


def test_cycles_end(spark):
    symbols = spark.createDataFrame([(i, "v", f"s{i}", "complexType", None, None) for i in range(1, 5)], "id int, vocabulary_id string, local_name string, kind string, type_ref string, parent_symbol_id int")
    one = spark.createDataFrame([(1, "p")], "id int, name string")
    inherit = spark.createDataFrame([(1, 1, 2, 1, "extension"), (2, 2, 1, 1, "extension")], "id int, symbol_id int, base_symbol_id int, profile_id int, relation string")
    groups = spark.createDataFrame([(1, 3, None, 4, 1, "attributeGroup", 1, 1, 0), (2, 4, None, 3, 1, "attributeGroup", 1, 1, 0)], "id int, parent_symbol_id int, compositor_id int, group_symbol_id int, profile_id int, ref_kind string, min_occurs int, max_occurs int, order_index int")
    attrs = spark.createDataFrame([(i, i, None, f"a{i}", 1, "optional", None, None, None, 0) for i in range(1, 5)], "id int, symbol_id int, attr_symbol_id int, local_name string, profile_id int, attr_use string, default_value string, fixed_value string, type_ref string, order_index int")
    graph = {"symbols": symbols, "profiles": one, "inheritance_edges": inherit, "group_edges": groups, "attr_edges": attrs}
    found = {}
    for r in G.attributes(graph, "p").collect():
        found.setdefault(r.root, []).append(r.local_name)
    assert {k: sorted(v) for k, v in found.items()} == {1: ["a1", "a2"], 2: ["a1", "a2"], 3: ["a3", "a4"], 4: ["a3", "a4"]}
    assert G.base_chain(graph, "p").where("root = 1").count() == 2


def test_tools(spark, graph):
    log = []
    engine = Engine(spark, graph, record=log.append)
    assert "Element `page`" in engine.call("element", {"qname": "w:page"})
    assert "ambiguous" in engine.call("element", {"qname": "grid"})
    assert "Local element `width`" in engine.call("element", {"qname": "width"})
    assert "Complex type `Base`" in engine.call("type", {"qname": f"{{{W}}}Base"})
    assert "`first` [1..1]" in engine.call("children", {"qname": "w:page"})
    assert "`run`" in engine.call("children", {"qname": "w:Inline"})
    assert "`tone` (required)" in engine.call("attributes", {"qname": "w:note"})
    assert engine.call("enum", {"qname": "w:Side"}).index("both") < engine.call("enum", {"qname": "w:Side"}).index("right")
    assert "Not found" in engine.call("enum", {"qname": "w:Base"})
    assert "no namespace goes by the prefix zz" in engine.call("type", {"qname": "zz:A"})
    assert "Did you mean" in engine.call("type", {"qname": "s:Base"})
    assert "wml-main" in engine.call("namespace", {"uri": W})
    assert "sharedTypes" in engine.call("namespace", {"uri": "urn:x/SHAREDTYPES//"})
    assert "Image Part" in engine.call("package_part", {"content_type": "image/png"})
    assert "share this relationship" in engine.call("package_part", {"relationship_type": "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"})
    assert "`adj8`" in engine.call("preset_shape", {"shape": " callout3 "})
    assert "no adjust guides" in engine.call("preset_shape", {"shape": "rect"})
    assert "No preset shape" in engine.call("preset_shape", {"shape": "Rect"})
    calls = len(log)
    with pytest.raises(ToolError) as error:
        engine.call("nothing")
    assert error.value.code == METHOD_NOT_FOUND and len(log) == calls
    assert rpc(engine, {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "search", "arguments": {}}})["error"]["code"] == -32602
    assert len(rpc(engine, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"})["result"]["tools"]) == 11

    def broken(_):
        raise OSError

    assert "rect" in Engine(spark, graph, record=broken).call("preset_shape", {"shape": "rect"})


def test_lattices_of_groups_are_walked_once(spark):
    """Each level refers twice to the next: two to the depth ways, one visit each."""
    depth = 24
    groups = [(i * 10 + k, i, None, i + 1, 1, "attributeGroup", 1, 1, k) for i in range(1, depth) for k in (0, 1)]
    groups.append((900, depth, None, 1, 1, "attributeGroup", 1, 1, 0))  # and a cycle
    tables = {
        "profiles": spark.createDataFrame([(1, "transitional")], "id int, name string"),
        "symbols": spark.createDataFrame([(i, f"g{i}") for i in range(1, depth + 1)], "id int, local_name string"),
        "group_edges": spark.createDataFrame(groups, "id int, parent_symbol_id int, compositor_id int, group_symbol_id int, profile_id int, ref_kind string, min_occurs int, max_occurs int, order_index int"),
        "inheritance_edges": spark.createDataFrame([], "symbol_id int, base_symbol_id int, profile_id int"),
        "attr_edges": spark.createDataFrame([(i, i, f"a{i}", 1, "optional", None, None, None, 0) for i in range(1, depth + 1)], "id int, symbol_id int, local_name string, profile_id int, attr_use string, default_value string, fixed_value string, type_ref string, order_index int"),
    }
    got = G.attributes(tables, "transitional", tables["symbols"].where("id = 1")).orderBy("ordinal").collect()
    assert [r.local_name for r in got] == [f"a{i}" for i in range(1, depth + 1)]
    assert [r.source for r in got] == ["self"] + ["attributeGroup"] * (depth - 1)


def test_compositors_end_at_one_they_have_met(spark):
    rows = [(1, 7, None), (2, None, 1), (3, None, 2), (4, 8, 5), (5, None, 4)]
    tables = {
        "profiles": spark.createDataFrame([(1, "transitional")], "id int, name string"),
        "compositors": spark.createDataFrame([(i, s, p, 1, "sequence", 1, 1, 0) for i, s, p in rows], "id int, parent_symbol_id int, parent_compositor_id int, profile_id int, kind string, min_occurs int, max_occurs int, order_index int"),
    }
    assert sorted((r.owner, r.compositor_id, len(r.path)) for r in G.compositor_tree(tables, "transitional").collect()) == [(7, 1, 1), (7, 2, 2), (7, 3, 3), (8, 4, 1), (8, 5, 2)]


def test_names_are_resolved_together_as_one_by_one(spark, graph):
    names = ["page", "grid", "width", "Base", "Inline", "Side", "note", "nothing"]
    asked = spark.createDataFrame([(W, x) for x in names] + [(W, "page"), (None, "page"), ("urn:none", None)], "namespace_uri string, local_name string")
    found = {(r.namespace_uri, r.local_name): r for r in G.owners(graph, "transitional", asked, groups=True).collect()}
    assert len(found) == len(names) + 2
    got = {x: (found[W, x].element_outcome, found[W, x].outcome, found[W, x].via) for x in names}
    assert got["page"] == ("declared", "found", "element")
    assert got["grid"] == ("ambiguous", "ambiguous", None) and got["width"][0] == "single"
    assert got["Base"] == ("none", "found", "type") and got["Side"] == ("none", "found", "type")
    assert got["Inline"] == ("none", "found", "group") and got["nothing"] == ("none", "none", None)
    assert found[None, "page"].outcome == "none" and found["urn:none", None].outcome == "none"
    assert G.owners(graph, "transitional", asked.limit(0)).count() == 0
    assert G.owners(graph, "transitional", asked.where("local_name = 'Inline'")).first().outcome == "none"
    listed = G.suggestions(graph, "transitional", asked.where("local_name = 'Base'")).collect()
    assert [r.place for r in listed] == list(range(1, len(listed) + 1)) and listed


def test_a_section_report_is_read_page_by_page(spark):
    rows = [(i, 1, f"1.{i % 3}" if i < 9 else "1", "a title" if i % 2 else None, f"text {i}") for i in range(12)]
    content = spark.createDataFrame(rows, "id int, part_number int, section_id string, title string, content string")
    whole = Engine(spark, content=content).call("section", {"section_id": "1"})
    engine, after, order = Engine(spark, content=content, page_rows=5), None, []
    for _ in range(3):
        text = engine.call("section", {"section_id": "1", "after": after})
        order += [x for x in text.split("\n") if x.startswith("text ")]
        after = text.rpartition("after `")[2].removesuffix("`.") if "More follows" in text else None
    assert after is None and order == [x for x in whole.split("\n") if x.startswith("text ")] and len(order) == 12
    with pytest.raises(ToolError):
        engine.call("section", {"section_id": "1", "after": "nothing"})


def nested_graph(spark):
    symbols = [(1, None), (2, 1), (3, 2), (4, 3), (5, None), (6, 7), (7, 6), (8, None)]  # 1 holds 2 holds 3 holds 4; 6 and 7 hold each other
    compositors = [(10, 3, None), (11, None, 10), (12, None, 11), (13, None, 12), (14, None, 13), (20, 5, None), (21, None, 20)]
    return {
        "symbols": spark.createDataFrame(symbols, "id int, parent_symbol_id int"),
        "compositors": spark.createDataFrame(compositors, "id int, parent_symbol_id int, parent_compositor_id int"),
        "child_edges": spark.createDataFrame([(1, 3, 14, 5), (2, 5, 21, 8), (3, 5, 20, 4)], "id int, parent_symbol_id int, compositor_id int, child_symbol_id int"),
        "group_edges": spark.createDataFrame([(1, 5, 14, 8), (2, 5, None, 8)], "id int, parent_symbol_id int, compositor_id int, group_symbol_id int"),
        "behavior_notes": spark.createDataFrame([(1, 4), (2, None), (3, 6)], "id int, symbol_id int"),
        "unknown": spark.createDataFrame([(1, 1)], "id int, symbol_id int"),
    }


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_delete_leaves_no_orphan_at_any_depth(spark):
    graph = nested_graph(spark)
    left = merge.cascade(graph, spark.createDataFrame([(1,), (1,), (None,), (99,)], "id int"))
    assert {k: ids(v) for k, v in left.items()} == {"symbols": [5, 6, 7, 8], "compositors": [20, 21], "child_edges": [2], "group_edges": [2], "behavior_notes": [2, 3], "unknown": [1]}
    for table, refs in model.REFERENCES.items():
        for column, (target, _) in refs.items():
            if table in left and target in left and column in left[table].columns:
                assert model.dangling(left[table], column, left[target]).isEmpty(), (table, column)
    assert ids(merge.cascade(graph, spark.createDataFrame([(7,)], "id int"))["symbols"]) == [1, 2, 3, 4, 5, 8]
    nothing = merge.cascade(graph, spark.createDataFrame([], "id int"))
    assert {k: ids(v) for k, v in nothing.items()} == {k: ids(v) for k, v in graph.items()}


def test_a_delete_may_be_refused(spark):
    graph = nested_graph(spark)
    with pytest.raises(Exception, match="child_edges.child_symbol_id still refers to symbols 4"):
        merge.cascade(graph, spark.createDataFrame([(1,)], "id int"), restrict=True)["child_edges"].collect()
    left = merge.cascade(graph, spark.createDataFrame([(10,)], "id int"), "compositors", restrict=True)
    assert ids(left["compositors"]) == [20, 21] and ids(left["child_edges"]) == [2, 3] and ids(left["symbols"]) == ids(graph["symbols"])


def chain_graph(spark, edges, count):
    return {
        "profiles": spark.createDataFrame([(1, "p")], "id int, name string"),
        "symbols": spark.range(1, count + 1).selectExpr("CAST(id AS INT) AS id"),
        "inheritance_edges": edges.selectExpr("CAST(src AS INT) AS symbol_id", "CAST(dst AS INT) AS base_symbol_id", "1 AS profile_id", "'extension' AS relation"),
    }


def test_a_chain_of_twenty_thousand_types(spark):
    n = 20_000
    graph = chain_graph(spark, spark.range(1, n).selectExpr("id AS src", "id + 1 AS dst"), n)
    found = G.base_chain(graph, "p", graph["symbols"].where("id IN (1, 19990)"))
    got = found.groupBy("root").agg({"type": "sum", "depth": "max", "*": "count"}).collect()
    assert {r.root: (r["count(1)"], r["sum(type)"], r["max(depth)"]) for r in got} == {1: (n, n * (n + 1) // 2, n - 1), 19990: (11, sum(range(19990, 20001)), 10)}


def test_chains_end_in_cycles_of_any_length(spark):
    steps = {1: 2, 2: 3, 3: 4, 4: 5, 5: 3, 6: 6, 7: 8, 9: 1}  # 3, 4 and 5 go round, 6 is its own base
    graph = chain_graph(spark, spark.createDataFrame(list(steps.items()), "src int, dst int"), 9)
    want = set()
    for root in range(1, 10):
        at, depth, seen = root, 0, set()
        while at and at not in seen:
            seen.add(at)
            want.add((root, at, depth))
            at, depth = steps.get(at), depth + 1
    assert {tuple(r) for r in G.base_chain(graph, "p").collect()} == want
    assert {tuple(r) for r in G.base_chain(chain_graph(spark, graph["inheritance_edges"].limit(0).selectExpr("symbol_id AS src", "base_symbol_id AS dst"), 3), "p").collect()} == {(i, i, 0) for i in (1, 2, 3)}


def test_deep_compositors(spark):
    n = 300
    rows = [(i, 7 if i == 1 else None, i - 1 if i > 1 else None) for i in range(1, n + 1)] + [(500, None, 501), (501, None, 502), (502, None, 500), (600, None, 601), (700, None, None)]
    tables = {
        "profiles": spark.createDataFrame([(1, "p")], "id int, name string"),
        "compositors": spark.createDataFrame([(i, s, p, 1, "choice", 1, None, i % 3) for i, s, p in rows], "id int, parent_symbol_id int, parent_compositor_id int, profile_id int, kind string, min_occurs int, max_occurs int, order_index int"),
    }
    got = sorted(G.compositor_tree(tables, "p").collect(), key=lambda r: r.compositor_id)
    assert [(r.owner, r.compositor_id, len(r.path)) for r in got] == [(7, i, i) for i in range(1, n + 1)]
    assert got[-1].place == [x for i in range(1, n + 1) for x in (i % 3, 2, i)]


def test_a_second_profile_shares_the_symbols(tables, graph):
    both = {k: cut(v) for k, v in ingest(tables, "strict", 7, {k: v for k, v in graph.items() if k != "stats"}).items()}
    n = {r.counter: r.n for r in both["stats"].collect()}
    assert (n["symbols"], n["symbols_existing"], n["memberships"], n["compositors"], n["inheritance_edges"]) == (0, 34, 34, 12, 6)
    assert sorted(map(repr, both["symbols"].collect())) == sorted(map(repr, graph["symbols"].select(*both["symbols"].columns).collect()))
    assert {r["name"]: r.id for r in both["profiles"].collect()} == {"transitional": 1, "strict": 2}
    for name in ("compositors", "child_edges", "attr_edges", "group_edges", "inheritance_edges", "enums"):
        assert both[name].count() == 2 * graph[name].count() == both[name].select("id").distinct().count(), name
    assert [r for r in model.violations({k: v for k, v in both.items() if k != "stats"}).collect() if r.n] == []
    for profile in ("transitional", "strict"):
        got = G.content_model(both, profile, root(both, "Ordered")).orderBy("ordinal").collect()
        assert [c.local_name for c in got] == ["a", "b", "c", "d"]
    again = ingest(tables, "strict", 7, {k: v for k, v in both.items() if k != "stats"})
    assert {r.counter: r.n for r in again["stats"].collect()}["memberships"] == 0 and again["child_edges"].count() == both["child_edges"].count()
