"""Plans and paths that grow with the tables no faster than they do."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.functions import text as X
from lodestone.functions.qname import DEFAULT_NAMESPACE
from lodestone.operators import graph as G
from lodestone.operators import merge
from lodestone.plans.derived import tables
from lodestone.sources.schema_set import schema_set

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("view", ["child_edges", "attr_edges"])
def test_no_task_numbers_all_edges(spark, view):
    df = tables(spark, SF, view)[view]
    assert "SinglePartition" not in plan(df).split("Physical Plan")[-1].replace("rangepartitioning", "").split("BroadcastExchange")[0]
    assert sorted(r.id for r in df.select("id").collect()) == list(range(1, df.count() + 1))


def test_attributes_without_cycles_are_not_walked_root_by_root(spark, monkeypatch):
    def walked(*_):
        raise AssertionError("walked")

    monkeypatch.setattr(G, "_first_visits", walked)
    ids = "id int, parent_symbol_id int, group_symbol_id int, profile_id int, ref_kind string, order_index int"
    graph = {
        "symbols": spark.createDataFrame([(i, f"s{i}") for i in range(1, 6)], "id int, local_name string"),
        "profiles": spark.createDataFrame([(1, "p")], "id int, name string"),
        "inheritance_edges": spark.createDataFrame([(2, 1, 1), (3, 2, 1)], "symbol_id int, base_symbol_id int, profile_id int"),
        # 4 refers to itself before it refers to 5.
        "group_edges": spark.createDataFrame([(1, 3, 4, 1, "attributeGroup", 0), (2, 4, 4, 1, "attributeGroup", 0), (3, 4, 5, 1, "attributeGroup", 1)], ids),
        "attr_edges": spark.createDataFrame([(i, i, n, 1, "optional", None, None, None, 0) for i, n in ((1, "a"), (2, "b"), (3, "c"), (4, "b"), (5, "e"))], "id int, symbol_id int, local_name string, profile_id int, attr_use string, default_value string, fixed_value string, type_ref string, order_index int"),
    }
    got = {}
    for r in G.attributes(graph, "p").orderBy("root", "ordinal").collect():
        got.setdefault(r.root, []).append((r.local_name, r.source, r.owner_name))
    assert got[3] == [("c", "self", "s3"), ("b", "attributeGroup", "s4"), ("e", "attributeGroup", "s5"), ("a", "inherited", "s1")]
    assert got[4] == [("b", "self", "s4"), ("e", "attributeGroup", "s5")] and got[2] == [("b", "self", "s2"), ("a", "inherited", "s1")]


@pytest.mark.parametrize("name", ["gr10_enums", "snk18_enum_reports"])
def test_shared_lists_are_ordered_once(spark, name):
    assert "Window" not in plan(entry.queries()[name](spark, SF)).split("Physical Plan")[-1].replace("WindowGroupLimit", "")


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_values_of_one_list_are_the_work_of_many_tasks(spark, monkeypatch, most):
    """Before, the tasks were as many as the bytes of both sides need, and one task made all rows of a list once lists were not broadcast."""
    for name, value in (("TASK_ROWS", 1000), ("BLOCK", 8), ("CELL_ROWS", 160), ("BROADCAST_VALUES", most)):
        monkeypatch.setattr(G, name, value, raising=False)
    uses = spark.createDataFrame([(i, 1 + (i == 7), i % 100 and 1) for i in range(400)] + [(400, 1, 2), (401, 1, None), (402, 1, 9)], "symbol_id int, profile_id int, list_id int")
    values = spark.createDataFrame([(0, 60, 1, "b"), (0, 50, 1, "a"), (0, 70, 0, None)] + [(1, i, 99 - i // 2, f"v{i}") for i in range(50)] + [(3, 80, 0, "x"), (None, 81, 0, "y")], "list_id int, id int, order_index int, value string")
    profiles = spark.createDataFrame([(1, "p"), (2, "q")], "id int, name string")
    own = uses.join(values, "list_id").drop("list_id")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        found = G.enums({"enum_uses": uses, "enum_values": values, "profiles": profiles}, "p").withColumn("task", F.spark_partition_id()).collect()
        want = G.enums({"enums": own, "profiles": profiles}, "p").collect()
    finally:
        spark.conf.set(key, before)
    rows = sorted(((r.symbol_id, r.ordinal, r.value or "") for r in found))
    assert rows == sorted((r.symbol_id, r.ordinal, r.value or "") for r in want) and len(rows) == 395 * 50 + 4 * 3
    if most:
        tasks = [r.task for r in found]
        assert len(set(tasks)) > 4 and max(map(tasks.count, set(tasks))) < len(rows) / 4


def test_reports_are_made_without_python(spark):
    assert "InArrow" not in plan(entry.queries()["snk18_children_reports"](spark, SF))


def test_sections_of_one_file_are_the_work_of_all_cores(spark, tmp_path):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('**1** **T', id, '**\\n\\ntext') AS md", "0 AS page_offset")
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    found = X.sections(spark.read.parquet(str(tmp_path / "docs"))).select("doc_id", "title", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.doc_id, r.title) for r in found) == [(i, f"T{i}") for i in range(400)]
    assert len({r.task for r in found}) > 1


def test_schemas_are_parsed_once(spark):
    """Before, every table that reads the nodes parsed the files again."""
    text = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="%s"><xs:complexType name="T"/></xs:schema>' % DEFAULT_NAMESPACE
    found = schema_set(spark.createDataFrame([("a.xsd", text)], "path string, xml string"), ["a.xsd"])
    assert [r.local_name for r in found["declarations"].collect()] == ["T"]
    assert not any("MapInPandas" in plan(df) for df in found.values())


@pytest.mark.parametrize("most", [merge.BROADCAST_KEYS, 0])
def test_a_cascade_sorts_no_table(spark, monkeypatch, most):
    """Before, every table was sorted by every reference it holds, once its keys were too many to be broadcast unasked."""
    monkeypatch.setattr(merge, "BROADCAST_KEYS", most)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        symbols = spark.range(60).selectExpr("CAST(id AS INT) AS id", "CASE WHEN id % 3 <> 0 THEN CAST(id - 1 AS INT) END AS parent_symbol_id")
        edges = spark.range(60).selectExpr("CAST(id AS INT) AS id", "CAST(id AS INT) AS parent_symbol_id", "CAST((id * 7) % 60 AS INT) AS child_symbol_id")
        left = merge.cascade({"symbols": symbols, "child_edges": edges}, spark.range(0, 30, 3).select("id"))
        assert not any("SortMergeJoin" in plan(df) for df in left.values())
        assert sorted(r.id for r in left["symbols"].collect()) == list(range(30, 60))
        assert sorted(r.id for r in left["child_edges"].collect()) == [i for i in range(30, 60) if i * 7 % 60 >= 30]
    finally:
        spark.conf.set(key, before)
