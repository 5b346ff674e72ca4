import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain(value):
    """A value in a form that both engines share."""
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, list | tuple):
        return [plain(x) for x in value]
    return value.asDict() if hasattr(value, "asDict") else value


@pytest.mark.parametrize(
    "name",
    ["gr5_content_model", "gr8_attributes", "fn21_sections", "snk6_upsert_symbols", "fn1_parse_qname", "lm4_top_per_part", "snk14_deep_cascade", "tool_section", "tool_namespace", "src18_shapes_xml", "snk18_part_reports", "ddl4_bucket_join"],
)
def test_rows_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    want = sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


def test_no_name_is_defined_twice_in_a_module():
    import ast
    from pathlib import Path

    for file in (Path(__file__).parents[1] / "lodestone").rglob("*.py"):
        names = [x.name for x in ast.parse(file.read_text()).body if isinstance(x, ast.FunctionDef | ast.ClassDef)]
        assert len(names) == len(set(names)), file
