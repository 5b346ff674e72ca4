"""Declared schemas of the specification tables, and their integrity rules as violation reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"I": T.IntegerType(), "L": T.LongType(), "S": T.StringType(), "B": T.BooleanType(), "TS": T.TimestampType(), "V": T.ArrayType(T.FloatType())}


def _table(columns: str) -> T.StructType:
    """`name TYPE` pairs; a type ending in ? may be null."""
    fields = (x.split() for x in columns.split(","))
    return T.StructType([T.StructField(n, _TYPES[t.rstrip("?")], t.endswith("?")) for n, t in fields])


TABLES: dict[str, T.StructType] = {
    "schema_migrations": _table("name S, checksum S, applied_at TS"),
    "reference_sources": _table("id I, name S, kind S, edition S?, version S?, url S?, license_note S?, sha256 S?, fetched_at TS, created_at TS"),
    "spec_content": _table("id I, part_number I, section_id S?, title S?, content S, content_type S, page_number I?, embedding V?, source_id I?, created_at TS"),
    "usage_events": _table("id L, user_id S, client_id S, tool S, surface S, occurred_at TS"),
    "profiles": _table("id I, name S, description S?"),
    "namespaces": _table("id I, uri S"),
    "symbols": _table("id I, vocabulary_id S, local_name S, kind S, type_ref S?, parent_symbol_id I?, payload S?"),
    "symbol_profiles": _table("id I, symbol_id I, profile_id I, namespace_id I, source_id I?"),
    "compositors": _table("id I, parent_symbol_id I?, parent_compositor_id I?, profile_id I, kind S, min_occurs I, max_occurs I?, order_index I"),
    "child_edges": _table("id I, parent_symbol_id I, compositor_id I, child_symbol_id I, profile_id I, min_occurs I, max_occurs I?, order_index I"),
    "attr_edges": _table("id I, symbol_id I, attr_symbol_id I?, local_name S, profile_id I, attr_use S, default_value S?, fixed_value S?, type_ref S?, order_index I"),
    "group_edges": _table("id I, parent_symbol_id I, compositor_id I?, group_symbol_id I, profile_id I, ref_kind S, resolved B, min_occurs I, max_occurs I?, order_index I"),
    "inheritance_edges": _table("id I, symbol_id I, base_symbol_id I, profile_id I, relation S"),
    "enums": _table("id I, symbol_id I, profile_id I, value S, annotation S?, order_index I"),
    "behavior_notes": _table("id I, symbol_id I?, app S, version_scope S?, claim_type S, summary S, source_id I?, section_id S?, confidence S?"),
}

# The closed domains of the enumerated columns.
DOMAINS: dict[tuple[str, str], tuple[str, ...]] = {
    ("compositors", "kind"): ("sequence", "choice", "all"),
    ("attr_edges", "attr_use"): ("required", "optional", "prohibited"),
    ("group_edges", "ref_kind"): ("group", "attributeGroup"),
    ("inheritance_edges", "relation"): ("extension", "restriction"),
    ("behavior_notes", "claim_type"): ("ignores", "requires_despite_optional", "writes", "reads_but_ignores", "layout_behavior", "varies_from_spec"),
}

KEYS: dict[str, tuple[str, ...]] = {
    "schema_migrations": ("name",),
    "reference_sources": ("name",),
    "profiles": ("name",),
    "namespaces": ("uri",),
    "symbols": ("vocabulary_id", "local_name", "kind", "parent_symbol_id"),
    "symbol_profiles": ("symbol_id", "profile_id"),
    "inheritance_edges": ("symbol_id", "profile_id"),
}

#: What columns refer to: the table whose id they hold, and whether a delete there takes the row along.
REFERENCES: dict[str, dict[str, tuple[str, bool]]] = {
    "spec_content": {"source_id": ("reference_sources", False)},
    "symbols": {"parent_symbol_id": ("symbols", True)},
    "symbol_profiles": {"symbol_id": ("symbols", True), "profile_id": ("profiles", True), "namespace_id": ("namespaces", False), "source_id": ("reference_sources", False)},
    "compositors": {"parent_symbol_id": ("symbols", True), "parent_compositor_id": ("compositors", True), "profile_id": ("profiles", True)},
    "child_edges": {"parent_symbol_id": ("symbols", True), "compositor_id": ("compositors", True), "child_symbol_id": ("symbols", False), "profile_id": ("profiles", True)},
    "attr_edges": {"symbol_id": ("symbols", True), "attr_symbol_id": ("symbols", False), "profile_id": ("profiles", True)},
    "group_edges": {"parent_symbol_id": ("symbols", True), "compositor_id": ("compositors", True), "group_symbol_id": ("symbols", False), "profile_id": ("profiles", True)},
    "inheritance_edges": {"symbol_id": ("symbols", True), "base_symbol_id": ("symbols", False), "profile_id": ("profiles", True)},
    "enums": {"symbol_id": ("symbols", True), "profile_id": ("profiles", True)},
    "behavior_notes": {"symbol_id": ("symbols", True), "source_id": ("reference_sources", False)},
}


def duplicate_keys(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Key values that occur more than once; nulls are values, so two null parents clash."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dangling(df: DataFrame, column: str, target: DataFrame, target_key: str = "id") -> DataFrame:
    """Rows whose reference is set but has no target."""
    keys = target.select(F.col(target_key).alias("_key"))
    return df.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_key"), "left_anti")


def outside_domain(df: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    return df.where(~F.col(column).isin(*domain) | F.col(column).isNull())


def parents_not_exclusive(df: DataFrame) -> DataFrame:
    """Compositors with both parents or neither."""
    return df.where(F.col("parent_symbol_id").isNull() == F.col("parent_compositor_id").isNull())


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rule, n): how many rows or keys break each rule of the given tables."""
    found = []

    def count(df: DataFrame, table: str, rule: str) -> None:
        found.append(df.agg(F.count("*").alias("n")).select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), "n"))

    for table, df in tables.items():
        if table in KEYS:
            count(duplicate_keys(df, KEYS[table]), table, "unique " + ", ".join(KEYS[table]))
        for (of, column), domain in DOMAINS.items():
            if of == table:
                count(outside_domain(df, column, domain), table, f"domain of {column}")
        if table == "compositors":
            count(parents_not_exclusive(df), table, "one parent")
        for column, (target, _) in REFERENCES.get(table, {}).items():
            if target in tables and column in df.columns:
                count(dangling(df, column, tables[target]), table, f"{column} in {target}")
    return reduce(DataFrame.union, found)
