"""Registered queries of files: each writes to the shared folder and reads its files with the operator."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import datetime
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import merge, migrations, prose
from lodestone.plans.derived import sql, tables
from lodestone.plans.prose_queries import table
from lodestone.plans.registry import register
from lodestone.plans.tools import TOOLS, Engine, ToolError
from lodestone.session import importable
from lodestone.sources import files
from lodestone.sources.schema_set import path_within
from lodestone.staging import shared
from lodestone.streaming import usage


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared(spark)}/{name}-{uuid4().hex}"


@register("src9_nested_archives", "SELECT CAST(page_id AS VARCHAR) AS path, sha256(coalesce(html, '')) AS sha256 FROM pages")
def nested_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page packed into an archive within an archive, and read back."""

    def packed(name: str, content: bytes) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            archive.writestr("other", b"")
            archive.writestr(name, content)
        return out.getvalue()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.iloc[at : at + 100]
                yield pd.DataFrame({"path": part["path"], "content": [packed("inner.zip", packed("page.html", (x or "").encode())) for x in part["html"]]})

    importable(spark)
    archives = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), "html").mapInPandas(run, "path string, content binary")
    return files.archive_entries(archives, ["inner.zip", "page.html"]).select("path", F.sha2("content", 256).alias("sha256"))


@register("src11_stage_scan", "SELECT CAST(c_custkey AS VARCHAR) AS sectionId, c_name AS title, CAST(c_nationkey AS INT) AS pageStart, c_name || chr(10) || '\"quoted\"' AS content FROM customer")
def stage_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage file is one JSON array; the customers of each nation make one, which a task writes."""
    name, path = F.col("c_name"), _folder(spark, "stage")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("_file"), F.col("c_custkey").alias("_at"), F.col("c_custkey").cast("string").alias("sectionId"), name.alias("title"), F.col("c_nationkey").cast("int").alias("pageStart"), F.concat(name, F.lit('\n"quoted"')).alias("content"))
    files.write_stage_documents(rows, path, "_file", "_at")
    return files.stage(spark, path, files.SECTIONS).select("sectionId", "title", "pageStart", "content")


@register("snk17_stage_write", sql("SELECT section_id AS \"sectionId\", title, page_number AS \"pageStart\", md5(content) AS digest FROM spec_content", "spec_content"))
def stage_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables(spark, sf_dir, "spec_content")["spec_content"]
    path = _folder(spark, "stage")
    files.write_stage(rows.select(F.col("section_id").alias("sectionId"), "title", F.col("page_number").alias("pageStart"), "content"), path)
    return spark.read.schema(files.SECTIONS).json(path).select("sectionId", "title", "pageStart", F.md5("content").alias("digest"))


@register("src12_migration_files", "SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '_' || lower(replace(s_name, '#', '_')) || '.sql' AS name, sha256('-- ' || s_name || chr(10)) AS checksum FROM supplier")
def migration_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A migration for each supplier, and a file of another kind, packed into archives by the tasks and read from them."""
    folder, suppliers = _folder(spark, "migrations"), table(spark, sf_dir, "supplier")
    name = F.concat(F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit("_"), F.lower(F.replace("s_name", F.lit("#"), F.lit("_"))), F.lit(".sql"))
    rows = suppliers.select(name.alias("name"), F.concat(F.lit("-- "), "s_name", F.lit("\n")).alias("content"))
    files.write_migrations(rows.union(suppliers.limit(1).select(F.lit("README.md"), "s_name")), folder)
    return files.archived_migrations(spark, folder).select("name", "checksum")


@register("snk16_tracked_migrations", "SELECT n_name AS name, md5(n_name) AS checksum, n_regionkey <> 2 AS before FROM nation")
def tracked_migrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger that knows the migrations of four regions; those of the fifth run, and are recorded together."""
    path = _folder(spark, "ledger")
    every = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.md5(F.col("n_name").cast("binary")).alias("checksum"), "n_regionkey")
    old, new = (F.lit(x).cast("timestamp") for x in ("2020-01-01", "2021-01-01"))
    migrations.baseline(every.where("n_regionkey <> 2"), path, old)
    migrations.migrate(every.drop("n_regionkey"), path, lambda name: None, new)
    return migrations.ledger(spark, path).select("name", "checksum", (F.col("applied_at") == old).alias("before"))


@register("src8_fetch", "SELECT sha256(text || chr(10)) AS sha256, CAST(strlen(text) + 1 AS INT) AS size FROM benchmark")
def fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text is put in a file of its own, and fetched from its URL as the manifest of all says."""
    folder = _folder(spark, "sources")
    table(spark, sf_dir, "benchmark").select("text").write.option("maxRecordsPerFile", 1).text(folder)
    there = spark.read.format("binaryFile").load(folder)
    manifest = there.select(F.col("path").alias("name"), F.col("path").alias("url"), F.sha2("content", 256).alias("sha256"))
    return prose.fetched(manifest).select("sha256", F.length("content").alias("size"))


@register("src6_path_guard", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'c/' || p_partkey || '.xsd' WHEN 1 THEN p_partkey || '.xsd' WHEN 2 THEN 'x/' || p_partkey || '.xsd' END AS found FROM part""")
def path_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths within a folder, with detours or not; and those that leave it, by a parent, by another root, or as its namesake."""
    k, name = F.col("p_partkey") % 6, F.concat(F.col("p_partkey").cast("string"), F.lit(".xsd"))
    at = lambda x: F.concat(F.lit(x), name)
    path = F.when(k == 0, at("/a/b/c/")).when(k == 1, at("/a/./b//")).when(k == 2, at("/a/b/y/../x/")).when(k == 3, at("/a/b/../")).when(k == 4, at("a/b/")).otherwise(at("/a/bb/"))
    return table(spark, sf_dir, "part").select("p_partkey", path_within(F.lit("/a/b"), path).alias("found"))


@register("snk4_clear_restart", "SELECT CAST(row_number() OVER (ORDER BY c_name, c_custkey) AS INT) AS id, c_name AS name FROM customer")
def clear_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table emptied: it keeps its columns, and ids begin anew."""
    path, customers = _folder(spark, "cleared"), table(spark, sf_dir, "customer")
    old = customers.select((F.col("c_custkey") + 500).cast("int").alias("id"), F.col("c_name").alias("name"))
    old.write.parquet(path)
    merge.clear(path, old)
    new = customers.select(F.col("c_name").alias("name"), "c_custkey")
    return merge.insert(spark.read.parquet(path), new, ["name", "c_custkey"])


@register("snk15_usage_append", "SELECT 'preset_shape' AS tool, n_name AS user_id, CAST(1 + n_regionkey % 2 AS BIGINT) AS calls FROM nation")
def usage_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user per nation calls a tool; calls that succeed are recorded, those that fail are not. One call is one report, so the driver makes them."""
    path = _folder(spark, "usage")
    with usage.recorder(spark, path, rows=8) as record:
        engine = Engine(spark, record=record, clock=lambda: datetime(2024, 1, 1))
        for r in table(spark, sf_dir, "nation").collect():
            for shape in ("star5", "none")[: 1 + r["n_regionkey"] % 2]:
                engine.call("preset_shape", {"shape": shape}, user=r["n_name"])
            try:
                engine.call("section", {}, user=r["n_name"])
            except ToolError:
                continue
    return spark.read.parquet(path).groupBy("tool", "user_id").agg(F.count("*").alias("calls"))


@register("fn31_tool_names", "SELECT tool, tool IN ('search', 'section', 'parts', 'element', 'type', 'children', 'attributes', 'enum', 'namespace', 'package_part', 'preset_shape') AS known FROM (SELECT DISTINCT event_type AS tool FROM events UNION SELECT 'search' UNION SELECT 'preset_shape')")
def tool_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").select(F.col("event_type").alias("tool")).union(spark.createDataFrame([("search",), ("preset_shape",)], "tool string")).distinct()
    return asked.select("tool", F.col("tool").isin(*TOOLS).alias("known"))
