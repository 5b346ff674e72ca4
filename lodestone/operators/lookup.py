"""Tables laid out for lookups: sorted with Bloom filters for single keys, bucketed for joins.

Parquet has no secondary index. Rows sorted by a key give row groups narrow
bounds on it, and a Bloom filter tells whether a row group holds a value of a
column it is not sorted by; readers pass over row groups that cannot match.
Buckets let tables meet on their key without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sorted(df: DataFrame, path: str, key: str, bloom: dict[str, int] | None = None, group_bytes: int = 8 << 20) -> None:
    """Write df sorted by `key` over all files, with row groups of about `group_bytes`, and Bloom filters.

    bloom: columns that are looked up too, with about how many values a row
    group has. Null keys come first.
    """
    out = df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").option("parquet.block.size", group_bytes)
    # Row groups end where the writer looks at their size, so it has to look often enough.
    out = out.option("parquet.page.size.row.check.min", 100).option("parquet.block.size.row.check.min", 100).option("parquet.page.size", max(1024, group_bytes // 16))
    for column, values in (bloom or {}).items():
        out = out.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", values).option(f"parquet.enable.dictionary#{column}", "false")
    out.parquet(path)


def lookup(spark: SparkSession, path: str, **values: object) -> DataFrame:
    """The rows that hold the given values; nulls are looked up as nulls."""
    rows = spark.read.parquet(path)
    for column, value in values.items():
        rows = rows.where(F.col(column).isNull() if value is None else F.col(column) == value)
    return rows


def lookup_many(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in the table of keys; of a small table of keys the scan gets their least and greatest."""
    low, high, n = keys.agg(F.min(key), F.max(key), F.count("*")).first()
    if not n or low is None:
        return rows.limit(0)
    return rows.where(F.col(key).between(low, high)).join(keys.select(key).distinct(), key, "left_semi")


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """df as a bucketed, sorted table of the catalog with its files at `path`; joins and groups on `key` need no shuffle.

    Tables meet without a shuffle if they have the same number of buckets; take
    it from the size of the larger one, a few hundred MB a bucket.
    """
    # Each task would write a file per bucket; dealt out by the buckets' own hash a bucket is one file.
    dealt = df.repartition(buckets, F.col(key))
    dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def exchanges(df: DataFrame) -> int:
    """How many shuffles the plan of df has."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def rows_scanned(df: DataFrame) -> int:
    """Run df; how many rows its scans gave, after row groups and pages were passed over."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if node.nodeName().startswith("Scan "):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total

