"""Gapless numbers over a whole order, without a task that holds the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.staging import counted, cut


def numbered(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """df with `out`: each row's place from 0 in the order, which should be total.

    Rows are dealt out by ranges of the order and numbered within their range;
    a range begins after those before it, whose counts are one row each. The
    dealt rows are written once, so that counts and numbers see the same ranges.
    """
    return numbered_counted(df, order, out)[0]


def numbered_counted(df: DataFrame, order: list[Column | str], out: str, **metrics: Column) -> tuple[DataFrame, dict[str, int]]:
    """`numbered`, and aggregates that are taken while the dealt rows are written."""
    # The aggregates stand behind the exchange, as Spark reads the rows before it twice to find the ranges.
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt, found = counted(dealt, **metrics) if metrics else (cut(dealt), {})
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    ranked = dealt.withColumn("_own", own)
    return ranked.join(F.broadcast(starts), "_range").withColumn(out, (F.col("_start") + F.col("_own")).cast("long")).drop("_range", "_own", "_start"), found
