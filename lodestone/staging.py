"""Cutting a plan's lineage in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The checkpoint folder: the session's spark.checkpoint.dir; only a purely local session that lacks it gets one of its own."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = "file:" + os.path.join(tempfile.gettempdir(), "checkpoints")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read from there."""
    spark = df.sparkSession
    shared(spark)
    try:
        return df.checkpoint(eager=True)
    except Py4JJavaError as error:
        # Over some unions Spark fails while it infers filters from a plan's constraints; the query is fine, so it is planned anew without them.
        if "key not found" not in str(error.java_exception):
            raise
        key = "spark.sql.constraintPropagation.enabled"
        before = spark.conf.get(key, "true")
        spark.conf.set(key, "false")
        try:
            return df.select("*").checkpoint(eager=True)
        finally:
            spark.conf.set(key, before)


def saved(df: DataFrame) -> DataFrame:
    """`cut` by Parquet files, for tables that rounds write again and again: computed once, packed, and read by the column."""
    spark = df.sparkSession
    path = f"{shared(spark)}/saved-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def saved_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """`saved`, and the number of rows."""
    seen = Observation()
    out = saved(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get.get("n") or 0


def counted(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict[str, int]]:
    """`cut`, and aggregates that are taken while the rows are written."""
    seen = Observation()
    out = cut(df.observe(seen, *[x.alias(name) for name, x in metrics.items()]))
    return out, {name: value or 0 for name, value in seen.get.items()}


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores, if it is read from fewer files and is too small to be split among them; else df as it is.

    A file of one row group cannot be shared, so work that is heavy for its
    bytes would run in a task or two, and take longer the larger the file.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * split and 0 < len(df.inputFiles()) < cores else df
