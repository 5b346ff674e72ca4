"""Tables in the folder that driver and executors share, and size-checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import importable

#: Most rows and bytes that any operator broadcasts, both measured; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only a purely local session may lack it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file:" + os.path.join(tempfile.gettempdir(), "checkpoints")


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodestone-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def tidy(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """run, for mapInArrow: what Arrow keeps for later goes back after every batch, as workers live on between stages."""

    @wraps(run)
    def tidied(*args: object) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        for batch in run(*args):
            yield batch
            pool.release_unused()
        del args
        pool.release_unused()

    return tidied


def lean(texts: DataFrame, rows: int = 1_000) -> DataFrame:
    """texts, with Arrow batches of at most `rows` rows in this session: long texts come in batches of some megabytes.

    Spark reads the setting when a plan is executed, so it cannot end with the
    call: it stays lowered, the lowest bound asked for holds whatever the order
    of calls, and a lower one of the session's own is kept. Results do not
    depend on it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = importable(texts.sparkSession).conf
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return texts


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores, if it is read from fewer files and is too small to be split among them; else df as it is.

    Work that is heavy for its bytes would else run in a task or two, as a file
    of one row group cannot be shared. Tables of many or of large files, the
    usual ones on a cluster, are left where they lie.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # Only the files of a small table are listed.
    return df.repartition(cores) if size < cores * split and 0 < len(df.inputFiles()) < cores else df


def _bytes(field: T.StructField) -> Column:
    """What a value takes, at least a word each."""
    col, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + F.lit(16)
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
        return F.greatest(F.size(col), F.lit(0)) * F.lit(8) + F.lit(16)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0)) + F.lit(16)
    return F.lit(8)


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if it is measured to hold at most `limit` rows and `most` bytes, else df for a shuffled join.

    df should be a saved table or a plain selection of one: it is read to be measured.
    """
    each = reduce(lambda a, b: a + b, map(_bytes, df.schema.fields), F.lit(16)).cast("long")
    rows, size = df.select(each.alias("size")).agg(F.count("*"), F.sum("size")).first()
    return F.broadcast(df) if rows <= limit and (size or 0) <= most else df


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, rows_per_task: int = 2_000) -> DataFrame:
    """Add `out`: a gapless number from 0 within each value of `keys`.

    Large keys are split over buckets by a hash of `order`; a bucket's numbers
    start after those of the buckets before it, so no task sorts a whole key.
    Rows that agree in all of `order` may swap numbers. df must be cheap to
    compute twice (a saved table).
    """
    from pyspark.sql import Window

    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    buckets = -(-most // rows_per_task) or 1
    spread = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    own = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = spread.withColumn("_rank", F.row_number().over(own) - F.lit(1))
    if buckets == 1:
        return ranked.withColumn(out, F.col("_rank").cast("long")).drop("_rank", "_bucket")
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy(*keys, "_bucket").count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    same = [ranked[k].eqNullSafe(starts[k]) for k in [*keys, "_bucket"]]
    joined = ranked.join(starts, same).select(*[ranked[c] for c in ranked.columns], starts["_start"])
    return joined.withColumn(out, (F.col("_rank") + F.col("_start")).cast("long")).drop("_rank", "_bucket", "_start")
