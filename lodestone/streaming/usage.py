"""Usage events as a stream: append, windowed counts and sessions. An extension; each equals its batch form."""

from __future__ import annotations

from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from lodestone.model import TABLES


def read(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    options = {"maxFilesPerTrigger": str(files_per_trigger)} if files_per_trigger else {}
    return spark.readStream.schema(schema).options(**options).parquet(folder)


def counts(events: DataFrame, width: str = "1 hour", lateness: str = "30 minutes", slide: str | None = None) -> DataFrame:
    """(start, tool, calls) per tumbling or sliding window; `events` has occurred_at and tool. Works on streams and tables."""
    found = events.withWatermark("occurred_at", lateness) if events.isStreaming else events
    window = F.window("occurred_at", width, slide) if slide else F.window("occurred_at", width)
    return found.groupBy(window.alias("w"), "tool").agg(F.count("*").alias("calls")).select(F.col("w.start").alias("start"), "tool", "calls")


def sessions(events: DataFrame, gap: str = "20 minutes", lateness: str = "30 minutes") -> DataFrame:
    """(user_id, start, end, calls) of uses no further apart than `gap`."""
    found = events.withWatermark("occurred_at", lateness) if events.isStreaming else events
    grouped = found.groupBy("user_id", F.session_window("occurred_at", gap).alias("w")).agg(F.count("*").alias("calls"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls")


def once(events: DataFrame, lateness: str = "30 minutes") -> DataFrame:
    """events without repeats of an id that arrive within the lateness."""
    return events.withWatermark("occurred_at", lateness).dropDuplicatesWithinWatermark(["id"])


def append(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of events to a table, each once."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def log(events: DataFrame, path: str, checkpoint: str, name: str = "usage") -> StreamingQuery:
    """Write a stream of events to a log, a folder per batch, as far as there are events now.

    A batch that is run again, because the driver died after its rows were
    written and before the stream knew, finds its folder finished and is not
    written again; one half written is written over. `name` tells streams that
    share a log apart, as each counts its batches from 0.
    """
    spark = events.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        folder = f"{path.rstrip('/')}/stream={name}/batch={number}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            batch.write.mode("overwrite").parquet(folder)

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def logged(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of a log, of all its streams."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


class Recorder:
    """Appends usage rows to a table, for the tools' `record`: `rows` of them a file, the rest at `flush` or the end of a `with` block.

    Rows not yet written are lost with the driver; at one row a file none are.
    """

    def __init__(self, spark: SparkSession, path: str, rows: int = 1):
        self.spark, self.path, self.rows = spark, path, rows
        self.schema = T.StructType([f for f in TABLES["usage_events"].fields if f.name != "id"])
        self._waiting: list[object] = []
        self._lock = Lock()

    def __call__(self, row: object) -> None:
        with self._lock:
            self._waiting.append(row)
            full = len(self._waiting) >= self.rows
        if full:
            self.flush()

    def flush(self) -> None:
        """Write what waits; if that fails it goes on waiting."""
        with self._lock:
            if self._waiting:
                self.spark.createDataFrame(self._waiting, self.schema).coalesce(1).write.mode("append").parquet(self.path)
                self._waiting = []

    def __enter__(self) -> Recorder:
        return self

    def __exit__(self, *_: object) -> None:
        self.flush()


def recorder(spark: SparkSession, path: str, rows: int = 1) -> Recorder:
    return Recorder(spark, path, rows)
