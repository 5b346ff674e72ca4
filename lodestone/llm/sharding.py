"""Shards of near-equal bytes by longest-processing-time scheduling."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import numbered, saved

#: Groups of at least 1 / (shards * GRAIN) of all bytes are scheduled one by one; smaller ones in as many bundles.
GRAIN = 1024
ROW_BYTES = 8


def schedule(sizes: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Longest first, each to the least-loaded shard; ties by item, then by shard number."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, item in sorted(sizes, key=lambda x: (-x[0], str(x[1]))):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out[item] = shard
    return out


def shards(docs: DataFrame, count: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard (null).

    Equal texts stay together (null texts are a group of their own); loads are
    as equal in bytes as that allows, a group above its share filling a shard.
    Size is the text's UTF-8 bytes plus 8; a null text has the crc of no
    bytes. slot numbers a shard's rows from 0 without gaps; repeated rows get
    a slot each. Empty tables give empty results; other columns are ignored.

    The driver schedules at most shards * 1024 large groups, and the others in
    at most as many hash bundles, whatever the corpus: both tables are bounded
    by these numbers and are broadcast. Text is read once and never shuffled.
    Loads differ by one item at most, a large group or a bundle; a bundle holds
    about one in 24,576 of the bytes, so bundling costs a shard about one part
    in a thousand of its share.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col(text_col).isNull(), F.lit("null")).otherwise(F.sha2(text, 256)).alias("group"),
    )
    base = saved(base.withColumn("bundle", F.pmod(F.xxhash64("group"), F.lit(count * GRAIN)).cast("int")), "sized")
    total = base.agg(F.sum("size")).first()[0] or 0
    groups = saved(base.groupBy("group", "bundle").agg(F.sum("size").alias("size")), "groups")
    large = F.col("size") * (count * GRAIN) >= total
    items = [(r["size"], r["group"]) for r in groups.where(large).select("size", "group").collect()]
    items += [(r["size"], r["bundle"]) for r in groups.where(~large).groupBy("bundle").agg(F.sum("size").alias("size")).collect()]
    plan = schedule(items, count)
    alone = spark.createDataFrame([(k, v) for k, v in plan.items() if isinstance(k, str)], "group string, own int")
    bundled = spark.createDataFrame([(k, v) for k, v in plan.items() if isinstance(k, int)], "bundle int, shared int")
    placed = base.join(F.broadcast(alone), "group", "left").join(F.broadcast(bundled), "bundle", "left")
    placed = placed.select("doc_id", "size", "text_crc32", F.coalesce("own", "shared").alias("shard"))
    done = numbered(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
