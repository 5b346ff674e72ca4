"""Exact duplicates through an extendible-hash index kept on shared files.

The directory leads from the first bits of a text's 64-bit key to a bucket; it
doubles while a bucket is overfull, and only that bucket splits. Buckets in a
row belong to one owner task, which has the chains of their keys: for each key
the different texts under it, told apart byte by byte. Every row's result is
read from its bucket. The buckets stay in a folder, if one is named, and a
later batch of documents is looked up there and added.
"""

from __future__ import annotations

from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import saved, small

#: Distinct keys that one bucket of the index holds at most.
BUCKET_KEYS = 20_000
#: Bits that the directory uses at most; a bucket that is overfull beyond them keeps its keys in longer chains.
MAX_DEPTH = 24
#: Bits of the map that tells most texts without copies apart before they would move: 2 ** 21 words of 64 bits.
MAP_BITS = 27


def _prefix(key: str, depth: int | Column) -> Column:
    """The first `depth` bits of a key."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.col(key), (F.lit(64) - depth).cast("int")))


def build_directory(keys: DataFrame, capacity: int = BUCKET_KEYS, known: DataFrame | None = None) -> tuple[DataFrame, int]:
    """The directory (pointer, place, bucket, depth) over distinct 64-bit `key`s, and its global depth.

    Buckets that hold more than `capacity` keys split in two, and again, until
    none does; others keep their depth, and several pointers lead to them.
    place orders the buckets and does not change when others split. known: the
    buckets (prefix, depth) of an earlier directory, which this one extends.
    """
    spark = keys.sparkSession
    if known is None:
        start = min(MAX_DEPTH, max(0, int(log2(max(1, keys.count() / capacity))) - 1))
        cells = spark.range(1 << start).select(F.col("id").alias("prefix"), F.lit(start).alias("depth"))
    else:
        cells = known.select("prefix", "depth")
    depths = [r[0] for r in cells.select("depth").distinct().collect()]
    mine = F.explode(F.array(*[F.struct(_prefix("key", d).alias("prefix"), F.lit(d).alias("depth")) for d in sorted(depths)]))
    open_ = keys.select("key", mine.alias("c")).select("key", "c.*") if len(depths) > 1 else keys.select("key", _prefix("key", depths[0]).alias("prefix"), F.lit(depths[0]).alias("depth"))
    closed = []
    while True:
        counts = open_.groupBy("prefix", "depth").agg(F.count("*").alias("n"))
        counted = saved(cells.join(counts, ["prefix", "depth"], "left").withColumn("n", F.coalesce("n", F.lit(0))), "cells")
        splits = (F.col("n") > capacity) & (F.col("depth") < MAX_DEPTH)
        closed.append(counted.where(~splits))
        full = counted.where(splits).select("prefix", "depth")
        if full.isEmpty():
            break
        cells = full.select(F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"), (F.col("depth") + 1).alias("depth"))
        deeper = open_.join(small(full), ["prefix", "depth"], "left_semi").withColumn("depth", F.col("depth") + 1)
        open_ = deeper.select("key", _prefix("key", F.col("depth")).alias("prefix"), "depth")
    buckets = saved(reduce(DataFrame.union, closed).select("prefix", "depth"), "buckets")
    depth = buckets.agg(F.max("depth")).first()[0]
    span = lambda bits: F.col("prefix") * F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(bits) - F.col("depth")).cast("int"))
    width = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(depth) - F.col("depth")).cast("int"))
    pointers = F.explode(F.sequence(span(depth), span(depth) + width - 1))
    name = F.concat(F.col("prefix").cast("string"), F.lit("/"), F.col("depth").cast("string"))
    return saved(buckets.select(pointers.alias("pointer"), span(MAX_DEPTH).alias("place"), name.alias("bucket"), "prefix", "depth"), "directory"), depth


def _versions(spark: SparkSession, folder: str) -> tuple[list[int], object]:
    """Numbers of the finished versions of an index, and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path(folder)):
        return [], files
    names = [x.getPath().getName() for x in files.listStatus(path(folder))]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and files.exists(path(f"{folder}/{n}/directory/_SUCCESS"))), files


def _marked(base: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows whose key may be among the repeated ones: all of these, and others as seldom as the map is full.

    The map is a table of 2 ** (MAP_BITS - 6) words at most, whatever the corpus.
    """
    word, bit = F.pmod(F.shiftright("key", 6), F.lit(1 << (MAP_BITS - 6))), F.pmod(F.col("key"), F.lit(64)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bits = saved(repeated.groupBy(word.alias("_word")).agg(F.bit_or(one).alias("_bits")), "map")
    return base.withColumn("_word", word).join(F.broadcast(bits), "_word").where(F.col("_bits").bitwiseAND(one) != 0).drop("_word", "_bits")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_KEYS, index: str | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. The row with
    the largest id stays. Of repeated rows (same id, same text) one stays.
    A null id stays only where all ids of its group are null. An empty table
    gives an empty result; other columns are ignored.

    index: a folder for the index. What earlier calls put there is looked up:
    keep_id and group_size then count those rows too, which are known by key,
    SHA-256 and length. The new version is finished before it is read, and the
    one before the last is deleted.

    Rows are first reduced to 64-bit keys, and a key that occurs once is put
    into its bucket without its text. Texts under repeated keys go to the
    owners of their buckets, copies collapsed before that in each task, so
    that a text with a third of all rows moves a row a task. Where repeated
    keys are too many to broadcast, a map of bits of fixed size keeps most
    other texts from moving.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t")).withColumn("key", F.xxhash64("t"))
    told = [F.sha2("t", 256).alias("sha"), F.octet_length("t").cast("long").alias("length")]
    entries = saved(base.select("id", "key", *told).groupBy("id", "key", "sha", "length").agg(F.count("*").alias("n")), "entries")
    keys = saved(entries.groupBy("key").agg(F.sum("n").alias("n"), F.max("id").alias("id"), F.max("sha").alias("sha"), F.max("length").alias("length")), "keys")
    versions, files = _versions(spark, index) if index else ([], None)
    before = spark.read.parquet(f"{index}/v{versions[-1]}/buckets") if versions else None
    known = spark.read.parquet(f"{index}/v{versions[-1]}/directory").select("prefix", "depth").distinct() if versions else None
    every = keys.select("key") if before is None else keys.select("key").union(before.select("key")).distinct()
    directory, depth = build_directory(every, capacity, known)
    owned = lambda df: df.withColumn("pointer", _prefix("key", depth)).join(small(directory.select("pointer", "place", "bucket")), "pointer").drop("pointer")

    # Texts under repeated keys meet at their buckets' owners, who chain the different ones.
    repeated = saved(owned(keys.where("n > 1").select("key")), "repeated")
    wanted = base.join(near, "key") if (near := small(repeated)) is not repeated else _marked(base, repeated).join(repeated, "key")
    sent = wanted.withColumn("_task", F.spark_partition_id()).groupBy("place", "bucket", "key", "t", "_task").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    chains = sent.repartitionByRange("place").groupBy("place", "bucket", "key", "t").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    columns = ["place", "bucket", "key", "sha", "length", "keep_id", "group_size"]
    chains = saved(chains.select(*told, *[c for c in columns if c not in ("sha", "length")]), "chains")
    single = owned(keys.where("n = 1").select("key", "sha", "length", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")))
    rows = chains.select(*columns).unionByName(single.select(*columns))
    if before is not None:
        rows = rows.unionByName(owned(before.drop("place", "bucket")).select(*columns))
        rows = rows.groupBy("place", "bucket", "key", "sha", "length").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    buckets = rows.repartitionByRange("place").sortWithinPartitions("place", "key", "sha").select(*columns)
    if index:
        folder = f"{index}/v{(versions or [0])[-1] + 1}"
        buckets.write.mode("overwrite").parquet(f"{folder}/buckets")
        directory.write.mode("overwrite").parquet(f"{folder}/directory")
        for old in versions[:-1]:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{index}/v{old}"), True)
        buckets = spark.read.parquet(f"{folder}/buckets")
    else:
        buckets = saved(buckets, "index")

    # Every row reads its chain.
    found = entries.join(buckets.drop("place", "bucket"), ["key", "sha", "length"])
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return found.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
