import hashlib

import pytest

from lodestone.llm.exactdedup import build_directory, exact_duplicates

SCHEMA = "doc_id long, text string, key string, bucket string, keep_id long"


def rows(spark, data):
    return exact_duplicates(spark.createDataFrame([(a, b, "x", "y", 0) for a, b in data], SCHEMA), capacity=3).collect()


def test_matches_grouping_by_text(spark):
    data = [(i, ["a", "b", "", None, f"own {i}"][i % 5]) for i in range(60)] + [(7, "b"), (7, "b"), (None, "a"), (None, "z")]
    got = rows(spark, data)
    assert len(got) == len(data)
    groups = {}
    for i, t in data:
        groups.setdefault(t or "", []).append(i)
    of = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = {}
    for r in got:
        ids = of[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) == {1}


def test_empty_table_and_very_long_text(spark):
    assert rows(spark, []) == []
    long = "word " * 300_000
    assert sorted((r.doc_id, r.kept) for r in rows(spark, [(1, long), (2, long), (3, long + "x")])) == [(1, False), (2, True), (3, True)]


@pytest.mark.parametrize("capacity", [1, 5, 1000])
def test_directory_covers_every_key(spark, capacity):
    keys = spark.range(200).selectExpr("xxhash64(id) AS key")
    directory, depth = build_directory(keys, capacity)
    found = directory.collect()
    owner = {r.pointer: r.bucket for r in found}
    load = {}
    for r in keys.collect():
        pointer = (r.key % (1 << 64)) >> (64 - depth) if depth else 0
        load[owner[pointer]] = load.get(owner[pointer], 0) + 1
    assert len(owner) == len(found)
    assert max(load.values()) <= capacity


def test_only_the_full_bucket_splits(spark):
    from pyspark.sql import functions as F

    few = spark.range(64).select(F.shiftleft("id", 58).alias("key"))  # four keys in each sixteenth
    crowd = spark.range(300).select((F.lit(5 << 60) + F.col("id") * (1 << 44)).cast("long").alias("key"))
    directory, depth = build_directory(few.union(crowd).distinct(), 60)
    buckets = {r.bucket: r.depth for r in directory.collect()}
    start = min(buckets.values())
    crowded = {b for b in buckets if int(b.split("/")[0]) >> (buckets[b] - start) == 5 >> (4 - start)}
    assert depth > start and all(buckets[b] == start for b in buckets.keys() - crowded)
    assert len({r.pointer for r in directory.collect()}) == 1 << depth


def test_a_second_batch_is_looked_up_and_added(spark, tmp_path):
    folder = f"file:{tmp_path}/index"
    make = lambda data: spark.createDataFrame([(a, b, "x", "y", 0) for a, b in data], SCHEMA)
    first = [(i, f"text {i % 40}") for i in range(100)] + [(None, ""), (7, "alone")]
    second = [(500 + i, f"text {i}") for i in range(30, 60)] + [(1, "alone"), (2, None), (3, "alone"), (3, "alone")]
    got = exact_duplicates(make(first), capacity=5, index=folder).collect()
    assert sorted((r.doc_id or -1, r.keep_id) for r in got if r.text_sha256 == hashlib.sha256(b"alone").hexdigest()) == [(7, 7)]
    got = exact_duplicates(make(second), capacity=5, index=folder).collect()
    groups = {}
    for i, t in first + second:
        groups.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), []).append(i)
    assert len(got) == len(second)
    for r in got:
        ids = groups[r.text_sha256]
        assert (r.group_size, r.keep_id) == (len(ids), max(i for i in ids if i is not None))
    kept = spark.read.parquet(f"{folder}/v2/buckets")
    assert {r.sha: r.group_size for r in kept.collect()} == {k: len(v) for k, v in groups.items()}
    directory = {r.bucket for r in spark.read.parquet(f"{folder}/v2/directory").collect()}
    assert {r.bucket for r in kept.collect()} <= directory and kept.groupBy("bucket").count().agg({"count": "max"}).first()[0] <= 5
    old = {r.bucket for r in spark.read.parquet(f"{folder}/v1/directory").collect()}
    assert old & directory and directory - old


def test_texts_with_no_copy_do_not_move_where_keys_are_many(spark, monkeypatch):
    from lodestone.llm import exactdedup

    monkeypatch.setattr(exactdedup, "small", lambda df, *a: df)
    data = [(i, f"text {i % 90}") for i in range(130)] + [(900 + i, f"own {i}") for i in range(200)]
    got = rows(spark, data)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == sorted((i, i + 90 if i < 40 else i, 2 if i < 40 or 90 <= i < 130 else 1) for i, _ in data)
    docs = spark.createDataFrame(data, "id long, t string").selectExpr("id", "t", "xxhash64(t) AS key")
    twice = docs.groupBy("key").count().where("count > 1").select("key")
    marked = exactdedup._marked(docs, twice)
    assert {r.id for r in marked.collect()} == {i for i, _ in data if i < 40 or 90 <= i < 130}
