"""Registered queries of layouts and loads: each writes to the shared folder, and reads with the operator."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import embedding, lookup, merge, vector, vector_codes, versions
from lodestone.operators.number import numbered
from lodestone.plans.derived import sql, tables
from lodestone.plans.prose_queries import _COSINE, _first_vector, table
from lodestone.plans.registry import register
from lodestone.sources import shapes
from lodestone.staging import shared
from lodestone.streaming import usage


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared(spark)}/{name}-{uuid4().hex}"


@register("vec2_code_search", f"SELECT vec_id, label, round({_COSINE}, 6) AS score FROM embeddings ORDER BY {_COSINE} DESC, vec_id LIMIT 20")
def code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors are scanned for the neighbours of the first; few rows are read whole."""
    folder = _folder(spark, "codes")
    vector_codes.build(table(spark, sf_dir, "embeddings"), folder, "vec_id")
    asked = _first_vector(spark, sf_dir).first()["embedding"]
    return vector_codes.search(spark, folder, asked, vector.clamp_limit(99), id_col="vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


@register("snk2_replace_on_disk", sql("SELECT id, part_number, content_type FROM spec_content WHERE part_number <> 2 UNION ALL SELECT id + 1000000, 2, 'new' FROM spec_content WHERE part_number = 3", "spec_content"))
def replace_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is loaded, one replaced; a writer that dies after it has staged its rows changes nothing."""
    rows, path = tables(spark, sf_dir, "spec_content")["spec_content"].select("id", "part_number", "content_type"), _folder(spark, "parts")
    versions.load(rows, path)
    versions.stage(rows.where("part_number = 3").withColumn("content_type", F.lit("lost")), path, 3)
    new = rows.where("part_number = 3").select((F.col("id") + 1000000).alias("id"), F.lit(2).alias("part_number"), F.lit("new").alias("content_type"))
    versions.replace_part(new, path, 2)
    return versions.read(spark, path, rows.schema)


@register("snk3_update_vector", "SELECT vec_id, CAST(e[1] AS DOUBLE) AS first, CAST(e[len(e)] AS DOUBLE) AS last, CAST(len(e) AS INT) AS size FROM (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN list_reverse(embedding) ELSE embedding END AS e FROM embeddings)")
def update_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth row gets another vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    done = merge.update_column(rows, rows.where("vec_id % 10 = 0").select("vec_id", F.reverse("embedding").alias("embedding")), "vec_id", "embedding")
    return done.select("vec_id", F.col("embedding")[0].cast("double").alias("first"), F.element_at("embedding", -1).cast("double").alias("last"), F.size("embedding").alias("size"))


@register("snk15_stream_log", "SELECT event_id AS id, CAST(user_id AS VARCHAR) AS user_id, event_type AS tool FROM events")
def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are streamed into a log file by file; the stream forgets that its last batch was written, and runs it again."""
    folder = _folder(spark, "events")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("tool"))
    rows.repartitionByRange(4, "id").write.parquet(f"{folder}/in")
    stream = usage.read(spark, f"{folder}/in", rows.schema, files_per_trigger=1)
    usage.log(stream, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/checkpoint/commits")
    files = done.getFileSystem(spark._jsc.hadoopConfiguration())
    last = max((x.getPath() for x in files.listStatus(done) if x.getPath().getName().isdigit()), key=lambda x: int(x.getName()))
    files.delete(last, False)
    usage.log(stream, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return usage.logged(spark, f"{folder}/log", rows.schema)


class Backwards:
    """A provider's call that answers backwards, and fails at every third try; a vector is the text's length and number of spaces."""

    def __init__(self) -> None:
        self.tries = 0

    def __call__(self, texts: list[str]) -> Iterator[tuple[int, list[float]]]:
        self.tries += 1
        if self.tries % 3 == 0:
            raise ConnectionError("not now")
        return [(i, [float(len(x)), float(x.count(" "))]) for i, x in reversed(list(enumerate(texts)))]


@register("vec4_provider_order", "SELECT doc_id, length(text) AS chars, length(text) - length(replace(text, ' ', '')) AS spaces FROM documents")
def provider_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document gets the vector of its own text, whatever the order of the answers, and though calls fail."""
    provider = embedding.Provider(Backwards(), 2, "backwards", batch=64, first_wait=0.001)
    found = embedding.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), provider, "text", "vector")
    return found.select("doc_id", F.col("vector")[0].cast("long").alias("chars"), F.col("vector")[1].cast("long").alias("spaces"))


@register("src18_shapes_xml", """SELECT 'shape' || p_partkey AS name, list_concat([p_type || ' & <' || (p_partkey % 7) || '>'], list_transform(range(1, CAST(p_size % 5 + 1 AS BIGINT)), lambda i: 'adj' || (6 - i))) AS guides,
  row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part""")  # fmt: skip
def shapes_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shape per part, every tenth written twice, as XML and read back with its guides in order."""
    part = table(spark, sf_dir, "part")
    first = F.concat("p_type", F.lit(" & <"), (F.col("p_partkey") % 7).cast("string"), F.lit(">"))
    own = F.concat(F.array(first), F.expr("slice(array('adj5', 'adj4', 'adj3', 'adj2', 'adj1'), 1, CAST(p_size % 5 AS INT))"))
    rows = part.select("p_partkey", F.concat(F.lit("shape"), F.col("p_partkey").cast("string")).alias("name"), own.alias("guides"))
    twice = rows.withColumn("n", F.explode(F.when(F.col("p_partkey") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    path = _folder(spark, "shapes")
    shapes.write_shapes(twice.repartitionByRange("p_partkey").sortWithinPartitions("p_partkey", "n").select("name", "guides"), path)
    return numbered(shapes.read_shapes(spark, path), ["place"], "_at").select("name", "guides", F.col("_at").alias("place"))


@register("ddl4_point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = (SELECT max(o_custkey) FROM orders WHERE o_orderkey % 7 = 3) OR o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders sorted by their key, with Bloom filters on the customer: both are looked up."""
    orders, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), _folder(spark, "orders")
    lookup.write_sorted(orders, path, "o_orderkey", {"o_custkey": 2_000}, 32 << 10)
    customer, order = orders.agg(F.max(F.when(F.col("o_orderkey") % 7 == 3, F.col("o_custkey"))), F.max("o_orderkey")).first()
    return lookup.lookup(spark, path, o_custkey=customer).union(lookup.lookup(spark, path, o_orderkey=order)).distinct()


@register("ddl4_bucket_join", "SELECT c_custkey, c_name, count(*) AS orders, max(o_orderkey) AS last FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def bucket_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and orders in buckets of the customer's key meet, and are grouped, without a shuffle."""
    name = f"lodestone_{uuid4().hex}"
    customers = lookup.write_bucketed(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), f"{name}_c", _folder(spark, "customers"), "c_custkey", 8)
    orders = lookup.write_bucketed(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), f"{name}_o", _folder(spark, "orders"), "o_custkey", 8)
    joined = customers.join(orders.hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_custkey", "c_name").agg(F.count("*").alias("orders"), F.max("o_orderkey").alias("last"))
