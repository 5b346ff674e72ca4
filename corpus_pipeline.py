"""A training corpus from raw documents: filtered, cleaned, deduplicated, mixed and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import linededup, mixing, nearcopies, packing, toxicity
from lodestone.llm.store import saved


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without its source's boilerplate lines; n_chars follows the text."""
    cleaned = linededup.drop_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles at Jaccard 0.8, or fingerprints within 3 bits."""
    return nearcopies.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a document taken twice is packed twice."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hashing, fitted scores and packing are beyond SQL; tests hold the stages and the whole run against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written as Parquet and read again by the next.

    Null, empty and wordless texts score as texts without terms, have no lines
    to drop, form one group of near copies, of which a row stays, pass the mix
    once and are packed as their end id. Rows may share an id or have none:
    rows are near copies by their texts, of a group the smallest id stays, and
    rows that agree in id and text become one. Null sources are a source, null
    langs and n_chars stay as they are. Long texts are read whole. Columns
    besides those of documents go along up to packing. An empty table, or one
    of which nothing is left, gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
