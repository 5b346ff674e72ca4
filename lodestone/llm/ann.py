"""Approximate nearest neighbours by cross-polytope hashing.

A table rotates unit vectors pseudo-randomly (three rounds of random signs and
a fast Hadamard transform) and files each under its nearest signed axis. A
query looks up the axes nearest to it, several per table; the rows found there
are ranked by their exact inner products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import importable

from .store import saved, small

TABLES = 8
#: Share of each table's axes that a query looks up; there are two a dimension.
PROBES = 1 / 8
SEED = 7
#: Rows and queries of one bucket that a task compares at once; larger buckets are dealt out.
CHUNK_ROWS, CHUNK_QUERIES = 8192, 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths; the width is a power of two."""
    n, width, half = len(x), x.shape[1], 1
    while half < width:
        y = x.reshape(n, -1, 2, half)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """x turned by a table's pseudo-rotation, padded to a power of two."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    signs = np.random.Generator(np.random.PCG64([SEED, table])).choice([-1.0, 1.0], (3, width))
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    for s in signs:
        out = hadamard(out * s)
    return out


def nearest_axes(x: np.ndarray, table: int, count: int) -> np.ndarray:
    """The signed axes nearest to each row, nearest first; axis i + width is the negative of axis i."""
    turned = rotated(x, table)
    both = np.concatenate((turned, -turned), axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, :count]


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _lookup(width: int, bound: float | None, tables: int, probes: int):
    """A row per table and probe. bound: the largest norm, to lift vectors of unequal norms onto a sphere; queries are not lifted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            if bound is not None:
                lift = np.sqrt(np.maximum(bound**2 - norm**2, 0)) if probes == 1 else np.zeros_like(norm)
                x, norm = np.concatenate((x, lift), axis=1), bound if probes == 1 else norm
            x = x / norm
            for table in range(tables):
                axes = nearest_axes(x, table, probes)
                for at in range(axes.shape[1]):
                    label = pa.array(np.full(len(x), table, np.int32))
                    yield pa.RecordBatch.from_arrays([label, pa.array(axes[:, at].astype(np.int32)), batch.column("id"), batch.column("v")], ["table", "axis", "id", "v"])

    return run


def usable(vector: Column) -> Column:
    """Not null, of finite components, and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _rank(k: int, width: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not queries.num_rows or not rows.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        q, v = _matrix(queries.column("v"), width), _matrix(rows.column("v"), width)
        qid, vid = queries.column("id").to_numpy(), rows.column("id").to_numpy()
        found = []
        for a in range(0, len(q), 256):
            near = q[a : a + 256] @ v.T
            near[qid[a : a + 256, None] == vid] = -np.inf
            least = np.partition(near, -k, axis=1)[:, -k, None] if near.shape[1] > k else np.full((len(near), 1), -np.inf)
            i, j = np.nonzero((near >= least - 1e-9 * (1 + np.abs(least))) & (near > -np.inf)) if near.shape[1] > k else np.nonzero(near > -np.inf)
            exact = np.zeros(len(i))
            for d in range(width):  # in order, so that equal vectors have equal scores wherever they are compared
                exact += q[a + i, d] * v[j, d]
            order = np.lexsort((vid[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            first = np.searchsorted(i, np.arange(len(near)))
            use = np.arange(len(i)) - first[i] < k
            found.append((qid[a + i[use]], vid[j[use]], exact[use]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=names)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, share: float = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, by inner product, ties to smaller ids.

    Vectors that are null, zero or hold null or non-finite components take no
    part; shorter vectors count as filled with zeros. A row is no neighbour of
    a query with its own id; a repeated id counts once, with its best score.
    Queries that find fewer than k rows look up every axis, which finds all.
    Empty tables give empty results; other columns are ignored.

    Every row is in every table. Buckets above a chunk are dealt out by a hash
    of the id, their queries going to each part, so a vector with a third of
    all rows is spread; a part yields at most k rows a query.
    """
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())
    importable(vectors.sparkSession)
    rows, asked = pick(vectors), pick(queries)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    widths = rows.select(F.size("v").alias("n"), norm.alias("norm")).union(asked.select(F.size("v"), F.lit(None).cast("double")))
    width, least, most, low, high = widths.agg(F.max("n"), F.min("n"), F.count("norm"), F.min("norm"), F.max("norm")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not most:
        return vectors.sparkSession.createDataFrame([], schema)
    if least != width:
        filled = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get("v", i), F.lit(0.0)))
        rows, asked = rows.withColumn("v", filled), asked.withColumn("v", filled)
    bound = None if high - low <= 1e-6 * high else float(high)
    axes = 2 << max(0, (width if bound is None else width + 1) - 1).bit_length()
    probes = max(2, round(axes * share))
    kind = f"table int, axis int, id long, v {rows.schema['v'].dataType.simpleString()}"
    index = rows.mapInArrow(_lookup(width, bound, tables, 1), kind)

    def search(some: DataFrame, count: int) -> DataFrame:
        kind_q = f"table int, axis int, id long, v {some.schema['v'].dataType.simpleString()}"
        probe = some.mapInArrow(_lookup(width, bound, tables if count == probes else 1, count), kind_q)
        of = ["table", "axis"]
        sizes = index.groupBy(*of).agg(F.count("*").alias("n")).join(probe.groupBy(*of).agg(F.count("*").alias("m")), of)
        parts = sizes.select(*of, F.ceil(F.col("n") / CHUNK_ROWS).cast("int").alias("parts"), F.ceil(F.col("m") / CHUNK_QUERIES).cast("int").alias("shares"))
        parts = small(saved(parts.where("parts > 1 OR shares > 1"), "buckets"))
        own = lambda n: F.pmod(F.xxhash64("id"), F.coalesce(F.col(n), F.lit(1))).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
        dealt = index.join(parts, of, "left").withColumn("part", own("parts")).withColumn("share", every("shares"))
        posed = probe.join(parts, of, "left").withColumn("share", own("shares")).withColumn("part", every("parts"))
        keys = [*of, "part", "share"]
        pairs = posed.select(*keys, "id", "v").groupBy(*keys).cogroup(dealt.select(*keys, "id", "v").groupBy(*keys))
        found = pairs.applyInArrow(_rank(k, width), "query_id long, vec_id long, score double")
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    done = saved(search(asked, probes), "nearest")
    full = done.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = saved(asked.join(full, "id", "left_anti"), "short")
    if short.isEmpty():
        return done
    again = search(short, axes)
    return done.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi").unionByName(again)
