"""Vector search over embedded rows, exact and in double precision, and a local embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import importable
from lodestone.staging import saved_counted

DIMENSIONS = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for zero or null vectors."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def wrong_dimension(df: DataFrame, column: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.size(column) != dimensions))


def clamp_limit(limit: int | None, default: int = 5, most: int = 20) -> int:
    """A search limit between 1 and `most`; none and 0 are the default."""
    return max(1, min(limit or default, most))


def wanted(part: int | None = None, content_type: str | None = None) -> Column:
    """The filters of a search; absent ones filter nothing."""
    out = F.lit(True)
    if part is not None:
        out = out & (F.col("part_number") == part)
    if content_type is not None:
        out = out & (F.col("content_type") == content_type)
    return out


def search(rows: DataFrame, query: list[float] | DataFrame, limit: int, id_col: str = "id", column: str = "embedding", part: int | None = None, content_type: str | None = None) -> DataFrame:
    """The `limit` embedded rows nearest to the query by cosine, with `score`; ties to the smaller id. Absent filters filter nothing.

    query: the numbers, or a table of one row whose first column holds them.
    It is one array literal or a broadcast row, so plans do not grow with the
    dimension; a query's norm is computed once.
    """
    spark = rows.sparkSession
    if not isinstance(query, DataFrame):
        query = spark.range(1).select(F.from_json(F.lit(str([float(x) for x in query])), "array<double>").alias("q"))
    asked = query.select(F.transform(F.col(query.columns[0]), lambda x: x.cast("double")).alias("__q")).withColumn("__q_norm", F.sqrt(dot(F.col("__q"), F.col("__q"))))
    found = rows.where(wanted(part, content_type) & F.col(column).isNotNull()).crossJoin(F.broadcast(asked.limit(1)))
    score = F.try_divide(dot(F.col(column), F.col("__q")), F.sqrt(dot(F.col(column), F.col(column))) * F.col("__q_norm"))
    return found.withColumn("score", score).drop(column, "__q", "__q_norm").orderBy(F.desc_nulls_last("score"), id_col).limit(limit)


#: Rows that a task of `search_many` compares with a block of queries, and the numbers it works on at once.
GRID_ROWS, SLICE_NUMBERS = 8_192, 1 << 22


def search_many(rows: DataFrame, queries: DataFrame, limit: int, id_col: str = "id", column: str = "embedding", part: int | None = None, content_type: str | None = None, block: int = 1_000) -> DataFrame:
    """(query_id, place, id, score): for every query the `limit` nearest rows by cosine, ties to the smaller id.

    queries: query_id and embedding. Every block of some `block` queries meets
    every block of rows, each pair of blocks in a group of its own that sends
    `limit` rows a query at most; so the work grows with rows times queries,
    and what a task holds with neither. Rows and queries without a direction,
    or of another number of dimensions than the query, take no part. Ids are
    integers; rows that repeat an id each count.
    """
    spark = importable(rows.sparkSession)
    kind = queries.schema["query_id"].dataType.simpleString()
    asked, n_asked = saved_counted(queries.select("query_id", F.transform("embedding", lambda x: x.cast("double")).alias("q")))
    known, n_known = saved_counted(rows.where(wanted(part, content_type) & F.col(column).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(column).alias("v")))
    across, down = max(1, -(-n_asked // block)), max(1, -(-n_known // GRID_ROWS))
    own = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Groups are heavy for their bytes, so their partitions are counted, not left to be put together by size.
    dealt = lambda df: df.repartition(min(across * down, 4 * spark.sparkContext.defaultParallelism), "_row", "_query").groupBy("_row", "_query")
    left = dealt(known.withColumn("_row", own(down)).withColumn("_query", every(across)))
    right = dealt(asked.withColumn("_query", own(across)).withColumn("_row", every(down)))
    out = left.cogroup(right).applyInArrow(_nearest(limit), f"query_id {kind}, id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return out.withColumn("place", F.row_number().over(by)).where(F.col("place") <= limit).select("query_id", "place", "id", "score")


def _vectors(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """Lists of `size` numbers as the rows of a matrix, null as NaN."""
    flat = pc.list_flatten(column).cast(pa.float64()).fill_null(np.nan)
    return np.asarray(flat, float).reshape(-1, size)


def _nearest(limit: int, rows_at_once: int = 2_048, queries_at_once: int = 256) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a cogroup of rows (id, v) and queries (query_id, q): the `limit` nearest of the rows for each query."""

    def first(query: np.ndarray, score: np.ndarray, row: np.ndarray, ids: np.ndarray, null: np.ndarray) -> np.ndarray:
        """The places of each query's `limit` first."""
        order = np.lexsort((ids[row], null[row], -score, query))
        q = query[order]
        return order[np.arange(len(q)) - np.searchsorted(q, q) < limit]

    def scored(vectors: np.ndarray, queries: np.ndarray, row: np.ndarray, query: np.ndarray) -> np.ndarray:
        """The products of pairs, summed one way, so that equal vectors score alike; a slice of pairs at a time."""
        step = max(1, SLICE_NUMBERS // vectors.shape[1])
        return np.concatenate([np.zeros(0), *[(vectors[row[a : a + step]] * queries[query[a : a + step]]).sum(axis=1) for a in range(0, len(row), step)]])

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        names, found_ids, scores = [], [], []
        lengths, asked = np.asarray(pc.fill_null(pc.list_value_length(rows["v"]), -1)), np.asarray(pc.fill_null(pc.list_value_length(queries["q"]), -1))
        for size in np.unique(asked[asked > 0]):
            mine = rows.filter(pa.array(lengths == size))
            ids, null = np.asarray(mine["id"].fill_null(0)), np.asarray(mine["id"].is_null())
            those = queries.filter(pa.array(asked == size))
            for at in range(0, len(those), queries_at_once):
                some = those.slice(at, queries_at_once)
                q = _vectors(some["q"], size)
                fine = np.isfinite(q).all(axis=1) & q.any(axis=1)
                some, q = some.filter(pa.array(fine)), q[fine]
                with np.errstate(all="ignore"):
                    norms = np.sqrt((q * q).sum(axis=1))
                kept = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
                least = np.full(len(q), -np.inf)
                for begin in range(0, len(mine), rows_at_once) if len(q) else ():
                    vectors = _vectors(mine["v"].slice(begin, rows_at_once), size)
                    with np.errstate(all="ignore"):
                        norm = np.sqrt((vectors * vectors).sum(axis=1))
                        near = (vectors @ q.T) / (norm[:, None] * norms)
                    near[~(np.isfinite(norm) & (norm > 0))] = -np.inf
                    near[np.isnan(near)] = -np.inf
                    # The matrix product picks the pairs that may count; only those are summed.
                    if len(near) > limit:
                        least = np.maximum(least, np.partition(near, -limit, axis=0)[-limit])
                    row, query = np.nonzero((near > -np.inf) & (near >= least - 1e-9))
                    score = scored(vectors, q, row, query) / (norm[row] * norms[query])
                    query, score, row = (np.concatenate(x) for x in zip(kept, (query, score, row + begin), strict=True))
                    best = first(query, score, row, ids, null)
                    kept = query[best], score[best], row[best]
                    full = np.flatnonzero(np.bincount(kept[0], minlength=len(q)) == limit)
                    least[full] = np.maximum(least[full], kept[1][np.searchsorted(kept[0], full, side="right") - 1])
                query, score, row = kept
                names.append(some["query_id"].take(pa.array(query)))
                found_ids.append(pa.array(ids[row], pa.int64(), mask=null[row]))
                scores.append(pa.array(score, pa.float64()))
        if not names:
            return pa.table({"query_id": queries["query_id"].slice(0, 0), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        chunks = [c for x in names for c in x.chunks]
        return pa.table({"query_id": pa.chunked_array(chunks, queries["query_id"].type), "id": pa.chunked_array(found_ids), "score": pa.chunked_array(scores)})

    return run


def embed_text(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A unit vector from hashed words and word pairs: the same text gives the same vector everywhere."""
    out = np.zeros(dimensions, np.float64)
    words = text.lower().split()
    for gram in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
        h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little")
        out[h % dimensions] += 1.0 if h >> 63 else -1.0
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).astype(np.float32)


def embed(df: DataFrame, text_col: str = "embedding_text", out: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """df with the vectors of a text column; null texts have none."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if x is None else embed_text(x, dimensions))

    importable(df.sparkSession)
    return df.withColumn(out, run(F.col(text_col)))
