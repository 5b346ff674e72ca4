"""Exact vector search that reads a byte a dimension.

Every vector's direction is kept twice: whole, sorted by id, and as a code of
one byte a dimension in narrow files of their own. A code bounds the score of
its row from both sides; a search scans the codes, and only rows whose upper
bound reaches the last of the best lower bounds are read whole and scored. It
needs no clusters in the vectors, unlike `vector_index`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import vector
from lodestone.session import importable
from lodestone.staging import cut

#: What rounding may add to a bound.
SLACK = 1e-6
#: Ranges of ids that a search pushes into the scan of whole rows; with more candidates than MOST the rows are joined instead.
RANGES, MOST = 64, 5_000


def _vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have a direction, and their unit vectors."""
    lengths = np.array(column.value_lengths().fill_null(-1))
    whole = np.flatnonzero(lengths == size)
    values = column.take(pa.array(whole)).flatten()
    found = np.array(values.cast(pa.float64()).fill_null(np.nan)).reshape(len(whole), size)
    with np.errstate(all="ignore"):
        norm = np.linalg.norm(found, axis=1)
    fine = np.isfinite(norm) & (norm > 0)
    return whole[fine], found[fine] / norm[fine][:, None]


def build(rows: DataFrame, folder: str, id_col: str = "id", column: str = "embedding", page_rows: int = 8) -> None:
    """Write the rows that have a vector to `folder`: whole ones sorted by id in pages of `page_rows`, codes, and the codes' scale.

    A dimension's scale spans what the unit vectors have in it, in 256 steps;
    with a code goes the length of what it leaves out. The commonest number of
    dimensions is the index's; rows of another, zero and non-finite ones have
    no code and are candidates of every search. Ids may repeat or be null. The
    driver holds a row per dimension.
    """
    spark = importable(rows.sparkSession)
    known = rows.where(F.col(column).isNotNull())
    sizes = known.groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = sizes["size"] if sizes else 0
    whole = known.repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col)
    # Without a dictionary a page is read by itself.
    whole.write.mode("overwrite").option("parquet.page.row.count.limit", page_rows).option("parquet.page.size.row.check.min", page_rows).option("parquet.enable.dictionary", "false").parquet(f"{folder}/rows")
    kept = spark.read.schema(known.schema).parquet(f"{folder}/rows")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(size, np.inf), np.full(size, -np.inf)
        for batch in batches:
            _, unit = _vectors(batch.column(0), size)
            low, high = np.minimum(low, unit.min(axis=0, initial=np.inf)), np.maximum(high, unit.max(axis=0, initial=-np.inf))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(low), pa.array(high)], ["dim", "low", "high"])

    span = kept.select(column).mapInArrow(spans, "dim int, low double, high double").groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    scale = sorted((r["dim"], r["low"], (r["high"] - r["low"]) / 256) for r in span.collect()) if size else []
    scale = [(d, low, step) if np.isfinite(low) else (d, 0.0, 0.0) for d, low, step in scale]
    low, step = (np.array([x[k] for x in scale]) for k in (1, 2))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.schema.names.index(column))
            own, unit = _vectors(vectors, size)
            code = np.clip(np.floor((unit - low) / np.where(step > 0, step, 1)), 0, 255).astype(np.uint8)
            rest = np.linalg.norm(unit - (low + (code + 0.5) * step), axis=1)
            blobs, rests = [None] * len(batch), np.full(len(batch), np.nan)
            for i, row in zip(own, code, strict=True):
                blobs[i] = row.tobytes()
            rests[own] = rest
            others = [c for c in batch.schema.names if c != column]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(c)) for c in others], pa.array(blobs, pa.binary()), pa.array(rests)], [*others, "_code", "_rest"])

    narrow = [c for c in (id_col, "part_number", "content_type") if c in known.columns]
    schema = ", ".join(f"`{c}` {known.schema[c].dataType.simpleString()}" for c in narrow)
    kept.select(*narrow, column).mapInArrow(codes, f"{schema}, _code binary, _rest double").write.mode("overwrite").option("parquet.enable.dictionary", "false").parquet(f"{folder}/codes")
    spark.createDataFrame(scale, "dim int, low double, step double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/scale")


def bounds(spark: SparkSession, folder: str, query: list[float], limit: int, id_col: str = "id", wanted: Column | None = None) -> DataFrame:
    """(id, lower, upper): the rows that may be among the `limit` nearest of those wanted, as far as each task can tell."""
    scale = spark.read.parquet(f"{folder}/scale").orderBy("dim").collect()
    low, step = np.array([r["low"] for r in scale]), np.array([r["step"] for r in scale])
    asked = np.array(query, dtype=np.float64)
    asked = asked / np.linalg.norm(asked)
    weight, base, most = asked * step, float(asked @ (low + step / 2)), float(np.abs(asked) @ step / 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lower, upper, best = [], np.zeros(0), np.zeros(0), np.zeros(0)
        for batch in batches:
            code, rest = batch.column("_code"), np.array(batch.column("_rest").fill_null(np.nan))
            own = np.flatnonzero(np.array(code.is_valid()))
            a, b = np.full(len(batch), -np.inf), np.full(len(batch), np.inf)
            if len(own):
                matrix = np.frombuffer(b"".join(code.take(pa.array(own)).to_pylist()), np.uint8).reshape(len(own), -1)
                score, off = matrix @ weight + base, np.minimum(rest[own], most) + SLACK
                a[own], b[own] = score - off, score + off
            best = np.sort(np.concatenate([best, a]))[-limit:]
            ids.append(batch.column("_id"))
            lower, upper = np.concatenate([lower, a]), np.concatenate([upper, b])
            if len(best) == limit:
                keep = upper >= best[0]
                ids = [pa.chunked_array(ids).filter(pa.array(keep)).combine_chunks()]
                lower, upper = lower[keep], upper[keep]
        if ids:
            for at in pa.Table.from_arrays([pa.chunked_array(ids), pa.array(lower), pa.array(upper)], ["id", "lower", "upper"]).to_batches(10_000):
                yield at

    rows = spark.read.parquet(f"{folder}/codes")
    rows = rows if wanted is None else rows.where(wanted)
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("_id"), "_code", "_rest").mapInArrow(run, f"id {kind}, lower double, upper double")


def search(spark: SparkSession, folder: str, query: list[float], limit: int, id_col: str = "id", column: str = "embedding", part: int | None = None, content_type: str | None = None) -> DataFrame:
    """What `vector.search` gives over all rows, read from the codes and the rows they leave; two jobs run at once.

    A query without a direction, or of other dimensions, and an index that
    holds fewer than `limit` wanted rows, are answered by a scan.
    """
    importable(spark)
    rows = spark.read.parquet(f"{folder}/rows")
    asked = np.array(query, dtype=np.float64)
    norm = np.linalg.norm(asked) if len(asked) else 0.0
    whole = vector.search(rows, query, limit, id_col, column, part, content_type)
    if len(asked) != spark.read.parquet(f"{folder}/scale").count() or not (np.isfinite(norm) and norm > 0):
        return whole
    found = cut(bounds(spark, folder, query, limit, id_col, vector.wanted(part, content_type)))
    best = [r["lower"] for r in found.orderBy(F.desc("lower")).limit(limit).select("lower").collect()]
    if len(best) < limit or not np.isfinite(best[-1]):
        return whole
    near = found.where(F.col("upper") >= best[-1]).select("id").distinct()
    ids = [r["id"] for r in near.limit(MOST + 1).collect()]
    if len(ids) > MOST:
        return vector.search(rows.join(near, rows[id_col].eqNullSafe(near["id"]), "left_semi"), query, limit, id_col, column, part, content_type)
    return vector.search(rows.where(_among(F.col(id_col), ids)), query, limit, id_col, column, part, content_type)


def _among(column: Column, ids: list) -> Column:
    """Whether a value is one of the ids; ranges around them let the scan pass over pages."""
    known = sorted(x for x in ids if x is not None)
    out = F.lit(False) if len(known) == len(ids) else column.isNull()
    if not known:
        return out
    step = -(-len(known) // RANGES)
    if isinstance(known[0], (int, float)) and len(known) > RANGES:  # cut where the gaps are widest
        wide = sorted(range(1, len(known)), key=lambda i: known[i - 1] - known[i])[: RANGES - 1]
        edges = [0, *sorted(wide), len(known)]
    else:
        edges = [*range(0, len(known), step), len(known)]
    spans = [(known[a], known[b - 1]) for a, b in zip(edges, edges[1:], strict=False)]
    near = reduce(Column.__or__, [column == a if a == b else column.between(a, b) for a, b in spans])
    return out | (near & column.isin(*known))
