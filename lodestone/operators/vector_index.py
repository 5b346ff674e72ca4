"""An exact index for vector search: rows in cells around pivots, cells that cannot hold a neighbour are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import vector
from lodestone.session import importable

#: Rows without a direction (zero, non-finite or of another dimension); every search reads them.
STRAY = -1
#: Angles are compared with this much to spare.
SLACK = 1e-6


def _directions(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def build(rows: DataFrame, folder: str, cells: int = 256, id_col: str = "id", column: str = "embedding") -> None:
    """Write `rows` that have a vector to `folder`, in a partition per cell, with the pivots and widths of the cells.

    Pivots are `cells` vectors at most, drawn by a hash of the id: the only
    vectors that reach the driver, and each task holds them once. A row goes to
    the pivot at the least angle; a cell's width is its rows' largest angle.
    Repeated rows stay; ties go to the first pivot. An empty table makes an
    empty index. A column `cell` of the rows would be lost, so it is refused.
    """
    spark = importable(rows.sparkSession)
    if "cell" in rows.columns or "_cosine" in rows.columns:
        raise ValueError("rows must not have columns named cell or _cosine")
    known = rows.where(F.col(column).isNotNull())
    drawn = known.where(vector.dot(F.col(column), F.col(column)).between(1e-300, 1e300)).select(id_col, column)
    picked = [r[column] for r in drawn.orderBy(F.xxhash64(id_col), id_col).limit(cells).collect()]
    size = len(picked[0]) if picked else 0
    pivots = _directions(np.array([p for p in picked if len(p) == size], dtype=np.float64)) if picked else np.zeros((0, 0))

    @F.pandas_udf("cell int, cosine double")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, cosine = np.full(len(batch), STRAY, np.int32), np.full(len(batch), np.nan)
            fit = np.array([i for i, v in enumerate(batch) if len(pivots) and len(v) == size and not any(x is None for x in v)], dtype=np.int64)
            if len(fit):
                stack = np.array([batch.iloc[i] for i in fit], dtype=np.float64)
                with np.errstate(all="ignore"):
                    norm = np.linalg.norm(stack, axis=1)
                fine = np.isfinite(norm) & (norm > 0)
                near = _directions(stack[fine]) @ pivots.T
                cell[fit[fine]], cosine[fit[fine]] = near.argmax(axis=1), near.max(axis=1, initial=-1.0)
            yield pd.DataFrame({"cell": cell, "cosine": cosine})

    placed = known.withColumn("_at", place(F.col(column))).select(*known.columns, F.col("_at.cell").alias("cell"), F.col("_at.cosine").alias("_cosine"))
    if known.isEmpty():  # a partitioned table without rows would have no schema
        placed.coalesce(1).write.mode("overwrite").parquet(f"{folder}/rows")
    else:
        placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/rows")
    widths = {r["cell"]: r["least"] for r in spark.read.parquet(f"{folder}/rows").groupBy("cell").agg(F.min("_cosine").alias("least")).collect()}
    table = [(i, pivots[i].tolist(), widths[i]) for i in range(len(pivots)) if i in widths]
    spark.createDataFrame(table, "cell int, pivot array<double>, least double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells")


def reached(spark: SparkSession, folder: str, query: list[float], limit: int, first: int = 4, id_col: str = "id", column: str = "embedding", part: int | None = None, content_type: str | None = None) -> list[int] | None:
    """The cells that can hold one of the `limit` nearest rows; None if all have to be read.

    The `first` nearest cells set a bound, the score of their last hit; a cell
    whose nearest possible angle is beyond it is left out. Where vectors have no
    clusters few cells can be left out, and the search is a scan.
    """
    cells = spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()
    asked = np.array(query, dtype=np.float64)
    norm = np.linalg.norm(asked)
    if not cells or len(asked) != len(cells[0]["pivot"]) or not (np.isfinite(norm) and norm > 0):
        return None
    away = np.arccos(np.clip(np.array([c["pivot"] for c in cells]) @ (asked / norm), -1, 1))
    wide = np.arccos(np.clip(np.array([c["least"] for c in cells]), -1, 1))
    numbers = np.array([c["cell"] for c in cells])
    near = spark.read.parquet(f"{folder}/rows").where(F.col("cell").isin(STRAY, *numbers[np.argsort(away, kind="stable")[:first]].tolist()))
    scores = [r["score"] for r in vector.search(near, query, limit, id_col, column, part, content_type).collect()]
    if len(scores) < limit or scores[-1] is None or not np.isfinite(scores[-1]):
        return None
    return [STRAY, *numbers[away - wide <= np.arccos(np.clip(scores[-1], -1, 1)) + SLACK].tolist()]


def search(spark: SparkSession, folder: str, query: list[float], limit: int, first: int = 4, id_col: str = "id", column: str = "embedding", part: int | None = None, content_type: str | None = None) -> DataFrame:
    """What `vector.search` gives over all rows, read from the cells that can hold it."""
    cells = reached(spark, folder, query, limit, first, id_col, column, part, content_type)
    rows = spark.read.parquet(f"{folder}/rows")
    if cells is not None:
        rows = rows.where(F.col("cell").isin(*cells))
    return vector.search(rows.drop("cell", "_cosine"), query, limit, id_col, column, part, content_type)
