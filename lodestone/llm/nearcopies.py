"""Near copies among documents: five-word shingles at Jaccard similarity 0.8, besides SimHash.

Documents are banded by MinHash, with bands so many that three pairs in 100,000
are missed at the threshold and fewer above; those that collide are compared by
exact Jaccard similarity. The links found join those of equal and near
fingerprints, so that one document of each group stays by either measure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simhash import drop_near_duplicates, fingerprint, text_key
from .store import lean, saved, small, tidy
from .substring import band_keys, holding, near_sets

SHINGLE = 5
BANDS, ROWS = 20, 4


def shingles(text: str | None) -> tuple[int, np.ndarray]:
    """A hash of the words, and those of the distinct five-word shingles; a shorter text is one shingle, a wordless one has none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line = b" ".join(found)
    key = xxhash.xxh64_intdigest(line, 43)
    if len(found) <= SHINGLE:
        return key, np.array([key] if found else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-SHINGLE])).tolist()
    return key, np.unique(np.array([xxhash.xxh64_intdigest(line[a:b], 43) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)], np.uint64))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(flat.view(np.int64)))


@tidy
def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 250):
            batch = whole.slice(at, 250)
            texts = batch.column(2).to_pylist()
            prints = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
            keys, sets = zip(*map(shingles, texts), strict=True)
            long = [x for x in sets if len(x) > 1]
            rows = iter(band_keys(np.concatenate(long), np.array([*map(len, long)]), BANDS, ROWS).view(np.uint64) if long else ())
            bands = [next(rows) if len(x) > 1 else x[:0] for x in sets]
            columns = [batch.column(0), batch.column(1), pa.array(prints.view(np.int64)), pa.array(np.array(keys, np.uint64).view(np.int64)), _lists(bands)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "fp", "key", "bands"])


@tidy
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 250):
            keys, sets = zip(*map(shingles, whole.column(0).slice(at, 250).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), _lists(list(sets))], ["key", "shingles"])


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies. All columns stay.

    Near copies have five-word shingles of Jaccard similarity 0.8 or more, or
    fingerprints within 3 bits; groups are connected by either. Which row
    stays, and what null, empty and repeated rows do, is as in
    drop_near_duplicates.
    """
    texts = lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    banded = saved(texts.mapInArrow(_banded, "doc_id long, text_key binary, fp long, key long, bands array<long>"), "banded")

    def sets(wanted: DataFrame) -> DataFrame:
        holders = saved(banded.join(small(wanted), "key", "left_semi").select("text_key").distinct(), "holders")
        return holding(texts.select("text_key", "text"), holders).select("text").mapInArrow(_sets, "key long, shingles array<long>")

    links = saved(near_sets(banded.select("key", "bands"), sets), "copies")
    ends = saved(links.select(F.col("a").alias("key")).union(links.select(F.col("b").alias("key"))).distinct(), "ends")
    known = saved(banded.join(small(ends), "key", "left_semi").groupBy("key").agg(F.first("fp").alias("fp")), "known")
    one = lambda end, fp: small(known.select(F.col("key").alias(end), F.col("fp").alias(fp)))
    more = links.join(one("a", "x"), "a").join(one("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return drop_near_duplicates(docs, id_col, text_col, prints=banded.select("doc_id", "text_key", "fp"), more=more)
