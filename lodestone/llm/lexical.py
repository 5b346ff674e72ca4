"""Ranked lexical search with inverted treaps.

Documents are indexed in shards. A shard has a treap per term over the term's
postings: a search tree by document and a heap by impact, so a subtree's root
bounds what the term adds to any document below it. A query walks its terms'
treaps together: a range of documents has a subtree of each, the sum of their
roots bounds every score in the range, and ranges whose bound cannot enter the
best k so far are dropped, the others split at the document of their largest
impact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import importable

from .store import lean, saved, spread, tidy

#: Documents that a task of the search gets, about, and postings that a shard within it holds at most, but for a single document's.
TASK_DOCS, SHARD_POSTINGS = 40_000, 2_000_000
#: Terms of the items that are searched in one go, about; more items are worked off in blocks.
BLOCK_TERMS = 200_000
#: Ranges that are split at once.
_FRONT = 2048

# Bytes that a term is made of are digits, letters and all that is not ASCII.
_TERM_BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))


def terms(text: bytes | None) -> list[bytes]:
    """A text's terms in order: runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return (text or b"").translate(_TERM_BYTES).split()


def weight(documents: int, holding: int) -> int:
    """A term's weight, from the number of documents with a term and of those that hold this one."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, documents: int, occurrences: int) -> np.ndarray:
    """What a term of weight 1 adds to a document that holds it tf times in `length` terms."""
    m = 50 + (50 * length * documents) // max(occurrences, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Treaps:
    """The treaps of a shard. Postings lie term after term, by document; left and right are places of postings, -1 for none."""

    def __init__(self, docs: np.ndarray, adds: np.ndarray, starts: np.ndarray):
        """docs, adds: of each posting; starts: where each term's postings begin, and the end."""
        self.docs, self.adds = docs, adds
        # A heap by impact; equal impacts are ordered by a hash of the document, so that the trees stay shallow.
        spread = (docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        by = np.lexsort((spread, adds))
        rank = np.empty(len(by) + 1, np.int64)
        rank[by] = np.arange(len(by))
        rank[-1] = -1
        self.left, self.right = np.full((2, len(docs)), -1, np.int64)
        self.roots = np.full(len(starts) - 1, -1, np.int64)
        # Level by level: the root of every run of postings, then the runs on both sides of it.
        some = np.flatnonzero(starts[1:] > starts[:-1])
        low, high = starts[:-1][some], starts[1:][some]
        above, side = some, np.zeros(len(some), np.int8)
        while len(low):
            at = by[np.maximum.reduceat(rank, np.stack([low, high], 1).ravel())[::2]]
            for k, slots in enumerate((self.roots, self.left, self.right)):
                slots[above[side == k]] = at[side == k]
            low, high = np.stack([low, at + 1], 1).ravel(), np.stack([at, high], 1).ravel()
            above, side = np.repeat(at, 2), np.tile(np.array([1, 2], np.int8), len(at))
            some = low < high
            low, high, above, side = low[some], high[some], above[some], side[some]

    def settle(self, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The roots of what lies from low to below high in the subtrees of nodes: a row per range, a column per term."""
        flat = nodes.ravel().copy()
        moving = np.flatnonzero(flat >= 0)
        row = moving // max(nodes.shape[1], 1)
        low, high = low[row], high[row]
        while len(moving):
            at = flat[moving]
            doc = self.docs[at]
            over, under = doc >= high, doc < low
            stray = over | under
            moving, low, high = moving[stray], low[stray], high[stray]
            at = np.where(over[stray], self.left[at[stray]], self.right[at[stray]])
            flat[moving] = at
            on = at >= 0
            moving, low, high = moving[on], low[on], high[on]
        return flat.reshape(nodes.shape)

    def best(self, asked: np.ndarray, k: int, size: int, least: int = 1, limit: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, ranges looked at): the k highest scores among `size` documents, smaller documents first in ties, and maybe others.

        asked: the query's terms. Only scores above `least` are looked for, or
        equal to it at a document below `limit`.
        """
        roots = self.roots[asked]
        nodes = roots[roots >= 0][None, :]
        low, high = np.zeros(len(nodes), np.int64), np.full(len(nodes), size, np.int64)
        limit, looked = size if limit is None else limit, 0
        docs, scores = np.zeros((2, 0), np.int64)
        adds = np.append(self.adds, 0)  # at -1, for no node
        bound = adds[nodes].sum(axis=1)
        may = lambda bound, low: (bound > least) | (bound == least) & (low < limit)
        while True:
            keep = may(bound, low)
            nodes, low, high, bound = nodes[keep], low[keep], high[keep], bound[keep]
            if not len(nodes):
                return docs, scores, looked
            order = np.argpartition(-bound, _FRONT) if len(nodes) > _FRONT else np.arange(len(nodes))
            now, later = order[:_FRONT], order[_FRONT:]
            mine, a, b = nodes[now], low[now], high[now]
            looked += len(mine)
            split = self.docs[mine[np.arange(len(mine)), adds[mine].argmax(axis=1)]]
            score = adds[self.settle(mine, split, split + 1)].sum(axis=1)
            good = may(score, split)
            docs, scores = np.concatenate([docs, split[good]]), np.concatenate([scores, score[good]])
            if len(docs) >= k:
                first = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[first], scores[first]
                least, limit = int(scores[-1]), int(docs[-1])
            parts = [self.settle(mine, a, split), self.settle(mine, split + 1, b)]
            nodes = np.concatenate([nodes[later], *parts])
            low = np.concatenate([low[later], a, split + 1])
            high = np.concatenate([high[later], split, b])
            bound = np.concatenate([bound[later], *(adds[x].sum(axis=1) for x in parts)])


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    column = batch.column("text")
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(i, t) for i, x in zip(batch.column("item_id").to_pylist(), _texts(batch), strict=True) for t in set(terms(x))]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())], ["item_id", "term"])


def occurrences(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, length, terms, tfs): a row per document with its number of terms and those of the vocabulary, by number, with their counts."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.get
        for batch in batches:
            length, held = [], []
            for text in _texts(batch):
                found = terms(text)
                counts = Counter(map(known, found))
                counts.pop(None, None)
                length.append(len(found))
                held.append(counts)
            columns = [pa.array(length, pa.int64()), pa.array([[*x] for x in held], pa.list_(pa.int32())), pa.array([[*x.values()] for x in held], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "length", "terms", "tfs"])

    texts = lean(spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    return texts.mapInArrow(run, "doc_id long, length long, terms array<int>, tfs array<int>")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, whether null, lengths, the documents' places, terms and counts of the postings), of as many documents as a shard holds."""
    rows: list[tuple[np.ndarray, ...]] = []
    postings = 0

    def shard() -> tuple[np.ndarray, ...]:
        ids, null, length, held, term, tf = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((ids, null))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return ids[order], null[order], length[order], place[np.repeat(np.arange(len(held)), held)], term, tf

    for batch in batches:
        ids, listed = batch.column("doc_id"), batch.column("terms")
        rows.append((np.array(ids.fill_null(0)), np.array(ids.is_null()), np.array(batch.column("length")), np.array(listed.value_lengths()), np.array(listed.flatten()), np.array(batch.column("tfs").flatten(), np.int64)))
        postings += len(rows[-1][-1])
        if postings >= SHARD_POSTINGS:
            yield shard()
            rows, postings = [], 0
    if rows:
        yield shard()


def _first(k: int, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((ids, null, -scores))[:k]
    return scores[order], null[order], ids[order]


def _searched(index: DataFrame, asked: list[np.ndarray], weights: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """(item, doc_id, score): the best k of every task for every query."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        tops = [none] * len(asked)
        for ids, null, length, doc, term, tf in _shards(batches):
            order = np.lexsort((doc, term))
            doc, term, tf = doc[order], term[order], tf[order]
            adds = weights[term] * impacts(tf, length[doc], documents, total)
            treaps = Treaps(doc, adds, np.searchsorted(term, np.arange(len(weights) + 1)))
            for item, numbers in enumerate(asked):
                scores, absent, own = tops[item]
                least, limit = 1, len(ids)
                if len(scores) == k:  # the last of what other shards gave is to be beaten
                    least, limit = int(scores[-1]), int(np.searchsorted(ids[~null], own[-1])) if not absent[-1] else len(ids)
                at, got, _ = treaps.best(numbers, k, len(ids), least, limit)
                tops[item] = _first(k, np.concatenate([scores, got]), np.concatenate([absent, null[at]]), np.concatenate([own, ids[at]]))
        for at in range(0, len(asked), 1000):
            some = tops[at : at + 1000]
            item = np.repeat(np.arange(at, at + len(some), dtype=np.int32), [len(x[0]) for x in some])
            score, null, ids = (np.concatenate([x[c] for x in some]) for c in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=null), pa.array(score)], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0, ties to the smaller doc_id.

    docs: doc_id and text; items: item_id and text; ids are integers, other
    columns are ignored. Statistics are over all documents with a term. Rows
    that repeat a doc_id are documents of their own, rows without one come last
    in ties; rows that repeat an item_id, or have none, are one item with the
    terms of all of them. Null, empty and termless texts are found by nothing
    and find nothing; long ones are read whole. An empty table on either side
    gives no rows. Items are worked off in blocks of about BLOCK_TERMS terms,
    which the driver and every task hold; documents stay where they are, each
    task sends k rows an item at most.
    """
    spark = importable(docs.sparkSession)
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_terms, "item_id long, term binary")
    wanted = saved(wanted.distinct(), "items")
    blocks = -(-wanted.count() // BLOCK_TERMS)
    out = []
    for block in range(blocks):
        own = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        rows = sorted(own.groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect(), key=lambda r: (r["item_id"] is None, r["item_id"]))
        vocabulary = {t: n for n, t in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
        asked = [np.array(sorted(vocabulary[bytes(t)] for t in r["terms"]), np.int64) for r in rows]
        index = saved(occurrences(docs, vocabulary), "postings")
        all_rows, documents, total = index.agg(F.count("*"), F.count_if(F.col("length") > 0), F.coalesce(F.sum("length"), F.lit(0))).first()
        holding = np.zeros(len(vocabulary), np.int64)
        for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            holding[r["term"]] = r["count"]
        weights = np.array([weight(documents, int(x)) for x in holding], np.int64)
        tasks = -(-all_rows // TASK_DOCS) or 1
        found = _searched(index.repartition(tasks), asked, weights, documents, total, k)
        names = spark.createDataFrame([(n, r["item_id"]) for n, r in enumerate(rows)], "item int, item_id long")
        found = saved(found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score"), "found")
        salts = -(-tasks // 200)
        if salts > 1:
            found = _ranked(found, k, F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(salts)))
        out.append(_ranked(found, k))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result.select("item_id", "rank", "doc_id", "score")


def _ranked(found: DataFrame, k: int, *salt: Column) -> DataFrame:
    order = Window.partitionBy("item_id", *salt).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
