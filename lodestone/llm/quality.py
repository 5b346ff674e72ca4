"""Text quality by logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's words are seen in two views: the words themselves, A-Z lower-cased,
and their shapes (case, kinds of characters, the signs around them, whether
the word repeats the one before). Single words and pairs of each view are
hashed into one table of weights; a feature's value is its share of the
view's n-grams, so a score is a sparse dot product that sums over a text
block by block, whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import importable

from .store import lean, saved, spread, tidy
from .toxicity import remainder

#: Weights are kept for 2^BITS hashed n-grams, and one for the bias after them.
BITS = 18
#: Labelled rows that a model is fitted on at most, drawn by a hash of doc_id.
SAMPLE_ROWS = 12_000
#: Rows whose crc32(doc_id) modulo HOLD_OUT is 0 are never learnt from.
HOLD_OUT = 5
#: Learners, each with its share of the rows; passes a learner makes before states are averaged, and averagings.
LEARNERS, PASSES, ROUNDS = 4, 3, 2
#: The update's learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 0.1, 0.002, 0.001
#: The score from which a text counts as good.
GOOD = 0.3

#: Words that are worked on at once, and words remembered at most.
_BLOCK, _REMEMBERED = 1 << 19, 300_000
_SIZE = (1 << BITS) + 1
_WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
_SIGNS = re.compile(r"[^\w\s]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_VIEWS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_REPEATS = np.uint64(0x85EBCA77C2B2AE63)


def shape(word: str) -> str:
    """A word's look: case and kind of its letters, then the signs in it, runs of a sign cut to three."""
    core = _SIGNS.sub("", word)
    if not core:
        kind = "sign"
    elif core.isdigit():
        kind = "number"
    elif not core.isalpha():
        kind = "mixed"
    elif core.isupper():
        kind = "capitals" if len(core) > 1 else "capital"
    elif core.islower():
        kind = "small"
    elif core[0].isupper() and core[1:].islower():
        kind = "title"
    else:
        kind = "camel"
    return kind + "".join(re.sub(r"(.)\1{2,}", r"\1\1\1", x) for x in _SIGNS.findall(word)[-2:])


class _Words(dict):
    """Numbers of words; `hashes` holds the hashes of each word and of its shape."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.zeros((1024, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[at] = xxhash.xxh3_64_intdigest(word.translate(_LOWER)), xxhash.xxh3_64_intdigest(shape(word.decode("utf-8", "replace")))
        self[word] = at
        return at


def _places(mixed: np.ndarray) -> np.ndarray:
    """Hashes to places of the table."""
    mixed = mixed ^ (mixed >> np.uint64(33))
    mixed = mixed * np.uint64(0xFF51AFD7ED558CCD)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def _views(hashes: np.ndarray, before: int) -> Iterator[np.ndarray]:
    """The places of the n-grams of each view of a run of words that end in its own words, which begin after `before` others."""
    word, look = hashes[:, 0], hashes[:, 1].copy()
    look[1:][word[1:] == word[:-1]] += _REPEATS
    for first, pair, view in ((_VIEWS[0], _VIEWS[1], word), (_VIEWS[2], _VIEWS[3], look)):
        yield _places(view[before:] * first)
        yield _places(view[:-1] * pair + (view[1:] ^ first))[max(before - 1, 0) :]


class Reader:
    """Texts to n-grams; it remembers words between texts."""

    def __init__(self) -> None:
        self.words = _Words()

    def runs(self, text: bytes) -> Iterator[tuple[np.ndarray, int]]:
        """Hashes of the words in blocks; a block begins with the last two words before it, if there are any, and how many they are."""
        if len(text) <= 4 * _BLOCK:
            blocks = [text.split()]
        else:
            found = _WORDS.finditer(text)
            blocks = iter(lambda: [m[0] for m in islice(found, _BLOCK)], [])
        last: list[bytes] = []
        for words in blocks:
            if len(self.words) > _REMEMBERED:
                self.words = _Words()
            ids = np.fromiter(map(self.words.__getitem__, last + words), np.int64, len(last) + len(words))
            yield self.words.hashes[ids], len(last)
            last = (last + words)[-2:]

    def weigh(self, text: bytes, weights: np.ndarray) -> float:
        """The dot product of a text's features with the weights, without the bias."""
        sums, counts = np.zeros(4), np.zeros(4)
        for hashes, before in self.runs(text):
            for view, own in enumerate(_views(hashes, before)):
                sums[view] += weights[own].sum()
                counts[view] += len(own)
        return float((sums / np.maximum(counts, 1)).sum())

    def features(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(places, values) of a text, places ascending; the bias comes last."""
        places, values, counts = [], [], np.zeros(4)
        for hashes, before in self.runs(text):
            for view, found in enumerate(_views(hashes, before)):
                own, times = np.unique(found, return_counts=True)
                counts[view] += times.sum()
                places.append(own)
                values.append((view, times))
        if not places:
            return np.array([_SIZE - 1]), np.ones(1)
        shares = np.concatenate([times / max(counts[view], 1) for view, times in values])
        own, at = np.unique(np.concatenate(places), return_inverse=True)
        return np.append(own, _SIZE - 1), np.append(np.bincount(at, shares, len(own)), 1.0)


class Learner:
    """Follow-the-regularised-leader with a rate per weight (McMahan et al., 2013); state is (z, n)."""

    def __init__(self, state: np.ndarray | None = None):
        self.z, self.n = np.zeros((2, _SIZE)) if state is None else state.copy()

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(places)
        p = 1 / (1 + np.exp(-np.clip(w @ values, -30, 30)))
        g = (p - label) * values
        n = self.n[places]
        self.z[places] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[places] += g * g


def _bytes(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield x.as_py() or b""


@tidy
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    for batch in batches:
        found = [reader.features(x) for x in _bytes(batch.column("text"))]
        columns = [pa.array([x.tolist() for x, _ in found], pa.list_(pa.int32())), pa.array([x.tolist() for _, x in found], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([batch.column("turn"), batch.column("learner"), batch.column("good"), *columns], ["turn", "learner", "good", "places", "shares"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights, learnt from at most `rows` labelled rows outside the held-out part, drawn by a hash of doc_id.

    The rows are dealt to LEARNERS learners; in a round each goes over its rows
    PASSES times, in the order of their hashes, then the states are averaged.
    The driver holds a state of each, whatever the input. Null labels, and
    labels or texts without an id, are passed over; of contradicting labels the
    lower one holds. Null and empty texts count as rows without n-grams, long
    ones are read whole; rows that repeat an id each count. Without labels
    every text scores a half.
    """
    importable(docs.sparkSession)
    drawn = labels.where((remainder("doc_id", HOLD_OUT) != 0) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = drawn.withColumn("turn", F.xxhash64("doc_id", F.lit("quality"))).orderBy("turn", "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    dealt = lean(texts, 250).select("turn", F.pmod("turn", F.lit(LEARNERS)).cast("int").alias("learner"), (F.col("quality") > 0).alias("good"), "text")
    seen = saved(dealt.mapInArrow(_read, "turn long, learner int, good boolean, places array<int>, shares array<double>"), "quality")
    state: np.ndarray | None = None

    def one_round(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, rows = Learner(state), []
        for batch in batches:
            got = (batch.column(c) for c in ("turn", "places", "shares", "good"))
            rows += [(turn.as_py(), np.array(places.values), np.array(shares.values), int(good.as_py())) for turn, places, shares, good in zip(*got, strict=True)]
        rows.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes(), r[3]))
        for _ in range(PASSES):
            for _, places, shares, good in rows:
                learner.learn(places, shares, good)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.stack([learner.z, learner.n]).tobytes()], pa.binary())], ["learner", "state"])

    for _ in range(ROUNDS):
        run = seen.groupBy("learner").applyInArrow(one_round, "learner int, state binary")
        found = [np.frombuffer(r["state"]).reshape(2, _SIZE) for r in sorted(run.collect(), key=lambda r: r["learner"])]
        if not found:
            break
        state = np.mean(found, axis=0)
    return Learner(state).weights()


def score(text: Column, weights: np.ndarray) -> Column:
    """From 0 to 1 for every text; null and empty texts get the score of a text without n-grams."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader()
        for batch in batches:
            sums = np.array([reader.weigh((x or "").encode(), weights) for x in batch], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums + weights[-1], -30, 30))), dtype="float64")

    return run(text)


def scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Repeated rows score alike, null and empty texts like a text without
    n-grams; long texts are read whole. A row without an id is not held out.
    An empty table gives an empty result; other columns are ignored.
    """
    held = F.coalesce(remainder("doc_id", HOLD_OUT) == 0, F.lit(False)).alias("held_out")
    done = lean(spread(docs.select("doc_id", "text"))).select("doc_id", held, score(F.col("text"), weights).alias("score"))
    return done.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
