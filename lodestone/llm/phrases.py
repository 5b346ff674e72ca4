"""Phrases whose words keep company: candidates from a sketch, exact counts from automata.

Every phrase of up to `words` words is hashed to a cell of a sketch; a cell's
sum is an upper bound of the count of any phrase in it. Tasks then go over
the texts in shards: the phrases of a shard that are in a cell of at least
`least` are its candidates, compiled into an Aho-Corasick automaton with a
delimiter on both sides; one scan counts all their matches, overlaps included
(single words, which only scores need, are counted by their numbers). The
shards' counts are summed, so a phrase's count is exact wherever its bound
is high enough, and thresholds apply to the sums. Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import importable

from .store import lean, saved, spread, tidy

#: The language of rows without one.
UNKNOWN = "und"
#: Words of a phrase at most, occurrences at least.
WORDS, LEAST = 3, 10
#: A phrase goes if a longer candidate holds it in at least so many hundredths of its occurrences.
COVERED = 50
#: Phrases a language's report holds.
REPORT = 2000
#: The sketch has as many cells as phrases are expected, between these powers of two; a bit for each is broadcast, 32 MB at most. With more phrases
#: than cells the bounds get loose: then more phrases are counted and shuffled, and the results are the same.
CELLS_FROM, CELLS_TO = 16, 28
#: Cells of a bucket of the sketch, as a power of two; words of a shard; cells gathered before they are sent.
_BUCKET, _SHARD, _GATHERED = 16, 1_000_000, 6_000_000

# Characters that end a piece of text, and those that end a word.
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_END = b"\xff"  # not a byte of UTF-8
_FOLD = bytes(0xFF if c in ENDS else 32 if c in GAPS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP, _SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xFF51AFD7ED558CCD)


def tokens(text: bytes | None) -> list[bytes]:
    """A text's words, A-Z lower-cased, with _END after every piece."""
    return (text or b"").translate(_FOLD).replace(_END, b" \xff ").split() + [_END]


class _Numbers(dict):
    """Words to numbers from 1 in order of appearance; the end of a piece is 0."""

    def __init__(self) -> None:
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _numbered(found: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The different words, and the number of each in order."""
    numbers = _Numbers()
    ids = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
    return list(numbers), ids


def _cells(lang: str, names: list[bytes], ids: np.ndarray, words: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For phrases of 1 to `words` words: where they begin, and their cells."""
    seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
    own = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names), np.uint64, len(names))[ids]
    real, key = ids > 0, np.zeros(len(ids), np.uint64)
    inside = np.ones(len(ids), bool)
    for n in range(1, words + 1):
        stop = len(ids) - n + 1
        if stop <= 0:
            return
        inside = inside[:stop] & real[n - 1 :]
        key = key[:stop] * np.uint64(_STEP) + own[n - 1 :]
        at = np.flatnonzero(inside)
        mixed = (key[at] ^ seed) + np.uint64(n * _STEP % 2**64)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _SPREAD
        yield at, (mixed >> np.uint64(64 - bits)).astype(np.uint32)


def _by_lang(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, tokens): texts of a language together, at most about `most` words at a time; a longer text is a shard of its own."""
    held: dict[str, list[bytes]] = {}
    total = 0
    for batch in batches:
        column = batch.column("text")
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
        for lang, text in zip(batch.column("lang").to_pylist(), column, strict=True):
            found = tokens(text.as_py())
            held.setdefault(UNKNOWN if lang is None else lang, []).extend(found)
            total += len(found)
            if total >= most:
                yield from held.items()
                held, total = {}, 0
    yield from held.items()


def _sketch(batches: Iterator[pa.RecordBatch], words: int, least: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(bucket, cells, counts): sums of the cells touched, `least` at most, by bucket."""
    gathered: list[np.ndarray] = []

    def sent() -> pa.RecordBatch:
        cells, counts = np.unique(np.concatenate(gathered), return_counts=True)
        counts = np.minimum(counts, least).astype(np.uint8)
        bucket, place = cells >> np.uint32(_BUCKET), (cells & np.uint32((1 << _BUCKET) - 1)).astype(np.uint16)
        own, starts = np.unique(bucket, return_index=True)
        ends = np.append(starts[1:], len(cells))
        # The high and the low byte of places lie apart: sorted, the high ones compress to little.
        split = [(place[a:b] >> 8).astype(np.uint8).tobytes() + (place[a:b] & 255).astype(np.uint8).tobytes() + counts[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(split, pa.binary())], ["bucket", "sums"])

    for lang, found in _by_lang(batches, _SHARD):
        names, ids = _numbered(found)
        gathered += [cells for _, cells in _cells(lang, names, ids, words, bits)]
        if sum(map(len, gathered)) >= _GATHERED:
            yield sent()
            gathered = []
    if sum(map(len, gathered)):
        yield sent()


def _high(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(bucket, bits): of every bucket, in rows sorted by it, a bit per cell whose sum is at least `least`."""
    last, sums = None, np.zeros(1 << _BUCKET, np.uint16)

    def done() -> Iterator[pa.RecordBatch]:
        if last is not None and (sums >= least).any():
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())], ["bucket", "bits"])

    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            if bucket != last:
                yield from done()
                last = bucket
                sums[:] = 0
            high, low, counts = np.frombuffer(blob, np.uint8).reshape(3, -1)
            place = high.astype(np.uint16) << 8 | low
            sums[place] = np.minimum(sums[place] + counts, least)
    yield from done()


def sketch(texts: DataFrame, words: int = WORDS, least: int = LEAST) -> tuple[int, np.ndarray]:
    """(bits, high): the sketch has 2**bits cells; high holds a bit for each, set if its sum reaches `least` (255 at most)."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(int(size * words / 8).bit_length(), CELLS_FROM), CELLS_TO)
    sums = texts.mapInArrow(tidy(lambda batches: _sketch(batches, words, least, bits)), "bucket int, sums binary")
    merged = sums.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(lambda batches: _high(batches, least)), "bucket int, bits binary")
    high = np.zeros((1 << bits - _BUCKET, (1 << _BUCKET) // 8), np.uint8)
    for r in merged.toLocalIterator():
        high[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    return bits, high.ravel()


def _candidates(lang: str, names: list[bytes], ids: np.ndarray, words: int, bits: int, high: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """Phrases of each length that occur here and are in a high cell: their length, where each occurs first, and their text."""
    for n, (at, cells) in enumerate(_cells(lang, names, ids, words, bits), 1):
        at = at[(high[cells >> np.uint32(3)] >> (np.uint32(7) - (cells & np.uint32(7)))) & 1 == 1]
        key = np.zeros(len(at), np.int64)
        for k in range(n):  # phrases to their own numbers, a word at a time
            key = np.unique(key * len(names) + ids[at + k], return_inverse=True)[1]
        first = at[np.unique(key, return_index=True)[1]]
        parts = [[names[i] for i in ids[first + k]] for k in range(n)]
        yield n, first, [b" ".join(x).decode() for x in zip(*parts, strict=True)]


def matches(phrases: list[str], found: list[bytes]) -> np.ndarray:
    """How often each phrase occurs among the tokens, within pieces, overlaps included."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for n, phrase in enumerate(phrases):
        automaton.add_word(f" {phrase} ", n)
    if not len(automaton):
        return np.zeros(0, np.int64)
    automaton.make_automaton()
    # A line end is no part of a word, so no phrase goes over it.
    text = f" {b' '.join(found).replace(_END, b'\n').decode()} "
    return np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64), minlength=len(phrases))


def counts(texts: DataFrame, bits: int, high: np.ndarray, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, f): phrases with f of at least `least`; the number of all words of a language is where words is 0."""
    cells = texts.sparkSession.sparkContext.broadcast(high.tobytes())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(cells.value, np.uint8)
        for lang, found in _by_lang(batches, _SHARD):
            names, ids = _numbered(found)
            phrases, lengths, times = [""], [0], [np.array([np.count_nonzero(ids)])]
            for n, first, some in _candidates(lang, names, ids, words, bits, own):
                if n == 1:  # a word is its own number; phrases of several are for the automaton
                    times.append(np.bincount(ids)[ids[first]])
                    single = 1 + len(some)
                phrases += some
                lengths += [n] * len(some)
            f = np.concatenate([*times, matches(phrases[single:], found)])
            columns = [pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array(lengths, pa.int32()), pa.array(f, pa.int64())]
            for at in range(0, len(phrases), 50_000):
                yield pa.RecordBatch.from_arrays([x.slice(at, 50_000) for x in columns], ["lang", "phrase", "words", "f"])

    found = texts.mapInArrow(run, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))


def _exact(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def scored(counted: DataFrame, covered: int = COVERED) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates no longer one covers; counted as `counts` gives it, saved.

    The lowest-scoring cut of a phrase counts, the first of equal ones.
    """
    every = counted.where("words > 0").select("lang", "phrase", "f")
    phrase, total = counted.where("words > 1"), counted.where("words = 0").select("lang", F.col("f").alias("n"))
    of = lambda a, b: F.array_join(F.slice("_list", a, b), " ")
    listed = phrase.withColumn("_list", F.split("phrase", " "))
    cuts = listed.withColumn("_cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "f", "_cut", of(F.lit(1), F.col("_cut")).alias("_head"), of(F.col("_cut") + 1, F.col("words") - F.col("_cut")).alias("_tail"))
    head, tail = every.toDF("lang", "_head", "l"), every.toDF("lang", "_tail", "r")
    whole = cuts.join(head, ["lang", "_head"]).join(tail, ["lang", "_tail"])
    a = _exact(F.col("f"))
    score = F.expr("(1000000 * _aa) div _lr")
    whole = whole.withColumn("_aa", a * a).withColumn("_lr", _exact(F.col("l")) * _exact(F.col("r"))).withColumn("_score", score)
    lowest = whole.groupBy("lang", "phrase", "f").agg(F.min(F.struct("_score", "_cut", "l", "r")).alias("_low"))
    # Phrases inside longer candidates, with the most that one of these has.
    begin = F.explode(F.expr("flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1), i -> array_join(slice(_list, i, k), ' '))))"))
    inside = listed.where("words > 2").select("lang", begin.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_most"))
    left = lowest.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("_most") < covered * F.col("f"), F.lit(True)))
    return left.join(F.broadcast(total) if total.limit(10_001).count() <= 10_000 else total, "lang").select(
        "lang", "phrase", F.col("f").alias("a"), F.col("_low.l").alias("l"), F.col("_low.r").alias("r"), "n", F.col("_low._score").alias("score")
    )


def collocations(docs: DataFrame, words: int = WORDS, least: int = LEAST, report: int = REPORT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `report` phrases by score, a and phrase.

    docs: lang and text; other columns are ignored. Null langs count as `und`;
    null, empty and wordless texts hold no phrase; long ones are read whole;
    rows that repeat count as often as they are there. A language without a
    phrase has no rows, nor has an empty table.
    """
    importable(docs.sparkSession)
    texts = lean(spread(docs.select("lang", "text")), 500)
    bits, high = sketch(texts, words, least)
    counted = saved(counts(texts, bits, high, words, least), "phrases")
    found = saved(scored(counted), "scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salts = -(-found.count() // 200_000)
    if salts > 1:  # a language may hold most of the phrases
        first = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= report).drop("rank")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= report).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
