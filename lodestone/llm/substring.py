"""Repeated passages within documents: paragraphs banded by MinHash, verified and clustered.

Paragraphs are of two kinds. Lines are banded over five-word shingles, with
bands so short that six pairs in a thousand are missed at the threshold; those
that collide are compared by exact Jaccard similarity and clustered by
components. Passages are often copied into the middle of a line, where the
lines differ, so every run of `passage_words` words (a window) is a paragraph
too. A window has one band: its MinHash over phrases of eight words, that is
the phrase with the smallest hash. Equal windows always collide, and windows
that collide are compared by equality, a similarity of 1; a copy with edits
is found by its unedited runs. To move few rows, windows that follow each
other and share their band go as one stretch: stretches that are the only one
in their bucket are settled whole, others window by window. Matches that
overlap or follow each other closely in a document form a passage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .store import lean, saved, small, spread, tidy

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 5, 2
#: Words of a phrase, of a line that counts (a shorter one has no near-duplicate but its equals), and of a window.
PHRASE_WORDS, PARAGRAPH_WORDS, PASSAGE_WORDS = 8, 13, 28
#: Words between two matches of one passage at most.
GAP_WORDS = 8
#: Paragraphs of one bucket, and shingles in them, that are compared in one go; larger buckets go in pairs of blocks.
BLOCK_MEMBERS, BLOCK_SHINGLES = 2_000, 1_000_000
_BREAK = "\ue0ff"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…“”«»"


def _powers(n: int, base: np.uint64 = _ODD) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(0, n - 1), base))), dtype=np.uint64)


#: Windows are told apart modulo this prime; sums modulo a power of two are equal for words arranged to that end.
_PRIME, _BASE = (1 << 61) - 1, 0x1B873593CC9E2D51


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(_PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(_PRIME), x - np.uint64(_PRIME), x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of numbers below the prime, modulo it."""
    half, low, s31 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1), np.uint64(31)
    a1, a0, b1, b0 = a >> s31, a & half, b >> s31, b & half
    middle = a1 * b0 + a0 * b1
    return _reduced(np.uint64(2) * (a1 * b1) + (middle >> np.uint64(30)) + ((middle & low) << s31) + a0 * b0)


@lru_cache(maxsize=2)
def _prime_powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, _times(out, np.uint64(pow(base, len(out), _PRIME)))])
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(33))


class Words:
    """The words of a batch of texts as arrays.

    code: a 64-bit hash of each word in lower case without signs around it.
    text, line: where it belongs, counted through the batch; start, its place
    among its text's words. Line breaks take no place.
    """

    def __init__(self, texts: pa.Array):
        marked = pc.replace_substring(pc.fill_null(texts, ""), "\n", f" {_BREAK} ")
        split = pc.ascii_split_whitespace(marked)
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        plain = [w.lower().strip(_PUNCTUATION) or w for w in names]
        hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 11) for w in plain), np.uint64, len(plain))
        at = coded.indices.to_numpy(zero_copy_only=False)
        breaks = np.fromiter((w == _BREAK for w in names), bool, len(names))[at]
        real = np.fromiter((bool(w) and w != _BREAK for w in names), bool, len(names))[at]
        bounds = split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        new_text = np.concatenate(([True], np.diff(text) > 0)) if len(text) else np.zeros(0, bool)
        line = np.cumsum(breaks | new_text)
        self.text, self.line = text[real], line[real]
        self.code = hashes[at[real]]
        n = len(self.code)
        first = np.searchsorted(self.text, np.arange(len(bounds) - 1))
        self.start = np.arange(n) - first[self.text] if n else np.zeros(0, np.int64)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and number of words of each line."""
        first = np.flatnonzero(np.concatenate(([True], np.diff(self.line) > 0))) if len(self.line) else np.zeros(0, np.int64)
        return first, np.diff(np.concatenate((first, [len(self.line)])))

    def grams(self, k: int) -> np.ndarray:
        """A hash of the k words that begin at each word, across texts too; there must be k words."""
        n = len(self.code)
        with np.errstate(over="ignore"):
            total = np.concatenate(([np.uint64(0)], np.cumsum(self.code * _powers(n), dtype=np.uint64)))
            return _mixed((total[k:] - total[:-k]) * _powers(n - k + 1, _INVERSE))

    def runs(self, k: int) -> np.ndarray:
        """A hash of the k words that begin at each word, across texts too; there must be k words. A polynomial modulo a prime, so unlike runs of any length share it by chance only."""
        n = len(self.code)
        room = 1 << (n - 1).bit_length()  # few sizes, so that powers are kept
        terms = _times(_reduced(self.code), _prime_powers(_BASE, room)[:n])
        low, high = (np.concatenate(([np.uint64(0)], np.cumsum(x, dtype=np.uint64))) for x in (terms & np.uint64((1 << 32) - 1), terms >> np.uint64(32)))
        total = _reduced(_reduced(low) + _times(high, np.uint64(1 << 32)))
        part = _reduced(total[k:] + np.uint64(_PRIME) - total[:-k])
        return _mixed(_times(part, _prime_powers(pow(_BASE, -1, _PRIME), room)[: n - k + 1]))

    def stretches(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of windows of `size` words and phrase hash of each stretch; where all their windows begin, in a row."""
        n = len(self.code) - size + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        phrase = self.grams(PHRASE_WORDS)
        least, at, width, wanted = phrase, np.arange(len(phrase)), 1, size - PHRASE_WORDS + 1
        while width < wanted:  # the last smallest of `width` phrases, at the first of them
            step = min(width, wanted - width)
            later = least[step:] <= least[:-step]
            least, at = np.where(later, least[step:], least[:-step]), np.where(later, at[step:], at[:-step])
            width += step
        inside = np.flatnonzero(self.text[:n] == self.text[size - 1 :])
        at = at[inside]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(at) > 0) | (np.diff(inside) > 1)))) if len(at) else np.zeros(0, np.int64)
        return inside[new], np.diff(np.concatenate((new, [len(at)]))), phrase[at[new]], inside

    def hashed(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """A row per run: two 64-bit hashes of its words in order."""
        codes = memoryview(self.code.tobytes())
        found = b"".join(xxhash.xxh3_128_digest(codes[8 * a : 8 * (a + n)]) for a, n in zip(first.tolist(), count.tolist(), strict=True))
        return np.frombuffer(found, ">u8").astype(np.uint64).reshape(-1, 2)

    def shingles(self, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs' five-word shingles in a row, and how many each has; a run below five words is one shingle."""
        each = np.maximum(count - (SHINGLE - 1), 1)
        if not len(first):
            return np.zeros(0, np.uint64), each
        place = np.repeat(first - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(each.sum())
        ends = np.repeat(first + count, each)
        total = np.zeros(len(place), np.uint64)
        with np.errstate(over="ignore"):
            for k, p in enumerate(_powers(SHINGLE)):
                inside = place + k < ends
                total += np.where(inside, self.code[np.minimum(place + k, len(self.code) - 1)], np.uint64(0)) * p
        return _mixed(total), each


def band_keys(shingles: np.ndarray, each: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A row of band keys per run."""
    rng = np.random.Generator(np.random.PCG64(5))
    factors = rng.integers(1, 1 << 63, bands * rows, np.uint64) | np.uint64(1)
    starts = np.concatenate(([0], np.cumsum(each)[:-1])).astype(np.int64)
    out = np.zeros((len(each), bands), np.uint64)
    with np.errstate(over="ignore"):
        for k, f in enumerate(factors):
            least = np.minimum.reduceat(shingles * f, starts) if len(each) else np.zeros(0, np.uint64)
            out[:, k // rows] = _mixed(out[:, k // rows] * _ODD + least + np.uint64(k))
    return out.view(np.int64)


@tidy
def _units(batches: Iterator[pa.RecordBatch], size: int, least: int) -> Iterator[pa.RecordBatch]:
    """A row per stretch (bands null) and per line of `least` words. whole: a hash of all the words."""
    for batch_of in batches:
        for at in range(0, batch_of.num_rows, 500):
            batch = batch_of.slice(at, 500)
            words, ids = Words(batch.column(1)), batch.column(0)
            first, n, key, _ = words.stretches(size)
            whole = words.hashed(first, n + (size - 1))[:, 0]
            found = [(0, first, n + (size - 1), key, pa.array(np.ascontiguousarray(whole).view(np.int64)), pa.nulls(len(first), pa.list_(pa.int64())))]
            first, count = words.lines()
            use = count >= least
            first, count = first[use], count[use]
            key, second = words.hashed(first, count).T
            flat = pa.array(band_keys(*words.shingles(first, count)).reshape(-1))
            found.append((1, first, count, key, pa.array(second.copy().view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * BANDS), flat)))
            for kind, first, count, key, whole, bands in found:
                owner = ids.take(pa.array(words.text[first]))
                columns = [owner, pa.array(np.full(len(first), kind, np.int8)), pa.array(words.start[first].astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(np.ascontiguousarray(key).view(np.int64)), whole, bands]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "kind", "start", "words", "key", "whole", "bands"])


@tidy
def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, at, key, windows): first word, phrase and window hashes of each stretch."""
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            words = Words(batch.column(1))
            first, n, key, inside = words.stretches(size)
            windows = words.runs(size)[inside] if len(inside) else np.zeros(0, np.uint64)
            offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(windows.view(np.int64)))
            columns = [batch.column(0).take(pa.array(words.text[first])), pa.array(words.start[first].astype(np.int32)), pa.array(key.view(np.int64)), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "key", "windows"])


@tidy
def _paragraph_shingles(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(key, shingles): the distinct shingles of each banded paragraph."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            words = Words(whole.column(0).slice(at, 1000))
            first, count = words.lines()
            use = count >= least
            key = words.hashed(first[use], count[use])[:, 0]
            flat, each = words.shingles(first[use], count[use])
            owner = np.repeat(np.arange(len(each)), each)
            order = np.lexsort((flat, owner))
            flat, owner = flat[order], owner[order]
            new = np.concatenate((np.ones(min(1, len(flat)), bool), (np.diff(owner) > 0) | (flat[1:] != flat[:-1])))
            offsets = np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=len(each))))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[new].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(key).view(np.int64)), lists], ["key", "shingles"])


def spanning_links(keys: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all members whose exact Jaccard similarity, directly or through others, reaches the threshold.

    Members of equal labels count as connected.
    """
    label, out = np.arange(len(keys)) if labels is None else np.unique(labels, return_inverse=True)[1], []
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    for i in range(len(keys) - 1):
        other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        ratio = np.minimum(sizes[other], sizes[i]) >= similarity * np.maximum(sizes[other], sizes[i])
        other = other[ratio]
        if not len(other):
            continue
        if len(other) * 4 < len(keys):
            shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in other])
        else:
            hits = np.concatenate(([0], np.cumsum(np.isin(flat[starts[i + 1] :], sets[i]))))
            shared = hits[starts[other + 1] - starts[i + 1]] - hits[starts[other] - starts[i + 1]]
        near = other[shared >= similarity * (sizes[other] + sizes[i] - shared) - 1e-9]
        near = near[label[near] != label[i]]
        if len(near):
            groups, first = np.unique(label[near], return_index=True)
            out += [(int(keys[i]), int(keys[j])) for j in near[first]]
            label[np.isin(label, groups)] = label[i]
    return out


@tidy
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group: verified links of each. Holds one group at a time."""
    group, keys, labels, sets = None, [], [], []

    def links() -> pa.RecordBatch:
        found = spanning_links(np.array(keys, np.int64), sets, labels=np.array(labels, np.int64))
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for *g, k, label, s in zip(*(batch.column(i).to_pylist() for i in range(6)), batch.column(6), strict=True):
            if g != group:
                if len(keys) > 1:
                    yield links()
                group, keys, labels, sets = g, [], [], []
            keys.append(k)
            labels.append(label)
            sets.append(s.values.to_numpy(zero_copy_only=False).copy())
    if len(keys) > 1:
        yield links()


def near_paragraphs(docs: DataFrame, paragraphs: DataFrame, least: int = PARAGRAPH_WORDS) -> DataFrame:
    """(a, b): links between keys of paragraphs that are near-duplicates but not equal; paragraphs: doc_id, key, bands.

    Shingles are taken again from one document of each paragraph that meets another.
    """

    def sets(wanted: DataFrame) -> DataFrame:
        one = paragraphs.join(small(wanted), "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
        texts = holding(docs, saved(one.select("doc_id").distinct(), "holders"))
        return texts.select("text").mapInArrow(lambda batches: _paragraph_shingles(batches, least), "key long, shingles array<long>")

    return near_sets(paragraphs.select("key", "bands"), sets)


def holding(docs: DataFrame, holders: DataFrame) -> DataFrame:
    """docs whose first column is in `holders` (a saved column of that name), if these can be broadcast; else docs, so that texts never move."""
    name = holders.columns[0]
    if (few := small(holders)) is holders:
        return docs
    return docs.join(few.withColumnRenamed(name, "_held"), F.col(name).eqNullSafe(F.col("_held")), "left_semi")


def near_sets(paragraphs: DataFrame, sets: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): verified links between keys that meet in a bucket; paragraphs: key, bands.

    sets: key, shingles (distinct), or what gives them for a table of keys; it may give others too.

    Each member is compared with its bucket's first, pair by pair. Buckets
    that this does not connect are compared in full, in pairs of blocks that
    are bounded in members and bytes; members already connected are not
    compared again.
    """
    spark = paragraphs.sparkSession
    banded = paragraphs.select("key", F.posexplode("bands").alias("band", "bucket"))
    shared = banded.groupBy("band", "bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("band", "bucket", "low")
    met = saved(banded.join(small(saved(shared, "buckets")), ["band", "bucket"]).distinct(), "collisions")
    wanted = saved(met.select("key").distinct(), "wanted")
    sets = sets if isinstance(sets, DataFrame) else sets(wanted)
    sets = sets.join(small(wanted), "key", "left_semi")
    sets = saved(sets.groupBy("key").agg(F.first("shingles").alias("shingles")), "shingles")
    star = met.where("key <> low").select(F.col("low").alias("a"), F.col("key").alias("b")).distinct()
    one = lambda end, own: sets.select(F.col("key").alias(end), F.col("shingles").alias(own))
    common = F.size(F.array_intersect("x", "y"))
    alike = common >= SIMILARITY * (F.size("x") + F.size("y") - common) - 1e-9
    near = saved(star.join(one("a", "x"), "a").join(one("b", "y"), "b").where(alike).select("a", "b"), "first_links")
    labels = saved(connected_components(near), "labels").select(F.col("node").alias("key"), "component")
    mass = sets.select("key", F.size("shingles").alias("mass"))
    labelled = met.join(small(labels), "key", "left").join(small(mass), "key").select("band", "bucket", "key", "mass", F.coalesce("component", "key").alias("label"))
    open_ = labelled.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"), F.min("label").alias("low"), F.max("label").alias("high"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_MEMBERS), F.ceil(F.col("mass") / BLOCK_SHINGLES)).cast("int")
    open_ = saved(open_.where("n > 2 AND low <> high").select("band", "bucket", blocks.alias("blocks")), "open")
    if open_.isEmpty():
        return near
    dealt = labelled.join(small(open_), ["band", "bucket"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.select("band", "bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "key", "label")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = pairs.join(sets, "key").select("band", "bucket", "x", "y", "key", "label", "shingles").repartition(parts, "band", "bucket", "x", "y")
    rest = members.sortWithinPartitions("band", "bucket", "x", "y", "key").mapInArrow(_verify, "a long, b long").distinct()
    return near.unionByName(rest)


def _seen(rows: DataFrame, *more: str) -> DataFrame:
    """(key, keep_doc_id): keys in two documents or more, and the first of these. more: columns that are part of the key."""
    return rows.groupBy("key", *more).agg(F.min("doc_id").alias("keep_doc_id"), F.max("doc_id").alias("_last")).where("keep_doc_id <> _last").drop("_last")


def copied_runs(docs: DataFrame, stretches: DataFrame, size: int) -> DataFrame:
    """(doc_id, start, words, key, keep_doc_id): runs that hold each window of `size` words found in two documents or more, and no other.

    stretches: doc_id, start, words, key, whole. A run's windows have the same
    first document; a longer copy is a chain of runs that overlap.
    """
    least = [F.min("doc_id").alias("keep_doc_id"), F.max("doc_id").alias("_last"), F.min("whole").alias("_low"), F.max("whole").alias("_high")]
    phrases = saved(stretches.groupBy("key").agg(*least).where("keep_doc_id <> _last").select("key", "keep_doc_id", (F.col("_low") != F.col("_high")).alias("_mixed")), "phrases")
    same = stretches.drop("whole").join(phrases.where("NOT _mixed").drop("_mixed"), "key")  # grows with the corpus: not for broadcast
    mixed = small(phrases.where("_mixed").select("key"))
    holders = saved(stretches.join(mixed, "key", "left_semi").select("doc_id").distinct(), "holders")
    windows = holding(docs, holders).mapInArrow(lambda batches: _windows(batches, size), "doc_id long, at int, key long, windows array<long>")
    windows = windows.join(mixed, "key", "left_semi")
    windows = saved(windows.select("doc_id", "at", F.posexplode("windows").alias("_n", "key")).select("doc_id", "at", (F.col("at") + F.col("_n")).alias("start"), "key"), "windows")
    found = windows.join(saved(_seen(windows), "repeated"), "key")
    by = Window.partitionBy("doc_id", "at").orderBy("start", "key")
    breaks = (F.col("start") > F.lag("start").over(by) + 1) | (F.col("keep_doc_id") != F.lag("keep_doc_id").over(by))
    parted = found.withColumn("_run", F.sum(F.coalesce(breaks.cast("int"), F.lit(1))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = parted.groupBy("doc_id", "at", "_run", "keep_doc_id").agg(F.min("start").alias("start"), F.max("start").alias("_last"), F.min_by("key", "start").alias("_a"), F.max_by("key", "start").alias("_b"))
    words = (F.col("_last") - F.col("start") + size).cast("int")
    return same.select("doc_id", "start", "words", "key", "keep_doc_id").unionByName(runs.select("doc_id", "start", words.alias("words"), F.xxhash64("_a", "_b", words).alias("key"), "keep_doc_id"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage_words: int = PASSAGE_WORDS, paragraph_words: int = PARAGRAPH_WORDS, least_words: int = 0) -> DataFrame:
    """A row per copied run, and per equal or near-duplicate line.

    Columns: doc_id, start and words (of the match, in words of the text),
    passage_start, passage_words, cluster_id, keep_doc_id (document of the
    cluster's first occurrence), removed (every other occurrence). A cluster
    repeats if it is in two documents or more, by id; rows that repeat an id,
    or have none, count as one document. Null, empty and short texts have no
    rows, nor has an empty table; other columns are ignored.

    A copied run is exact: whatever two documents share in `passage_words`
    words or more (8 at least) is covered word by word, and nothing else is;
    keep_doc_id is the first document that has its windows. Words, and runs of
    them, are told apart by 64-bit hashes: stretches by xxh3, windows by a
    polynomial modulo 2^61 - 1, so two that differ are taken for equal by
    chance only. Lines count from
    `paragraph_words` words on, each on its own, whatever stands beside it; at
    1 every line does. Lines below 13 words are alike only if equal.
    `least_words` leaves out passages that are shorter, all matches together.

    Equal stretches and lines are reduced to one row per key before anything
    is compared, buckets yield spanning trees instead of pairs, and what is
    kept of a text between passes is its hashes.
    """
    named = lean(spread(docs)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size, least = max(passage_words, PHRASE_WORDS), max(paragraph_words, 1)
    units = saved(named.mapInArrow(lambda batches: _units(batches, size, least), "doc_id long, kind byte, start int, words int, key long, whole long, bands array<long>"), "units")
    paragraphs = units.where("kind = 1")
    near = saved(connected_components(near_paragraphs(named, paragraphs.select("doc_id", "key", "bands"), least)), "near").withColumnRenamed("node", "key")
    copied = copied_runs(named, units.where("kind = 0").select("doc_id", "start", "words", "key", "whole"), size)
    # A line without near-duplicates is a cluster with its equals, told by both hashes.
    alone = F.col("component").isNull()
    clustered = paragraphs.select("doc_id", "start", "words", "key", "whole").join(small(near), "key", "left")
    clustered = saved(clustered.select("doc_id", "start", "words", F.coalesce("component", "key").alias("key"), F.when(alone, F.col("whole")).otherwise(F.lit(0)).alias("whole")), "clustered")
    alike = clustered.join(small(saved(_seen(clustered, "whole"), "alike")), ["key", "whole"]).drop("whole")
    matches = saved(copied.unionByName(alike), "matches")
    # Matches that overlap or follow each other closely form a passage.
    by = Window.partitionBy("doc_id").orderBy("start", "words", "key")
    ends = F.col("start") + F.col("words")
    reach = F.max(ends).over(by.rowsBetween(Window.unboundedPreceding, -1))
    parted = matches.withColumn("_new", F.coalesce((F.col("start") > reach + GAP_WORDS).cast("int"), F.lit(1)))
    parted = parted.withColumn("_p", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("doc_id", "_p")
    spans = parted.withColumn("passage_start", F.min("start").over(whole)).withColumn("passage_words", F.max(ends).over(whole) - F.col("passage_start"))
    return spans.where(F.col("passage_words") >= least_words).select("doc_id", "start", "words", "passage_start", "passage_words", F.col("key").alias("cluster_id"), "keep_doc_id", (F.col("doc_id") != F.col("keep_doc_id")).alias("removed"))
