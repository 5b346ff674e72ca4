"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs, drawn from its code point. An
n-gram's vector binds its letters' vectors, each rotated by its place in the
n-gram; a text's vector bundles the vectors of its n-grams, and a language's
prototype the unit vectors of its documents. The nearest prototype by cosine
is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import lean, saved, small
from .toxicity import remainder

DIMENSIONS = 1024
SEED = 20_011
NGRAM = 3
#: Documents per language that prototypes are learnt from, about; drawn by a hash of doc_id.
SAMPLE_DOCS = 3_000
#: Rows whose crc32(doc_id) modulo PARTS is HELD are never learnt from.
PARTS, HELD = 3, 1
UNKNOWN = "und"
#: Characters that are worked on at once.
_BLOCK = 1 << 19
_SPACE = 32


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((not 0xD800 <= i < 0xE000 and chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=4096)
def _letter(code: int) -> np.ndarray:
    bits = np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, DIMENSIONS, np.int8)
    return bits * np.int8(2) - np.int8(1)


def _bind(alphabet: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """A row per n-gram; grams holds places in the alphabet, a column per letter."""
    letters = np.stack([_letter(int(c)) for c in alphabet])
    out = np.ones((len(grams), DIMENSIONS), np.int8)
    for place in range(NGRAM):
        out *= np.roll(letters, NGRAM - 1 - place, axis=1)[grams[:, place]]
    return out.astype(np.float32)


def _block(codes: np.ndarray, row: np.ndarray, own: np.ndarray, rows: int) -> np.ndarray:
    """The bundle of each row's n-grams; codes holds letters and spaces, row the text each belongs to, own if its n-gram counts here."""
    out = np.zeros((rows, DIMENSIONS), np.float32)
    keep = (codes[1:-1] != _SPACE) & own[1:-1]
    if len(codes) < NGRAM or not keep.any():
        return out
    present = np.flatnonzero(np.bincount(codes))
    place = np.zeros(present[-1] + 1, np.int64)
    place[present] = np.arange(len(present))
    index, size = place[codes], len(present)
    gram = ((index[:-2] * size + index[1:-1]) * size + index[2:])[keep]
    owner = row[1:-1][keep]
    if size**3 <= 1 << 22:
        found = np.flatnonzero(np.bincount(gram, minlength=1))
        spot = np.zeros(found[-1] + 1, np.int64)
        spot[found] = np.arange(len(found))
        inverse = spot[gram]
    else:
        found, inverse = np.unique(gram, return_inverse=True)
    step = 8192
    counts_of = lambda a: (inverse >= a) & (inverse < a + step)
    for a in range(0, len(found), step):
        part = found[a : a + step]
        grams = np.stack([part // size**2, part // size % size, part % size], axis=1)
        mine = counts_of(a) if len(found) > step else slice(None)
        counts = np.bincount(owner[mine] * len(part) + inverse[mine] - a, minlength=rows * len(part)).reshape(rows, -1)
        out += counts.astype(np.float32) @ _bind(present, grams)
    return out


def bundles(texts: list[str | None]) -> np.ndarray:
    """A vector per text; zero for texts without a letter. Texts of any length are worked off in blocks."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    lowered = [(x or "").lower() for x in texts]
    start = 0
    while start < len(lowered):
        stop, chars = start, 0
        while stop < len(lowered) and (stop == start or chars + len(lowered[stop]) <= _BLOCK) and stop - start < 1024:
            chars += len(lowered[stop])
            stop += 1
        group = lowered[start:stop]
        for at in range(0, max(map(len, group)), _BLOCK):
            parts = [x[max(0, at - 1) : at + _BLOCK + 1] for x in group]
            codes = np.frombuffer((" " + " ".join(parts) + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            row = np.concatenate(([0], np.repeat(np.arange(len(parts)), [len(x) + 1 for x in parts])))
            own = np.ones(len(codes), bool)
            ends = np.cumsum([len(x) + 1 for x in parts])
            if at:
                own[np.concatenate(([1], ends[:-1] + 1))] = False
            own[[e - 1 for e, x in zip(ends, group, strict=True) if len(x) > at + _BLOCK]] = False
            letter = _is_letter()[codes]
            codes = np.where(letter, codes, _SPACE)
            use = letter | np.concatenate(([True], letter[:-1]))
            out[start:stop] += _block(codes[use], row[use], own[use], len(parts))
        start = stop
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def drawn(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, text): about `per_language` documents of every language, all of rare ones, outside the held-out part."""
    learn = lean(docs).where((remainder("doc_id", PARTS) != HELD) & F.col("lang").isNotNull())
    share = saved(learn.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("_share")), "shares")
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("lang")), 11) / F.lit(float(1 << 53))
    return learn.join(small(share), "lang").where(draw < F.col("_share")).select("lang", "text")


def fit(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> dict[str, np.ndarray]:
    """Prototypes by language, from about `per_language` documents each outside the held-out part.

    Rare languages give all their documents. Tasks add up their documents'
    vectors; the driver gets one vector per language. Rows without an id or a
    lang are not learnt from; null, empty and wordless texts add nothing. No
    rows give no prototypes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            unit = _unit(bundles(batch.column("text").to_pylist()))
            langs = batch.column("lang").to_pylist()
            for lang in set(langs):
                own = unit[[x == lang for x in langs]].sum(axis=0, dtype=np.float64)
                sums[lang] = sums.get(lang, 0) + own
        names = sorted(sums)
        vectors = [np.round(sums[x], 6).tolist() for x in names]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(vectors, pa.list_(pa.float64()))], ["lang", "v"])

    parts = drawn(docs, per_language).mapInArrow(run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("at", "x"))
    summed = parts.groupBy("lang", "at").agg(F.sum(F.col("x").cast("decimal(24,6)")).cast("double").alias("x"))
    rows = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).orderBy("lang").collect()
    return {r["lang"]: np.array([p["x"] for p in r["v"]]) for r in rows}


def identify(text: Column, prototypes: dict[str, np.ndarray]) -> Column:
    """struct(lang_pred, score): the nearest prototype and its cosine, at least 0.

    Null texts and texts without a letter are `und` with score 0, as is every
    text if nothing was learnt. Ties go to the first language by name.
    """
    names = sorted(prototypes)
    stacked = _unit(np.stack([prototypes[n] for n in names])).astype(np.float32) if names else np.zeros((1, DIMENSIONS), np.float32)
    labels = np.array([*names] or [UNKNOWN], object)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = bundles(batch.tolist())
            some = np.abs(vectors).max(axis=1, initial=0) > 0
            cosine = _unit(vectors) @ stacked.T
            best = cosine.argmax(axis=1)
            pred = np.where(some, labels[best], UNKNOWN)
            yield pd.DataFrame({"lang_pred": pred, "score": np.where(some, cosine.max(axis=1).clip(0, 1), 0.0).astype(float)})

    return run(text)


def languages(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Repeated rows get the same; null texts and texts without a letter are
    `und`, long texts are read whole. A row without an id is not held out, nor
    is it learnt from. An empty table gives an empty result; other columns are
    ignored.
    """
    held = F.coalesce(remainder("doc_id", PARTS) == HELD, F.lit(False)).alias("held_out")
    done = lean(docs).select("doc_id", held, identify(F.col("text"), prototypes).alias("_found"))
    return done.select("doc_id", "held_out", "_found.lang_pred", "_found.score")
