"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding disguises.

Text is folded first: case, accents, letters of other scripts that look Latin,
characters without a shape, digits or signs that stand for letters, and words
spelt out letter by letter. The lexicon holds whole words and
word beginnings with weights learnt from labelled rows: log-odds of a toxic
text, shrunk by how weak their evidence is. Phrases that clean rows hold
around a term are learnt as exceptions and cancel it. A text's weight, absolute
and per word, goes through a logistic curve that is fitted on rows weighed
with lexicons of other rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lodestone.session import importable

from .store import lean, saved, spread, tidy

#: Labelled rows that a model is fitted on at most, drawn by a hash of doc_id.
SAMPLE_ROWS = 12_000
#: Evidence (the likelihood ratio statistic) that chance explains, times the logarithm of the number of terms.
CHANCE = 1.25
#: Parts of the labelled rows; each is weighed with a lexicon of the others when the curve is fitted.
FOLDS = 4
BEGINNINGS = range(4, 9)
#: Rows whose crc32(doc_id) modulo HOLD_OUT is 0 are never learnt from.
HOLD_OUT = 5

# Letters that look like a Latin letter, with that letter.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "н": "h", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y", "ь": "b",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "զ": "q", "ց": "g",
    "ɑ": "a", "ƅ": "b", "ƈ": "c", "đ": "d", "ɗ": "d", "ɡ": "g", "ɠ": "g", "ħ": "h", "ɦ": "h", "ı": "i", "ɩ": "i", "ƙ": "k", "ł": "l", "ɫ": "l", "ɱ": "m", "ɲ": "n", "ŋ": "n", "ø": "o", "ƥ": "p", "ɾ": "r", "ʂ": "s", "ŧ": "t", "ƭ": "t", "ʋ": "v", "ƴ": "y", "ʐ": "z", "ƶ": "z",
    "ᴀ": "a", "ʙ": "b", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ꜰ": "f", "ɢ": "g", "ʜ": "h", "ɪ": "i", "ᴊ": "j", "ᴋ": "k", "ʟ": "l", "ᴍ": "m", "ɴ": "n", "ᴏ": "o", "ᴘ": "p", "ʀ": "r", "ꜱ": "s", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ʏ": "y", "ᴢ": "z",
}
# Digits and signs that stand for a letter within a word; 1 may stand for another too.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}
OTHER = {**SUBSTITUTES, "1": "l"}
#: Single letters in a row that are read as one word.
SPELT = 4
_TABLE = str.maketrans(HOMOGLYPHS)
_SUBSTITUTES, _OTHER = str.maketrans(SUBSTITUTES), str.maketrans(OTHER)
_MIXED = re.compile(r"(?<![^\W_])[^\W_]*[0-9][^\W_]*")
_SIGNS = re.compile(r"(?<=[^\W\d_])[@$!|]+(?=[^\W\d_])")
_GAPS = re.compile(r"[\W\d_]+")
_PLAIN = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalpha()})
_ALONE = re.compile(rf"(?<= )[^\W\d_](?: [^\W\d_]){{{SPELT - 1},}}(?= )")


@lru_cache(maxsize=1)
def _unseen() -> re.Pattern:
    """Characters without a shape of their own: marks on others, and those that only steer how text is set."""
    codes = [i for i in range(128, 0x110000) if unicodedata.category(chr(i)) in ("Mn", "Me", "Cf")]
    starts = [c for c, before in zip(codes, [0, *codes], strict=False) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], 0], strict=True) if after != c + 1]
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends, strict=True)) + "]+")


def _digits(match: re.Match) -> str:
    """A word with digits read as letters; if a 1 may be either of two letters, both words."""
    word = match[0]
    if word.isdigit():
        return word
    one, other = word.translate(_SUBSTITUTES), word.translate(_OTHER)
    return one if one == other else f"{one} {other}"


def fold(text: str | None) -> str:
    """Folded words, each between single spaces; a space if there is none."""
    text = (text or "").lower()
    if not text.isascii():
        text = _unseen().sub("", unicodedata.normalize("NFKD", text.translate(_TABLE))).translate(_TABLE)
    text = _SIGNS.sub(lambda m: m[0].translate(_SUBSTITUTES), text)
    text = _MIXED.sub(_digits, text)
    words = text.translate(_PLAIN).split() if text.isascii() else _GAPS.sub(" ", text).split()
    if not words:
        return " "
    folded = f" {' '.join(words)} "
    return _ALONE.sub(lambda m: m[0].replace(" ", ""), folded)


@dataclass(frozen=True)
class Model:
    terms: dict[str, float]
    curve: tuple[float, float, float]
    exceptions: tuple[str, ...] = ()


class Matcher:
    """A Model's terms as an automaton. Terms begin with a space; those of whole words also end with one."""

    def __init__(self, model: Model):
        import ahocorasick

        self.curve, self.automaton = model.curve, ahocorasick.Automaton()
        for term, weight in model.terms.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in model.exceptions:
            self.automaton.add_word(fold(phrase), (len(fold(phrase)), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def found(self, folded: str) -> dict[int, float]:
        """The heaviest term at each word of a folded text, by where the space before the word is."""
        if not len(self.automaton):
            return {}
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in self.automaton.iter(folded):
            at = end - length + 1
            if weight is None:
                spared.append((at, end))
            elif best.get(at, 0.0) < weight:
                best[at] = weight
        for a, b in spared:
            for at in [x for x in best if a <= x < b]:
                del best[at]
        return best

    def weigh_folded(self, folded: str) -> tuple[float, int]:
        """The sum over words of their heaviest term, and the number of words."""
        return float(sum(self.found(folded).values())), max(folded.count(" ") - 1, 0)

    def weigh(self, text: str | None) -> tuple[float, int]:
        return self.weigh_folded(fold(text))

    def features(self, folded: str) -> tuple[float, float, float]:
        weight, words = self.weigh_folded(folded)
        return 1.0, np.log1p(weight), np.log1p(1000 * weight / words) if words else 0.0

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.curve, self.features(fold(text))), -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.diag([1e-3, *[1] * (x.shape[1] - 1)])
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * np.r_[1e-3 * beta[0], beta[1:]])
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def _candidates(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in BEGINNINGS if len(w) > k}


@tidy
def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([fold(x.as_py()) for x in batch.column("text")], pa.string()), batch.column("toxic"), batch.column("part")], ["folded", "toxic", "part"])


_SUMS = [f"{kind}{part}" for kind in ("toxic", "clean") for part in range(FOLDS)]


@tidy
def _tally(batches: Iterator[pa.RecordBatch], what: Callable[[str], set[str]]) -> Iterator[pa.RecordBatch]:
    """(term, sums by kind and part): documents that hold what is looked for, summed in this task."""
    sums = [Counter() for _ in _SUMS]
    for batch in batches:
        for text, toxic, part in zip(batch.column("folded"), batch.column("toxic").to_pylist(), batch.column("part").to_pylist(), strict=True):
            sums[part + (0 if toxic else FOLDS)].update(what(text.as_py()))
    terms = list(set().union(*sums))
    for at in range(0, len(terms), 50_000):
        some = terms[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *[pa.array([x[t] for t in some], pa.int64()) for x in sums]], ["term", *_SUMS])


def _tallied(texts: DataFrame, what: Callable[[str], set[str]], kind: str, label: str) -> tuple[DataFrame, int]:
    """The sums of terms that a text of `kind` holds, and how many terms there are in all; others cannot be told from chance by that kind."""
    found = texts.mapInArrow(lambda batches: _tally(batches, what), "term string, " + ", ".join(f"{c} long" for c in _SUMS))
    seen = Observation()
    every = found.groupBy("term").agg(*[F.sum(c).alias(c) for c in _SUMS]).observe(seen, F.count(F.lit(1)).alias("n"))
    return saved(every.where(" + ".join(c for c in _SUMS if c.startswith(kind)) + " > 0"), label), seen.get["n"]


def _weighed(k1: Column, k0: Column, n1: float, n0: float, chance: float) -> tuple[Column, Column]:
    """A term's log-odds of toxic, shrunk towards 0 by its evidence, and the evidence."""
    k, n = k1 + k0, n1 + n0
    cell = lambda x, expected: F.when(x > 0, 2 * x * F.log(x / expected)).otherwise(0.0)
    evidence = cell(k1, k * (n1 / n)) + cell(k0, k * (n0 / n)) + cell(n1 - k1, n1 - k * (n1 / n)) + cell(n0 - k0, n0 - k * (n0 / n))
    odds = F.log((k1 + 0.5) / (n1 - k1 + 0.5)) - F.log((k0 + 0.5) / (n0 - k0 + 0.5))
    return odds * F.greatest(1 - chance / F.greatest(evidence, F.lit(1e-9)), F.lit(0.0)), evidence


def _phrases(matcher: Matcher) -> Callable[[str], set[str]]:
    """The terms' words in a folded text with the word before, and with the word after."""

    def run(folded: str) -> set[str]:
        out = set()
        for at in matcher.found(folded):
            end = folded.index(" ", at + 1)
            if at:
                out.add(folded[folded.rindex(" ", 0, at) : end + 1])
            if end + 1 < len(folded):
                out.add(folded[at : folded.index(" ", end + 1) + 1])
        return out

    return run


def remainder(id_col: str, parts: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most `rows` labelled rows outside the held-out part, drawn by a hash of doc_id.

    Labels that are null, and labels or texts without an id, are passed over;
    of contradicting labels the toxic one holds. Null and empty texts count as
    rows without terms, long ones are read whole. Without a toxic or a clean
    row the model scores every text alike. Rows that repeat an id each count.
    """
    importable(docs.sparkSession)
    drawn = labels.where((remainder("doc_id", HOLD_OUT) != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(FOLDS)).cast("int").alias("part")
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", (F.col("toxic") > 0).alias("toxic"), part)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    texts = saved(lean(texts.repartition(cores)).mapInArrow(_folded, "folded string, toxic boolean, part int"), "labelled")
    bad, good = np.zeros(FOLDS), np.zeros(FOLDS)
    for r in texts.groupBy("part", "toxic").count().collect():
        (bad if r["toxic"] else good)[r["part"]] = r["count"]
    if not bad.sum() or not good.sum():
        return Model({}, (3.0 if bad.sum() else -3.0, 0.0, 0.0))

    def without(kind: str, k: int | None) -> Column:
        return reduce(Column.__add__, [F.col(f"{kind}{part}") for part in range(FOLDS) if part != k]).cast("double")

    def weight(k: int | None, terms: int) -> Column:
        """Of a term, by all parts but k."""
        n1, n0 = (float(x.sum() - (0 if k is None else x[k])) for x in (bad, good))
        if not n1 or not n0:
            return F.lit(0.0)
        return _weighed(without("toxic", k), without("clean", k), n1, n0, CHANCE * float(np.log(max(terms, 2))))[0]

    # The lexicons of all parts, and of all but each: what chance explains is in none, so they are as small as the labelled rows are few.
    terms, n = _tallied(texts, _candidates, "toxic", "terms")
    weighed = terms.select("term", F.array(*[weight(k, n) for k in (*range(FOLDS), None)]).alias("w"))
    rows = weighed.where(F.exists("w", lambda x: x > 0)).collect()
    *others, whole = [{r["term"]: float(r["w"][k]) for r in rows if r["w"][k] > 0} for k in range(FOLDS + 1)]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [Matcher(Model(x, (0.0, 0.0, 0.0))) for x in others]
        for batch in batches:
            found = np.array([matchers[k].features(x.as_py()) for x, k in zip(batch.column("folded"), batch.column("part").to_pylist(), strict=True)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 1]), pa.array(found[:, 2]), batch.column("toxic").cast(pa.int64())], ["a", "b", "y"])

    found = sorted((r["a"], r["b"], r["y"]) for r in texts.mapInArrow(features, "a double, b double, y long").collect())
    curve = _logistic(np.array([(1.0, a, b) for a, b, _ in found]), np.array([float(y) for *_, y in found]))
    # Exceptions: phrases that clean rows hold too often for chance, though a term is in them.
    around, n = _tallied(texts, _phrases(Matcher(Model(whole, curve))), "clean", "phrases")
    spared = around.where(weight(None, n) < 0).select("term").collect()
    return Model(whole, curve, tuple(sorted(r["term"].strip() for r in spared)))


def score(text: Column, model: Model) -> Column:
    """From 0 to 1 for every text; null and empty texts get the score of a text without terms."""
    terms = model.terms, model.curve, model.exceptions

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(Model(*terms))
        for batch in batches:
            yield pd.Series([matcher.score(x) for x in batch], dtype="float64")

    return run(text)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Repeated rows score alike, null and empty texts like a text without terms;
    long texts are read whole. A row without an id is not held out. An empty
    table gives an empty result; other columns are ignored.
    """
    held = F.coalesce(remainder("doc_id", HOLD_OUT) == 0, F.lit(False)).alias("held_out")
    done = lean(spread(docs)).select("doc_id", held, score(F.col("text"), model).alias("score"))
    return done.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """docs whose score is below `limit`, all columns kept."""
    return lean(spread(docs)).withColumn("__lodestone_score", score(F.col("text"), model)).where(F.col("__lodestone_score") < limit).drop("__lodestone_score")
