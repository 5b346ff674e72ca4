"""Packing token sequences by shortest-pack-first over the length histogram."""

from __future__ import annotations

import os
import re
import zlib
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import lean, numbered, saved, tidy

CONTEXT = 2048
END_ID = 1
#: Distinct words whose ids a worker remembers, at some 70 bytes each; beyond it those of the latest batch stay.
WORD_CACHE = 1_000_000
_TAIL = re.compile(r"[!-/:-@\[-`{-~]*\Z")
_PROBE = re.compile(r"[^\W\d_]+|[\W\d_]+")
_PROBES = ("One  two\tthree.\n\nFour, five. ", " \x0b Ninety Words. The end.", "hello Hello HELLO hello. x . y.")
_ODD = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes and length, computed on Arrow's buffers. Different words may share one."""
    raw, size = _letters(words)
    out, some, first = np.zeros(len(words), np.uint64), size > 0, np.cumsum(size) - size
    with np.errstate(over="ignore"):
        if some.any():
            powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(size.max()) - 1, _ODD))), dtype=np.uint64)
            place = np.arange(len(raw)) - np.repeat(first, size)
            out[some] = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * powers[place], first[some])
        out = (out ^ (out >> np.uint64(29)) ^ size.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes in a row, and how many each has."""
    bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    raw = words.buffers()[2] if len(words) else None
    return (np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw else np.zeros(0, np.uint8)), np.diff(bounds)


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The pieces of flat that begin at start[i] with size[i] entries, for each i of at in turn."""
    taken = size[at].astype(np.int64)
    upto = np.concatenate(([0], np.cumsum(taken)))
    return flat[np.repeat(start[at] - upto[:-1], taken) + np.arange(upto[-1])]


class WordEncoder:
    """Whole-text ids from a tokenizer whose words never span ASCII white space.

    The vocabulary drops white space and splits at it, so a text's ids are
    those of its space-separated words in a row. It also folds case and keeps
    letters and signs apart, so a word of letters with signs after it is the
    letters' ids, then the signs'. Arrow splits the texts and finds the
    distinct words; each is encoded once, and the texts' ids are gathered.
    What is known of words lies in arrays, sorted by hash; a word is known
    only if the bytes there are its own. Vocabularies of another kind, told by
    a few probes, encode whole texts.
    """

    hashes = staticmethod(word_hashes)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core
        self.tokenizer = Tokenizer.from_file(path)
        plain = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.stop = (plain(".") or [-1])[0]
        # Words apart, folded and with their signs apart must give the ids of the whole.
        self.by_word = all(plain(x) == [i for word in x.lower().split() for part in _PROBE.findall(word) for i in plain(part)] for x in _PROBES)
        self._forget()

    def _forget(self) -> None:
        self.hash, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.begin, self.length = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.letters = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def _runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The runs' ids in a row, and how many each has.

        Letters go to the tokenizer many at a time, a full stop after each:
        that is an id of its own, which no run of letters holds.
        """
        plain = [len(x) < 1000 and x.lower().isalpha() for x in runs]
        words = [x for x, p in zip(runs, plain, strict=True) if p]
        texts = [" . ".join(words[k : k + 64]) + " ." for k in range(0, len(words), 64)]
        found = [x.ids for x in self.tokenizer.encode_batch_fast([*texts, *(x for x, p in zip(runs, plain, strict=True) if not p)], add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(found[: len(texts)]), np.uint32)
        ends = np.flatnonzero(flat == self.stop)
        if len(ends) != len(words):
            raise ValueError("the vocabulary does not keep a full stop apart")
        size, rest = np.zeros(len(runs), np.int64), found[len(texts) :]
        plain_at, other_at = np.flatnonzero(plain), np.flatnonzero(~np.array(plain, bool))
        size[plain_at] = np.diff(np.concatenate(([-1], ends))) - 1
        size[other_at] = [len(x) for x in rest]
        both = np.concatenate((flat[flat != self.stop], np.fromiter(chain.from_iterable(rest), np.uint32)))
        start = np.zeros(len(runs), np.int64)
        by = np.concatenate((plain_at, other_at))
        start[by] = np.concatenate(([0], np.cumsum(size[by])[:-1])) if len(by) else start[by]
        return gathered(both, start, size, np.arange(len(runs))), size

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids in a row, and how many each has."""
        place: dict[str, int] = {}
        pairs = np.zeros((len(words), 2), np.int64)
        for i, word in enumerate(words):
            at = 0 if word.isalpha() else _TAIL.search(word).start()
            head, tail = (word[:at], word[at:]) if at and word[:at].lower().isalpha() else (word, "")
            pairs[i] = place.setdefault(head, len(place)), place.setdefault(tail, len(place))
        flat, size = self._runs(list(place))
        start = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
        return gathered(flat, start, size, pairs.ravel()), size[pairs].sum(axis=1)

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        """Where each hash is in the table; -1 if it is not."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, at, -1)

    def _learn(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Places in the table of the words' hashes, after words with hashes that it lacks are encoded."""
        at = self._known(hashes)
        new = np.flatnonzero(at < 0)
        if len(self.hash) + len(new) > WORD_CACHE:
            self._forget()
            new = np.arange(len(hashes))
        if len(new):
            lacking, first = np.unique(hashes[new], return_index=True)
            fresh = words.take(pa.array(new[first]))
            flat, size = self._encode(fresh.to_pylist())
            letters, length = _letters(fresh)
            begins = lambda known, sizes: len(known) + np.cumsum(sizes) - sizes
            spot = np.searchsorted(self.hash, lacking)
            self.start = np.insert(self.start, spot, begins(self.flat, size))
            self.begin = np.insert(self.begin, spot, begins(self.letters, length))
            self.hash, self.size, self.length = np.insert(self.hash, spot, lacking), np.insert(self.size, spot, size.astype(np.int32)), np.insert(self.length, spot, length.astype(np.int32))
            self.flat, self.letters = np.concatenate((self.flat, flat)), np.concatenate((self.letters, letters))
            at = self._known(hashes)
        return at

    def _others(self, words: pa.Array, at: np.ndarray) -> np.ndarray:
        """Words that are not, byte by byte, the word at their place in the table."""
        letters, length = _letters(words)
        same = np.flatnonzero(self.length[at] == length)
        mine = gathered(letters, np.cumsum(length) - length, length, same)
        wrong = np.concatenate(([0], np.cumsum(mine != gathered(self.letters, self.begin, self.length, at[same]))))
        ends = np.cumsum(length[same])
        differs = np.ones(len(words), bool)
        differs[same] = wrong[ends] != wrong[ends - length[same]]
        return np.flatnonzero(differs)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, without end ids, and where each text's begin (one entry more than texts)."""
        texts = texts.fill_null("")
        if not self.by_word:
            found = [x.ids for a in range(0, len(texts), 64) for x in self.tokenizer.encode_batch_fast(texts[a : a + 64].to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int64)
        # A text that may name a special id stays as written: those names are matched by case.
        lowered = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(lowered)
        coded = split.flatten().dictionary_encode()
        place = self._learn(coded.dictionary, self.hashes(coded.dictionary))
        flat, start, size = self.flat, self.start[place], self.size[place]
        # Words whose hash is another word's are encoded for this batch alone.
        odd = self._others(coded.dictionary, place)
        if len(odd):
            more, each = self._encode(coded.dictionary.take(pa.array(odd)).to_pylist())
            start[odd], size[odd] = len(flat) + np.cumsum(each) - each, each
            flat = np.concatenate((flat, more))
        at = coded.indices.to_numpy(zero_copy_only=False)
        upto = np.concatenate(([0], np.cumsum(size[at], dtype=np.int64)))
        bounds = split.offsets.to_numpy(zero_copy_only=False)
        return gathered(flat, start, size, at), upto[bounds - bounds[0]]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One per worker process, kept between tasks."""
    return WordEncoder(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids with the end id, cut every `context` ids."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary or tokenizer_path())
        for batch in batches:
            flat, bounds = words.ids(batch.column(1))
            rows = []
            for key, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                ids = memoryview(np.append(flat[a:b], np.uint32(END_ID)).astype("<u4", copy=False)).cast("B")
                total = len(ids) // 4
                rows += [(key, at, min(context, total - at), zlib.crc32(ids[4 * at : 4 * (at + context)]), total) for at in range(0, total, context)]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return lean(docs, 2_000).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, schema)


def pack_histogram(counts: dict[int, int], context: int = CONTEXT) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (how often, lengths) that place every counted length once, shortest pack first.

    Lengths go longest first. Each goes to the packs with the most room left,
    as many at a time as a group of equal packs allows; new packs open only
    where none has room.
    """
    room: list[int] = []
    groups: dict[int, list[list]] = {}

    def put(left: int, times: int, lengths: tuple) -> None:
        if left not in groups:
            groups[left] = []
            insort(room, left)
        groups[left].append([times, lengths])

    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        need, placed = counts[length], []
        while need:
            if not room or room[-1] < length:
                placed.append((context - length, need, (length, None)))
                break
            left = room[-1]
            times, lengths = groups[left].pop()
            if not groups[left]:
                del groups[left]
                room.pop()
            fit = left // length
            if times * fit <= need or times == 1:
                each, took = (fit, times) if times * fit <= need else (min(fit, need), 1)
            else:
                each, took = (fit, need // fit) if need >= fit else (need, 1)
            if took < times:
                put(left, times - took, lengths)
            chain = lengths
            for _ in range(each):
                chain = (length, chain)
            placed.append((left - each * length, took, chain))
            need -= each * took
        for x in placed:
            put(*x)
    out = []
    for same in groups.values():
        for times, chain in same:
            lengths = []
            while chain:
                lengths.append(chain[0])
                chain = chain[1]
            out.append((times, tuple(reversed(lengths))))
    return out


def pattern_slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """For each run of ranks of a length: its first rank, and where the run's pieces go. Sorted by length, then rank."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for times, lengths in patterns:
        at = 0
        for length in lengths:
            first = used.get(length, 0)
            used[length] = first + times
            rows.append((length, first, base, at))
            at += length
        base += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("length", "first", "sequence", "offset"), table.T.copy(), strict=True))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed once a
    row. Long texts are cut every `context` ids, and the rest shares a
    sequence with others. Other columns are ignored; no rows give no rows.

    Text is tokenized once, into a saved table of pieces. The driver sees the
    histogram only: at most `context` counts, whatever the corpus. Pieces of a
    length are ranked over hash buckets and find their place by binary search
    in the broadcast runs, whose number depends on `context` alone.
    """
    cut = saved(pieces(docs, id_col, text_col, context, vocabulary), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = cut.sparkSession.sparkContext.broadcast(pattern_slots(pack_histogram(counts, context)))
    ranked = numbered(cut, ["length"], ["doc_id", "start", "ids_crc32"], "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = slots.value
        span = int(where["first"].max(initial=0)) + 1 if len(where["first"]) else 1
        bits = span.bit_length() + 1
        keys = (where["length"] << bits) + where["first"]
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            length = batch.column("length").to_numpy(zero_copy_only=False)
            last = np.searchsorted(where["length"], length, side="right") - 1
            run = np.minimum(np.searchsorted(keys, (length << bits) + np.minimum(rank, span), side="right") - 1, last)
            sequence = where["sequence"][run] + rank - where["first"][run]
            arrays = [batch.column(x) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sequence), pa.array(where["offset"][run])], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)
