import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from lodestone.llm.packing import WordEncoder, pack, pack_histogram, tokenizer_path, word_hashes


def test_histogram_is_placed_exactly_and_tightly():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 65, rng.integers(1, 400))
        counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
        patterns = pack_histogram(counts, 64)
        back = {}
        for times, one in patterns:
            assert sum(one) <= 64
            for x in one:
                back[x] = back.get(x, 0) + times
        assert back == counts
        assert sum(t for t, _ in patterns) <= 1.3 * sum(lengths) / 64 + 2


def test_word_ids_equal_whole_text_ids(spark):
    whole = Tokenizer.from_file(tokenizer_path())
    texts = ["Hello,  world's\tend\n\n  É é it's 123abc  x y", "", "a<|endoftext|>b <|startoftext|>", " lead trail ", "日本 語\x0bß İstanbul ΣΑΣ", "!!! ... ---word"]
    encoder = WordEncoder(tokenizer_path())
    texts += ["RE. re, Re### été!! d'été's o'clock's é\u0301x. \u2014. a\u2014. x's. y'S! 1st. a1. \u0130. \u03a3.", "tail-' 's. it's' ..a.. w... w., it's. <|ENDOFTEXT|> E. \u00a0b\u00a0. \u3000\u3000"]
    for _ in range(2):
        flat, bounds = encoder.ids(pa.array([None, *texts])[1:])
        for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
            assert flat[a:b].tolist() == whole.encode(t, add_special_tokens=False).ids


def test_pieces_fill_sequences_without_gaps(spark):
    texts = [None, "", "same words here", "same words here", "word " * 9000] + [f"text {i} " * (i % 37) for i in range(300)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(3, "same words here", 5), (None, "x", 5)], "doc_id long, text string, length int")
    got = pack(docs).collect()
    whole = Tokenizer.from_file(tokenizer_path())
    ids = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate([*texts])}
    ids[None] = np.array([*whole.encode("x", add_special_tokens=False).ids, 1], "<u4")
    fill = {}
    for r in got:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(map(len, ids.values())) + len(ids[3])
    for x in fill.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def thue_morse(n, a, b):
    return [(a, b)[i.bit_count() % 2] for i in range(n)]


def test_words_of_one_hash_have_their_own_ids():
    whole = Tokenizer.from_file(tokenizer_path())
    pairs = [("".join(thue_morse(n, "a", "b")), "".join(thue_morse(n, "b", "a"))) for n in (1024, 4096)]
    texts = [x for pair in pairs for x in pair] + ["one two ab ba"]
    encoder = WordEncoder(tokenizer_path())
    hashes = word_hashes(pa.array(texts[:4]))
    assert hashes[0] == hashes[1] and hashes[2] == hashes[3]
    encoder.hashes = lambda words: np.zeros(len(words), np.uint64)
    for one in (WordEncoder(tokenizer_path()), encoder):
        for batch in (texts, texts[::-1], [" ".join(texts), "", texts[1], "two"]):
            flat, bounds = one.ids(pa.array(batch))
            for t, a, b in zip(batch, bounds[:-1], bounds[1:], strict=True):
                assert flat[a:b].tolist() == whole.encode(t, add_special_tokens=False).ids


def test_other_vocabularies_encode_whole_texts():
    import glob
    import os

    import public_tokenizers

    texts = ["Hello,  World's\tend\n\n  É 123abc. x", "", " lead trail ", "日本 語 ß", "a. B. ab."]
    for path in glob.glob(os.path.join(os.path.dirname(public_tokenizers.__file__), "*.json")):
        try:
            whole = Tokenizer.from_file(path)
        except Exception:  # not a tokenizer's file
            continue
        flat, bounds = WordEncoder(path).ids(pa.array([None, *texts]))
        for t, a, b in zip(["", *texts], bounds[:-1], bounds[1:], strict=True):
            assert flat[a:b].tolist() == whole.encode(t, add_special_tokens=False).ids, path


def test_clashing_columns_and_null_ids(spark):
    rows = [(i % 7 or None, "a word or two " * (i % 5), i, i, i, i, "z") for i in range(60)] + [(1, "word " * 60_000, 0, 0, 0, 0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int, _bucket int, sequence_id int, offset int, length string")
    got = pack(docs).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in got if r.start == 0) == sorted((i or 0, len(t.split()) + 1) for i, t, *_ in rows)
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in fill.values():
        assert [a for a, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 2048
