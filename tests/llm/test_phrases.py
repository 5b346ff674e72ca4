import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import phrases

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, words=3, least=10, report=2000):
    """The report by its definition; rows are (lang, text)."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            found = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(found)
            for k in range(1, words + 1):
                f.setdefault(lang, Counter()).update(tuple(found[i : i + k]) for i in range(len(found) - k + 1))
    out = set()
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in kept.items():
            inside = lambda q, p=p: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
            if any(inside(q) and 100 * b >= 50 * a for q, b in kept.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:report], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return out


def corpus(rng):
    words = ["la", "De", "x", "é", "É", "new", "york", "city", "a b", "w|", "the"]
    rows = []
    for i in range(300):
        body = [rng.choice(words) for _ in range(rng.randrange(30))]
        if i % 3 == 0:
            body += ["New", "York", "City"]
        if i % 7 == 0:
            body += ["hot", "dog"] if i % 2 else ["hot", "dog", "stand"]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for w in body)
        rows.append((("aa", "bb", None)[i % 3], text))
    return rows + [("und", "new york city " * 15), ("aa", None), ("cc", ""), ("dd", " .,; "), ("ee", "la la la la " * 20), ("ff", "once upon")]


def test_report_equals_its_definition(spark, monkeypatch):
    rows = corpus(random.Random(1))
    df = spark.createDataFrame([(i, lang, t, "x", 1) for i, (lang, t) in enumerate(rows)], "doc_id int, lang string, text string, phrase string, f int").repartition(4)
    show = lambda **more: {tuple(r) for r in phrases.collocations(df, **more).collect()}
    want = plain(rows)
    assert len(want) > 20 and show() == want
    assert show(words=4, least=5, report=7) == plain(rows, 4, 5, 7)
    # A sketch that is far too small bounds nothing, and shards of a text or so: the results are the same.
    monkeypatch.setattr(phrases, "CELLS_TO", phrases.CELLS_FROM)
    monkeypatch.setattr(phrases, "_SHARD", 10)
    monkeypatch.setattr(phrases, "_GATHERED", 50)
    assert show() == want
    assert phrases.collocations(df.limit(0)).collect() == []


def test_every_frequent_phrase_is_in_a_high_cell(spark):
    rows = corpus(random.Random(2))
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    bits, high = phrases.sketch(df, 3, 10)
    counts = {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        names, ids = phrases._numbered(phrases.tokens(None if text is None else text.encode()))
        for n, (at, cells) in enumerate(phrases._cells(lang, names, ids, 3, bits), 1):
            for i, cell in zip(at, cells.tolist(), strict=True):
                key = (lang, *(names[x] for x in ids[i : i + n]))
                counts.setdefault(key, [0, cell])[0] += 1
                assert counts[key][1] == cell
    flags = np.unpackbits(high)
    assert all(flags[cell] for n, cell in counts.values() if n >= 10)
    assert sum(bool(flags[cell]) for n, cell in counts.values() if n < 5) < 0.05 * len(counts)


def test_matches_overlap_and_stay_within_pieces():
    found = phrases.tokens(b"a a a a. a b\ta, b a\nB A b")
    assert b" ".join(x for x in found if x != b"\xff") == b"a a a a a b a b a b a b"
    assert phrases.matches(["a a", "a a a", "a b", "b a", "b a b", "a", "c"], found).tolist() == [3, 2, 2, 3, 1, 8, 0]
    assert phrases.matches([], found).tolist() == []


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_007
    rows = [("x", "", 0, 4 * big), ("x", "a", 1, 2 * big), ("x", "b", 1, big + 2), ("x", "c", 1, 2 * big + 1), ("x", "a b", 2, big), ("x", "b c", 2, big - 1), ("x", "a b c", 3, big // 2)]
    counted = spark.createDataFrame(rows, "lang string, phrase string, words int, f long")
    f = {tuple(p.split()): n for _, p, w, n in rows if w}
    want = {}
    for p, a in f.items():
        if len(p) > 1:
            want[" ".join(p)] = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))[0]
    got = {r.phrase: r.score for r in phrases.scored(counted).collect()}
    assert got == {"a b": want["a b"], "a b c": want["a b c"]}  # b c is in a b c for half of its occurrences and more
    assert {r.phrase: r.score for r in phrases.scored(counted, covered=60).collect()} == want


def test_long_texts_and_many_candidates(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = [("aa", " ".join(rng.choice(words) for _ in range(60_000))), ("aa", "solo " * 40_000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = {tuple(r) for r in phrases.collocations(df).collect()}
    assert got == plain(rows) and any(r[2] == "solo solo solo" for r in got)
    assert df.select(F.max(F.length("text"))).first()[0] > 200_000
