import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import quality

SCHEMA = "doc_id long, text string, score double, quality int"


def made(rng, i, words):
    """(text, quality): plain sentences, or one of four kinds of junk."""
    body = [rng.choice(words) for _ in range(rng.randrange(40, 120))]
    kind = i % 8
    if kind == 0:
        return " ".join(w + "###" for w in body), 0
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in body), 0
    if kind == 2:
        return " ".join([body[0]] * 60 + [body[1]] * 50), 0
    if kind == 3:
        return " | ".join(body), 0
    return " ".join(w.capitalize() if k % 9 == 0 else w for k, w in enumerate(body)) + ".", 1


def plain_features(text):
    """{place: value} by the definition."""
    words = text.split()
    looks = [quality.shape(w) for w in words]
    h = lambda x: quality.xxhash.xxh3_64_intdigest(x)
    lower = [h(w.encode().translate(quality._LOWER)) for w in words]
    look = [h(x) + (int(quality._REPEATS) if k and lower[k] == lower[k - 1] else 0) for k, x in enumerate(looks)]
    top, views, out = 2**64, [int(v) for v in quality._VIEWS], {}

    def place(x):
        x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD % top
        return x >> 64 - quality.BITS

    for view, (one, two) in ((lower, views[:2]), (look, views[2:])):
        view = [x % top for x in view]
        grams = [[place(x * one % top) for x in view], [place((a * two + (b ^ one)) % top) for a, b in zip(view, view[1:], strict=False)]]
        for found in grams:
            for p in found:
                out[p] = out.get(p, 0) + 1 / len(found)
    return out


def test_features_and_dot_products_follow_the_definition(monkeypatch):
    weights = np.random.default_rng(2).normal(size=quality._SIZE)
    for text in ("", "one", "Same same SAME word!! 12 a1 é $$$$", "a b c " * 30):
        want = plain_features(text)
        places, values = quality.Reader().features(text.encode())
        assert dict(zip(places[:-1].tolist(), values[:-1], strict=True)).keys() == want.keys() and places[-1] == quality._SIZE - 1 and values[-1] == 1.0
        assert all(abs(v - want[p]) < 1e-12 for p, v in zip(places[:-1].tolist(), values[:-1], strict=True))
        dot = sum(weights[p] * v for p, v in want.items())
        assert abs(quality.Reader().weigh(text.encode(), weights) - dot) < 1e-9
        for block in (1, 2, 7):  # long texts go block by block, and come to the same
            monkeypatch.setattr(quality, "_BLOCK", block)
            assert abs(quality.Reader().weigh(text.encode(), weights) - dot) < 1e-9
            again = quality.Reader().features(text.encode())
            assert (again[0] == places).all() and np.allclose(again[1], values)
        monkeypatch.undo()


def test_updates_follow_the_definition():
    rng = np.random.default_rng(3)
    learner, z, n = quality.Learner(), {}, {}
    for _ in range(60):
        places = np.append(np.sort(rng.choice(40, 6, replace=False)), quality._SIZE - 1)
        values, label = np.append(rng.random(6), 1.0), int(rng.random() < 0.5)
        w = {}
        for p in places:
            a = z.get(p, 0.0)
            w[p] = 0.0 if abs(a) <= quality.L1 else -(a - np.sign(a) * quality.L1) / ((quality.BETA + np.sqrt(n.get(p, 0.0))) / quality.ALPHA + quality.L2)
        chance = 1 / (1 + np.exp(-sum(w[p] * v for p, v in zip(places, values, strict=True))))
        for p, v in zip(places, values, strict=True):
            g = (chance - label) * v
            z[p] = z.get(p, 0.0) + g - (np.sqrt(n.get(p, 0.0) + g * g) - np.sqrt(n.get(p, 0.0))) / quality.ALPHA * w[p]
            n[p] = n.get(p, 0.0) + g * g
        learner.learn(places, values, label)
    assert all(abs(learner.z[p] - z[p]) < 1e-9 and abs(learner.n[p] - n[p]) < 1e-9 for p in z)


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(800)]
    data = [(i, *made(rng, i, words)) for i in range(700)]
    rows = [(i, t, 0.0, 5) for i, t, _ in data] + [(5000, None, 0.0, 1), (5001, "", 0.0, 1), (5002, " \n ", 0.0, 1), (5003, "Plain words here " * 50_000, 0.0, 1), (None, "zzz### qqq###", 0.0, 1), (3, data[3][1], 0.0, 5)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("places", F.lit("clash"))
    labels = spark.createDataFrame([(i, q) for i, _, q in data] + [(None, 0), (4, None), (12, 1), (12, 1)], "doc_id long, quality int")
    weights = quality.fit(df, labels)
    assert (quality.fit(df, labels) == weights).all()  # a second run learns the same
    got = quality.scores(df, weights).collect()
    truth = {i: q for i, _, q in data}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    empty = {r.score for r in got if r.doc_id in (5000, 5001, 5002)}
    assert len(empty) == 1
    other = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.fit(df, other) == weights).all()  # held-out labels change nothing
    none = quality.fit(df, labels.limit(0))
    assert {r.score for r in quality.scores(df, none).collect()} == {0.5} and quality.scores(df.limit(0), none).collect() == []
    assert not quality.fit(df.limit(0), labels).any()
