import numpy as np
import pytest

from lodestone.llm import ann

SCHEMA = "vec_id long, embedding array<float>, axis int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 0.0) for i, v in rows], SCHEMA)


def exact(rows, queries, k):
    good = [(i, np.array(v, "f4").astype("f8")) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in queries:
        own = [v for i, v in good if i == q]
        if own:
            out[q] = sorted(((-float(np.dot(own[0], v)), i) for i, v in good if i != q))[:k]
    return out


def test_rotation_keeps_lengths_and_axes_are_nearest():
    x = np.random.default_rng(0).normal(size=(20, 24))
    turned = ann.rotated(x, 3)
    assert turned.shape == (20, 32) and np.allclose(np.linalg.norm(turned, axis=1), np.linalg.norm(x, axis=1))
    first = ann.nearest_axes(x, 3, 1)[:, 0]
    assert (np.abs(turned)[np.arange(20), first % 32] == np.abs(turned).max(axis=1)).all()


@pytest.mark.parametrize("unequal", [False, True])
def test_recall(spark, unequal):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 64))
    x = centres[rng.integers(0, 12, 1200)] * 0.35 + rng.normal(size=(1200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if unequal:
        x *= rng.uniform(0.5, 2, (1200, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = frame(spark, rows)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = exact(rows, range(0, 1200, 20), 20)
    assert all(len(v) == 20 for v in got.values()) and len(got) == 60
    hit = sum(len({i for _, i in want[q]} & {i for _, i, _ in got[q]}) for q in want) / (20 * len(want))
    assert hit >= 0.9
    for q, found in got.items():
        found.sort()
        assert [-s for _, _, s in found] == sorted(-s for _, _, s in found)
        true = dict((i, -s) for s, i in exact(rows, [q], 5000)[q])
        assert all(abs(true[i] - s) < 1e-9 for _, i, s in found)


def test_ties_bad_vectors_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK_ROWS", 7)
    monkeypatch.setattr(ann, "CHUNK_QUERIES", 3)
    same = [0.6, 0.8, 0.0]
    rows = [(i, same) for i in range(40)] + [(40, None), (41, [0, 0, 0]), (42, [float("nan"), 1, 1]), (43, [None, 1, 1]), (44, [float("inf"), 0, 1])]
    df = frame(spark, rows)
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 0] == list(range(1, 21))
    assert [r.vec_id for r in got if r.query_id == 20] == list(range(20))
    few = frame(spark, [(0, [1, 0, 0]), (1, [-1, 0, 0]), (2, [0, 1, 0.5]), (2, [0, 1, 0.5]), (3, [0, -2])])
    found = ann.nearest(few, few.where("vec_id = 0"), 20).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 6)) for r in found] == [(2, 0.0), (3, 0.0), (1, -1.0)]
    assert ann.nearest(few.limit(0), few, 5).collect() == [] and ann.nearest(few, few.limit(0), 5).collect() == []
