import math
import random

import pytest

from lodestone.llm import mixing

SCHEMA = "doc_id long, text string, source string, n_chars long, size int, target string, lam double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 0, 0, "x", 0.0) for i, t, s in rows], SCHEMA)


def levels(sizes, weights, cap):
    """Resharing by hand: sizes in source order."""
    total, out, full = sum(sizes), [0.0] * len(sizes), set()
    while True:
        rest = total - sum(cap * sizes[i] for i in full)
        live = [i for i in range(len(sizes)) if i not in full]
        share = sum(weights[i] for i in live)
        for i in live:
            out[i] = rest * weights[i] / share
        over = {i for i in live if out[i] > cap * sizes[i]}
        for i in over:
            out[i] = cap * sizes[i]
        if not over:
            return out
        full |= over


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_rates(spark, seed):
    rng = random.Random(seed)
    rows, i = [], 0
    for s in range(7):
        for _ in range(rng.choice([5, 40, 200])):
            rows.append((i, "w " * int(rng.lognormvariate(3, 1)), f"s{s}" if s else None))
            i += 1
    got = mixing.mix(docs(spark, rows)).collect()
    names = sorted({r[2] for r in rows if r[2]}) + [None]
    size = {n: sum(len(t.split()) for _, t, s in rows if s == n) for n in names}
    want = dict(zip(names, levels([size[n] for n in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 3), strict=True))
    of = {i: s for i, _, s in rows}
    longest = {n: max(len(t.split()) for _, t, s in rows if s == n) for n in names}
    for n in names:
        mine = [r for r in got if of[r.doc_id] == n]
        assert all(r.source_size == size[n] and abs(r.target - want[n]) < 1e-6 * want[n] for r in mine)
        assert abs(sum(r.rate * r.size for r in mine) - want[n]) <= 1e-6 * want[n]
        assert abs(sum(r.taken for r in mine) - want[n]) <= longest[n]
        assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in mine)
        # An exponential tilt: log odds are linear in size.
        odds = {r.size: math.log(r.rate / (3 - r.rate)) + math.log(2) for r in mine if r.size and 0.01 < r.rate < 2.99}
        slopes = [v / k for k, v in odds.items()]
        assert not slopes or max(slopes) - min(slopes) < 1e-6 * max(1, abs(max(slopes)))
    again = mixing.mix(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", "b"), (3, "one two", "b"), (4, " \t", None)]
    got = {(r.doc_id, r.size, r.source_size) for r in mixing.mix(docs(spark, rows)).collect()}
    assert got == {(1, 0, 0), (2, 0, 0), (3, 2, 4), (4, 0, 0)}
    out = mixing.mixed_rows(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3, 3, 4]
    assert mixing.mix(docs(spark, [])).collect() == [] and mixing.mixed_rows(docs(spark, [])).collect() == []


def test_mixed_rows_are_the_copies(spark):
    rows = [(i, "w " * (1 + i % 17), f"s{i % 3}") for i in range(90)]
    plan = {r.doc_id: r.copies for r in mixing.mix(docs(spark, rows)).collect()}
    found = {}
    for r in mixing.mixed_rows(docs(spark, rows)).collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {k: v for k, v in plan.items() if v}


def test_many_sources_go_through_shuffles_and_agree(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(40), f"s{i % 9}") for i in range(300)] + [(900, "long " * 50_000, "s1"), (None, "x y", "s2"), (None, "x y", "s2")]
    want = sorted(map(repr, mixing.mix(docs(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "SOURCES", 0)
    assert sorted(map(repr, mixing.mix(docs(spark, rows)).collect())) == want
