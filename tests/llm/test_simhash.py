import random

import numpy as np
import pytest
import xxhash

from lodestone.llm import simhash


def brute(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def test_fingerprint_and_engine_hash(spark):
    for t in [None, "", " \t\n", "One", "one TWO", "a b c", "a b c d e f É é", "x " * 5000]:
        assert simhash.fingerprint(t) == brute(t)
    h = spark.sql("SELECT xxhash64('a b c') h").first().h
    assert h % (1 << 64) == brute("a b c")


def classes(prints):
    ids, out = list(range(len(prints))), []
    parent = ids[:]
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in ids:
        for j in ids[:i]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in ids]


@pytest.mark.parametrize("members", [4096, 2])
def test_components_equal_brute_force(spark, monkeypatch, members):
    monkeypatch.setattr(simhash, "CELL_MEMBERS", members)
    rng = random.Random(5)
    prints = []
    for _ in range(60):
        x = rng.getrandbits(64)
        prints.append(x)
        for _ in range(rng.randrange(12)):
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            prints.append(x)
    prints += [0, 0, 7, (1 << 63) | 1]
    df = spark.createDataFrame([(i, int(np.uint64(x).view(np.int64))) for i, x in enumerate(prints)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(None, prints=df).collect()}
    want = classes(prints)
    assert [got[i] for i in range(len(prints))] == want


def test_nulls_repeats_and_clashing_columns(spark):
    data = [(1, None, 1, 2), (2, "", 1, 2), (3, "some text of five words", 1, 2), (3, "some text of five words", 1, 2), (9, "quite other matter in this one here", 1, 2)]
    docs = spark.createDataFrame(data, "doc_id long, text string, fp int, component_id int")
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (3, 3), (9, 9)]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 9]
    empty = docs.limit(0)
    assert simhash.near_duplicates(empty).collect() == [] and simhash.drop_near_duplicates(empty).collect() == []


def test_rows_with_shared_or_missing_ids_keep_one_of_every_group(spark):
    texts = {k: f"{k} " + " ".join(f"{k}{i}word" for i in range(40)) for k in "ABCDE"}
    data = [(7, "A"), (7, "B"), (1, "B"), (None, "C"), (None, "D"), (0, "D"), (9, "E"), (9, "E"), (None, "E"), (3, None), (4, ""), (None, None)]
    docs = spark.createDataFrame([(i, texts.get(t, t), n) for n, (i, t) in enumerate(data)], "doc_id long, text string, root int")
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted((r.text or "")[:1] + str(r.doc_id) for r in kept) == ["3", "A7", "B1", "CNone", "D0", "E9"]
    assert next(r.root for r in kept if r.doc_id == 9) == 6


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(11)
    rows = []
    for g in range(25):
        base = [f"g{g}w{i}" for i in range(400)]
        for _ in range(rng.randrange(1, 6)):
            own = list(base)
            if rng.random() < 0.5:
                own[rng.randrange(400)] = "edit"
            rows.append((rng.choice([None, rng.randrange(40)]), " ".join(own)))
    prints = [simhash.fingerprint(t) for _, t in rows]
    group = classes(prints)
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    best = {}
    for (i, t), c in zip(rows, group, strict=True):
        best[c] = min(best.get(c, (True, 0)), (i is None, i or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(best.values())
    assert sorted(classes([simhash.fingerprint(r.text) for r in kept])) == list(range(len(best)))
