import random

import numpy as np

from lodestone.llm import substring
from lodestone.llm.components import connected_components


def text(rng, n, words):
    return " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 6000 + i) for i in range(300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_spanning_links_connect_exactly_what_is_similar():
    rng = np.random.default_rng(1)
    sets, keys = [], np.arange(60)
    for _ in range(12):
        base = rng.integers(0, 1 << 40, 40)
        for _ in range(5):
            own = base.copy()
            own[: rng.integers(0, 9)] += 1
            sets.append(np.unique(own))
    def groups(links):
        label = list(range(60))
        for a, b in links:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
        return label
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    every = [(i, j) for i in range(60) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    links = substring.spanning_links(keys, sets)
    assert groups(links) == groups(every) and len(links) < 60


def test_passages(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    passage, rows = text(rng, 55, words), []
    for i in range(60):
        body = text(rng, 150, words).split()
        if i in (3, 17, 40):
            body[70:70] = passage.split()
        rows.append((i, " ".join(body[:100]) + "\n" + " ".join(body[100:])))
    long = text(rng, 60, words)
    edited = long.split()
    edited[0] = "changed"
    rows += [(70, "short line here\n" + long), (71, " ".join(edited)), (72, None), (73, ""), (74, "short line here"), (75, "menu line that many pages have"), (76, "menu line that many pages have")]
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, start int, key string")
    got = substring.repeated_passages(df).collect()
    assert {r.doc_id for r in got} == {3, 17, 40, 70, 71}
    assert {r.keep_doc_id for r in got if r.doc_id in (3, 17, 40)} == {3}
    assert {r.keep_doc_id for r in got if r.doc_id in (70, 71)} == {70}
    assert all(r.removed == (r.doc_id != r.keep_doc_id) for r in got)
    by = {i: t.split() for i, t in rows if t}
    for r in got:
        if r.doc_id == 17:
            span = " ".join(by[17][r.passage_start : r.passage_start + r.passage_words])
            assert span in passage
    assert substring.repeated_passages(df.limit(0)).collect() == []


def test_copies_and_repeated_rows(spark):
    rng = random.Random(4)
    words = [f"w{i}x" for i in range(500)]
    body = text(rng, 80, words)
    df = spark.createDataFrame([(1, body), (2, body), (2, body), (9, text(rng, 80, words))], "doc_id long, text string")
    assert {(r.doc_id, r.keep_doc_id) for r in substring.repeated_passages(df).collect()} == {(1, 1), (2, 1)}
    alone = spark.createDataFrame([(2, body), (2, body)], "doc_id long, text string")
    assert substring.repeated_passages(alone).collect() == []


def test_every_copy_of_28_words_is_found_word_by_word(spark):
    rng = random.Random(28)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(5000)]
    rows, spans = [], {}
    for i in range(120):
        n = (27, 28, 29, 32, 40, 51)[i % 6]
        copy = [rng.choice(words) for _ in range(n)]
        for k, d in enumerate((2 * i, 2 * i + 1)):
            before, after = ([f"{w}{d}" for w in rng.choices(words, k=rng.randrange(5, 60))] for _ in range(2))
            rows.append((d, " ".join(before) + ("\n" if k else " ") + " ".join(copy) + ("\n" if k else " ") + " ".join(after)))
            if n >= 28:
                spans[d] = (len(before), n)
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.passage_start, r.passage_words) for r in got} == {(d, *x) for d, x in spans.items()}
    assert all(r.keep_doc_id == r.doc_id // 2 * 2 and r.removed == bool(r.doc_id % 2) for r in got)


def test_copied_words_agree_with_brute_force(spark):
    rng = random.Random(6)
    pool = [[rng.choice("abcdefg") + str(rng.randrange(90)) for _ in range(70)] for _ in range(12)]
    rows = []
    for i in range(80):
        body = []
        for _ in range(rng.randrange(4)):
            part = rng.choice(pool)
            at = rng.randrange(45)
            body += part[at : at + rng.randrange(20, 60)] + [f"u{rng.randrange(1 << 40)}" for _ in range(rng.randrange(20))]
        rows.append((i, " ".join(body)))
    rows += [(90, " ".join(["la"] * 100)), (91, " ".join(["la"] * 60)), (91, " ".join(["la"] * 60))]
    windows = {}
    for i, t in rows:
        w = t.split()
        for a in range(len(w) - 27):
            windows.setdefault(tuple(w[a : a + 28]), set()).add((i, a))
    want, first = set(), {}
    for places in windows.values():
        if len({i for i, _ in places}) > 1:
            for i, a in places:
                want |= {(i, a + k) for k in range(28)}
                first[i, a] = min(places)[0]
    units = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.repeated_passages(units).collect()
    exact = [r for r in got if r.words >= 28 and all((r.doc_id, r.start + k) in first for k in range(r.words - 27))]
    assert {(r.doc_id, r.start + k) for r in exact for k in range(r.words)} == want
    assert {(r.doc_id, r.start + k) for r in got for k in range(r.words)} >= want
    least = {}
    for r in exact:
        for k in range(r.words - 27):
            least.setdefault((r.doc_id, r.start + k), set()).add(r.keep_doc_id)
    assert all(first[k] in least[k] for k in first)


def test_equal_paragraphs_are_clusters_at_full_length(spark):
    rng = random.Random(27)
    words = [f"w{i}x" for i in range(4000)]
    plain = lambda n: " ".join(rng.choice(words) for _ in range(n))
    near, same, whole = plain(20), plain(20), plain(60)
    edited = " ".join([*near.split()[:-1], "changed"])
    rows = [(1, f"{plain(30)}\n{near}\n{same}\n{plain(30)}"), (2, f"{plain(30)}\n{edited}\n{same}\n{plain(30)}"), (3, f"{plain(9)}\n{whole}"), (4, f"{whole}\n{plain(9)}"), (5, plain(9) + "\n" + plain(60))]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.passage_start, r.passage_words) for r in got} == {(1, 30, 40), (2, 30, 40), (3, 9, 60), (4, 0, 60)}
    clusters = {}
    for r in got:
        if r.words in (20, 60):
            clusters.setdefault(r.cluster_id, []).append((r.doc_id, r.start, r.words, r.keep_doc_id))
    assert sorted(map(sorted, clusters.values())) == [[(1, 30, 20, 1), (2, 30, 20, 1)], [(1, 50, 20, 1), (2, 50, 20, 1)], [(3, 9, 60, 3), (4, 0, 60, 3)]]


def test_lines_of_equal_hash_sums_are_told_apart(spark):
    for n in (1024, 4096):
        one, other = ([("alpha", "beta")[(i.bit_count() + k) % 2] for i in range(n)] for k in (0, 1))
        words = substring.Words(__import__("pyarrow").array([" ".join(one), " ".join(other)]))
        keys = words.hashed(*words.lines())
        assert keys[0, 0] != keys[1, 0] and keys[0, 1] != keys[1, 1]


def test_runs_are_told_apart_modulo_a_prime():
    rng = np.random.default_rng(7)
    p, base = substring._PRIME, substring._BASE
    a, b = (rng.integers(0, p, 2000, np.uint64) for _ in range(2))
    edge = np.array([0, 1, 2, p - 1, p - 2, (1 << 31) - 1, 1 << 31, 1 << 60], np.uint64)
    a, b = np.concatenate([a, np.repeat(edge, 8)]), np.concatenate([b, np.tile(edge, 8)])
    assert substring._times(a, b).tolist() == [int(x) * int(y) % p for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    words = substring.Words(__import__("pyarrow").array([" ".join(f"w{i % 17}" for i in range(300)), "a b c"]))
    code = [int(x) % p for x in words.code.tolist()]
    for k in (1, 8, 28, 303):
        want = np.array([sum(c * pow(base, j, p) for j, c in enumerate(code[i : i + k])) % p for i in range(len(code) - k + 1)], np.uint64)
        assert (words.runs(k) == substring._mixed(want)).all()


def test_windows_of_equal_hash_sums_are_told_apart(spark):
    """Two words in the order of the Thue-Morse sequence and the other way round: their sums modulo a power of two are equal."""
    for n in (1024, 2048):
        one, other = (" ".join(("alpha", "beta")[(i.bit_count() + k) % 2] for i in range(n)) for k in (0, 1))
        docs = spark.createDataFrame([(1, f"here {one} there"), (2, f"now {other} then"), (3, "x"), (4, f"early {one}")], "doc_id long, text string")
        found = {(r.doc_id, r.start, r.words) for r in substring.repeated_passages(docs, passage_words=n, paragraph_words=9 * n).collect()}
        assert found == {(1, 1, n), (4, 1, n)}


def test_a_very_long_text(spark):
    rng = random.Random(3)
    words = [f"w{i}x" for i in range(50_000)]
    long = [rng.choice(words) for _ in range(300_000)]
    copy = long[250_000:250_060]
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(["own", *copy, "end"])), (3, " ".join(rng.choice(words) for _ in range(200)))], "doc_id long, text string")
    assert {(r.doc_id, r.passage_start, r.passage_words) for r in substring.repeated_passages(docs).collect()} == {(1, 250_000, 60), (2, 1, 60)}


def test_each_length_on_both_sides_of_its_limit(spark):
    rng = random.Random(12)
    words = [f"w{i}x" for i in range(9000)]
    plain = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, lines = [], {}
    for i, n in enumerate((1, 4, 5, 10, 12, 13, 20, 27, 28)):
        lines[n] = plain(n)
        rows += [(2 * i, f"{plain(40)}\n{lines[n]}\n{plain(40)}"), (2 * i + 1, f"{plain(30)}\n{lines[n]}")]
    middle = {n: plain(n) for n in (20, 27, 28)}
    rows += [(100 + 2 * i + k, f"{plain(20 + k)} {middle[n]} {plain(20)}") for i, n in enumerate(middle) for k in (0, 1)]
    docs = spark.createDataFrame([*rows, (None, None), (None, "")], "doc_id long, text string")
    found = lambda **more: {(r.doc_id, r.passage_words) for r in substring.repeated_passages(docs, **more).collect()}
    both = lambda first, n: {(first, n), (first + 1, n)}
    exact = both(104, 28)
    assert found() == both(10, 13) | both(12, 20) | both(14, 27) | both(16, 28) | exact
    every = found(paragraph_words=1)
    assert every == exact.union(*(both(2 * i, n) for i, n in enumerate(lines)))
    assert found(least_words=28) == both(16, 28) | exact
    assert found(passage_words=20, paragraph_words=100) == both(12, 20) | both(14, 27) | both(16, 28) | both(100, 20) | both(102, 27) | exact


def test_crowded_buckets_connect_what_blocks_connect(spark, monkeypatch):
    rng = np.random.default_rng(3)
    sets, keys = [], list(range(90))
    for _ in range(6):
        base = rng.integers(0, 1 << 40, 60)
        for _ in range(15):
            own = base.copy()
            own[: rng.integers(0, 12)] = rng.integers(0, 1 << 40)
            sets.append(sorted({int(x) for x in own}))
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    edges = [(i, j) for i in keys for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    bands = spark.createDataFrame([(k, [k // 30, 7]) for k in keys], "key long, bands array<long>")
    table = spark.createDataFrame(list(zip(keys, sets, strict=True)), "key long, shingles array<long>")

    def groups(links):
        label = list(keys)
        for a, b in links:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
        return label

    for members, shingles in ((2000, 1_000_000), (7, 1_000_000), (2000, 400)):
        monkeypatch.setattr(substring, "BLOCK_MEMBERS", members)
        monkeypatch.setattr(substring, "BLOCK_SHINGLES", shingles)
        assert groups([(r.a, r.b) for r in substring.near_sets(bands, table).collect()]) == groups(edges)
