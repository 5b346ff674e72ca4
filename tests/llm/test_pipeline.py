import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as P
from lodestone.llm import linededup, packing
from lodestone.llm.simhash import fingerprint


def test_stages_keep_what_they_should(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "packing"]
    toxic = P.drop_toxic(spark, docs, sf)
    assert toxic.columns == docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in toxic.collect()}
    clean = [i for i, t in labels.items() if not t]
    assert sum(i in gone for i in clean) <= 0.05 * len(clean)
    lines = P.drop_lines(spark, docs, sf)
    assert lines.columns == docs.columns and lines.count() == docs.count()
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    near = P.drop_near_copies(spark, docs, sf)
    assert near.columns == docs.columns
    texts = {r.text for r in docs.collect()}
    assert len({r.text for r in near.collect()}) == near.count() <= len(texts)
    mixed = P.mix_sources(spark, docs, sf)
    assert mixed.columns == docs.columns


def test_run_packs_what_the_mix_took(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = Tokenizer.from_file(packing.tokenizer_path())
    got = P.run(spark, sf).collect()
    boiler = linededup.drop_boilerplate(P.drop_toxic(spark, docs, sf))
    ids = {r.doc_id: np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in boiler.collect()}
    assert got and {r.doc_id for r in got} <= set(ids)
    for r in got:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())


def test_near_copies_of_five_word_jaccard_go(spark):
    rng = random.Random(5)
    jaccard = lambda a, b: len(a & b) / len(a | b)
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    rows = []
    for i in range(60):
        body = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 200))]
        rows.append((2 * i, " ".join(body)))
        edited = list(body)
        for _ in range(1 + len(body) // 60):
            edited[rng.randrange(len(body))] = "changed"
        rows.append((2 * i + 1, " ".join(edited if i % 2 else edited[: len(body) // 2])))
    rows += [(200, "one two"), (201, "one two"), (202, "one three"), (203, None), (204, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = dict((i, grams(t)) for i, t in rows[:120])
    alike = {2 * i + 1 for i in range(60) if jaccard(sets[2 * i], sets[2 * i + 1]) >= 0.8}
    bits = lambda i: (fingerprint(rows[i][1]) ^ fingerprint(rows[i - 1][1])).bit_count()
    assert len(alike) >= 15 and any(bits(i) > 3 for i in alike)
    near = {i for i in range(1, 120, 2) if bits(i) <= 3}
    left = P.drop_near_copies(spark, docs, "")
    assert {r.doc_id for r in left.collect()} == {i for i, _ in rows} - alike - near - {201, 204}
    assert left.columns == docs.columns and P.drop_near_copies(spark, docs.limit(0), "").collect() == []


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, shingles string"


def folder(spark, tmp_path, rows, labels):
    spark.createDataFrame([(i, t, lang, s, n, 0.5, 1, "x") for i, t, lang, s, n in rows], SCHEMA).repartition(3).write.parquet(f"file:{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file:{tmp_path}/labels.parquet")
    return f"file:{tmp_path}"


def plain_groups(texts):
    """Smallest members of the classes of near copies, by comparing every pair."""
    grams = []
    for t in texts:
        w = (t or "").encode().lower().split()
        grams.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    prints, label = [fingerprint(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            shared = len(grams[i] & grams[j])
            alike = shared and shared >= 0.8 * (len(grams[i]) + len(grams[j]) - shared) - 1e-9
            if alike or (prints[i] ^ prints[j]).bit_count() <= 3:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return label


def test_run_agrees_with_plain_stages(spark, tmp_path):
    from collections import Counter

    from lodestone.llm import mixing, toxicity

    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(5)) for _ in range(900)]
    plain = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(150):
        text = plain(rng.randrange(30, 90))
        if i % 9 == 0:
            text = " ".join(w + (" zorglub quixzap" if k % 9 == 0 else "") for k, w in enumerate(text.split()))
        if i % 10 == 1:
            text = rows[-1][1].rsplit(" ", 1)[0] + " changed"
        rows.append((i, f"{text}\nread more here" if i % 2 else text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(i % 9 == 0)))
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (None, plain(40), None, None, 7), (None, plain(40), "en", "s1", None)]
    rows += [(5, plain(50), "en", "s2", 1), (302, "long words " * 20_000, "en", "s3", 1)] + [rows[7]] * 3
    sf = folder(spark, tmp_path, rows, labels)
    docs, tally = spark.read.parquet(f"{sf}/documents.parquet"), lambda rs: Counter((r.doc_id, r.text, r.source) for r in rs)
    matcher = toxicity.Matcher(toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    stage = docs.collect()
    found = P.drop_toxic(spark, docs, sf)
    assert tally(found.collect()) == tally([r for r in stage if matcher.score(r.text) < 0.5]) and found.count() < docs.count()

    docs, stage = found, found.collect()
    found = P.drop_lines(spark, docs, sf)
    pages, seen = Counter(r.source for r in stage), Counter((r.source, x) for r in stage for x in {y.strip() for y in (r.text or "").split("\n")})
    bad = {(s, x) for (s, x), n in seen.items() if x and n >= 3 and n > 0.1 * pages[s]}
    want = Counter((r.doc_id, None if r.text is None else "\n".join(x for x in r.text.split("\n") if (r.source, x.strip()) not in bad), r.source) for r in stage)
    assert tally(found.collect()) == want and bad

    docs, stage = found, found.collect()
    found = P.drop_near_copies(spark, docs, sf)
    label, best = plain_groups([r.text for r in stage]), {}
    for r, c in zip(stage, label, strict=True):
        best[c] = min(best.get(c, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    kept = found.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(best.values()) and len(kept) < len(stage)
    assert len(set(plain_groups([r.text for r in kept]))) == len(kept)

    copies = mixing.mix(found).collect()
    times = Counter()
    for r in copies:
        times[r.doc_id] += max(r.copies, 1) if r.size == 0 else r.copies
    mixed = P.mix_sources(spark, found, sf)
    assert Counter(r.doc_id for r in mixed.collect()) == +times and mixed.columns == found.columns == spark.read.parquet(f"{sf}/documents.parquet").columns

    got = P.run(spark, sf).collect()
    assert Counter(r.doc_id for r in got if r.start == 0) == +times
    whole, tokens = Tokenizer.from_file(packing.tokenizer_path()), Counter()
    for r in mixed.collect():
        tokens[r.doc_id] += len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1
    packed = Counter()
    for r in got:
        packed[r.doc_id] += r.length
    assert packed == tokens


def test_empty_tables(spark, tmp_path):
    sf = folder(spark, tmp_path, [], [])
    assert P.run(spark, sf).collect() == []
