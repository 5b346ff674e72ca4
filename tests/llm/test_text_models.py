import random
import zlib

import numpy as np

from lodestone.llm import langid, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, score double, curve int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0.0, 0) for i, t, lang in rows], SCHEMA)


def test_folding():
    assert toxicity.fold("Тr4sh, ЅTÚPID!! 1d10t $$$ 555-7209 a@b") == " trash stupid idiot ldlot aab "
    assert toxicity.fold(None) == toxicity.fold(" 12 ") == "  ".replace("  ", " ") or toxicity.fold(None).strip() == ""


def test_disguises_are_folded():
    assert toxicity.fold("zοrgluЬ zorg\u200blub zo\u00adrglub zórglu\u0301b") == " " + "zorglub " * 4
    assert toxicity.fold("zorg1ub 1d10t 11 z0rg") == " zorgiub zorglub idiot ldlot zorg "
    assert toxicity.fold("һеlр ԁо ӏеt ɩt ᴢᴏʀɢ 𝐳𝐨𝐫𝐠 ｚｏｒｇ ⓩⓞⓡⓖ") == " help do let it zorg zorg zorg zorg "
    assert toxicity.fold("see z o r g l u b now, a b c as is") == " see zorglub now a b c as is "
    assert toxicity.fold("größe") == " große " and toxicity.fold("\u200b") == " "


def test_matcher_boundaries_and_exceptions():
    m = toxicity.Matcher(toxicity.Model({" trash ": 2.0, " tras": 1.0, " scum": 3.0}, (0.0, 1.0, 0.0), ("trash can",)))
    assert m.weigh("trash trashed untrash") == (3.0, 3)
    assert m.weigh("the trash can") == (0.0, 3)
    assert m.weigh("scum scummy sc0m") == (6.0, 3)
    assert m.weigh("") == (0.0, 0) and m.weigh(None) == (0.0, 0)


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        text = [rng.choice(words) for _ in range(60)]
        if bad:
            for _ in range(4):
                text[rng.randrange(60)] = rng.choice(["zorglub", "zorglubish", "quixzap"])
        rows.append((i, " ".join(text), "en"))
        labels.append((i, int(bad)))
    rows += [(2000, None, None), (2001, "", None), (2002, "Zorglub! " + "fine words here " * 20_000, None), (5, rows[5][1], None)]
    df = docs(spark, rows)
    model = toxicity.fit(df, spark.createDataFrame([*labels, (3, None), (4, 0)], "doc_id long, toxic int"))
    got = toxicity.scores(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert {r.doc_id for r in got if r.predicted and r.doc_id >= 2000} == set()
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(1 - r.predicted for r in got)
    none = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.scores(df.limit(0), none).collect() == [] and {r.predicted for r in toxicity.scores(df, none).collect()} == {0}


def test_bundles_equal_the_definition():
    text = "ab, bca"
    want = np.zeros(langid.DIMENSIONS)
    s = " ab bca "
    for a, b, c in zip(s, s[1:], s[2:], strict=False):
        if b != " ":
            want += np.roll(langid._letter(ord(a)), 2) * np.roll(langid._letter(ord(b)), 1) * langid._letter(ord(c))
    assert np.allclose(langid.bundles([text, None, "12"])[0], want)
    assert not langid.bundles([text, None, "12"])[1:].any()


def test_blocks_do_not_matter(monkeypatch):
    texts = ["some words in a row " * 30, "x", "ééé one", ""]
    whole = langid.bundles(texts)
    monkeypatch.setattr(langid, "_BLOCK", 64)
    assert np.allclose(langid.bundles(texts), whole)


def test_languages(spark):
    rng = random.Random(9)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "eit", "och"], "cc": ["çé", "eau", "ou", "ê"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[l]) for _ in range(3)) for _ in range(20)), l) for i, l in enumerate(sorted(syllables) * 60)]
    rows += [(500, None, "aa"), (501, "12 !!", "aa"), (502, "kalomi " * 60_000, None), (3, rows[3][1], rows[3][2])]
    df = docs(spark, rows)
    got = langid.languages(df, langid.fit(df)).collect()
    truth = {i: l for i, _, l in rows if i < 500}
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[500] == by[501] == "und" and by[502] == "aa"
    assert langid.languages(df.limit(0), langid.fit(df.limit(0))).collect() == []


def test_no_language_is_cut_away(spark):
    from pyspark.sql import functions as F

    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.concat(F.lit("l"), F.col("id") % 20_000).alias("lang"))
    learn = docs.where(langid.remainder("doc_id", langid.PARTS) != langid.HELD).select("lang").distinct().count()
    assert learn > 10_000 and langid.drawn(docs).select("lang").distinct().count() == learn


def auc(y, score):
    good, bad = [x for x, t in zip(score, y, strict=True) if not t], [x for x, t in zip(score, y, strict=True) if t]
    return sum((b > g) + (b == g) / 2 for b in bad for g in good) / len(bad) / len(good)


def test_few_labels_are_enough_and_clean_phrases_are_spared(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(2000)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 8 == 0
        text = [rng.choice(words) for _ in range(80)]
        if bad:
            for _ in range(3):
                text[rng.randrange(80)] = rng.choice(["zorglub", "quixzap", "mubblefop"])
        elif i % 3 == 0:
            text[40:42] = ["zorglub", "festival"]
        rows.append((i, " ".join(text), "en"))
        labels.append((i, int(bad)))
    df = docs(spark, [*rows, (None, "zorglub zorglub quixzap", None)])
    model = toxicity.fit(df, spark.createDataFrame([*labels, (None, 1)], "doc_id long, toxic int"))
    assert " quixzap " in model.terms and "zorglub festival" in model.exceptions
    got = toxicity.scores(df, model).collect()
    held = [r for r in got if r.held_out]
    truth = dict(labels)
    assert auc([truth[r.doc_id] for r in held], [r.score for r in held]) >= 0.9
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    weights = toxicity.Matcher(model)
    for r in got[:60]:
        assert abs(r.score - weights.score(rows[r.doc_id][1])) < 1e-12
    assert weights.weigh("the zorglub festival")[0] == 0 < weights.weigh("a zorglub")[0]


def test_automaton_equals_plain_matching():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 6)))
    for _ in range(200):
        terms = {f" {word()}" + rng.choice(["", " "]): rng.random() for _ in range(8)}
        spare = tuple(f"{word()} {word()}" for _ in range(3))
        text = " ".join(word() for _ in range(30))
        folded = toxicity.fold(text)
        spared = {at for x in spare for at in range(len(folded)) for start in range(len(folded)) if folded.startswith(f" {x} ", start) and start <= at < start + len(x) + 1}
        want = 0.0
        for at in (k for k, c in enumerate(folded[:-1]) if c == " "):
            best = max((w for t, w in terms.items() if folded.startswith(t, at)), default=0.0)
            want += 0.0 if at in spared else best
        weight, words = toxicity.Matcher(toxicity.Model(terms, (0.0, 0.0, 0.0), spare)).weigh(text)
        assert abs(weight - want) < 1e-9 and words == len(folded.split())


def test_predictions_equal_the_nearest_prototype(spark):
    rows = [(i, "".join(chr(97 + (i * k) % 11) for k in range(40)), "xyz"[i % 3]) for i in range(30)] + [(None, "abc abc", "x")]
    df = docs(spark, rows)
    prototypes = langid.fit(df)
    for r in langid.languages(df, prototypes).collect():
        text = dict((i, t) for i, t, _ in rows)[r.doc_id]
        v = langid.bundles([text])[0].astype(float)
        cosine = {n: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for n, p in prototypes.items()}
        assert r.lang_pred == max(sorted(cosine), key=lambda n: round(cosine[n], 5)) and abs(r.score - max(0, max(cosine.values()))) < 1e-4
        assert r.doc_id is not None or r.held_out is False
