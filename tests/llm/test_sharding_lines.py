import zlib

from lodestone.llm import linededup
from lodestone.llm.sharding import schedule, shards

SCHEMA = "doc_id long, text string, source string, bundle int, shard int, `_keys` int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 0, 0, 0) for i, t, s in rows], SCHEMA)


def test_schedule_is_longest_first():
    assert schedule([(3, "a"), (5, "b"), (4, "c"), (2, "d")], 2) == {"b": 0, "c": 1, "a": 1, "d": 0}


def test_shards(spark):
    rows = [(i, None if i % 50 == 0 else "x" * (i % 97) + str(i // 3), "s") for i in range(900)] + [(7, "x" * 7 + "2", "s")]
    got = shards(docs(spark, rows), 24).collect()
    assert len(got) == len(rows)
    home, load, slots = {}, [0] * 24, {}
    text = {i: t for i, t, _ in rows}
    for r in got:
        t = text[r.doc_id]
        assert r.size == len((t or "").encode()) + 8 and r.text_crc32 == zlib.crc32((t or "").encode())
        assert home.setdefault(t, r.shard) == r.shard
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    groups = {}
    for i, t, _ in rows:
        groups[t] = groups.get(t, 0) + len((t or "").encode()) + 8
    assert max(load) - min(load) <= max(groups.values())
    assert shards(docs(spark, []), 24).collect() == []


def by_hand(rows, ratio, least):
    pages, seen = {}, {}
    for _, t, s in rows:
        pages[s] = pages.get(s, 0) + 1
        for line in {x.strip(" \t\r") for x in (t or "").split("\n")} - {""} if t is not None else ():
            seen[s, line] = seen.get((s, line), 0) + 1
    bad = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\r")) not in bad) for _, t, s in rows]


def test_lines(spark, monkeypatch):
    rows = [(i, f"menu\nunique {i}\n  menu \n\nfoot\t", "a" if i % 3 else None) for i in range(30)]
    rows += [(100, None, "a"), (101, "", "a"), (102, "menu", "b"), (103, "menu\r\nx", "a"), (103, "menu\r\nx", "a"), (104, "word " * 100_000, "a")]
    want = sorted(map(repr, by_hand(rows, 0.1, 3)))
    for limit in (200_000, 0):
        monkeypatch.setattr(linededup, "BROADCAST_LINES", limit)
        out = linededup.drop_boilerplate(docs(spark, rows))
        assert out.columns == docs(spark, rows).columns
        assert sorted(repr(r.text) for r in out.collect()) == want
    counted = {r.doc_id: (r["_lines"], r["_dropped"]) for r in linededup.drop_boilerplate(docs(spark, rows), counts=True).collect()}
    assert counted[1] == (4, 3) and counted[100] == (0, 0) and counted[102] == (1, 0)
    assert linededup.drop_boilerplate(docs(spark, [])).collect() == []


def test_shards_of_long_texts_and_rows_without_ids(spark):
    rows = [(None, "long " * 100_000, "s"), (None, "long " * 100_000, "s"), (3, "", "s"), (4, None, "s"), (5, "", None)] + [(10 + i, f"t{i}", "s") for i in range(50)]
    got = shards(docs(spark, rows), 4).collect()
    assert len(got) == len(rows) and len({r.shard for r in got if r.doc_id is None}) == 1
    assert len({r.shard for r in got if r.doc_id in (3, 5)}) == 1
    big = next(r.shard for r in got if r.doc_id is None)
    assert {r.doc_id for r in got if r.shard == big} == {None}


def test_long_lists_drop_the_same_lines(spark):
    rows = [(i, "\n".join(f"menu {k}" for k in range(i % 3, 300)) + f"\nown {i}\nown {i}", "a") for i in range(9)]
    got = linededup.drop_boilerplate(docs(spark, rows), ratio=0.5).collect()
    assert {r.text for r in got} == {f"own {i}\nown {i}" if i % 3 else f"own {i}\nown {i}" if sum(j % 3 == 0 for j in range(9)) > 4.5 else f"menu 0\nown {i}\nown {i}" for i in range(9)}
