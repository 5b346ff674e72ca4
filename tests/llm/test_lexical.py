import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, k=50):
    """The ranking by its definition: docs (doc_id, text), items (item_id, text)."""
    read = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    n, total = sum(bool(x) for _, x in read), sum(len(x) for _, x in read)
    counts = [Counter(x) for _, x in read]
    df = Counter(t for c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    out = set()
    for item, terms in asked.items():
        scores = []
        for (doc, words), c in zip(read, counts, strict=True):
            if words:
                m = 100 - 50 + (50 * len(words) * n) // total
                scores.append((sum(weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c), doc))
        ranked = sorted(((s, d) for s, d in scores if s > 0), key=lambda x: (-x[0], x[1] is None, x[1]))[:k]
        out |= {(item, rank, d, s) for rank, (s, d) in enumerate(ranked, 1)}
    return out


def test_terms():
    text = "Ab-cD_é9Ω x\t\n\x7fZ{q}~ÀB"
    assert [t.decode() for t in lexical.terms(text.encode())] == TERM.findall(text.translate(LOWER)) == ["ab", "cd", "é9ω x" if False else "é9Ω x", "z", "q", "Àb"]
    assert lexical.terms(None) == lexical.terms(b"") == lexical.terms(b" .,") == []


def test_treaps_are_search_trees_and_heaps():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 2, 40, 0, 300]
    docs = np.concatenate([np.sort(rng.choice(1000, n, replace=False)) for n in sizes]).astype(np.int64)
    adds = rng.integers(1, 6, len(docs))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    treaps, seen = lexical.Treaps(docs, adds, starts), set()
    for term, root in enumerate(treaps.roots):
        assert (root < 0) == (sizes[term] == 0)
        todo = [(root, -1, 1000, 99, 0)] if root >= 0 else []
        while todo:
            at, low, high, most, depth = todo.pop()
            assert starts[term] <= at < starts[term + 1] and low < docs[at] < high and adds[at] <= most and depth < 40
            seen.add(at)
            todo += [(child, *span, adds[at], depth + 1) for child, span in ((treaps.left[at], (low, docs[at])), (treaps.right[at], (docs[at], high))) if child >= 0]
    assert len(seen) == len(docs)


@pytest.mark.parametrize("front", [1, 5, 2048])
def test_the_best_are_found_and_few_are_looked_at(monkeypatch, front):
    monkeypatch.setattr(lexical, "_FRONT", front)
    rng, size, terms = np.random.default_rng(front), 3000, 8
    lists = [np.sort(rng.choice(size, rng.integers(1, size // (1 + k)), replace=False)) for k in range(terms)]
    docs, starts = np.concatenate(lists).astype(np.int64), np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    adds = np.concatenate([rng.integers(1, 50, len(x)) * (1 + 3 * k) for k, x in enumerate(lists)])
    treaps = lexical.Treaps(docs, adds, starts)
    for asked in ([0, 3, 7], list(range(terms)), [5]):
        total = np.zeros(size, np.int64)
        for t in asked:
            total[lists[t]] += adds[starts[t] : starts[t + 1]]
        want = np.lexsort((np.arange(size), -total))[:10]
        found, scores, looked = treaps.best(np.array(asked), 10, size)
        first = np.lexsort((found, -scores))[:10]
        assert found[first].tolist() == want.tolist() and scores[first].tolist() == total[want].tolist()
        assert looked < np.count_nonzero(total)
        last = int(total[want[-1]])
        beaten, better, _ = treaps.best(np.array(asked), 10, size, last, int(want[-1]))
        assert set(beaten.tolist()) == set(want[:-1].tolist()) and better.min() >= last


def test_search_equals_its_definition(spark, monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 4))) for _ in range(120)]
    text = lambda n: " ".join(rng.choice(words).upper() if rng.random() < 0.2 else rng.choice(words) + rng.choice(["", ".", "!"]) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(400)]
    docs += [(400 + i, docs[7][1]) for i in range(80)] + [(7, docs[7][1]), (None, docs[7][1]), (None, docs[9][1]), (900, None), (901, ""), (902, "... !!"), (903, " ".join(words) * 200)]
    items = [(i, text(rng.randrange(1, 25))) for i in range(30)] + [(50, docs[7][1]), (51, None), (52, "--"), (53, "nowhere"), (54, words[0]), (54, words[1]), (None, words[2]), (55, " ".join([words[3]] * 30))]
    d = spark.createDataFrame([(i, t, 1.0, [1]) for i, t in docs], "doc_id int, text string, score double, terms array<int>").repartition(5)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id int, text string, term string")
    want = plain(docs, items, 20)
    assert {tuple(r) for r in lexical.search(d, b, 20).collect()} == want
    # Many shards a task, many tasks, and items in blocks.
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", 40)
    monkeypatch.setattr(lexical, "TASK_DOCS", 1)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 100)
    assert {tuple(r) for r in lexical.search(d, b, 20).collect()} == want
    assert lexical.search(d.limit(0), b).collect() == [] == lexical.search(d, b.limit(0)).collect()
