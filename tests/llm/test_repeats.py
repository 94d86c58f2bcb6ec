import random
import re
from collections import defaultdict

import numpy as np

from tessera.llm import repeats


def test_equals_brute_force(spark):
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(5000)}"
    passages = [[word() for _ in range(n)] for n in (50, 51, 64, 90, 49, 200)]
    rows = []
    for i in range(60):
        words = [word() for _ in range(rnd.randrange(5, 120))]
        for p in rnd.sample(passages, 2):
            at = rnd.randrange(len(words))
            words[at:at] = p
        rows.append((i, " ".join(words)))
    rows += [(100, rows[0][1]), (101, None), (102, "few words"), (103, "x " * 80), (104, "x " * 70), (105, "")]
    found = repeats.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    texts = {i: re.findall(r"\S+", t or "") for i, t in rows}
    windows = defaultdict(set)
    for i, w in texts.items():
        for j in range(len(w) - 49):
            windows[tuple(w[j : j + 50])].add(i)
    want, got = defaultdict(set), defaultdict(set)
    for i, w in texts.items():
        for j in range(len(w) - 49):
            if len(windows[tuple(w[j : j + 50])]) > 1:
                want[i].update(range(j, j + 50))
    for r in found:
        got[r.doc_id].update(range(r.start_word, r.end_word))
        assert r.n_words == r.end_word - r.start_word >= 50 and r.other_id != r.doc_id
    runs = (103, 104)  # one word over and over: found, though not word for word
    assert all(got[i] and got[i] <= want[i] for i in runs)
    assert {i: w for i, w in got.items() if i not in runs} == {i: w for i, w in want.items() if i not in runs}


def test_kernels():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    for k in (1, 3, 16):
        g = repeats.gram_hashes(words, k)
        assert len(g) == 301 - k and len(set(g.tolist())) == len(g)
        assert (repeats.gram_hashes(words[10 : 10 + k], k) == g[10]).all()
    g = repeats.gram_hashes(words, 16)
    slow = sorted({i + int(np.argmin(g[i : i + 35])) for i in range(len(g) - 34)})
    assert repeats.minimisers(g, 35).tolist() == slow


def test_dirty_rows(dirty, none):
    assert {r.doc_id for r in repeats.find(dirty).collect()} == set() and repeats.find(none).count() == 0


def _covered(spark, texts, parts=4):
    """Words reported and words of windows of 50 that another text has, for each document."""
    windows = defaultdict(set)
    for i, w in texts.items():
        for j in range(len(w) - 49):
            windows[tuple(w[j : j + 50])].add(i)
    want, got = defaultdict(set), defaultdict(set)
    for i, w in texts.items():
        for j in range(len(w) - 49):
            if len(windows[tuple(w[j : j + 50])]) > 1:
                want[i].update(range(j, j + 50))
    rows = [(i, " ".join(w)) for i, w in texts.items()]
    for r in repeats.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
        assert len(windows[tuple(texts[r.doc_id][r.start_word : r.start_word + 50])]) > 1 and r.other_id != r.doc_id
    return dict(got), dict(want)


def test_passages_several_times_in_one_document(spark):
    rnd = random.Random(21)
    fresh = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    texts = {}
    for i in range(12):
        p = fresh(120)
        texts[2 * i] = fresh(15) + p + fresh(20) + p + fresh(15) + (p if i % 2 else [])
        texts[2 * i + 1] = fresh(30) + p + fresh(10)
    got, want = _covered(spark, texts)
    assert got == want and all(len(want[2 * i]) >= 240 for i in range(12))


def test_stock_sentences(spark):
    rnd = random.Random(5)
    fresh = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    texts = {}
    for _ in range(8):
        s = [fresh(12) for _ in range(5)]
        for kind in [s[1:]] * 30 + [s[:-1]] * 30 + [s] * 2:  # 48, 48 and 60 words
            texts[len(texts)] = fresh(8) + sum(kind, []) + fresh(8)
    got, want = _covered(spark, texts)
    assert got == want and len(want) == 16 and all(len(w) == 60 for w in want.values())


def test_runs_of_one_word(spark):
    rnd = random.Random(6)
    fresh = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    texts = {0: ["x"] * 1000 + ["end"], 1: fresh(9) + ["x"] * 1000, 2: ["a", "b"] * 200, 3: ["b"] + ["a", "b"] * 100 + fresh(5)}
    for _ in range(16):
        before, after = fresh(30), fresh(30)
        y = fresh(1)
        texts[len(texts)] = fresh(5) + before + y * 30 + fresh(5)
        texts[len(texts)] = fresh(7) + before + y * 60 + after + fresh(3)
        texts[len(texts)] = fresh(7) + y * 40 + after + fresh(3)
    got, want = _covered(spark, texts)
    assert got == want and len(want[0]) == 1000 and len(want) == len(texts)
