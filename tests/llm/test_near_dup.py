import random
import re

import numpy as np
import pytest

from tessera.llm import near_dup

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], least[find(i)] == d) for i, (d, _) in enumerate(rows))


@pytest.fixture(scope="module")
def crowd():
    """A large group of near copies with similarities on both sides of the threshold, and strangers."""
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rnd.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 4, 6, 9])):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + i, " ".join(rnd.choice(vocabulary) for _ in range(100))) for i in range(40)]
    return rows + [(3000, "Two words"), (3001, "two  WORDS"), (3002, ""), (3003, None), (3004, "É"), (3005, "é")]


@pytest.mark.parametrize("options", [{}, {"small": 8, "depth": 2}, {"small": 8, "depth": 4}, {"small": 30, "depth": 2, "together": 10}])
def test_equals_brute_force(spark, crowd, options):
    docs = spark.createDataFrame(crowd, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in near_dup.find(docs, near_dup.Config(shingle=4, **options)).collect())
    assert got == brute(crowd, 4)


def test_exact_set_comparison():
    rng = np.random.default_rng(1)
    for n in (5, 12):
        base = rng.integers(0, 1 << 60, 100, dtype=np.uint64)
        sets = [np.unique(np.concatenate([base[: 100 - k], rng.integers(0, 1 << 60, k, dtype=np.uint64)])) for k in range(0, 3 * n, 3)]
        links = near_dup.linked(sets, near_dup.Config())
        for i, j in links:
            both = len(np.intersect1d(sets[i], sets[j]))
            assert 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)
        near, want = np.eye(n, dtype=bool), np.eye(n, dtype=bool)
        for i, j in links:
            near[i, j] = near[j, i] = True
        for i in range(n):
            for j in range(n):
                both = len(np.intersect1d(sets[i], sets[j]))
                want[i, j] = 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both)
        assert near_dup._parts(near).tolist() == near_dup._parts(want).tolist()


def test_components(spark):
    edges = [(b"%03d" % i, b"%03d" % (i + 1)) for i in range(40)] + [(b"900", b"901"), (b"901", b"900")]
    got = {bytes(r.node): bytes(r.root) for r in near_dup.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert len(got) == 41 and {got[b"%03d" % i] for i in range(1, 41)} == {b"000"} and got[b"901"] == b"900"


def test_dirty_rows(dirty, none):
    rows = near_dup.find(dirty).collect()
    assert len(rows) == dirty.count() and near_dup.find(none).count() == 0
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert near_dup.keep_one(dirty).columns == dirty.columns


def test_one_id_with_two_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    docs = spark.createDataFrame([(1, b + " end"), (2, a), (2, b), (3, a + " end")], "doc_id long, text string")
    rows = sorted((r.doc_id, r.component_id, r.kept) for r in near_dup.find(docs).collect())
    assert rows == [(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False)]
    assert sorted(tuple(r) for r in near_dup.keep_one(docs).collect()) == [(1, b + " end"), (2, a)]


def test_miss_probability_of_trees():
    config, rng, pairs = near_dup.Config(), np.random.default_rng(2), 200_000
    agrees = lambda n: rng.random((pairs, n)) < 0.8
    alive = [agrees(1)[:, 0] for _ in range(config.branch)]
    for _ in range(config.depth - 1):
        at, rows, following = agrees(config.level_choice), np.arange(pairs), []
        for node in alive:
            pick, step = rng.integers(0, config.level_choice, pairs), rng.integers(1, config.level_choice, pairs)
            following += [node & at[rows, (pick + b * step) % config.level_choice] for b in range(config.branch)]
        alive = following
    missed = 1 - np.logical_or.reduce(alive).mean()
    assert missed < 0.086 and missed**config.trees < 5.5e-5
