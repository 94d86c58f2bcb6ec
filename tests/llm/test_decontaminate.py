import math
import random
import re

from tessera.llm import decontaminate

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_equals_brute_force(spark):
    rnd = random.Random(6)
    word = lambda: f"w{rnd.randrange(800)}"
    items = [(i, " ".join(word() for _ in range(rnd.choice([3, 5, 8, 20, 24, 25, 36, 40, 90, 300])))) for i in range(25)] + [(90, None), (91, ""), (None, "a b c d e f")]
    docs = []
    for i in range(80):
        words = [word() for _ in range(rnd.randrange(0, 400))]
        for _ in range(rnd.randrange(3)):
            part = (rnd.choice(items[:25])[1]).upper().split()
            if rnd.random() < 0.5 and len(part) > 8:
                part[rnd.randrange(len(part))] = "changed"
            words[rnd.randrange(len(words) + 1) : 0] = part
        docs.append((i, "  ".join(words)))
    docs += [(200, items[0][1]), (200, items[0][1]), (201, None), (202, items[3][1]), (203, items[4][1]), (203, "a text of its own with that id")]
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    items.append((24, "one more text of an item " + " ".join(word() for _ in range(9))))
    t = spark.createDataFrame(items, "item_id long, text string")
    sets = {j: set().union(*[shingles(y) for i, y in items if i == j]) for j, _ in items if j is not None}
    got = sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.find(d, t).collect())
    found = {(n, i, j, len(b), len(shingles(x) & b)) for n, (i, x) in enumerate(docs) for j, b in sets.items() if b and len(shingles(x) & b) / len(b) >= 0.8}
    assert got == sorted({f[1:] for f in found}) and len(got) > 20
    kept = sorted((i, x or "") for n, (i, x) in enumerate(docs) if n not in {f[0] for f in found})
    assert sorted((r.doc_id, r.text or "") for r in decontaminate.clean_documents(d, t).collect()) == kept and (203, docs[-1][1]) in kept


def test_partitions():
    config = decontaminate.Config()
    for c in range(5, 12):
        for n in {(1 << c >> 1) + 1, 1 << c}:
            m, k = math.ceil(0.8 * n), config.kept(c, n)
            if k < n:
                missed = sum(math.comb(m, h) * math.comb(n - m, k - h) for h in range(config.hits(c))) / math.comb(n, k)
                assert missed <= config.miss
    assert len({config.hits(c) for c in range(3, 12)}) == 9


def test_dirty_rows(spark, dirty, none):
    items = spark.createDataFrame([(1, "no id here at all")], "item_id long, text string")
    assert [tuple(r)[:2] for r in decontaminate.find(dirty, items).collect()] == [(None, 1)]
    assert decontaminate.find(none, items).count() == decontaminate.find(dirty, items.limit(0)).count() == 0
    assert decontaminate.clean_documents(dirty, items).columns == dirty.columns
