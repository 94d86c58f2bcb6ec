import re
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm import mixing


def _targets(sizes, share=1.5):
    """The contract word by word: share, cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(sizes.values())
    while True:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > 2 * sizes[s]} if free else set()
        if not above:
            return target | {s: left * weight[s] / total for s in free}
        for s in above:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in above)
        free -= above


def test_targets_and_takes(documents):
    docs = documents.withColumn("source", F.when(F.col("doc_id") % 17 == 0, None).otherwise(F.col("source"))).unionByName(documents.limit(40).withColumn("source", F.lit("src0")))
    rows = mixing.mix(docs, mixing.Config(bucket_rows=7)).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = _targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s]) and 0 <= target[s] - taken[s] < 1.0001
    key = lambda rs: sorted(map(repr, rs))
    assert key(rows) == key(mixing.mix(docs.repartition(9), mixing.Config(bucket_rows=7)).collect())
    assert key(rows) == key(mixing.mix(docs, mixing.Config(bucket_rows=10**6)).collect())


def test_mixed_documents(documents):
    docs = documents.unionByName(documents.limit(3))
    words = lambda df: df.agg(F.sum(mixing.n_words(F.col("text")))).first()[0]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and abs(words(mixed) - mixing.mix(docs).agg(F.sum("taken")).first()[0]) == 0
    assert mixed.where(F.length("text") != F.col("n_chars")).count() == docs.where(F.length("text") != F.col("n_chars")).count() == 0


def test_cut_keeps_white_space(spark):
    texts = ["a b c d", "  a\n\nb\tc  \n d ", "a\nb\r\nc d e\n", "é\u00a0x ü  ж\x0by z", "one two"]
    rows = [(t, n) for t in texts for n in range(1, len(re.findall(r"[^\x20\x09-\x0D]+", t)))]
    got = spark.createDataFrame(rows, "text string, n long").select("text", "n", mixing._first_words(F.col("text"), F.col("n")).alias("cut")).collect()
    for r in got:
        assert r.cut == r.text[: list(re.finditer(r"[^\x20\x09-\x0D]+", r.text))[r.n - 1].end()]


def test_dirty_rows(dirty, none):
    assert mixing.mix(dirty).count() == dirty.count() and mixing.mix(none).count() == 0
    assert mixing.mixed_documents(dirty).columns == dirty.columns and mixing.mixed_documents(none).count() == 0
