import zlib

import numpy as np

from tessera.llm import quality


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and all(0 <= r.score <= 1 for r in rows)
    assert len(held) > 50 and np.mean([r.predicted == r.quality for r in held]) >= 0.93


def test_scores_equal_slow_ones():
    texts = ["Word word word!", "", "a", "ab cd  ef", "é & ü" * 20]
    bodies = [t.encode() for t in texts]
    model = quality.train(bodies, [1, 0, 1, 0, 1], quality.Config(epochs=2, bits=10))
    raw, offsets = np.frombuffer(b"".join(bodies), np.uint8), np.cumsum([0, *map(len, bodies)])
    slow = [float(model.table[f].mean()) if len(f := quality.features(np.frombuffer(b, np.uint8), 10)) else 0.0 for b in bodies]
    assert np.allclose(quality.document_means(raw, offsets, model.table), slow, atol=1e-6)


def test_dirty_rows(spark, dirty, none):
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(dirty, labels).count() == dirty.count() and quality.classify(none, labels).count() == 0
    assert quality.classify(dirty, labels.limit(0)).select("score").distinct().collect()[0][0] == 0.5
    assert quality.filter_documents(dirty, labels).columns == dirty.columns
