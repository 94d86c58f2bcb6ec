import hashlib
import zlib

import numpy as np

from tessera.llm import media


def test_round_trip(spark, documents, dirty):
    docs = documents.select("doc_id", "text").unionByName(dirty.select("doc_id", "text"))
    got = sorted((tuple(r) for r in media.media_columns(docs).collect()), key=repr)
    want = []
    for r in docs.collect():
        b = (r.text or "").encode()
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        parts = media.chunks(p)
        form = media.stored_form([len(c) for c in parts], [hashlib.sha256(c).digest() for c in parts], p)
        want.append((r.doc_id, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(form), hashlib.sha256(form).hexdigest(), media.features(p, len(parts))))
    assert got == sorted(want, key=repr)


def test_store_is_deduplicated(spark):
    rng = np.random.default_rng(1)
    shared = "".join(map(chr, rng.integers(97, 123, 60_000)))
    docs = spark.createDataFrame([(i, shared + f" tail {i} " * 200) for i in range(5)] + [(9, shared + " tail 0 " * 200)], "doc_id long, text string")
    _, store = media.write_store(docs)
    rows = store.collect()
    assert sum(r.kind == "media" for r in rows) == 5 and sum(len(r.body) for r in rows) < 1.4 * len(shared) + 5 * 2500
    assert media.read_store(store).count() == 5


def test_cuts_depend_on_content():
    rng = np.random.default_rng(2)
    body = rng.integers(0, 256, 100_000, dtype=np.uint8).tobytes()
    a, b = media.chunks(body), media.chunks(b"xyz" + body)
    assert b"".join(a) == body and len(set(a) & set(b)) >= len(a) - 3
    config = media.Config()
    assert all(config.least <= len(c) <= config.most for c in a[:-1]) and 10 < len(a) < 60
    h = media.rolling(np.frombuffer(body[:200], np.uint8), media.gear(1))
    slow = 0
    for x in body[:100]:
        slow = (slow << 1) + int(media.gear(1)[x]) & 0xFFFFFFFF
    assert int(h[99]) == slow


def test_empty(none):
    assert media.media_columns(none).count() == 0
