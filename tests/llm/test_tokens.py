import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import tokens, wavelet


def test_wavelet_matrix():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 513, 5000):
        x = rng.integers(0, 60_000, n) % rng.integers(1, 60_000, max(n, 1))[:n]
        data = wavelet.pack(wavelet.WaveletMatrix.build(x, 16), np.array([7]), np.array([False]), np.array([n]))
        m, ids, null, lengths = wavelet.unpack(data)
        assert m.decode().tolist() == x.tolist() and ids.tolist() == [7] and lengths.tolist() == [n] and not null.any()
        for i in range(0, n, max(1, n // 20)):
            assert m.access(i) == x[i] and m.count(int(x[i]), i) == (x[:i] == x[i]).sum()
            at = np.flatnonzero(x == x[i])
            assert [m.locate(int(x[i]), j) for j in range(min(3, len(at)))] == at[:3].tolist()
        assert m.count(70_000) == 0
        with pytest.raises(IndexError):
            m.access(n)


def test_encoder_equals_the_tokenizer(documents):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(3)
    pieces = [" ", "\n", "\t", "a", "The", ",", ".", "'s", "é", "日本", "1", " x", "  ", "<|endoftext|>", "\r", " ", "\0", "🙂", "!!"]
    texts = [r.text for r in documents.collect()] + ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    for most in (1 << 30, 20_000, 0):
        encoder = tokens.Encoder(None, most)
        found = [b for i in range(0, len(texts), 200) for b in encoder.encode(texts[i : i + 200])]
        assert [np.frombuffer(b, encoder.kind).tolist() for b in found] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("size", [1 << 21, 3000])
def test_files(spark, documents, dirty, size):
    docs = documents.select("doc_id", "text").unionByName(dirty.select("doc_id", "text"))
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    shards = tokens.write_shards(docs, tokens.Config(shard_tokens=size))
    rows = sorted(((r.doc_id is not None, r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.read_shards(shards).collect()), key=lambda r: r[2])
    assert [r[:2] for r in rows] == sorted([r[:2] for r in rows], key=lambda r: (r[0], r[1] or 0))
    start = 0
    for r in rows:
        assert r[2] == start
        start += r[3]
    want = sorted((r.doc_id is not None, r.doc_id or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in docs.collect() for ids in [[*plain.encode(r.text or "", add_special_tokens=False).ids, 0]])
    assert sorted((r[0], r[1] or 0, r[3], r[4]) for r in rows) == want and (shards.count() > 4) == (size == 3000 or shards.count() > 4)


def test_empty(none):
    assert tokens.encode_documents(none).count() == 0


def test_known_pieces_never_reach_the_tokenizer_again():
    """Blank lines, runs of blanks and signs behind words are cut too, so a second pass over
    such texts gives the tokenizer nothing, and the first gives it each distinct piece once."""
    texts = ["A word,  another word.\n\nA word;\tanother: word (1234)!\r\n  ", "def a(b):\n    return b  # b, a\n\n\n", "é ß,  Straße x."] * 3
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder, given = tokens.Encoder(None, 1 << 30), []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch_fast(self, batch, **how):
            given.extend(w for b in batch for w in ([b] if isinstance(b, str) else b))
            return self.inner.encode_batch_fast(batch, **how)

        def tokenize(self, word):
            given.append(word)
            return self.inner.tokenize(word)

    for part in ("tokenizer", "model", "words"):
        if hasattr(encoder, part):
            setattr(encoder, part, Counted(getattr(encoder, part)))
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    for again in (False, True):
        assert [np.frombuffer(b, encoder.kind).tolist() for b in encoder.encode(texts)] == want
        assert not given if again else len(given) == len(set(given)) > 0
        given.clear()


def test_encoder_with_a_vocabulary_that_lacks_bytes(tmp_path):
    """Such a tokenizer drops characters, and ids may have gaps: pieces get their own ids all the same."""
    vocab = {"a": 0, "b": 5, "Ġ": 9, ".": 11, "ab": 70}
    spec = {"version": "1.0", "added_tokens": [], "normalizer": None, "post_processor": None, "decoder": None}
    spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    spec["model"] = {"type": "BPE", "dropout": None, "unk_token": None, "vocab": vocab, "merges": ["a b"]}
    path = tmp_path / "small.json"
    path.write_text(json.dumps(spec))
    texts = ["ab abc cab. b", "xyz", "a.b  a\n\nab", "", "é ab"]
    encoder = tokens.Encoder(str(path), 1 << 20)
    want = [e.ids for e in Tokenizer.from_file(str(path)).encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [np.frombuffer(b, encoder.kind).tolist() for b in encoder.encode(texts)] == want
