"""Token-ID output: documents as wavelet-matrix shards.

Documents are range-partitioned and sorted by id, encoded with a byte-level BPE, closed with
an end id and cut into shards at document borders.  A shard is one compressed file
(:mod:`tessera.llm.wavelet`), written by Spark as a row of a Parquet table, so it reaches any
store that Spark can write.  The numbers of the result are computed from the files, read back.

Encoding: a byte-level BPE works on each pre-token by itself.  So a text may be cut wherever a
pre-token begins for certain: at a run of white space, before its last character, after it unless
it ends with a space, and between an ASCII letter and an ASCII digit or sign.  The cuts are found
on the bytes, a slice's distinct pieces by Arrow's dictionary encoding, and each is looked up once
in a per-worker table of the ids of pieces already seen; the tokenizer only ever sees new ones, many
in a call, and its ids are dealt to the pieces by the bytes that they stand for.  Texts with the
vocabulary's special strings, or with white space beyond ASCII next to other white space, go to
the tokenizer whole.
The table has two generations and one budget in bytes (``Config.cache_bytes``): when the young
one has half of it, it becomes the old one, and what is used again moves back, so frequent
pieces stay and a worker's memory does not grow with the vocabulary of the corpus.

Defined results: a null or empty text is the end id alone; documents with equal ids keep a
fixed order (by text); a null id sorts first; any length is encoded whole; an empty table
gives no shards and no rows; other columns are ignored.
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _base, wavelet


@dataclass(frozen=True)
class Config:
    tokenizer: str | None = None  # path of a tokenizers JSON file; None: the installed byte-level BPE
    end_id: int = 0
    bits: int = 16
    shard_tokens: int = 1 << 21
    #: Memory that a worker's table of known pieces may take, about.
    cache_bytes: int = 192 << 20
    #: Characters of text that are encoded in one go; a longer text comes alone and whole.
    slice_chars: int = 2_000_000


#: White space beyond ASCII with other white space beside it: where pre-tokens begin is left to the tokenizer.
_TRICKY = re.compile(r"[^\S\x00-\x7f]\s|\s[^\S\x00-\x7f]")
# Kinds of bytes: 1 white space, 2 a space besides, 4 a letter, 8 a digit, sign or control.
_KIND = bytes(
    3 if b == 0x20 else 1 if b in b"\t\n\x0b\f\r" else 0 if b > 0x7F else 4 if chr(b).isalpha() else 8 for b in range(256)
)


def _byte_letters() -> str:
    """The letter that byte-level BPE writes for each byte: printable Latin-1 is itself, the
    others follow from U+0100 on, in order.  A line break stays, as it parts the words."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    letters = [chr(b) if b in plain else chr(next(rest)) for b in range(256)]
    letters[0x0A] = "\n"
    return "".join(letters)


_LETTERS = _byte_letters()
#: Pieces whose ids are put together at once, and words that go to the tokenizer in one call.
_BLOCK, _WORDS = 1 << 16, 1 << 13
#: Bytes that an entry of the table takes besides its characters and ids: two objects and a slot.
_ENTRY = 190


class Encoder:
    """Whole texts to token ids, as little-endian bytes of 16 or 32 bits."""

    def __init__(self, path: str | None, most: int) -> None:
        import json

        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.splits = (
            not spec.get("normalizer")
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
        )
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.words = Tokenizer(self.model)  # takes pre-tokens, spelt in the letters of bytes
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max(vocab.values(), default=0) + 1, np.int64)  # bytes that an id stands for
        for token, i in vocab.items():
            self.sizes[i] = len(token)
        self.most, self.held, self.seen, self.old = most, 0, {}, {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, tokenizer, words: list[str], sizes: list[int], pieces: list[str]) -> list[bytes]:
        """Ids of each piece, given as ``words`` of ``sizes`` bytes, many in a call."""
        found = []
        for k in range(0, len(pieces), _WORDS):
            some = slice(k, k + _WORDS)
            ids = np.array(tokenizer.encode_batch_fast([words[some]], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int64)
            ends, after = np.cumsum(sizes[some]), np.concatenate([[0], np.cumsum(self.sizes[ids])])
            cuts = np.searchsorted(after, ends)
            if after[-1] != ends[-1] or (after[cuts] != ends).any():  # not every byte has an id of its own
                found += self._whole(pieces[some])
                continue
            data, cuts = ids.astype(self.kind).tobytes(), (cuts * self.kind.itemsize).tolist()
            found += [data[a:b] for a, b in zip([0, *cuts], cuts)]
        return found

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of new pieces.  Words of common scripts are pre-tokens and go to the BPE model;
        the others go through the whole tokenizer."""
        word = [(p[1:] if p[0] == " " else p).isalpha() and (p.isascii() or max(p) < "\u0590") for p in pieces]
        words, odd = list(compress(pieces, word)), [p for p, w in zip(pieces, word, strict=True) if not w]
        spelt = codecs.charmap_decode("\n".join(words).encode(), "strict", _LETTERS)[0].split("\n")
        of_words = iter(self._each(self.words, spelt, list(map(len, spelt)), words))
        of_odd = iter(self._each(self.tokenizer, odd, [len(p.encode()) for p in odd], odd))
        ids = [next(of_words) if w else next(of_odd) for w in word]
        self.held += _ENTRY * len(pieces) + 2 * sum(map(len, pieces)) + sum(map(len, ids))
        return ids

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, by the table."""
        if self.held > self.most // 2:
            self.held, self.seen, self.old = 0, {}, self.seen
        ids = list(map(self.seen.get, pieces))
        gaps = [i for i, x in enumerate(ids) if x is None]
        new = [pieces[i] for i in gaps]
        again = list(map(self.old.get, new))
        fresh = [p for p, x in zip(new, again, strict=True) if x is None]
        self.held += (_ENTRY + 32) * (len(new) - len(fresh))
        learnt = iter(self._learn(fresh))
        found = [next(learnt) if x is None else x for x in again]
        self.seen.update(zip(new, found, strict=True))
        for i, x in zip(gaps, found, strict=True):
            ids[i] = x
        return ids

    def _pieces(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts that may be cut."""
        raw, at = _base.utf8(texts)
        if not len(raw):
            return [b""] * len(texts)
        kind = np.frombuffer(raw.tobytes().translate(_KIND), np.uint8)
        white = (kind & 1).view(bool)
        begins = white.copy()
        # Inside a run of white space, only before its last character if the text goes on.
        last = np.empty(len(raw), bool)
        last[:-1] = ~white[1:]
        last[at[1:][at[1:] > 0] - 1] = False
        begins[1:] &= last[1:] | ~white[:-1]
        begins[1:] |= (kind[:-1] == 1) & ~white[1:]
        begins[1:] |= (kind[:-1] == 4) & (kind[1:] == 8)
        begins[at[:-1][at[:-1] < len(raw)]] = True
        starts = np.flatnonzero(begins)
        cut = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw)).dictionary_encode()
        which = cut.indices.to_numpy()
        ids = self._known(cut.dictionary.to_numpy(zero_copy_only=False).tolist())
        width = self.kind.itemsize
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // width
        flat, first = np.frombuffer(b"".join(ids), self.kind), np.cumsum(sizes) - sizes
        body = []
        for k in range(0, len(which), _BLOCK):
            some = which[k : k + _BLOCK]
            n = sizes[some]
            ends = np.cumsum(n)
            body.append(flat[np.repeat(first[some] - ends + n, n) + np.arange(ends[-1])].tobytes())
        data = b"".join(body)
        after = np.concatenate([[0], np.cumsum(sizes[which])]) * width
        cuts = after[np.searchsorted(starts, at)].tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        raw, at = _base.utf8(column)
        # First bytes of all white space beyond ASCII: only texts with one of them need a look.
        rare = np.flatnonzero((raw == 0xC2) | (raw == 0xE1) | (raw == 0xE2) | (raw == 0xE3))
        look = np.diff(np.searchsorted(rare, at)) > 0
        plain = [self.splits and not any(s in t for s in self.special) and not (r and _TRICKY.search(t)) for t, r in zip(texts, look.tolist(), strict=True)]
        cut = iter(self._pieces(column if all(plain) else column.filter(pa.array(plain, pa.bool_()))))
        whole = iter(self._whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [next(cut) if p else next(whole) for p in plain]


_encoders: dict[tuple, Encoder] = {}


def encoder(config: Config) -> Encoder:
    key = (config.tokenizer, config.cache_bytes)
    if key not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[key] = Encoder(*key)
    return _encoders[key]


_SHARD = "part int, seq int, n_docs long, n_tokens long, content binary"


def write_shards(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """Encode and write; returns the table of shards (part, seq, n_docs, n_tokens, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        end = np.array([config.end_id], encoder(config).kind).tobytes()
        width = encoder(config).kind.itemsize
        ids, null, body, held = [], [], [], 0

        def shard() -> pd.DataFrame:
            nonlocal ids, null, body, held, seq
            tokens = np.frombuffer(b"".join(body), encoder(config).kind)
            matrix = wavelet.WaveletMatrix.build(tokens, config.bits if width == 2 else 32)
            content = wavelet.pack(matrix, np.array(ids, np.int64), np.array(null, bool), np.array([len(b) // width for b in body], np.uint32))
            row = pd.DataFrame({"part": [part], "seq": [seq], "n_docs": [len(ids)], "n_tokens": [len(tokens)], "content": [content]})
            ids, null, body, held, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            ends = np.concatenate([[0], batch["text"].str.len().cumsum()]).astype(np.int64)
            for first, last in _base.slices(ends, config.slice_chars):
                some = batch.iloc[first:last]
                for i, n, b in zip(some["id"], some["no_id"], encoder(config).encode(some["text"].tolist()), strict=True):
                    ids.append(i)
                    null.append(n)
                    body.append(b + end)
                    held += len(body[-1]) // width
                    if held >= config.shard_tokens:
                        yield shard()
        if ids:
            yield shard()

    # The text only breaks ties of the id, and only its digest is compared.
    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
        .select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "text")
    )
    return _base.materialize(dealt.mapInPandas(run, _SHARD), "token-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    A document's start is the sum over earlier parts, over earlier shards of its part, and
    within its shard; the first two are prefix sums over one row a part and one a shard.
    """
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("seq_start")).join(parts, "part")
    starts = starts.select("part", "seq", (F.col("seq_start") + F.col("part_start")).alias("shard_start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, seq, content in zip(batch["part"], batch["seq"], batch["content"], strict=True):
                matrix, ids, null, lengths = wavelet.unpack(content)
                tokens = memoryview(matrix.decode().astype("<u4").tobytes())
                ends = np.cumsum(lengths, dtype=np.int64)
                begins = ends - lengths
                yield pd.DataFrame(
                    {
                        "part": np.int32(part),
                        "seq": np.int32(seq),
                        "doc_id": pd.array(ids, dtype="Int64") if not null.any() else pd.array([None if z else int(i) for i, z in zip(ids, null)], dtype="Int64"),
                        "at": begins,
                        "n_tokens": lengths.astype(np.int64),
                        "ids_crc32": [zlib.crc32(tokens[4 * b : 4 * e]) for b, e in zip(begins, ends)],
                    }
                )

    rows = shards.select("part", "seq", "content").mapInPandas(run, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, config: Config = Config()) -> DataFrame:
    return read_shards(write_shards(docs, config))


def op9_tokens(spark, sf_dir: str) -> DataFrame:
    return encode_documents(_base.documents(spark, sf_dir))
