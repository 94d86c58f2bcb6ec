"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors, one for each hashed word, each hashed pair
of neighbouring words and each hashed character n-gram (n = 3, 4 code points) in it; a softmax over that average gives the class.  The vectors
and the output layer are trained together by plain stochastic gradient descent in numpy on
the driver, on a bounded sample of labelled rows (``Config.max_train_docs`` rows and
``Config.max_train_bytes`` bytes in all, whole texts of any length).

Scoring needs no vectors: because the average and the output layer are both linear, each
bucket's contribution to the difference of the two logits is one number.  A trained model
is therefore a table of ``2 ** bits`` floats, and a document's score is the mean of table
look-ups, computed on the code points of Arrow's buffers without a Python string a row.

Defined results: null and empty texts score the class prior that the bias learned; texts
of any length are read whole; repeated rows get equal scores; an empty table gives an
empty result; columns other than the id and text are passed through or ignored.  With no
usable label at all the score is 0.5 for every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import _base


@dataclass(frozen=True)
class Config:
    bits: int = 16
    dim: int = 8
    epochs: int = 5
    rate: float = 15.0
    seed: int = 7
    #: Bound of the sample that the model is fitted on: rows, and bytes of all rows together.
    max_train_docs: int = 4000
    max_train_bytes: int = 32 << 20
    threshold: float = 0.7


_POWERS = np.full(256, 0x9E3779B97F4A7C15, np.uint64)
_POWERS[0] = 1
_POWERS = np.cumprod(_POWERS, dtype=np.uint64)


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, and the offsets of the texts in them."""
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32), starts[offsets]


def _gram_buckets(chars: np.ndarray, bits: int) -> list[tuple[int, np.ndarray]]:
    """For n = 3 and 4: the bucket of the n-gram of characters at each position."""
    out, mixed = [], chars * np.uint32(0x9E3779B1)
    for n, odd in ((2, 0x85EBCA6B), (3, 0xC2B2AE35), (4, 0x27D4EB2F)):
        if len(chars) < n:
            break
        mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * np.uint32(odd) + chars[n - 1 :] * np.uint32(0x9E3779B1)
        if n > 2:
            out.append((n, (mixed * np.uint32(2654435761)) >> np.uint32(32 - bits)))
    return out


def _word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word and its 64-bit hash.  ``ends``: document ends, which end a word too."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    solid = (raw != 32) & ((raw < 9) | (raw > 13))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = ends[(ends > 0) & (ends < len(raw))]
    first[inner] = solid[inner]
    start = np.flatnonzero(first)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    at = np.arange(len(raw), dtype=np.int64)
    at -= np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(raw)]])))
    term = (raw.astype(np.uint64) + np.uint64(1)) * _POWERS[at & 255]
    term[~solid] = 0
    total = np.add.reduceat(term, start)
    return start, total ^ (total >> np.uint64(29))


def _word_buckets(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words, and of pairs of neighbours.

    A pair's hash is the exclusive or of its words, so every immediate repetition of a
    word, whatever the word, is one and the same feature.
    """
    shift, odd = np.uint64(64 - bits), np.uint64(0xBF58476D1CE4E5B9)
    pairs = hashes[1:] ^ hashes[:-1]
    return ((hashes * odd) >> shift).astype(np.uint32), ((pairs * odd) >> shift).astype(np.uint32)


def features(raw: np.ndarray, bits: int) -> np.ndarray:
    """All buckets of one document, with repeats."""
    raw = code_points(raw, np.array([0, len(raw)]))[0]
    parts = [x for _, x in _gram_buckets(raw, bits)]
    parts += _word_buckets(_word_hashes(raw, np.zeros(0, np.int64))[1], bits)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def document_means(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean table value over the buckets of each document; 0 where it has none."""
    bits = int(len(table)).bit_length() - 1
    out = np.zeros(len(offsets) - 1)
    for first, last in _base.slices(offsets):
        piece, at = code_points(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        start, end = at[:-1], at[1:]
        total, count = np.zeros(last - first), np.zeros(last - first)
        for n, bucket in _gram_buckets(piece, bits):
            run = np.concatenate([[0.0], np.cumsum(table[bucket], dtype=np.float64)])
            stop = np.maximum(start, np.minimum(end - n + 1, len(bucket)))
            total += run[stop] - run[start.clip(max=len(bucket))]
            count += stop - start
        begin, hashes = _word_hashes(piece, end)
        lo, hi = np.searchsorted(begin, start), np.searchsorted(begin, end)
        for short, bucket in enumerate(_word_buckets(hashes, bits)):
            run = np.concatenate([[0.0], np.cumsum(table[bucket], dtype=np.float64)])
            stop = np.maximum(lo, hi - short)
            total += run[stop] - run[lo.clip(max=len(bucket))]
            count += stop - lo
        out[first:last] = total / np.maximum(count, 1)
    return out


@dataclass
class Model:
    table: np.ndarray  # float32: logit difference of each bucket
    bias: float

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(document_means(raw, offsets, self.table) + self.bias, -60, 60)))


def train(texts: list[bytes], labels: list[int], config: Config = Config()) -> Model:
    """Fit vectors and output layer by stochastic gradient descent, one document a step."""
    size, rng = 1 << config.bits, np.random.default_rng(config.seed)
    vectors = rng.uniform(-1, 1, (size, config.dim)) / config.dim
    out, bias = np.zeros((2, config.dim)), np.zeros(2)
    bags = []
    for text in texts:
        bucket, count = np.unique(features(np.frombuffer(text, np.uint8), config.bits), return_counts=True)
        bags.append((bucket, count / max(1, count.sum())))
    y = np.asarray(labels, int)
    steps, done = max(1, config.epochs * len(bags)), 0
    for _ in range(config.epochs):
        for i in rng.permutation(len(bags)):
            rate = config.rate * (1 - done / steps)
            done += 1
            bucket, weight = bags[i]
            hidden = weight @ vectors[bucket]
            logit = out @ hidden + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out.T @ p
            out -= 0.1 * rate * np.outer(p, hidden)
            bias -= 0.002 * rate * p
            vectors[bucket] -= rate * np.outer(weight, back)
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def bucket_of_id(doc_id):
    """crc32 of the id as text, modulo 4 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, config: Config = Config()) -> Model:
    """Train on at most ``max_train_docs`` labelled rows outside the held-out quarter.

    The rows are the first in the order of a hash of the id, so that any part of the
    corpus is as likely to be picked, as many as ``max_train_bytes`` holds; one that does not
    fit is passed over.  First their lengths reach the driver, then their texts, so both are
    bounded at any input size.
    """
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (bucket_of_id(F.col("doc_id")) != 2))
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.max("quality").alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(config.max_train_docs)
    )
    named = docs.select("doc_id", "text").where(F.length("text") > 0).join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
    row = F.concat(F.col("label_id").cast("string"), F.lit(" "), F.col("text"))
    named = named.select("label_id", "label", "text", F.md5(row.cast("binary")).alias("key"), F.octet_length("text").alias("size"))
    sizes = named.select("label_id", "key", "size").orderBy(F.xxhash64("label_id"), "label_id", "key").limit(config.max_train_docs).collect()
    chosen, left = [], config.max_train_bytes
    for r in sizes:
        if r.size <= left:
            chosen.append(r.key)
            left -= r.size
    rows = named.where(F.col("key").isin(chosen)).dropDuplicates(["key"]).select("label", "key", F.encode("text", "utf-8").alias("body")).collect()
    rows.sort(key=lambda r: r.key)
    if not rows:
        return Model(np.zeros(1 << config.bits, np.float32), 0.0)
    return train([bytes(r.body) for r in rows], [int(r.label) for r in rows], config)


def score(docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` and the score of its ``text``."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(sent.value.score(*_base.utf8(batch.column(len(keep)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], scores], [*keep, name])

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, config: Config = Config()) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels, config), ["doc_id"])
    return scored.select(
        "doc_id",
        (bucket_of_id(F.col("doc_id")) == 2).alias("held_out"),
        "score",
        (F.col("score") >= config.threshold).cast("int").alias("predicted"),
    )


def filter_documents(docs: DataFrame, labels: DataFrame, config: Config = Config()) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their own columns."""
    scored = score(docs, fit(docs, labels, config), docs.columns, "__score")
    return scored.where(F.col("__score") >= config.threshold).drop("__score")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    return classify(_base.documents(spark, sf_dir), _base.documents(spark, sf_dir, "labels"))
