"""Media columns: content-defined chunking of payloads, deduplicated chunks, verified rebuild.

A document's payload is its UTF-8 text, padded with bytes 255 to a positive multiple of 576.
A gear hash rolls over the payload (32 bytes of memory, so a cut depends on content alone);
where its top bits are zero the payload is cut, within a least and a greatest chunk length.
A chunk is known by its SHA-256.

The store holds every payload once and every chunk that several payloads share once:

* ``media`` rows: the payload's ordered chunk list, and the bytes of the chunks that no
  other payload has, in line;
* ``chunk`` rows: the bytes of the shared chunks, written by the payload that owns them
  (found by grouping and joining digests, which are small, not bytes).

Reading joins the chunk lists of the media rows with the chunk rows they name, rebuilds each
payload in order, checks every chunk's digest and the payload's, and computes the result's
columns from the bytes that were read.  A payload's *stored form* is its chunk list (magic,
number of chunks, length and digest of each) followed by the chunks in order.

Texts cross the network once, compressed; what the joins move besides is digests and the
shared chunks.  A payload that a third of all rows have is one row after map-side grouping.

Defined results: null and empty texts have a payload of 576 bytes 255; equal texts have equal
values; repeated rows are repeated in the result; any length is chunked whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _base

UNIT = 576
MAGIC = b"TSCD1"


@dataclass(frozen=True)
class Config:
    least: int = 1024
    mask_bits: int = 12
    most: int = 16384
    seed: int = 97
    level: int = 6


_gears: dict[int, np.ndarray] = {}


def gear(seed: int) -> np.ndarray:
    if seed not in _gears:
        _gears[seed] = np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)
    return _gears[seed]


def payload(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT or (0 if text else UNIT))


def rolling(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: the sum over the last 32 bytes of gear << age, by doubling."""
    h = table[raw]
    for span in (1, 2, 4, 8, 16):
        more = h.copy()
        more[span:] += h[:-span] << np.uint32(span)
        h = more
    return h


def cuts(raw: np.ndarray, config: Config = Config()) -> list[int]:
    """Ends of the chunks of one payload."""
    n = len(raw)
    marks = np.flatnonzero(rolling(raw, gear(config.seed)) >> np.uint32(32 - config.mask_bits) == 0) + 1 if n > config.least else []
    ends, start, i = [], 0, 0
    while n - start > config.most or (i < len(marks) and n - start > config.least):
        i += int(np.searchsorted(marks[i:], start + config.least)) if i < len(marks) else 0
        end = int(marks[i]) if i < len(marks) else n
        end = min(end, start + config.most, n)
        if end >= n:
            break
        ends.append(end)
        start = end
    return [*ends, n]


def chunks(body: bytes, config: Config = Config()) -> list[bytes]:
    ends = cuts(np.frombuffer(body, np.uint8), config)
    return [body[a:b] for a, b in zip([0, *ends], ends)]


def features(body: bytes, n_chunks: int) -> str:
    counts = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    p = counts[counts > 0] / len(body)
    mean = float(np.arange(256) @ counts) / len(body)
    return f"chunks={n_chunks};distinct={len(p)};mean={mean:.4f};entropy={-float((p * np.log2(p)).sum()) + 0.0:.4f}"


def stored_form(lengths: list[int], digests: list[bytes], body: bytes) -> bytes:
    head = b"".join(struct.pack("<I", n) + d for n, d in zip(lengths, digests))
    return MAGIC + struct.pack("<Q", len(lengths)) + head + body


def _index(config: Config):
    """(doc_id, text) to (doc_id, n_bytes, media, digests)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = _base.utf8(batch.column(1))
            sizes, media, digests = [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                body = payload(raw[a:b].tobytes())
                sizes.append(b - a)
                media.append(hashlib.sha256(body).digest())
                digests.append([hashlib.sha256(c).digest() for c in chunks(body, config)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(digests, pa.list_(pa.binary()))],
                ["doc_id", "n_bytes", "media", "digests"],
            )

    return run


def _pressed(config: Config):
    """(text) to (media, pressed payload), one row for each payload of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=config.level).compress
        for batch in batches:
            raw, at = _base.utf8(batch.column(0))
            seen: dict[bytes, bytes] = {}
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                body = payload(raw[a:b].tobytes())
                key = hashlib.sha256(body).digest()
                if key not in seen:
                    seen[key] = press(body)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], ["media", "pressed"])

    return run


def _store(config: Config):
    """(media, pressed, shared, owned) to store rows; the lists hold chunk positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            keys, pressed = batch.column(0), batch.column(1)
            shared, owned = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out: list[tuple] = []
            for i in range(batch.num_rows):
                parts = chunks(open_(pressed[i].as_py()), config)
                digests = [hashlib.sha256(c).digest() for c in parts]
                away = set(shared[i] or ())
                out += [("chunk", digests[k], None, None, None, parts[k]) for k in owned[i] or ()]
                inline = b"".join(c for k, c in enumerate(parts) if k not in away)
                out.append(("media", keys[i].as_py(), [len(c) for c in parts], digests, sorted(away), inline))
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "key", "lengths", "digests", "away", "body"])

    return run


_STORE = "kind string, key binary, lengths array<int>, digests array<binary>, away array<int>, body binary"


def _describe():
    """Media rows with their fetched chunks to the columns of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, lengths, digests, away, body, fetched in zip(*[c.to_pylist() for c in batch.columns]):
                got = {x["seq"]: x["body"] for x in fetched or ()}
                if sorted(got) != sorted(away or ()):
                    raise ValueError("a shared chunk is missing from the store")
                parts, at = [], 0
                for k, n in enumerate(lengths):
                    if k in got:
                        parts.append(got[k])
                    else:
                        parts.append(body[at : at + n])
                        at += n
                    if hashlib.sha256(parts[-1]).digest() != digests[k]:
                        raise ValueError("a stored chunk does not match its digest")
                whole = b"".join(parts)
                digest = hashlib.sha256(whole)
                if digest.digest() != key:
                    raise ValueError("a rebuilt payload does not match its digest")
                form = stored_form(lengths, digests, whole)
                out.append((key, len(whole), digest.hexdigest(), zlib.crc32(whole[-32:]), len(form), hashlib.sha256(form).hexdigest(), features(whole, len(parts))))
            columns = list(zip(*out)) or [[]] * 7
            kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


_RESULT = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def write_store(docs: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Written tables: the index (doc_id, n_bytes, media, digests) and the store."""
    with _base.scratch(docs.sparkSession):
        kind = docs.schema["doc_id"].dataType.simpleString()
        index = _base.materialize(
            docs.select("doc_id", "text").mapInArrow(_index(config), f"doc_id {kind}, n_bytes long, media binary, digests array<binary>"), "media-index", keep=1
        )
        lists = index.groupBy("media").agg(F.first("digests").alias("digests"))
        refs = lists.select("media", F.posexplode("digests").alias("seq", "digest"))
        counted = refs.groupBy("digest").agg(F.min(F.struct("media", "seq")).alias("owner"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        owners = _base.materialize(counted.select("digest", "owner"), "shared-chunks")
        mine = (F.col("owner.media") == F.col("media")) & (F.col("owner.seq") == F.col("seq"))
        plans = (
            refs.join(owners, "digest")
            .groupBy("media")
            .agg(F.collect_list("seq").alias("shared"), F.collect_list(F.when(mine, F.col("seq"))).alias("owned"))
            .select(F.col("media").alias("plan_of"), "shared", "owned")
        )
        pressed = docs.select("text").mapInArrow(_pressed(config), "media binary, pressed binary")
        pressed = pressed.groupBy("media").agg(F.first("pressed").alias("pressed"))
        planned = pressed.join(plans, F.col("media") == F.col("plan_of"), "left").select("media", "pressed", "shared", "owned")
        return index, _base.materialize(planned.mapInArrow(_store(config), _STORE), "media-store", level=9, keep=1)


def read_store(store: DataFrame) -> DataFrame:
    """Rebuilt and verified payloads: one row for each media row of the store."""
    media = store.where(F.col("kind") == "media").select(F.col("key").alias("media"), "lengths", "digests", "away", "body")
    pool = store.where(F.col("kind") == "chunk").select(F.col("key").alias("digest"), F.col("body").alias("bytes"))
    fetched = "array<struct<seq:int,body:binary>>"
    alone = media.where(F.size("away") == 0).withColumn("fetched", F.lit(None).cast(fetched))
    joined = media.where(F.size("away") > 0)
    wants = joined.select("media", F.explode("away").alias("seq"), "digests").select("media", "seq", F.element_at("digests", F.col("seq") + 1).alias("digest"))
    got = wants.join(pool, "digest").groupBy(F.col("media").alias("of")).agg(F.collect_list(F.struct("seq", F.col("bytes").alias("body"))).cast(fetched).alias("fetched"))
    joined = joined.join(got, F.col("media") == F.col("of")).select("media", "lengths", "digests", "away", "body", "fetched")
    return alone.select("media", "lengths", "digests", "away", "body", "fetched").unionByName(joined).mapInArrow(_describe(), _RESULT)


def media_columns(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """Per row: doc_id, n_bytes and the columns computed from the store."""
    index, store = write_store(docs, config)
    read = read_store(store).withColumnRenamed("media", "of")
    return index.select("doc_id", "n_bytes", "media").join(read, F.col("media") == F.col("of")).drop("media", "of")


def op1_media(spark, sf_dir: str) -> DataFrame:
    return media_columns(_base.documents(spark, sf_dir))
