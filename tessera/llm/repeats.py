"""Repeated passages: word spans that several documents share.

A passage counts if it has ``least`` = gram + window - 1 words, so the passages of a document
are the union of its windows of ``least`` words that another text has too.  Comparing the hashes
of all windows of all texts would be a row for each word.  Two steps leave out what cannot
match, and nothing else:

* The *anchor* of a window is its k-gram (``gram`` words) with the smallest hash.  It depends on
  the words of the window alone, so texts that share a window share its anchor.  Anchors that
  occur in one text only are dropped by counting, with all of their windows.
* Consecutive windows with one anchor make a *piece*.  Equal pieces are counted as one row.  A
  piece that several texts have is repeated as a whole; the windows of all distinct pieces are
  counted once more, which finds the windows that a piece of one text shares with other pieces.

Scale: both counts are aggregates that combine before the shuffle, so a passage that a third of
all documents share is one row a task; only the way back from pieces to texts joins all rows of
a piece.  A text that has a piece many times has one row with all the places.  Copies of a
whole text are one text from the start.

Result: per document and maximal repeated passage: doc_id, start_word, end_word (exclusive),
n_words and other_id, a document that has the passage (or part of it) too.  Words are maximal
runs without ASCII white space, with A-Z lowered.  Defined results: null texts and texts of
fewer than ``least`` words have no passages; every document of a group of equal texts of at
least that length is one passage as a whole; passages repeated only within one document are
not reported; repeated rows of one id count as one document; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _base


@dataclass(frozen=True)
class Config:
    gram: int = 16
    window: int = 35

    @property
    def least(self) -> int:
        return self.gram + self.window - 1


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hash of each word of one text."""
    if not len(raw):
        return np.zeros(0, np.uint64)
    piece = _LOWER[raw]
    solid = _SOLID[piece]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    word = np.flatnonzero(begin)
    if not len(word):
        return np.zeros(0, np.uint64)
    at = np.arange(len(piece), dtype=np.int64)
    at -= np.repeat(np.concatenate([[0], word]), np.diff(np.concatenate([[0], word, [len(piece)]])))
    powers = np.full(int(at.max()) + 2, 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    term = (piece.astype(np.uint64) + np.uint64(1)) * np.cumprod(powers, dtype=np.uint64)[at]
    term[~solid] = 0
    return _mix(np.add.reduceat(term, word))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position, by doubling (any ``k``)."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    out, have, power, span = None, 0, words, 1
    while True:
        if k & span:
            piece = power[have : len(words) - k + 1 + have]
            out = piece if out is None else _mix(out[: len(piece)] * np.uint64(0xD6E8FEB86659FD93) + piece)
            have += span
        if have == k:
            return out
        power = _mix(power[:-span] * np.uint64(0xA24BAED4963EE407) + power[span:])
        span *= 2


def _sliding(x: np.ndarray, width: int, take: Callable) -> np.ndarray:
    """Least or greatest of each ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        x = take(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return take(x[:-rest], x[rest:]) if rest else x


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions that are the least of some window; of a run of equal k-grams only the last, which has their hash."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    least = _sliding(grams, window, np.minimum)
    padded = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    chosen = _sliding(padded, window, np.maximum) == grams
    chosen[:-1] &= grams[:-1] != grams[1:]
    return np.flatnonzero(chosen)


def _suffixes(config: Config) -> Callable:
    """(doc_id, cls, text) to suffix rows (key, cls, pos) and one row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, classes = batch.column(0), batch.column(1).to_pylist()
            raw, at = _base.utf8(batch.column(2))
            counts, keys, rows, seen = [], [], [], set()
            for i, cls in enumerate(classes):
                words = word_hashes(raw[at[i] : at[i + 1]])
                counts.append(len(words))
                if cls in seen:
                    continue
                seen.add(cls)
                grams = gram_hashes(words, config.gram)
                pos = minimisers(grams, config.window)
                keys.append(grams[pos])
                rows.append((cls, pos))
            kind = ids.type
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(classes, pa.binary()), pa.nulls(len(ids), pa.int64()), pa.array(counts, pa.int32())], ["doc_id", "cls", "key", "pos"]
            )
            n = [len(p) for _, p in rows]
            if sum(n):
                name = np.repeat(np.arange(len(rows)), n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(sum(n), kind),
                        pa.array([c for c, _ in rows], pa.binary()).take(pa.array(name)),
                        pa.array(np.concatenate(keys).view(np.int64)),
                        pa.array(np.concatenate([p for _, p in rows]).astype(np.int32)),
                    ],
                    ["doc_id", "cls", "key", "pos"],
                )

    return run


def anchors(grams: np.ndarray, window: int) -> np.ndarray:
    """For each ``window`` consecutive k-grams the position of the least, of equal ones the last."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    return _sliding(np.arange(len(grams)), window, lambda a, b: np.where(grams[b] <= grams[a], b, a))


def _lists(values: list[np.ndarray], sizes: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(values), kind))


#: Windows that one Arrow batch of pieces holds, about.
_MANY = 500_000


def _pieces(config: Config) -> Callable:
    """(cls, places, text) to pieces (piece, cls, starts, windows).

    A piece is a run of consecutive windows of ``least`` words that have one anchor: the hashes
    of its windows, and the words of the text where it starts, however often the text has it.
    """

    def rows(held: list[tuple]) -> pa.RecordBatch:
        classes, names, starts, times, windows, sizes = zip(*held)
        cls = pa.array(classes, pa.binary()).take(pa.array(np.repeat(np.arange(len(names)), [len(x) for x in names])))
        columns = [pa.array(np.concatenate(names).view(np.int64)), cls, _lists(starts, times, pa.int32()), _lists(windows, sizes, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["piece", "cls", "starts", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = _base.utf8(batch.column(2))
            held: list[tuple] = []
            many = 0
            for i, (cls, places) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                words = word_hashes(raw[at[i] : at[i + 1]])
                grams = gram_hashes(words, config.gram)
                anchor = anchors(grams, config.window)
                first = np.flatnonzero(np.diff(anchor, prepend=-1))
                size = np.diff(np.append(first, len(anchor)))
                keep = np.isin(grams[anchor[first]], grams[places])
                first, size = first[keep], size[keep]
                whole = gram_hashes(words, config.least)
                # The first and the last window overlap: with their distance they tell all words of the piece.
                name = _mix(whole[first] * np.uint64(0xD6E8FEB86659FD93) + _mix(whole[first + size - 1] + size.astype(np.uint64)))
                order = np.argsort(name, kind="stable")
                name, one, times = np.unique(name[order], return_index=True, return_counts=True)
                one = order[one]
                size, begin = size[one], first[one]
                ends = np.cumsum(size)
                windows = whole[np.arange(ends[-1]) + np.repeat(begin - ends + size, size)]
                held.append((cls, name, first[order].astype(np.int32), times, windows.view(np.int64), size))
                many += len(windows)
                if many > _MANY:
                    yield rows(held)
                    held, many = [], 0
            if held:
                yield rows(held)

    return run


def _merged(config: Config) -> Callable:
    """(cls, matches) to maximal spans (cls, start, stop, other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for cls, matches in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held: list | None = None
                spans = ((at + m["shift"], at + m["shift"] + m["n"] - 1 + config.least, m["other"]) for m in matches for at in m["starts"])
                for start, stop, other in sorted(spans):
                    if held is not None and start <= held[1]:
                        held[1], held[2] = max(held[1], stop), min(held[2], other)
                        continue
                    if held is not None:
                        out.append((cls, *held))
                    held = [start, stop, other]
                out.append((cls, *held))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, [pa.binary(), pa.int32(), pa.int32(), pa.binary()])], ["cls", "start", "stop", "other"]
            )

    return run


def _matches(pieces: DataFrame) -> DataFrame:
    """Pieces, or single windows of them, that another text has: cls, starts, shift, n windows, other."""
    known = pieces.groupBy("piece").agg(F.min("cls").alias("a"), F.max("cls").alias("b"), F.first("starts").alias("starts"), F.first("windows").alias("windows"))
    known = _base.materialize(known, "distinct-pieces")
    several = F.col("a") != F.col("b")
    other = F.when(F.col("a") == F.col("cls"), F.col("b")).otherwise(F.col("a")).alias("other")
    whole = known.where(several).select("piece", "a", "b", F.size("windows").alias("n"))
    whole = pieces.select("piece", "cls", "starts").join(whole, "piece").select("cls", "starts", F.lit(0).alias("shift"), "n", other)
    # A piece of one text may have windows that are parts of other pieces.
    repeated = known.select("a", "b", F.explode("windows").alias("window")).groupBy("window").agg(F.min("a").alias("a"), F.max("b").alias("b")).where(several)
    lone = known.where(~several).select(F.col("a").alias("cls"), "starts", F.posexplode("windows").alias("shift", "window"))
    return whole.unionByName(lone.join(repeated, "window").select("cls", "starts", "shift", F.lit(1).alias("n"), other))


def find(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """Per document and passage: doc_id, start_word, end_word, n_words, other_id."""
    with _base.scratch(docs.sparkSession):
        return _base.materialize(_found(docs, config), "repeats", keep=1)


def _found(docs: DataFrame, config: Config) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    texts = texts.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("cls"), "text")
    rows = _base.materialize(texts.mapInArrow(_suffixes(config), f"doc_id {kind}, cls binary, key long, pos int"), "suffix-keys")
    named = rows.where(F.col("key").isNull()).select("doc_id", "cls", F.col("pos").alias("n_words"))
    classes = named.groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.max("n_words").alias("n_words"))
    classes = _base.materialize(classes, "text-classes")
    keyed = rows.where(F.col("key").isNotNull()).select("key", "cls", "pos")
    shared = keyed.groupBy("key").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where(F.col("a") != F.col("b")).select("key")
    # Written, so that the join below reads two exchanges and a hot key's rows can be split.
    shared = _base.materialize(shared, "shared-keys")
    places = keyed.join(shared, "key").groupBy("cls").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    wanted = _base.materialize(places.join(classes.select("cls", "first_id"), "cls"), "suffix-places").withColumnRenamed("cls", "cls2")
    body = texts.join(wanted.hint("shuffle_hash"), (texts["doc_id"] == wanted["first_id"]) & (texts["cls"] == wanted["cls2"]))
    pieces = body.select("cls", "places", "text").mapInArrow(_pieces(config), "piece long, cls binary, starts array<int>, windows array<long>")
    pieces = _base.materialize(pieces, "pieces")
    gathered = _matches(pieces).groupBy("cls").agg(F.collect_list(F.struct("starts", "shift", "n", "other")).alias("matches"))
    spans = gathered.mapInArrow(_merged(config), "cls binary, start int, stop int, other binary")
    alone = classes.where(F.col("first_id") == F.col("last_id")).select("cls", F.col("first_id").alias("doc_id"))
    others = classes.select(F.col("cls").alias("other"), F.col("first_id").alias("other_id"))
    partial = spans.join(alone, "cls").join(others, "other").select("doc_id", F.col("start").alias("start_word"), F.col("stop").alias("end_word"), "other_id")
    groups = classes.where((F.col("first_id") != F.col("last_id")) & (F.col("n_words") >= config.least))
    whole = (
        named.select("doc_id", "cls")
        .join(groups, "cls")
        .select("doc_id", F.lit(0).alias("start_word"), F.col("n_words").alias("end_word"), F.when(F.col("doc_id") == F.col("first_id"), F.col("last_id")).otherwise(F.col("first_id")).alias("other_id"))
        .distinct()
    )
    return partial.unionByName(whole).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_id")


def op7_repeats(spark, sf_dir: str) -> DataFrame:
    return find(_base.documents(spark, sf_dir))
