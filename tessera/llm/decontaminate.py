"""Benchmark decontamination: size-partitioned MinHash containment search.

A document holds a test item if at least ``threshold`` of the item's distinct word shingles
are among the document's.  The search side is the short one: items are partitioned by the size
of their shingle set, by powers of two.  Each keeps the shingles with the smallest hashes (its
bottom sketch): ``sketch`` of them (all, if it has no more) in the first partitions, and
``growth`` more with each partition after.  Any one of these is in a document with the
probability of the containment itself, however long the document, so a document is probed with
every shingle it has.

A partition has two conditions of its own.  A document with fewer shingles than ``threshold``
times the partition's smallest item cannot hold any of its items.  And a candidate must hit a
number of sketch hashes that is computed from the hypergeometric distribution of the
partition's sizes: the most that an item at the threshold misses with a probability of at most
``miss``.  Items that keep all of their hashes are searched exactly.

Candidates are then verified with the shingles themselves (strings, not hashes): the number
of the item's distinct shingles that occur in the whole document.

The work on documents is one pass of hashing without a shuffle while the sketch table is
small: its size is that of a written table, so Spark broadcasts it only below its own
threshold and shuffles both sides otherwise.  All of it is DataFrame functions.

Defined results: words are maximal runs without ASCII white space, A-Z lowered; a text of
fewer than ``shingle`` words is one shingle, its whole sequence; texts of any length are read
whole; null and empty texts and items match nothing; an item id with several texts is the item
of all their shingles; repeated rows are reported once (results are pairs of ids), and of the
different texts of one document id the one that holds most of an item counts; an empty table on
either side gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _base


@dataclass(frozen=True)
class Config:
    shingle: int = 5
    threshold: float = 0.8
    sketch: int = 16
    growth: int = 4
    miss: float = 1e-6
    #: Items of more than two to this power of shingles share a partition.
    most_classes: int = 20

    def kept(self, size_class: int, size: int) -> int:
        """Hashes that an item of ``size`` shingles in the partition keeps."""
        return min(size, self.sketch + self.growth * max(0, size_class - 4))

    def hits(self, size_class: int) -> int:
        """Sketch hashes that a document must hit, for the worst size of the partition."""
        sizes = sorted({(1 << size_class >> 1) + 1, 1 << size_class} | set(range((1 << size_class >> 1) + 1, min(1 << size_class, 256) + 1)))
        return min(self._hits(n, self.kept(size_class, n)) for n in sizes)

    def _hits(self, n: int, k: int) -> int:
        m = math.ceil(self.threshold * n - 1e-9)  # shingles of the item that a match has at least
        if k == n:
            return m
        log = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
        missed, h = 0.0, 0
        while True:  # P(at most h of the k sampled are among the m)
            if h <= m and k - h <= n - m:
                missed += math.exp(log(m, h) + log(n - m, k - h) - log(n, k))
            if missed > self.miss:
                return max(1, h)
            h += 1


def _starts(words: Column, k: int) -> Column:
    """Positions at which shingles start; none for no words, one for fewer than ``k``."""
    return F.when(F.size(words) > 0, F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _hashes(words: Column, k: int) -> Column:
    """64-bit hash of each shingle.  ``get`` is null past the end, which the hash skips."""
    return F.transform(_starts(words, k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))


def _strings(words: Column, k: int) -> Column:
    return F.array_distinct(F.transform(_starts(words, k), lambda i: F.array_join(F.slice(words, i + 1, k), " ")))


def _worded(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the words.  The one-element explode keeps them a column of their own: as an
    ordinary projection they would be folded into each use, and be split anew for every shingle."""
    return df.select(*keep, F.explode(F.array(_base.words_of(_base.ascii_lower(F.col("text"))))).alias("words"))


def sketches(items: DataFrame, config: Config = Config()) -> DataFrame:
    """Written table (hash, item_id, hits, least): the smallest hashes of each item's set, the
    hashes that a document must hit, and the shingles that it must have."""
    worded = _worded(items.where(F.col("item_id").isNotNull()), ["item_id"]).select("item_id", F.explode(_hashes(F.col("words"), config.shingle)).alias("hash"))
    hashed = worded.groupBy("item_id").agg(F.array_sort(F.collect_set("hash")).alias("h"))
    bits = F.when(F.size("h") > 1, F.length(F.bin(F.size("h") - 1))).otherwise(0)  # log2, rounded up
    size_class = F.least(bits, F.lit(config.most_classes)).cast("int")
    classed = hashed.withColumn("size_class", size_class)
    classes = range(config.most_classes + 1)
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("size_class") + 1)
    kept = F.least(of([config.kept(c, 1 << 62) for c in classes]), F.size("h"))
    least = of([math.ceil(config.threshold * ((1 << c >> 1) + 1) - 1e-9) for c in classes])
    exact = F.ceil(F.size("h") * F.lit(config.threshold) - 1e-9).cast("int")
    hits = F.when(kept == F.size("h"), exact).otherwise(of([config.hits(c) for c in classes]))
    small = classed.select("item_id", F.explode(F.slice("h", F.lit(1), kept)).alias("hash"), hits.alias("hits"), least.alias("least"))
    return _base.materialize(small.select("hash", "item_id", "hits", "least"), "item-sketches")


def candidates(docs: DataFrame, sketch: DataFrame, config: Config = Config()) -> DataFrame:
    """Written table (doc_id, text_hash, item_id) of pairs that hit often enough."""
    probes = (
        _worded(docs, ["doc_id", F.xxhash64("text").alias("text_hash")])
        .select("doc_id", "text_hash", _hashes(F.col("words"), config.shingle).alias("h"))
        .select("doc_id", "text_hash", F.size("h").alias("size"), F.explode("h").alias("hash"))
    )
    hit = probes.join(sketch, "hash").where(F.col("size") >= F.col("least"))
    hit = hit.groupBy("doc_id", "text_hash", "item_id").agg(F.count_distinct("hash").alias("n"), F.max("hits").alias("hits"))
    return _base.materialize(hit.where(F.col("n") >= F.col("hits")).select("doc_id", "text_hash", "item_id"), "decontamination-candidates")


def find(docs: DataFrame, items: DataFrame, config: Config = Config()) -> DataFrame:
    """Pairs doc_id, item_id, n_item, n_shared, containment at or above the threshold."""
    found = _found(docs, items, config)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"), F.max("containment").alias("containment"))


def _found(docs: DataFrame, items: DataFrame, config: Config) -> DataFrame:
    """As ``find``, for each text of a document, with ``text_hash``."""
    with _base.scratch(docs.sparkSession):
        return _base.materialize(_verified(docs, items, config), "contaminations", keep=1)


def _verified(docs: DataFrame, items: DataFrame, config: Config) -> DataFrame:
    sketch = sketches(items, config)
    pairs = candidates(docs, sketch, config)
    k = config.shingle
    wanted = pairs.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.col("item_id").alias("i")).distinct()
    named = wanted.select("d", "t").distinct()
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts = texts.join(named, texts["doc_id"].eqNullSafe(named["d"]) & (texts["text_hash"] == named["t"]), "left_semi")
    texts = texts.dropDuplicates(["doc_id", "text_hash"])
    inside = _worded(texts, ["doc_id", "text_hash"]).select("doc_id", "text_hash", F.explode(_strings(F.col("words"), k)).alias("s"))
    parts = _worded(items.where(F.col("item_id").isNotNull()), ["item_id"]).select("item_id", _strings(F.col("words"), k).alias("ss"))
    sizes = parts.select(F.explode("ss").alias("s"), "item_id").distinct()
    n_item = sizes.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    asked = wanted.join(sizes, wanted["i"] == sizes["item_id"]).select("d", "t", "i", "s")
    shared = (
        inside.join(asked.withColumnRenamed("s", "s2"), inside["doc_id"].eqNullSafe(F.col("d")) & (inside["text_hash"] == F.col("t")) & (inside["s"] == F.col("s2")))
        .groupBy("doc_id", "text_hash", F.col("i").alias("item_id"))
        .agg(F.count_distinct("s").alias("n_shared"))
    )
    done = shared.join(n_item, "item_id").withColumn("containment", F.col("n_shared") / F.col("n_item"))
    return done.where(F.col("containment") >= config.threshold)


def clean_documents(docs: DataFrame, items: DataFrame, config: Config = Config()) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their own columns."""
    with _base.scratch(docs.sparkSession):
        dirty = _found(docs, items, config).select(F.col("doc_id").alias("__dirty"), F.col("text_hash").alias("__text_hash")).distinct()
        dirty = _base.materialize(dirty, "contaminated", keep=1)
    return docs.join(dirty, docs["doc_id"].eqNullSafe(dirty["__dirty"]) & (F.xxhash64(docs["text"]) == dirty["__text_hash"]), "left_anti")


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find(_base.documents(spark, sf_dir), _base.documents(spark, sf_dir, "benchmark"))


def _shingle_sql(table: str, key: str) -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
    SELECT DISTINCT {key}, r, s FROM (
      SELECT {key}, r, i, n, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS s
      FROM (SELECT {key}, r, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i, len(w) AS n
            FROM (SELECT {key}, row_number() OVER () AS r, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS w FROM {table}))
      WINDOW o AS (PARTITION BY r ORDER BY i))
    WHERE i <= greatest(n - 4, 1)"""


OP10_SQL = f"""
WITH ds AS ({_shingle_sql("documents", "doc_id")}),
its AS (SELECT DISTINCT item_id, s FROM ({_shingle_sql("benchmark", "item_id")})),
n AS (SELECT item_id, count(*) AS n_item FROM its GROUP BY item_id),
t AS (SELECT ds.doc_id, ds.r, its.item_id, count(*) AS n_shared FROM ds JOIN its USING (s) GROUP BY 1, 2, 3),
h AS (SELECT doc_id, item_id, max(n_shared) AS n_shared FROM t GROUP BY 1, 2)
SELECT h.doc_id, h.item_id, n.n_item, h.n_shared, h.n_shared::DOUBLE / n.n_item AS containment
FROM h JOIN n USING (item_id) WHERE h.n_shared::DOUBLE / n.n_item >= 0.8
"""
