"""Mixing sources to target weights by weighted random order.

Every document gets an Efraimidis-Spirakis key ``-ln(u) / w``: ``u`` is a reproducible
uniform number made from the row itself, ``w`` its quality weight.  Within a source, rows in
key order are a weighted sample without replacement of every length, so a budget of words is
met by a prefix.  A source whose target is above its size first gives complete epochs (each
row once) and only the rest is drawn from the order.  The row on the border is cut after the
words that are still wanted, so a source meets its target to the word; what is left keeps its
white space and line breaks.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share
``share`` times all words; none goes above ``most_epochs`` times its own size, and what that
frees is shared again by weight until none is above.  That fixed point is computed in closed
form: sorted by (limit / weight), the capped sources are a prefix.

Scale: only (id, source, size, key) of each row are kept after one read of the texts.  A hot
source is not one window: keys map through the source's own key distribution (a mixture of
one exponential for each weight class, whose counts are known) to evenly filled buckets; the
running sum is the sum over earlier buckets plus the one inside the bucket.

All of it is DataFrame functions.  Defined results: null and empty texts have size 0, take 0
words and stay in the result; a null source is a source of its own; repeated rows share a
key, so which of them is cut does not show; an empty table gives an empty result; a source
with no words has target 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _base


@dataclass(frozen=True)
class Config:
    share: float = 1.5
    most_epochs: int = 2
    #: A bucket of a source holds about this many rows, or the square root of its rows if more.
    bucket_rows: int = 1024


# What counts as a symbol, and the weight for each share of symbols.
SYMBOLS = "#$%&*|!<>{}[]\\^~_=+"
CLASSES = ((0.02, 1.0), (0.05, 0.5), (0.1, 0.25))
LOWEST = 0.1
WEIGHTS = (1.0, 0.5, 0.25, 0.1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_base.WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """One of four weights, by the share of symbols among the characters."""
    share = F.lit(1) - F.length(F.translate(text, SYMBOLS, "")) / F.greatest(F.length(text), F.lit(1))
    share = F.when(F.length(text) > 0, share).otherwise(F.lit(0.0))
    out = F.lit(LOWEST)
    for most, weight in reversed(CLASSES):
        out = F.when(share <= most, F.lit(weight)).otherwise(out)
    return F.coalesce(out, F.lit(1.0))


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1] from the row's id and text: 48 bits of an MD5 digest."""
    row = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.md5(row.cast("binary")), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(1 << 48))


def facts(docs: DataFrame, carried: list[str]) -> DataFrame:
    """id, source, size, weight and key of each row, without its text."""
    text = F.col("text")
    base = docs.select(*carried, "source", n_words(text).alias("size"), quality_weight(text).alias("w"), uniform(F.col("doc_id"), text).alias("u"))
    return base.withColumn("key", -F.log("u") / F.col("w"))


def source_targets(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """Per source: sid, source_size, target and the counts that its buckets need."""
    counts = [F.sum((F.col("w") == w).cast("long")).alias(f"n{i}") for i, w in enumerate(WEIGHTS)]
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), *counts)
    sid = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("sid", sid).withColumn("share_weight", F.element_at(F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0)), (F.col("sid") % 3 + 1).cast("int")))
    limit = (F.col("source_size") * config.most_epochs).cast("double")
    by = by.withColumn("limit", limit).withColumn("at", limit / F.col("share_weight"))
    order = Window.orderBy("at", "sid")
    everything = Window.partitionBy()
    wanted = F.sum("source_size").over(everything) * config.share
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("share_weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", (wanted - before) / rest)
    level = F.max(F.when(F.col("level") <= F.col("at"), F.col("level"))).over(everything)
    target = F.least(F.col("limit"), F.coalesce(level * F.col("share_weight"), F.col("limit")))
    return by.select("source", "sid", "source_size", "n", *[f"n{i}" for i in range(len(WEIGHTS))], target.alias("target"))


def mix(docs: DataFrame, config: Config = Config(), carried: list[str] | None = None) -> DataFrame:
    """Per row: ``carried`` columns, source, size, source_size, target, taken."""
    carried = ["doc_id"] if carried is None else carried
    rows = _base.materialize(facts(docs, carried), "mix-rows")
    sources = _base.materialize(source_targets(rows, config), "mix-sources").withColumnRenamed("source", "source_again")
    placed = rows.join(sources, rows["source"].eqNullSafe(sources["source_again"])).drop("source_again")
    below = F.lit(0.0)
    for i, w in enumerate(WEIGHTS):
        below = below + F.col(f"n{i}") * (1 - F.exp(-F.col("key") * w))
    per = F.greatest(F.lit(float(config.bucket_rows)), F.sqrt(F.col("n")))
    placed = placed.withColumn("bucket", F.floor(below / per).cast("long"))
    sums = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("sid", "bucket").orderBy("key", *carried, "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.join(sums, ["sid", "bucket"]).withColumn("ahead", F.col("earlier") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") - epochs * F.col("source_size")).cast("long")
    drawn = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("ahead")))
    return placed.select(*carried, "source", "size", "source_size", "target", (epochs * F.col("size") + drawn).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """The mix itself: each row as often as it is taken whole, and once more cut if it is cut.

    The columns are those of ``docs``; ``n_chars``, if there, is that of the text as given.
    """
    columns = docs.columns
    whole_row = F.struct(*[F.col(c) for c in columns])
    keyed = docs.select("doc_id", "source", "text", F.xxhash64(whole_row).alias("__key"))
    # Repeated rows have equal keys: number them, so that each meets a decision of its own.
    taken = mix(keyed, config, ["doc_id", "__key"]).select(
        "__key", "size", "taken", F.row_number().over(Window.partitionBy("__key").orderBy(F.col("taken").desc())).alias("__nth")
    )
    rows = docs.select(whole_row.alias("__row"), F.xxhash64(whole_row).alias("__key"))
    rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(0))))
    both = rows.join(taken.where(F.col("taken") > 0), ["__key", "__nth"])
    cut = F.col("taken") % F.col("size")
    copies = F.array_repeat(F.lit(-1).cast("long"), F.floor(F.col("taken") / F.col("size")).cast("int"))
    copies = F.when(cut > 0, F.array_append(copies, cut)).otherwise(copies)
    both = both.select("__row", F.explode(copies).alias("__take"))
    text = F.when(F.col("__take") < 0, F.col("__row.text")).otherwise(_first_words(F.col("__row.text"), F.col("__take")))
    both = both.select("__row", "__take", text.alias("__text"))
    out = []
    for c in columns:
        value = F.col("__row").getField(c)
        if c == "text":
            value = F.col("__text")
        elif c == "n_chars":
            value = F.when(F.col("__take") < 0, value).otherwise(F.length("__text").cast(docs.schema[c].dataType))
        out.append(value.alias(c))
    return both.select(*out)


def _first_words(text: Column, n: Column) -> Column:
    """A text to the end of its ``n``-th word, of more than ``n``: its white space and line breaks stay."""
    begins = F.substring(text, 1, 1).isin(*_base.BLANKS).cast("int")
    rest = F.get(F.split(text, _base.SPACE, n.cast("int") + begins + 1), n.cast("int") + begins)
    return F.rtrim(F.substring(text, F.lit(1), F.length(text) - F.length(rest)), F.lit(_base.BLANKS))


def op8_mix(spark, sf_dir: str) -> DataFrame:
    return mix(_base.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN coalesce(length(text), 0) = 0 THEN 0.0
              ELSE 1 - length(translate(text, '#$%&*|!<>{}[]\^~_=+', ''))::DOUBLE / length(text) END AS symbols,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 12))::BIGINT + 1)::DOUBLE / 281474976710656.0 AS u
  FROM documents),
k AS (
  SELECT *, -ln(u) / (CASE WHEN symbols <= 0.02 THEN 1.0::DOUBLE WHEN symbols <= 0.05 THEN 0.5 WHEN symbols <= 0.1 THEN 0.25 ELSE 0.1 END) AS key
  FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM k GROUP BY source),
w AS (
  SELECT *, CASE sid % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight, (source_size * 2)::DOUBLE AS lim FROM s),
l AS (
  SELECT *, lim / weight AS ratio,
         (sum(source_size) OVER ()::DOUBLE * 1.5 - coalesce(sum(lim) OVER (ORDER BY lim / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
           / sum(weight) OVER (ORDER BY lim / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size, least(lim, coalesce(max(CASE WHEN level <= ratio THEN level END) OVER () * weight, lim)) AS target FROM l),
p AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target - epochs * source_size)::BIGINT - ahead)))::BIGINT AS taken
FROM p
"""
