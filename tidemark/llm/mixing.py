"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Targets: each source gets its weight's share of all words. A source whose share exceeds
``max_epochs`` times its own size is clamped there and the excess goes to the others by weight,
until no share is above its cap.

Taking: a source is repeated whole ``floor(target / size)`` times. The rest comes from its
documents in a seeded order (md5 of seed and id), up to the document at which it is full; that
one document gives only the words that are missing. The place in that order is found with a
histogram of 4,096 hash buckets a source and a running sum within one bucket, so no task sees a
whole source.

Cases: a null text has size 0 and nothing is taken; null sources form one source, ordered last;
rows that repeat (id and size equal) share what falls on them evenly; an empty table gives an
empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BLANK, WORD, cut

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hex digits of the hash that name a bucket.
DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def source_weights(totals: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """totals with the weight of each source by its place among all sources. Places are counted
    within ranges and shifted, so the list of sources may be long."""
    ranged = cut(totals.repartitionByRange(F.col("_source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("_source").asc_nulls_last())) - 1 + F.col("_shift")
    values = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranged.join(shift, "_part").withColumn("_place", place)
    return ranked.select("_source", "_total", F.get(values, (F.col("_place") % len(weights)).cast("int")).alias("_weight"))


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """sources (_source, _total, _weight) with _target. One row of sums reaches the driver a round;
    a round clamps at least one more source, and the last clamps none."""
    cap = F.col("_total") * float(max_epochs)
    everything = sources.agg(F.sum("_total")).first()[0] or 0
    level, clamped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("_weight") * level > cap
        n, capped, weight = sources.agg(
            F.count(F.when(over, 1)), F.sum(F.when(over, F.col("_total"))), F.sum(F.when(~over, F.col("_weight")))
        ).first()
        if n == clamped or not weight:
            break
        clamped = n
        level = (everything - max_epochs * (capped or 0)) / weight
    level = 0.0 if level is None else level
    return sources.withColumn("_target", F.when(F.col("_weight") * level > cap, cap).otherwise(F.col("_weight") * level))


def mixture(sized: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """What each source gives, from rows of _source, _size and _key: _total, _target, _whole (times
    every document), _last and _last_size (where in the seeded order the rest ends) and _part
    (words of the row there)."""
    totals = sized.groupBy("_source").agg(F.sum("_size").alias("_total"))
    filled = water_fill(cut(source_weights(totals, weights)), max_epochs)
    whole = F.when(F.col("_total") > 0, F.floor(F.col("_target") / F.col("_total"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("_target") + 0.5).cast("long") - F.col("_whole") * F.col("_total")
    plan = cut(filled.withColumn("_whole", whole).withColumn("_rest", F.greatest(rest, F.lit(0))))

    bucket = F.substring("_key", 1, DIGITS)
    counted = sized.groupBy("_source", bucket.alias("_bucket")).agg(F.sum("_size").alias("_words"))
    running = Window.partitionBy("_source").orderBy("_bucket")
    reached = counted.withColumn("_sum", F.sum("_words").over(running)).alias("c").join(
        plan.alias("p"), F.col("c._source").eqNullSafe(F.col("p._source"))
    )
    at = reached.where("_rest > 0 AND _sum >= _rest AND _sum - _words < _rest").select(
        F.col("p._source").alias("_in"), "_bucket", (F.col("_rest") - F.col("_sum") + F.col("_words")).alias("_need")
    )
    rows = sized.join(at, F.col("_source").eqNullSafe(F.col("_in")) & (bucket == F.col("_bucket")))
    keys = rows.groupBy("_in", "_need", "_key", "_size").agg(F.count("*").alias("_rows"))
    row_order = Window.partitionBy("_in").orderBy("_key", "_size")
    ends = (
        keys.withColumn("_sum", F.sum(F.col("_size") * F.col("_rows")).over(row_order))
        .withColumn("_had", F.col("_sum") - F.col("_size") * F.col("_rows"))
        .where("_sum >= _need AND _had < _need")
        .select("_in", F.col("_key").alias("_last"), F.col("_size").alias("_last_size"), F.floor((F.col("_need") - F.col("_had")) / F.col("_rows")).alias("_part"))
    )
    return cut(
        plan.join(ends, F.col("_source").eqNullSafe(F.col("_in")), "left").select(
            F.col("_source").alias("_of"), "_total", "_target", "_whole", "_last", "_last_size", "_part"
        )
    )


def _extra() -> Column:
    """Words a row gives beyond the whole repetitions."""
    key, last, size = F.col("_key"), F.col("_last"), F.col("_size")
    before = (key < last) | ((key == last) & (size < F.col("_last_size")))
    here = (key == last) & (size == F.col("_last_size"))
    return F.when(before, size).when(here, F.col("_part")).otherwise(F.lit(0)).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, *keep: Column) -> DataFrame:
    return docs.select(
        *keep, F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_size"), order_key(F.col(id_col), seed).alias("_key")
    )


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Per document: its id, size, source_size, target (its source's) and taken, in words."""
    sized = cut(_sized(docs, id_col, text_col, source_col, seed, F.col(id_col).alias("_id")))
    shares = mixture(sized, weights, max_epochs)
    return sized.join(shares, F.col("_source").eqNullSafe(F.col("_of"))).select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_total").cast("long").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_whole") * F.col("_size") + _extra()).alias("taken"),
    )


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, in_part: bool = True) -> DataFrame:
    """The mixed corpus: the rows of docs, each as often as taken. The one document of a source
    that is taken in part keeps its first words, up to the number taken, as they stand; without
    ``in_part`` it is taken whole if at least half of it is wanted, and else left, so no text is
    ever cut and a source misses its target by half a document at most."""
    sized = cut(_sized(docs, id_col, text_col, source_col, seed))
    shares = mixture(sized, weights, max_epochs)
    # the whole row is one value, so its columns can't clash with those added here
    own = F.col("_doc").getField(text_col)
    rows = docs.select(F.struct("*").alias("_doc"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_size"), order_key(F.col(id_col), seed).alias("_key"))
    joined = rows.join(shares, F.col("_source").eqNullSafe(F.col("_of"))).withColumn("_more", _extra())
    # 0 stands for a copy in full, a positive number for that many words
    enough = F.col("_more") == F.col("_size") if in_part else 2 * F.col("_more") >= F.col("_size")
    again = (enough & (F.col("_size") > 0)).cast("long")
    full = F.array_repeat(F.lit(0).cast("long"), (F.col("_whole") + again).cast("int"))
    part = F.when((F.col("_more") > 0) & (F.col("_more") < F.col("_size")), F.array(F.col("_more"))).otherwise(F.array().cast("array<long>"))
    if not in_part:
        return joined.withColumn("_copy", F.explode(full)).select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
    copies = joined.withColumn("_words", F.explode(F.concat(full, part)))
    head = F.array_join(F.slice(F.regexp_extract_all(own, F.lit(rf"[{BLANK}]*{WORD}"), 0), 1, F.col("_words").cast("int")), "")
    text = F.when(F.col("_words") > 0, head).otherwise(own)
    changed = {text_col: text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_words") > 0, F.length(head).cast("long")).otherwise(F.col("_doc").getField("n_chars"))
    return copies.select(*[changed.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns])


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
sources AS (
  SELECT source, sum(size)::DOUBLE AS total,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, row_number() OVER o AS k, sum(total) OVER o AS capped, sum(w) OVER o AS gone,
         sum(total) OVER () AS everything, sum(w) OVER () AS weights
  FROM sources WINDOW o AS (ORDER BY total / w, source NULLS LAST)),
levels AS (
  SELECT k, (everything - 3 * (capped - total)) / (weights - (gone - w)) AS level, total, w FROM ordered),
water AS (SELECT min_by(level, k) AS level FROM levels WHERE level * w <= 3 * total),
plan AS (
  SELECT source, total, CASE WHEN w * level > 3 * total THEN 3 * total ELSE w * level END AS target
  FROM sources, water),
wanted AS (
  SELECT *, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END::BIGINT AS whole FROM plan),
running AS (
  SELECT s.doc_id, s.size, p.total, p.target, p.whole,
         floor(p.target + 0.5)::BIGINT - p.whole * p.total::BIGINT AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.size) AS upto
  FROM sized s JOIN wanted p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, total::BIGINT AS source_size, target,
       (whole * size + greatest(0, least(size, rest - (upto - size))))::BIGINT AS taken
FROM running
"""
