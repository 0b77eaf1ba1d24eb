"""Mixing sources to target weights with DataFrame operations only.

Sizes are summed per source, targets follow from the weights, and each document is emitted floor(rate) times plus one
hash-seeded Bernoulli copy with probability equal to the fraction, where rate = target / source size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._stage import saved

#: Characters between words (fixed values): blank and 0x09-0x0D.
BLANKS = "\t\n\x0b\f\r"


def n_words(text: Column) -> Column:
    """The number of runs of characters other than blanks; null counts as 0."""
    flat = F.translate(text, BLANKS, " " * len(BLANKS))
    return F.coalesce(F.size(F.array_remove(F.split(flat, " "), "")), F.lit(0)).cast("long")


def draw(*columns: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) that depends on the columns and the seed alone: 52 bits of an md5."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from one row per document with source and size.

    Sources in code point order, null last, take the weights in turn. Together they get share times all sizes; a target
    stops at most times its source's size, and the excess is shared anew by weight until none is above. That end state
    gives every source min(cap, level * weight): with sources sorted by cap / weight, the level follows from running sums.
    Only the per-source sums, aggregated before the shuffle, reach the ordering windows, which are one task: one short row
    a source, so a million sources are some 50 MB there.
    """
    summed = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = summed.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    full = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - full) / left
    leveled = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    leveled = leveled.withColumn("place", F.row_number().over(order))
    final = F.min(F.when(F.col("open"), F.struct("place", "level"))).over(every)["level"]
    target = F.when(final.isNull(), F.col("cap")).otherwise(F.least("cap", final * F.col("weight")))
    return leveled.select("source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """doc_id, source, size (words), source_size, target, copies and taken (size * copies) of every row.

    Each text is read once for its size and its draw; sizes and ids, not texts, go on. Null and empty texts have size 0; a
    null source is a source of its own. A row draws by its id and text, so rows without an id draw apart; rows that repeat
    both draw alike; reruns agree. A source without words gets target 0 and no copies. Other columns are ignored.
    """
    sizes = saved(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _draw(seed).alias("draw")), "mix-sizes")
    targets = saved(source_targets(sizes, weights, share, most), "mix-targets")
    return _planned(sizes, targets, most).drop("draw")


def _draw(seed: str) -> Column:
    return draw(F.col("doc_id"), F.md5("text"), seed=seed)


def _planned(rows: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """rows (source, draw) with source_size, target and copies. The targets are joined by broadcast while their file is small, else by a join that splits hot sources."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    named = targets.select(key.alias("_source"), "source_size", "target")
    joined = rows.withColumn("_source", key).join(named, "_source").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(F.col("draw") < rate - F.floor(rate), 1).otherwise(0)
    planned = joined.withColumn("copies", copies.cast("long"))
    return planned.withColumn("taken", F.col("size") * F.col("copies")) if "size" in rows.columns else planned


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mix itself: every row of docs, all columns, as many times as the plan says."""
    sizes = saved(docs.select("source", n_words(F.col("text")).alias("size")), "mix-sizes")
    targets = saved(source_targets(sizes, weights, share, most), "mix-targets")
    packed = docs.select("source", _draw(seed).alias("draw"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    emitted = _planned(packed, targets, most).where("copies > 0")
    return emitted.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
