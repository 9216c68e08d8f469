"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

Every source has a size (words) and a weight. The mix has ``total`` times all sizes; sources get it in
proportion to their weights, none more than ``max_epochs`` times its size. With sources sorted by size over
weight, those before the first one that its proportional share of the remainder doesn't fill are clamped,
and the rest share what is left by weight: the fixed point of clamping and resharing, found by one prefix
sum over the sources.

A source with target t and size s is repeated floor(t / s) times whole; of the rest, documents follow in the
order of a seeded hash until the words are reached, the last one in part (``fraction_words``). To find where
that order ends, words are summed by (source, slot of the hash), pre-aggregated, and summed up over the
slots; only the one slot where the words run out is ordered document by document. So a source with a third
of all rows is never sorted by one task. Reruns with the same seed agree.

Cases: null texts have no words and are taken 0 times; null source is a source of its own, last in order;
sources without words have target 0; equal rows have one hash, and share what is left for them in row order
of equal rows, so that results agree; empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, word_count

SLOTS = 4096


def targets(sizes: DataFrame, weights: Sequence[float], total: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size); weights repeat over sources in code point order, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    named = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    live = F.col("source_size") > 0
    filled = Window.orderBy((max_epochs * F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    wide = named.select(
        "*",
        (F.sum("source_size").over(every) * total).alias("_total"),
        F.coalesce(F.sum(max_epochs * F.col("source_size")).over(before), F.lit(0.0)).alias("_capped"),
        F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)).alias("_weights"),
    )
    # the first source that isn't clamped has the highest level of those that could be
    level = (F.col("_total") - F.col("_capped")) / F.col("_weights")
    wide = wide.withColumn("_level", F.when(level * F.col("weight") <= max_epochs * F.col("source_size"), level))
    share = F.max("_level").over(every) * F.col("weight")
    return wide.select("source", "source_size", F.when(live, F.least(max_epochs * F.col("source_size"), F.coalesce(share, max_epochs * F.col("source_size")))).otherwise(0.0).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), total: float = 1.5, max_epochs: float = 2.0, seed: int = 0, broadcast_rows: int = 100_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): size, source_size, target, repeats (whole ones),
    fraction_words (words of one more, partial repetition) and taken (words in all)."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    hashed = sized.withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "source", "size"))
    rows = materialize(hashed.withColumn("_slot", F.shiftrightunsigned("_hash", 52).cast("int")))
    slots = rows.groupBy("source", "_slot").agg(F.sum("size").alias("words"))
    sizes = slots.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = targets(sizes, weights, total, max_epochs)
    plan = plan.withColumn("repeats", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    plan = plan.withColumn("_rest", F.round(F.col("target") - F.col("repeats") * F.col("source_size")).cast("long"))
    up_to = Window.partitionBy("source").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    ends = slots.withColumn("_before", F.coalesce(F.sum("words").over(up_to), F.lit(0)))
    named = lambda df, name: df.withColumnRenamed("source", name)
    ends = ends.join(named(plan.select("source", "_rest"), "_of"), F.col("source").eqNullSafe(F.col("_of")))
    ends = ends.filter((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("words")))
    ends = ends.select(F.col("source").alias("_in"), F.col("_slot").alias("_end"), (F.col("_rest") - F.col("_before")).alias("_left"))
    plan = materialize(named(plan, "_source").join(ends, F.col("_source").eqNullSafe(F.col("_in")), "left").select("_source", "source_size", "target", "repeats", "_rest", "_end", "_left"))
    plan = F.broadcast(plan) if plan.count() <= broadcast_rows else plan
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    in_order = Window.partitionBy("source").orderBy("_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = joined.filter(F.col("_slot") == F.col("_end"))
    last = last.withColumn("_more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - F.coalesce(F.sum("size").over(in_order), F.lit(0)))))
    # without an end every slot is taken, or with nothing to take none
    others = joined.filter(~F.coalesce(F.col("_slot") == F.col("_end"), F.lit(False)))
    others = others.withColumn("_more", F.when((F.col("_slot") < F.col("_end")) | (F.col("_end").isNull() & (F.col("_rest") > 0)), F.col("size")).otherwise(F.lit(0)))
    out = last.unionByName(others)
    whole = F.col("repeats") + F.when((F.col("_more") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)
    part = F.when(F.col("_more") < F.col("size"), F.col("_more")).otherwise(0)
    return out.select(
        "doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, whole).otherwise(0).cast("long").alias("repeats"), part.cast("long").alias("fraction_words"), (F.col("repeats") * F.col("size") + F.col("_more")).cast("long").alias("taken")
    )
