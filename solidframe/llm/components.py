"""Connected components with DataFrame operations only.

Alternating large-star and small-star steps: in a large-star step every node ties its larger neighbours to
the smallest node it knows, in a small-star step itself and its smaller neighbours. The edges shrink to
stars around the smallest node of each component in about log(n) rounds. Each round is one job of
grouped minima and joins; its edges are written to the shared folder, so lineage stays short and a lost
executor costs at most one round; what a round has written goes once the next one is. The minima are pre-aggregated before they are shuffled and written, so that
the joins have plain exchanges on both sides and adaptive skew handling splits a hub's edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, release


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum((F.xxhash64("a", "b") % 1000003).cast("long"))).first())


def _round(edges: DataFrame) -> DataFrame:
    """The edges after both steps, written."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    large = both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    # now a > b in every edge
    large = materialize(large)
    smaller = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
    small = large.join(smaller, "a")
    own = smaller.select("a", F.col("m").alias("b"))
    others = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = materialize(own.unionByName(others).distinct())
    release(least, large, smaller)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its smallest node.

    Edges with a null end and loops tie nothing; repeated edges count once; no edges give no rows.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    while before[0]:
        last, edges = edges, _round(edges)
        release(last)
        after = _state(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
