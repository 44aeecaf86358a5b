"""Connected components of a table of links, by alternating large and small stars.

Every step is a join and a grouped minimum; the number of steps grows with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """One row per node of `links` (a, b): node and label, the smallest node of its component. Written."""
    pairs = written(
        links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars"
    )
    state = _state(pairs)
    while True:
        # Large star: each node gives its larger neighbours the smallest node around it.
        around = pairs.select(F.col("u").alias("x"), F.col("v").alias("y")).union(pairs.select("v", "u"))
        least = around.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = around.join(least, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        # Small star: each node and its smaller neighbours go to the smallest of them.
        small = large.groupBy("x").agg(F.min("y").alias("m"))
        moved = large.join(small, "x").filter("y != m").select(F.col("y").alias("u"), F.col("m").alias("v"))
        after = written(moved.union(small.select("x", "m")).distinct(), "stars")
        forget(pairs)
        pairs, before, state = after, state, _state(after)
        if state == before:
            break
    labels = pairs.select(F.col("u").alias("node"), F.col("v").alias("label"))
    labels = written(labels.union(pairs.select("v", "v")).distinct(), "labels")
    forget(pairs)
    return labels
