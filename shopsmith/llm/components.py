"""Connected components of a link table by alternating star operations (large star, small
star): every round is two grouped minima and joins, rounds grow with the logarithm of a
component's size, and no component is ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _star(links: DataFrame, small: bool) -> DataFrame:
    """``links`` (a, b).  Connect a node's neighbours to the least of them and itself:
    the larger neighbours (large star), or the smaller ones and itself (small star)."""
    if small:
        near = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = near.join(least, "u")
    if small:
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that is not the least of its component.

    ``links`` has two columns of one orderable type; self links and repeats are fine, nulls
    are ignored, no links give no rows.
    """
    a, b = links.columns
    now = stage(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "links")
    mark = None
    while True:
        now = stage(_star(_star(now, small=False), small=True), "links")
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()  # two numbers
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
