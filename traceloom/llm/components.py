"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``links (a, b)``, written; the label is the component's smallest node.

    Links of a node with itself and repeated ones count for nothing; a link with a null end is
    none; no links give no rows. Minima are partial aggregates and the joins may be split by skew handling, so a hub
    with many neighbours is no task of its own. Ends when a round changes nothing.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "cc")
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u")))
        further = materialize(small.distinct(), "cc")
        discard(edges)
        edges = further
    stars = edges.select(F.col("v").alias("node"), F.col("u").alias("label"))
    out = materialize(stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct()), "labels")
    discard(edges)
    return out
