"""Connected components of a table of links, by rounds of joins; nothing but a count goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """node and root (the smallest node of its component) for every node of edges(a, b); large star and small star in turn.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest among them; at the end each component
    is a star around its smallest node.  Rounds are written to the shared folder.  A hub costs its number of links, no more,
    and its links are not dealt to one task (base.spread_join).
    """
    now = base.cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), tag)
    last = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = base.cut(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), tag)
        large = base.cut(base.spread_join(both, low, ["a"], "n").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), tag)
        # now every link points down: a > b
        least = base.cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), tag)
        small = base.spread_join(large, least, ["a"], "n").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(least.select("a", F.col("m").alias("b")))
        now = base.cut(small.distinct(), tag)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
