"""Incidence of one column with another in long form, and what can be told from it with aggregates alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def incidence(df: DataFrame, block: str | list[str], treatment: str | list[str], by: Sequence[str] = ()) -> DataFrame:
    """b, t and n for every pair that occurs (in each slice, if by names columns); rows with a null in either are left out."""
    blocks, treatments = ([x] if isinstance(x, str) else list(x) for x in (block, treatment))
    rows = df.dropna(subset=[*blocks, *treatments])
    key = lambda cs: F.col(f"`{cs[0]}`").cast("string") if len(cs) == 1 else F.concat_ws(":", *(F.col(f"`{c}`").cast("string") for c in cs))
    return rows.select(*by, key(blocks).alias("b"), key(treatments).alias("t")).groupBy(*by, "b", "t").agg(F.count("*").alias("n"))


def cells(inc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (a slice): blocks, treatments, cells that occur, their smallest and largest count, rows, and the sum of squared counts."""
    return inc.groupBy(*by).agg(F.count_distinct("b").alias("n_b"), F.count_distinct("t").alias("n_t"), F.count("*").alias("filled"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("squares"))


def modal(inc: DataFrame, side: str, by: Sequence[str] = ()) -> DataFrame:
    """One row (a slice): the most frequent number of partners of a side (the smallest on a tie) and its share."""
    sizes = inc.groupBy(*by, side).agg(F.count("*").alias("size")).groupBy(*by, "size").agg(F.count("*").alias("m"))
    best = sizes.groupBy(*by).agg(F.max(F.struct("m", (-F.col("size")).alias("s"))).alias("x"), F.sum("m").alias("total"))
    return best.select(*by, (-F.col("x.s")).alias("mode"), (F.col("x.m") / F.col("total")).alias("share"))


def constant_within(df: DataFrame, units: dict[str, list[str]], cols: list[str]) -> DataFrame:
    """unit, groups and, for each column, whether it has one value (nulls left out) in every group: one pass with grouping sets."""
    names = sorted({c for u in units.values() for c in u})
    keyed = df.select(*(F.col(f"`{c}`") for c in names), *(F.col(f"`{c}`").alias(f"v|{c}") for c in cols if c not in names), *(F.col(f"`{c}`").alias(f"v|{c}") for c in cols if c in names))
    sets = [[F.col(f"`{c}`") for c in u] for u in units.values()]
    grouped = keyed.groupingSets(sets, *(F.col(f"`{c}`") for c in names)).agg(F.grouping_id().alias("__gid"), *(F.min(f"v|{c}").eqNullSafe(F.max(f"v|{c}")).alias(f"c|{c}") for c in cols))
    gid = {sum(0 if c in u else 1 << (len(names) - 1 - i) for i, c in enumerate(names)): k for k, u in units.items()}
    unit = F.lit(None).cast("string")
    for g, k in gid.items():
        unit = F.when(F.col("__gid") == g, F.lit(k)).otherwise(unit)
    return grouped.withColumn("unit", unit).groupBy("unit").agg(F.count("*").alias("groups"), *(F.bool_and(f"`c|{c}`").alias(c) for c in cols))


def components(edges: DataFrame, a: str = "b", b: str = "t") -> DataFrame:
    """node (with its side) and component (the smallest node in it) of a bipartite graph, by rounds of smallest labels.

    Each round is a written table in the shared folder.
    """
    from ..sources.scratch import cut

    links = edges.select(F.concat(F.lit("b:"), F.col(a)).alias("x"), F.concat(F.lit("t:"), F.col(b)).alias("y")).distinct()
    both = cut(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))), "links")
    label = both.select(F.col("x").alias("node"), F.col("x").alias("component")).distinct()
    last = None
    while True:
        near = both.join(label, F.col("y") == F.col("node")).groupBy("x").agg(F.min("component").alias("m"))
        label = cut(label.join(near, F.col("node") == F.col("x")).select("node", F.least("component", "m").alias("component")), "labels")
        # then to the label's own label: paths halve with every round
        up = label.select(F.col("node").alias("component"), F.col("component").alias("up"))
        label = cut(label.join(up, "component").select("node", F.least("component", "up").alias("component")), "labels")
        now = label.agg(F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first()[0]
        if now == last:
            return label
        last = now
