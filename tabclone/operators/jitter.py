"""Resolution of numeric columns and jitter within it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rng
from .ranking import bounds, bucket_of


def smallest_gap(df: DataFrame, col: str) -> DataFrame:
    """One row: gap, the least positive distance of neighbouring distinct values (null if there is none), and whole, low, high, n."""
    x = F.col(f"`{col}`").cast("double")
    values = df.select(x.alias("x")).where("x IS NOT NULL").distinct()
    placed = values.withColumn("b", bucket_of(F.col("x"), bounds(df, col)))
    inner = placed.withColumn("next", F.lead("x").over(Window.partitionBy("b").orderBy("x")))
    parts = inner.groupBy("b").agg(F.min(F.col("next") - F.col("x")).alias("gap"), F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"), F.bool_and(F.col("x") == F.floor("x")).alias("whole"))
    # at most as many rows as buckets
    edge = parts.withColumn("step", F.lead("low").over(Window.orderBy("b")) - F.col("high"))
    return edge.agg(F.min(F.least("gap", "step")).alias("gap"), F.bool_and("whole").alias("whole"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))


def resolution(df: DataFrame, col: str) -> DataFrame:
    """One row: 0 for at most one distinct value, 1 for whole values, else the smallest gap, but not under a 1e-8th of the range."""
    r = smallest_gap(df, col)
    rule = F.when(F.coalesce(F.col("n"), F.lit(0)) <= 1, F.lit(0.0)).when(F.col("whole"), F.lit(1.0)).otherwise(F.greatest(F.col("gap"), (F.col("high") - F.col("low")) * 1e-8))
    return r.select(rule.alias("resolution"), F.coalesce("n", F.lit(0)).alias("n_distinct"), "whole")


def jitter(df: DataFrame, col: str, rid: str, seed: str, measure: DataFrame, low: float | None = None) -> DataFrame:
    """df with col moved by up to half the resolution of measure's column; whole values are rounded up or down by chance."""
    r = F.broadcast(resolution(measure, col).select(F.col("resolution").alias("__res"), F.col("n_distinct").alias("__n"), F.col("whole").alias("__whole")))
    x, u, v = F.col(f"`{col}`").cast("double"), rng.uniform(seed, f"jitter:{col}", F.col(f"`{rid}`")), rng.uniform(seed, f"round:{col}", F.col(f"`{rid}`"))
    moved = x + (u - 0.5) * F.col("__res")
    if low is not None:
        moved = F.greatest(F.lit(low), moved)
    moved = F.when(F.col("__whole"), F.floor(moved) + F.when(v < moved - F.floor(moved), 1).otherwise(0)).otherwise(moved)
    done = F.when(F.col("__n") <= 2, x).otherwise(moved).cast(df.schema[col].dataType)
    return df.crossJoin(r).select(*((done.alias(c) if c == col else F.col(f"`{c}`")) for c in df.columns))


def stochastic_round(df: DataFrame, col: str, rid: str, seed: str) -> DataFrame:
    x, v = F.col(f"`{col}`").cast("double"), rng.uniform(seed, f"round:{col}", F.col(f"`{rid}`"))
    return df.withColumn(col, F.floor(x) + F.when(v < x - F.floor(x), 1).otherwise(0))
