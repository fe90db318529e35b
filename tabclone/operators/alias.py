"""Opaque aliases and label permutations: bijections from hash order, kept as two-column tables and joined, never inlined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import UnmappedValue  # type: ignore[attr-defined]
from ..functions import rng
from ..functions.kinds import LEVELS
from .ranking import hash_index


def levels(df: DataFrame, col: str) -> DataFrame:
    """The values of col; of a factor also the levels that no row has."""
    seen = df.select(F.col(f"`{col}`").alias("original")).where("original IS NOT NULL")
    if own := df.schema[col].metadata.get(LEVELS):
        seen = seen.unionByName(df.sparkSession.createDataFrame([(x,) for x in own], "original string"))
    return seen.distinct()


def alias_map(values: DataFrame, prefix: str, seed: str, stream: str) -> DataFrame:
    """original and alias for a table of distinct originals; the numbers have at least three digits."""
    placed = hash_index(values, rng.digest(seed, f"alias:{stream}", F.col("original")), "pos")
    width = placed.agg(F.greatest(F.lit(3), F.length(F.max("pos").cast("string"))).alias("width"))
    return placed.crossJoin(F.broadcast(width)).select("original", F.concat(F.lit(prefix), F.lpad(F.col("pos").cast("string"), F.col("width"), F.lit("0"))).alias("alias"))


def permuted_map(values: DataFrame, seed: str, stream: str) -> DataFrame:
    """original and alias, where the aliases are the originals in another order."""
    a = hash_index(values, rng.digest(seed, f"labels-from:{stream}", F.col("original")), "pos")
    b = hash_index(values, rng.digest(seed, f"labels-to:{stream}", F.col("original")), "pos")
    return a.join(b.withColumnRenamed("original", "alias"), "pos").select("original", "alias")


def translate(df: DataFrame, col: str, mapping: DataFrame, source: str = "original", target: str = "alias") -> DataFrame:
    """df with col translated; an unknown value fails when the column is computed.  Spark broadcasts maps under its size limit."""
    m = mapping.select(F.col(source).alias("__from"), F.col(target).alias("__to"))
    x = F.col(f"`{col}`")
    safe = F.when(x.isNotNull() & F.col("__to").isNull(), F.raise_error(F.lit(f"a value of column {col} is not in its map"))).otherwise(F.col("__to"))
    return df.join(m, x == F.col("__from"), "left").select(*((safe.alias(c) if c == col else F.col(f"`{c}`")) for c in df.columns))


def check(df: DataFrame, col: str, mapping: DataFrame, source: str = "original") -> None:
    """Raises on values of col that the map doesn't have, naming at most five."""
    have = levels(df, col).join(mapping.select(F.col(source).alias("original")), "original", "left_anti")
    if bad := [r[0] for r in have.orderBy("original").limit(5).collect()]:
        raise UnmappedValue(f"column {col} has values that aren't in its map: {bad}", bad)


def alias_names(columns: list[str], chosen: bool | list[str]) -> dict[str, str]:
    """New names by position among the columns: col_001 and so on, for all or the chosen."""
    width = max(3, len(str(len(columns))))
    return {c: f"col_{i:0{width}d}" for i, c in enumerate(columns, 1) if chosen is True or (chosen and c in chosen)}
