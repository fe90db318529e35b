"""Row permutations: the k-th row in one hash order gets the value of the k-th in another, among rows that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from .ranking import hash_index


def permuted(df: DataFrame, col: str | list[str], rid: str, seed: str, stream: str | None = None, strata: list[str] | None = None) -> DataFrame:
    """rid and the columns' permuted values, for the rows where the first column has a value."""
    cols = [col] if isinstance(col, str) else list(col)
    stream, strata = stream or cols[0], strata or []
    held = df.where(F.col(f"`{cols[0]}`").isNotNull()).select(F.col(f"`{rid}`").alias("__moved"), *(F.col(f"`{c}`") for c in strata), *(F.col(f"`{c}`").alias(f"__v{i}") for i, c in enumerate(cols)))
    to = hash_index(held.select("__moved", *strata), rng.digest(seed, f"permute-to:{stream}", F.col("__moved")), "__k", strata, ["__moved"])
    # the ids are not carried to break ties: equal digests are of equal ids
    source = hash_index(held, rng.digest(seed, f"permute-from:{stream}", F.col("__moved")), "__k", strata, without=["__moved"])
    on = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in strata] + [F.col("l.__k") == F.col("r.__k")]
    return to.alias("l").join(source.alias("r"), on).select(F.col("__moved").alias(rid), *(F.col(f"__v{i}").alias(c) for i, c in enumerate(cols)))


def permute_rows(df: DataFrame, col: str | list[str], rid: str, seed: str, stream: str | None = None, strata: list[str] | None = None) -> DataFrame:
    """df with col permuted within strata; nulls stay in place, so the null pattern and all frequencies are kept.

    Several columns move together, over the rows where the first has a value.
    """
    return replaced(df, permuted(df, col, rid, seed, stream, strata), rid)


def replaced(df: DataFrame, new: DataFrame, rid: str) -> DataFrame:
    """df with new's columns in place of its own, matched on rid; rows that new doesn't have get nulls there."""
    cols = [c for c in new.columns if c != rid]
    table = new.select(F.col(f"`{rid}`").alias("__new_rid"), *(F.col(f"`{c}`").alias(f"__new_{c}") for c in cols))
    joined = df.join(table, F.col(f"`{rid}`") == F.col("__new_rid"), "left")
    return joined.select(*(F.col(f"`__new_{c}`").alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns))
