"""Passes over a table that give every column's profile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import kinds
from ..functions.patterns import CATEGORICAL, DATES, NUMERIC


@dataclass(frozen=True)
class Profile:
    col: str
    kind: str
    n: int
    missing: int
    distinct: int | None  # of labels only: nothing asks for that of numbers and dates
    low: object = None
    high: object = None
    whole: bool = False
    top_share: float = 0.0

    def summary(self) -> str:
        if self.kind in NUMERIC:
            return "[all NA]" if self.low is None else f"[{self.low:g}, {self.high:g}]"
        if self.kind in DATES:
            return "[all NA]" if self.low is None else f"[{self.low}, {self.high}]"
        return {"factor": f"n={self.distinct} levels", "character": f"n={self.distinct} unique", "logical": f"n={self.distinct} values"}.get(self.kind, "other")


def _asked(c: str, kind: str) -> list[Column]:
    x = F.col(f"`{c}`")
    out = [F.count(x).alias(f"n|{c}")]
    if kind in NUMERIC + DATES:
        out += [F.min(x).alias(f"lo|{c}"), F.max(x).alias(f"hi|{c}")]
    if kind in NUMERIC:
        out.append(F.coalesce(F.bool_and(x == F.floor(x.cast("double"))), F.lit(False)).alias(f"w|{c}"))
    return out


def label_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """The number of distinct labels of each column.  Rows are dealt out first: a task keeps the labels of its rows, and a file may be one task."""
    if not cols:
        return {}
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(*(F.col(f"`{c}`") for c in cols), F.monotonically_increasing_id().alias("__row")).repartition(tasks, "__row")
    return dealt.agg(*(F.count_distinct(F.col(f"`{c}`")).alias(c) for c in cols)).first().asDict()


def profile(df: DataFrame) -> list[Profile]:
    """A driver-side profile for each column: two rows come back, whatever the table's size."""
    own = kinds(df)
    row = df.agg(F.count(F.lit(1)).alias("n"), *(a for c, k in own.items() for a in _asked(c, k))).first().asDict()
    labels = label_counts(df, [c for c, k in own.items() if k in CATEGORICAL])
    out = []
    for c, k in own.items():
        low, high = row.get(f"lo|{c}"), row.get(f"hi|{c}")
        if k == "numeric" and low is not None:
            low, high = float(low), float(high)
        out.append(Profile(c, k, row["n"], row["n"] - row[f"n|{c}"], labels.get(c), low, high, bool(row.get(f"w|{c}"))))
    return out


def profile_frame(df: DataFrame) -> DataFrame:
    """The counts as a table: col, kind, n, n_null, n_distinct."""
    own = {c: k for c, k in kinds(df).items() if k != "other"}
    wide = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.col(f"`{c}`")).alias(f"n|{c}") for c in own), *(F.count_distinct(F.col(f"`{c}`")).alias(f"d|{c}") for c in own))
    rows = F.array(*(F.struct(F.lit(c).alias("col"), F.lit(k).alias("kind"), F.col("n"), (F.col("n") - F.col(f"`n|{c}`")).alias("n_null"), F.col(f"`d|{c}`").alias("n_distinct")) for c, k in own.items()))
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def coordinate_shaped(df: DataFrame) -> list[str]:
    """Numeric columns whose values look like coordinates, if there are at least two."""
    cols = [c for c, k in kinds(df).items() if k == "numeric"]
    if not cols:
        return []
    asked = []
    for c in cols:
        x = F.col(f"`{c}`").cast("double")
        fine = F.abs(x * 1000 - F.rint(x * 1000)) > 1e-6  # a fourth decimal
        asked += [F.count_distinct(x).alias(f"d|{c}"), F.count(x).alias(f"n|{c}"), F.max(F.abs(x)).alias(f"m|{c}"), F.bool_and(x == F.rint(x)).alias(f"w|{c}"), F.bool_or(fine).alias(f"f|{c}")]
    r = df.agg(*asked).first()
    hits = [c for c in cols if r[f"n|{c}"] >= 3 and r[f"d|{c}"] >= 3 and not r[f"w|{c}"] and 1 < r[f"m|{c}"] <= 180 and r[f"f|{c}"]]
    return hits if len(hits) >= 2 else []
