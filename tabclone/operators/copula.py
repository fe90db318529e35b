"""Gaussian-copula resimulation of numeric columns, over the whole table or within strata.

Ranks give normal scores; their correlations (pairwise complete, brought to the nearest valid matrix) shape new normal draws;
each draw becomes the observed value at its quantile.  Only p x p matrices leave the executors' aggregates, and those stay a table:
factorising runs on its rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rng
from ..functions.special import pnorm, qnorm
from .ranking import average_rank, value_table

#: Positions of a block of the order table, and blocks that one of its rows may be spread over at once.
BLOCK, SPREAD = 32, 65_536
_WHOLE = "__all"


def nearest_correlation(m: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The nearest correlation matrix by alternating projections; m as it is, if it is well positive definite."""
    m = (m + m.T) / 2
    if np.linalg.eigvalsh(m)[0] >= np.sqrt(np.finfo(float).eps):
        return m
    y, s = m.copy(), np.zeros_like(m)
    for _ in range(rounds):
        r = y - s
        w, v = np.linalg.eigh(r)
        x = (v * np.maximum(w, 1e-7 * w[-1])) @ v.T
        s, y = x - r, x.copy()
        np.fill_diagonal(y, 1.0)
        if np.abs(y - x).max() < 1e-10:
            break
    return y


def factor(cov: list[float | None], p: int) -> list[float]:
    """The lower Cholesky factor of the correlations in a flat covariance matrix; a column without variance stands alone."""
    m = np.array([0.0 if c is None or not np.isfinite(c) else c for c in cov], float).reshape(p, p)
    sd = np.sqrt(np.diag(m))
    flat = sd < 1e-12
    sd[flat] = 1.0
    m = m / np.outer(sd, sd)
    m[flat], m[:, flat] = 0.0, 0.0
    np.fill_diagonal(m, 1.0)
    m = nearest_correlation(np.round(np.clip(m, -1, 1), 10))
    try:
        low = np.linalg.cholesky(m)
    except np.linalg.LinAlgError:
        low = np.linalg.cholesky(m + 1e-6 * np.eye(p))
    return [float(x) for x in low.ravel()]


def normal_scores(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """df with z_<col>: the normal score of each value's average rank (within by)."""
    own = df
    for c in cols:  # every table comes from the rows as they were, so the plan grows by one join a column
        df = average_rank(df, c, f"__u_{c}", by, own)
    return df.select(*own.columns, *(F.expr(qnorm(f"`__u_{c}`")).alias(f"z_{c}") for c in cols))


def score_covariance(scores: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """For each group: cov, the flat matrix of pairwise-complete covariances."""
    pairs = [F.covar_samp(F.when(F.col(f"`z_{b}`").isNotNull(), F.col(f"`z_{a}`")), F.when(F.col(f"`z_{a}`").isNotNull(), F.col(f"`z_{b}`"))) for a in cols for b in cols]
    return scores.groupBy(*by).agg(F.array(*pairs).alias("cov"))


def _factors(cov: DataFrame, by: list[str], p: int) -> DataFrame:
    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[by].assign(low=[factor(list(c), p) for c in part["cov"]])

    fields = [cov.schema[c] for c in by] + [T.StructField("low", T.ArrayType(T.DoubleType()))]
    return cov.mapInPandas(run, T.StructType(fields))


def order_table(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """by, __block, __first, __last and __value: each observed value in every block of BLOCK positions that its own, from first to last, reach into.

    A value that many rows share is spread in steps.  There are no more rows than values and blocks together, so than positions.
    """
    table = value_table(df, col, by).withColumns({"__low": F.expr(f"__first div {BLOCK}"), "__high": F.expr(f"__last div {BLOCK}")})
    steps = table.select(*by, F.col(f"`{col}`").alias("__value"), "__first", "__last", "__high", F.explode(F.sequence("__low", "__high", F.lit(SPREAD))).alias("__from"))
    return steps.select(*by, "__value", "__first", "__last", F.explode(F.sequence("__from", F.least(F.col("__high"), F.col("__from") + SPREAD - 1))).alias("__block"))


def resimulate(df: DataFrame, cols: list[str], rid: str, seed: str, stream: str = "copula", by: list[str] | None = None) -> DataFrame:
    """df with cols drawn anew from their joint distribution (within by), null where they were null."""
    if not cols:
        return df
    whole = not by
    names = df.columns
    own = df.withColumn(_WHOLE, F.lit(1)) if whole else df
    by = [_WHOLE] if whole else list(by)
    draws = {c: rng.uniform(seed, f"{stream}:{c}", F.col(f"`{rid}`")) for c in cols}
    if len(cols) == 1:
        new = own.withColumn(f"__n_{cols[0]}", draws[cols[0]])
    else:
        low = _factors(score_covariance(normal_scores(own, cols, by), cols, by), by, len(cols))
        on = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in by]
        e = own.withColumns({f"__u_{c}": d for c, d in draws.items()})
        e = e.select(*own.columns, *(F.expr(qnorm(f"`__u_{c}`")).alias(f"__e_{c}") for c in cols))
        e = e.alias("l").join(low.alias("r"), on).select(*(F.col(f"l.`{c}`") for c in e.columns), "low")
        z = e.select(*own.columns, *(F.expr(" + ".join(f"low[{i * len(cols) + j}] * `__e_{b}`" for j, b in enumerate(cols[: i + 1]))).alias(f"__z_{c}") for i, c in enumerate(cols)))
        new = z.select(*own.columns, *(F.expr(pnorm(f"`__z_{c}`")).alias(f"__n_{c}") for c in cols))
    for c in cols:
        totals = own.where(F.col(f"`{c}`").isNotNull()).groupBy(*by).agg(F.count("*").alias("__total"))
        on = [F.col(f"l.`{x}`").eqNullSafe(F.col(f"r.`{x}`")) for x in by]
        new = new.alias("l").join(totals.alias("r"), on, "left").select(*(F.col(f"l.`{x}`") for x in new.columns), "__total")
        at = F.greatest(F.lit(1), F.ceil(F.col("__total") * F.col(f"`__n_{c}`") - 4 * 2.220446049250313e-16))
        new = new.withColumn("__at", F.when(F.col(f"`{c}`").isNotNull(), F.least(at, F.col("__total"))))
        kept = [x for x in new.columns if x not in ("__total", "__at")]
        new = new.withColumn("__block", F.expr(f"__at div {BLOCK}"))
        on += [F.col("l.__block") == F.col("r.__block"), F.col("l.__at").between(F.col("r.__first"), F.col("r.__last"))]
        # Spark's sizes know nothing of the rows that explode adds, and would have the driver collect and broadcast them
        values = order_table(own, c, by).hint("merge")
        new = new.alias("l").join(values.alias("r"), on, "left").select(*(F.col("__value").alias(c) if x == c else F.col(f"l.`{x}`") for x in kept))
    return new.select(*(F.col(f"`{c}`") for c in names))


def strata(df: DataFrame, cols: list[str], least: int = 5, into: str = "__stratum") -> DataFrame:
    """df with the stratum of its conditioning columns (a null is a label of its own); strata under least rows are one fallback."""
    key = F.concat_ws("\r", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in cols)) if cols else F.lit("all")
    keyed = df.withColumn(into, key)
    small = keyed.groupBy(into).count().where(F.col("count") < least).select(F.col(into).alias("__small"))
    joined = keyed.join(small, F.col(into) == F.col("__small"), "left")
    return joined.withColumn(into, F.when(F.col("__small").isNotNull(), F.lit("\0fallback")).otherwise(F.col(into))).drop("__small")
