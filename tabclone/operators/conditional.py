"""Conditioning: the ladder of design columns, the variance they explain, and shifts for what is dropped from the strata."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConditionalDegraded, warn  # type: ignore[attr-defined]
from ..functions.patterns import LADDER_COORDINATE, LADDER_ENVIRONMENT, matches
from ..sources.scratch import cut

LEAST = 5
#: Effects that are solved as one matrix on the driver; more are solved by rounds over the written pairs, at most so many.
DENSE, ROUNDS = 2000, 500


@dataclass(frozen=True)
class Ladder:
    used: tuple[str, ...]
    dropped: tuple[str, ...]
    shifted: tuple[str, ...]
    fallback: float


def variance_explained(df: DataFrame, group: str, values: list[str]) -> DataFrame:
    """col and eta2: the adjusted share of each column's variance between groups, not under 0; from sums by group."""
    g = F.col(f"`{group}`").cast("string")
    long = df.select(g.alias("g"), F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("double").alias("y")) for c in values))).alias("s")).select("g", "s.*").where("g IS NOT NULL AND y IS NOT NULL")
    by = long.groupBy("col", "g").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    all_ = by.groupBy("col").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"))
    total, between = F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.col("between") - F.col("s") * F.col("s") / F.col("n")
    adjusted = 1 - (1 - between / total) * (F.col("n") - 1) / (F.col("n") - F.col("k"))
    ok = (F.col("n") >= 3) & (total > 0) & (F.col("k") < F.col("n"))
    return all_.select("col", F.when(ok, F.greatest(F.lit(0.0), adjusted)).otherwise(0.0).alias("eta2"))


def fallback_shares(df: DataFrame, rungs: list[list[str]], least: int = LEAST) -> list[float]:
    """The share of rows in strata under least rows, for each set of columns: one pass with grouping sets."""
    names = list(dict.fromkeys(c for r in rungs for c in r))
    keyed = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")).alias(f"k{i}") for i, c in enumerate(names)))
    keys = [f"k{i}" for i in range(len(names))]
    if not names:
        n = df.count()
        return [0.0 if n >= least else 1.0 for _ in rungs]
    sets = [[F.col(f"k{names.index(c)}") for c in r] for r in rungs]
    cells = keyed.groupingSets(sets, *(F.col(k) for k in keys)).agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))
    shares = {r["gid"]: r["f"] for r in cells.groupBy("gid").agg((F.sum(F.when(F.col("n") < least, F.col("n")).otherwise(0)) / F.sum("n")).alias("f")).collect()}
    return [shares.get(sum(0 if c in r else 1 << (len(names) - 1 - i) for i, c in enumerate(names)), 0.0) for r in rungs]


def ladder(df: DataFrame, cols: list[str], protect: list[str], values: list[str], kind: str = "hierarchy", least: int = LEAST) -> Ladder:
    """Drops design columns, never treatments, until no stratum is under least rows.

    "levels": the column of most levels first; "hierarchy": coordinates, then blocks, then environments.
    """
    protect = [c for c in cols if c in protect]
    free = [c for c in cols if c not in protect]
    if len(free) > 1:
        r = df.agg(*(F.count_distinct(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0"))).alias(c) for c in free)).first()
        if kind == "levels":
            free.sort(key=lambda c: -r[c])
        else:
            tier = {c: 1 if matches(c, LADDER_COORDINATE) else 3 if matches(c, LADDER_ENVIRONMENT) else 2 for c in free}
            eta = {c: np.mean([x["eta2"] for x in variance_explained(df, c, values).collect()] or [0.0]) if values else 0.0 for c in free}
            free.sort(key=lambda c: (tier[c], -r[c] if tier[c] == 1 else eta[c]))
    rungs = [[c for c in cols if c in protect or c in free[k:]] for k in range(len(free) + 1)]
    shares = fallback_shares(df, rungs, least)
    k = next((i for i, s in enumerate(shares) if s <= 0), len(rungs) - 1)
    used, dropped = rungs[k], [c for c in free[:k]]
    shifted: list[str] = []
    if kind == "hierarchy":
        single = dropped + (used if shares[k] > 0 else [])
        plain = [c for c in dropped if not matches(c, LADDER_COORDINATE)]
        shifted = single + [":".join(p) for p in combinations(plain, 2)]
    return Ladder(tuple(used), tuple(dropped), tuple(shifted), shares[k])


def term(name: str) -> F.Column:
    return F.concat_ws("\r", *(F.col(f"`{c}`").cast("string") for c in name.split(":")))


def shift_effects(df: DataFrame, value: str, terms: list[str]) -> tuple[dict[str, dict[str, float]], float]:
    """Least-squares main effects of terms on value, shrunken by their reliability, and the factor that restores the spread.

    Fitted from sums by level and by pair of levels, at any number of rows or crossed cells.  The last terms go only where there
    are no more rows than effects; they are then absent from the result.
    """
    terms = list(terms)
    rows = df.select(F.col(f"`{value}`").cast("double").alias("y"), *(term(t).alias(f"t{i}") for i, t in enumerate(terms))).dropna()
    n, yy, sy = rows.agg(F.count("*"), F.sum(F.col("y") * F.col("y")), F.sum("y")).first()
    if not terms or not n:
        return {}, 1.0
    each = rows.select("y", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"t{i}").alias("a")) for i in range(len(terms))))).alias("s"))
    by = {(r["i"], r["a"]): (r["n"], r["s"]) for r in each.groupBy("s.i", "s.a").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()}
    levels = [sorted(a for i, a in by if i == k) for k in range(len(terms))]
    while terms and 1 + sum(len(x) - 1 for x in levels) >= n:
        terms.pop()
        levels.pop()
    if not terms:
        return {}, 1.0
    at, width = [], 1
    for x in levels:
        at.append({v: width + i - 1 for i, v in enumerate(x) if i})
        width += len(x) - 1
    count, b = np.full(width, float(n)), np.full(width, float(sy))
    for i, x in enumerate(at):
        for v, k in x.items():
            count[k], b[k] = by[i, v]
    pairs = None
    if len(terms) > 1:
        both = [F.struct(F.lit(i).alias("i"), F.col(f"t{i}").alias("a"), F.lit(j).alias("j"), F.col(f"t{j}").alias("b")) for i, j in combinations(range(len(terms)), 2)]
        pairs = rows.select(F.explode(F.array(*both)).alias("s")).groupBy("s.i", "s.a", "s.j", "s.b").agg(F.count("*").alias("n"))
    if width <= DENSE:
        a = np.diag(count)
        a[0], a[:, 0] = count, count
        for r in pairs.toLocalIterator() if pairs is not None else ():
            p, q = at[r["i"]].get(r["a"]), at[r["j"]].get(r["b"])
            if p and q:
                a[p, q] = a[q, p] = r["n"]
        beta, _, rank, _ = np.linalg.lstsq(a, b, rcond=None)
    else:
        beta, rank = _solved(df.sparkSession, pairs, at, count, b), width
    sigma2 = max(0.0, yy - beta @ b) / max(n - rank, 1)
    out, used = {}, 0.0
    for i, t in enumerate(terms):
        effects = np.array([0.0] + [beta[at[i][v]] for v in levels[i][1:]])
        noise = sigma2 / (n / len(effects))
        tau2 = max(0.0, effects.var(ddof=1) - noise) if len(effects) > 1 else 0.0
        weight = tau2 / (tau2 + noise) if tau2 > 0 else 0.0
        out[t] = dict(zip(levels[i], (weight * effects).tolist(), strict=True))
        used += weight * (len(effects) - 1)
    return out, float(np.sqrt((n - 1) / (n - 1 - used))) if n - 1 > used else 1.0


def _solved(spark: SparkSession, pairs: DataFrame | None, at: list[dict[str, int]], count: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The normal equations by conjugate gradients from 0 (the solution of least norm); only vectors come to the driver."""
    width, slim = len(b), None
    if pairs is not None:
        index = spark.createDataFrame([(i, v, k) for i, x in enumerate(at) for v, k in x.items()], "i int, a string, k long")
        first, second = index.withColumnRenamed("k", "p"), index.toDF("j", "b", "q")
        slim = cut(pairs.join(first, ["i", "a"]).join(second, ["j", "b"]).select("p", "q", "n"), "shift-pairs")

    def times(x: np.ndarray) -> np.ndarray:
        out = count * x
        out[0] += count[1:] @ x[1:]
        out[1:] += count[1:] * x[0]
        if slim is None:
            return out
        held = spark.sparkContext.broadcast(x)

        def run(batches):
            part = np.zeros(width)
            for rb in batches:
                p, q, n = (rb.column(c).to_numpy() for c in ("p", "q", "n"))
                part += np.bincount(p, n * held.value[q], width) + np.bincount(q, n * held.value[p], width)
            on = np.flatnonzero(part)
            yield pa.RecordBatch.from_pydict({"k": on, "x": part[on]})

        for r in slim.mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
            out[r["k"]] += r["x"]
        held.destroy()
        return out

    x, rest = np.zeros(width), b.copy()
    way, size = rest.copy(), rest @ rest
    for _ in range(ROUNDS):
        if size <= (1e-9 * np.linalg.norm(b)) ** 2:
            return x
        ahead = times(way)
        step = size / (way @ ahead)
        x, rest = x + step * way, rest - step * ahead
        way, size = rest + (rest @ rest) / size * way, rest @ rest
    warn(ConditionalDegraded, f"shifts of {width} effects are solved to {np.sqrt(size) / np.linalg.norm(b):.1e} only")
    return x


def shift_column(df: DataFrame, effects: dict[str, dict[str, float]], into: str) -> DataFrame:
    """df with the sum of its rows' effects; effects travel as tables, never as literals.  A null in a term shifts nothing."""
    spark = df.sparkSession
    done = df.withColumn(into, F.lit(0.0))
    for t, levels in effects.items():
        table = spark.createDataFrame(list(levels.items()) or [("", 0.0)], "__level string, __effect double")
        done = done.join(table, term(t) == F.col("__level"), "left").withColumn(into, F.col(into) + F.coalesce("__effect", F.lit(0.0))).drop("__level", "__effect")
    return done
