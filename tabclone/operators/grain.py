"""Grain: columns with one value for each unit of the design are synthesised over units and given back to the units' rows."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GrainSmallUnits, warn  # type: ignore[attr-defined]
from ..functions.kinds import kinds
from ..functions.patterns import CATEGORICAL, DATES, NUMERIC
from ..plans.plan import Plan
from .copula import resimulate
from .incidence import constant_within
from .permute import permute_rows

LEAST_UNITS = 5


@dataclass(frozen=True)
class Grain:
    unit: tuple[str, ...]
    cols: tuple[str, ...]
    n_units: int
    synthesised: str = "unit"
    reason: str = ""


def units_of(design: list[str]) -> dict[str, list[str]]:
    return {c: [c] for c in design} | {f"{a}:{b}": [a, b] for a, b in combinations(design, 2)}


def detect_grain(df: DataFrame, plan: Plan, without: tuple[str, ...] = ()) -> list[Grain]:
    """For each scrambled column that varies, the coarsest unit (one or two design columns) within which it is constant."""
    cand = [e.col for e in plan.entries if e.col not in without and (
        (e.role in ("covariate", "outcome") and e.action == "scramble" and e.kind in NUMERIC + CATEGORICAL + DATES) or (e.role == "date" and e.action == "scramble") or (e.role == "covariate" and e.action == "alias" and e.kind in CATEGORICAL)
    )]
    design = [e.col for e in plan.entries if e.role == "design" and e.action != "drop"]
    if not cand or not design:
        return []
    first = df.agg(F.count(F.lit(1)).alias("n"), *(F.min(F.col(f"`{c}`")).alias(f"lo|{c}") for c in cand), *(F.max(F.col(f"`{c}`")).alias(f"hi|{c}") for c in cand)).first()
    n, cand = first["n"], [c for c in cand if first[f"lo|{c}"] != first[f"hi|{c}"]]
    if n < 4 or not cand:
        return []
    units = units_of(design)
    fits = {r["unit"]: r for r in constant_within(df, units, cand).collect()}
    order = sorted((u for u, r in fits.items() if 2 <= r["groups"] <= n / 2), key=lambda u: (fits[u]["groups"], len(units[u]), list(units).index(u)))
    grain: dict[str, list[str]] = {}
    for c in cand:
        if hit := next((u for u in order if fits[u][c]), None):
            grain.setdefault(hit, []).append(c)
    return [Grain(tuple(units[u]), tuple(cs), fits[u]["groups"]) for u, cs in grain.items()]


def resolve(grains: list[Grain], use: bool, mode: str) -> list[Grain]:
    out = []
    for g in grains:
        if not use:
            g = Grain(g.unit, g.cols, g.n_units, "row", "grain is off")
        elif mode == "collaborate" and g.n_units < LEAST_UNITS:
            warn(GrainSmallUnits, f"{list(g.cols)}: only {g.n_units} units of {list(g.unit)}; synthesised by rows")
            g = Grain(g.unit, g.cols, g.n_units, "row", f"only {g.n_units} units")
        out.append(g)
    return out


def unit_table(df: DataFrame, g: Grain, rid: str) -> DataFrame:
    """One row for each unit: its key, the first value of every column, and __unit, a text that stands for it."""
    firsts = [F.min_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(f"`{rid}`"))).alias(c) for c in g.cols]
    table = df.groupBy(*(F.col(f"`{u}`") for u in g.unit)).agg(*firsts)
    return table.withColumn("__unit", F.concat_ws("\r", *(F.coalesce(F.col(f"`{u}`").cast("string"), F.lit("\0")) for u in g.unit)))


def synthesise(df: DataFrame, g: Grain, rid: str, seed: str) -> DataFrame:
    """df with the unit's columns synthesised over units; a missing cell stays missing."""
    table = unit_table(df, g, rid)
    own = kinds(df)
    table = resimulate(table, [c for c in g.cols if own[c] in NUMERIC], "__unit", seed, "grain:" + ":".join(g.unit))
    for c in g.cols:
        if own[c] not in NUMERIC:
            table = permute_rows(table, c, "__unit", seed, f"grain:{c}")
    on = [F.col(f"l.`{u}`").eqNullSafe(F.col(f"r.`{u}`")) for u in g.unit]
    joined = df.alias("l").join(table.alias("r"), on)
    return joined.select(*((F.when(F.col(f"l.`{c}`").isNotNull(), F.col(f"r.`{c}`")).alias(c) if c in g.cols else F.col(f"l.`{c}`")) for c in df.columns))
