"""Masking a set of tables so that joins on their common keys survive, and the guided call for one table or many."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import BadInfo, BadLinks, InfoHint, ModeConflict, PlanMissingTable, warn  # type: ignore[attr-defined]
from .functions import rng
from .functions.kinds import kinds
from .functions.patterns import CATEGORICAL, INFO_TABLE, NUMERIC, matches
from .mask import Clone, mask
from .operators.alias import alias_map
from .operators.hygiene import Conformance, legal_names
from .plans.plan import Plan, propose

LONG_TEXT = 25


@dataclass
class CloneSet:
    clones: dict[str, Clone]
    links: list[str]
    mode: str
    info: list[str] = field(default_factory=list)

    def forward(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return {k: c.recipe.forward(tables[k]) for k, c in self.clones.items()}

    def inverse(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return {k: c.recipe.inverse(tables[k]) for k, c in self.clones.items() if k in tables}


def looks_like_info(name: str, df: DataFrame) -> bool:
    """Named like documentation, or narrow with a column of long texts."""
    if matches(name, INFO_TABLE):
        return True
    texts = [c for c, k in kinds(df).items() if k in ("character", "factor")]
    if len(df.columns) > 3 or not texts:
        return False
    r = df.agg(*(F.expr(f"percentile(length(`{c}`), 0.5)").alias(c) for c in texts)).first()
    return any((r[c] or 0) >= LONG_TEXT for c in texts)


def compatible(found: list[str]) -> bool:
    return all(k in CATEGORICAL for k in found) or all(k in NUMERIC for k in found)


def shared_values(tables: list[DataFrame], col: str) -> DataFrame:
    """The values that every table has."""
    parts = [t.select(F.col(f"`{col}`").cast("string").alias("v")).where("v IS NOT NULL").distinct() for t in tables]
    return reduce(lambda a, b: a.join(b, "v", "left_semi"), parts)


def detect_links(tables: dict[str, DataFrame]) -> list[str]:
    """Columns of one name in several tables, of like kinds, with a value that all of them have."""
    own = {n: kinds(t) for n, t in tables.items()}
    names = list(dict.fromkeys(c for t in tables.values() for c in t.columns))
    found = []
    for c in names:
        have = [n for n in tables if c in own[n]]
        if len(have) >= 2 and compatible([own[n][c] for n in have]) and shared_values([tables[n] for n in have], c).limit(1).count():
            found.append(c)
    return found


def shared_maps(tables: dict[str, DataFrame], links: list[str], seed: str) -> dict[str, DataFrame]:
    """One map for each link, over the union of its values in all tables."""
    out = {}
    for c in links:
        parts = [t.select(F.col(f"`{c}`").alias("original")).where("original IS NOT NULL") for t in tables.values() if c in t.columns]
        out[c] = alias_map(reduce(lambda a, b: a.unionByName(b), parts).distinct(), f"{c}_K", rng.link_seed(seed), c)
    return out


def mask_set(tables: dict[str, DataFrame | Conformance], plans: dict[str, Plan] | None = None, links: list[str] | bool | None = None, mode: str | None = None, seed: int | str | None = None, info: list[str] | None = None, keys: dict[str, list[str]] | None = None, **options: object) -> CloneSet:
    """Clones of all tables but the info ones, with one seed and shared maps for their links."""
    if bad := [n for n in info or [] if n not in tables]:
        raise BadInfo(f"no such tables: {bad}", bad)
    given = {n: t if isinstance(t, Conformance) else t.withColumnsRenamed(legal_names(t.columns)) for n, t in tables.items() if n not in (info or [])}
    own = {n: t.data if isinstance(t, Conformance) else t for n, t in given.items()}
    for n, t in own.items():
        if looks_like_info(n, t):
            warn(InfoHint, f"{n} looks like documentation; name it in info to set it aside")
    if plans is not None and (missing := [n for n in own if n not in plans]):
        raise PlanMissingTable(f"tables without a plan: {missing}", missing)
    modes = {p.mode for p in (plans or {}).values()}
    if mode is None and len(modes) > 1:
        raise ModeConflict(f"the plans have different modes: {sorted(modes)}")
    mode = mode or next(iter(modes), "local")
    plans = plans or {n: propose(t, mode, detect=False) for n, t in own.items()}
    if isinstance(links, list) and (bad := [c for c in links if sum(c in t.columns for t in own.values()) < 2]):
        raise BadLinks(f"links need two tables: {bad}", bad)
    found = [] if links is False else links if isinstance(links, list) else detect_links(own)
    # a link that is kept in every table needs no map
    found = [c for c in found if any(plans[n][c].action != "keep" for n in own if c in own[n].columns)]
    seed = rng.check_seed(seed)
    maps = shared_maps(own, found, seed)
    clones = {n: mask(given[n], plans[n], mode, seed, (keys or {}).get(n), shared_maps={c: m for c, m in maps.items() if c in t.columns}, **options) for n, t in own.items()}
    return CloneSet(clones, found, mode, list(info or []))


def clone(spark: SparkSession, source: str | DataFrame | dict[str, DataFrame], out: str | None = None, plan: Plan | dict[str, Plan] | None = None, mode: str = "local", seed: int | str | None = None, overwrite: bool = False, allow_high: bool = False, **options: object) -> Clone | CloneSet:
    """Reads, proposes what isn't planned, masks, and writes where out says so, after the gate."""
    from .sources.tables import read_set, read_table, write_clone, write_set

    if isinstance(source, str):
        many = not source.rstrip("/").rsplit(".", 1)[-1].lower() in ("csv", "tsv", "parquet", "orc", "json")
        source = read_set(spark, source) if many else read_table(spark, source)
    if isinstance(source, dict):
        done = mask_set(source, plan, mode=mode, seed=seed, **options)
        if out:
            write_set(done.clones, out, overwrite=overwrite, allow_high=allow_high)
        return done
    one = mask(source, plan or propose(source, mode), mode, seed, **options)
    if out:
        write_clone(one, out, overwrite, allow_high)
    return one


def summary(done: Clone) -> list[str]:
    """What was done, in words that give no map or seed away."""
    counts: dict[str, int] = {}
    for e in done.recipe.plan.entries:
        counts[e.action or ""] = counts.get(e.action or "", 0) + 1
    lines = [f"mode: {done.mode}", "columns: " + ", ".join(f"{n} {a}" for a, n in sorted(counts.items())), f"release: {done.status()}"]
    if done.recipe.conditioning:
        lines.append("conditioned on: " + (", ".join(done.recipe.conditioning["used"]) or "nothing"))
    return lines
