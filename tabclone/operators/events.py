"""Linked times to events: gaps and status patterns, permuted and drawn anew so that the order of events holds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadEvents, EventsPooled, warn  # type: ignore[attr-defined]
from ..sources.scratch import cut
from .copula import resimulate, strata
from .jitter import jitter
from .permute import permute_rows

LEAST = 5
#: Pooled patterns that a report lists; it counts the others.
SHOWN = 1000


@dataclass(frozen=True)
class EventSpec:
    time: tuple[str, ...]
    status: tuple[str, ...]


@dataclass
class EventReport:
    patterns: int = 0
    pooled: list[str] = field(default_factory=list)
    pooled_hidden: int = 0


def gaps(df: DataFrame, time: tuple[str, ...]) -> list[Column]:
    return [F.col(f"`{t}`") if i == 0 else F.col(f"`{t}`") - F.col(f"`{time[i - 1]}`") for i, t in enumerate(time)]


def pattern(status: tuple[str, ...]) -> Column:
    return F.concat_ws("/", *(F.col(f"`{s}`").cast("string") for s in status))


def validate(df: DataFrame, spec: EventSpec) -> None:
    """Times and statuses are there, none is missing, statuses are whole and times don't fall; one pass."""
    if len(spec.time) != len(spec.status) or not spec.time or len(set(spec.time + spec.status)) != 2 * len(spec.time):
        raise BadEvents("as many different times as statuses are needed")
    if bad := [c for c in spec.time + spec.status if c not in df.columns]:
        raise BadEvents(f"no such columns: {bad}", bad)
    missing = F.sum(sum((F.col(f"`{c}`").isNull().cast("int") for c in spec.time + spec.status), F.lit(0)))
    falls = F.sum(sum(((g < 0).cast("int") for g in gaps(df, spec.time)[1:]), F.lit(0)))
    parts = F.sum(sum(((F.col(f"`{s}`") != F.floor(F.col(f"`{s}`"))).cast("int") for s in spec.status), F.lit(0)))
    r = df.agg(missing.alias("missing"), falls.alias("falls"), parts.alias("parts")).first()
    if r["missing"] or r["falls"] or r["parts"]:
        raise BadEvents(f"event columns have {r['missing']} missing values, {r['falls']} falling times and {r['parts']} broken statuses")


def synthesise(df: DataFrame, spec: EventSpec, rid: str, seed: str, by: list[str] | None = None, jittered: bool = False, least: int = LEAST) -> tuple[DataFrame, EventReport]:
    """df with statuses permuted as patterns within by, and the gaps that a pattern leaves free drawn anew among like patterns.

    Cells of stratum and pattern under least rows are pooled with their pattern; patterns under it with every row.
    """
    validate(df, spec)
    by = list(by or [])
    names = df.columns
    k = len(spec.time)
    g = [f"__g{i}" for i in range(k)]
    own = df.withColumns(dict(zip(g, gaps(df, spec.time), strict=True))).withColumn("__pattern", pattern(spec.status))
    tally = own.groupBy("__pattern").agg(F.count("*").alias("n"), *(F.bool_or(F.col(x) != 0).alias(x) for x in g))
    patterns, pooled, *free = tally.agg(F.count("*"), F.count_if(F.col("n") < least), *(F.struct(F.count_if(x), F.min(F.when(F.col(x), F.struct("n", "__pattern")))) for x in g)).first()
    for many, only in free:
        if many == 1 and only["n"] < least:
            raise BadEvents(f"a gap is free only in the pattern {only['__pattern']!r}, which has fewer than {least} rows", only["__pattern"])
    small = [r["__pattern"] for r in tally.where(F.col("n") < least).orderBy("__pattern").limit(SHOWN).collect()]
    if small:
        warn(EventsPooled, f"patterns with fewer than {least} rows are pooled: {small}" + (f" and {pooled - len(small)} more" if pooled > len(small) else ""))
    # rows move as a whole: a row takes pattern and gaps of another of its stratum, then its free gaps are drawn within the cell
    moved = permute_rows(own, [*spec.status, *g, "__pattern"], rid, seed, "events", by)
    celled = strata(moved, [*by, "__pattern"], least, "__cell")
    celled = celled.withColumn("__cell", F.when(F.col("__cell") == F.lit("\0fallback"), F.concat(F.lit("\0"), F.col("__pattern"))).otherwise(F.col("__cell")))
    # read several times from here on
    celled = cut(strata(celled, ["__cell"], least, "__cell"), "events-cells")
    caps = celled.withColumn("__end", sum((F.col(x) for x in g), F.lit(0.0))).groupBy("__cell").agg(F.max("__end").alias("__cap"), *(F.bool_or(F.col(x) != 0).alias(f"__f{x}") for x in g))
    drawn = resimulate(celled, g, rid, seed, "events", ["__cell"])
    if jittered:
        for x in g:
            drawn = jitter(drawn, x, rid, seed, own, 0.0)
    drawn = drawn.join(caps, "__cell").withColumns({x: F.when(F.col(f"__f{x}"), F.greatest(F.lit(0.0), F.col(x).cast("double"))).otherwise(F.lit(0.0)) for x in g})
    times, total = [], F.lit(0.0)
    for x in g:
        total = total + F.col(x)
        times.append(total)
    capped = cap(times, [F.col(x) for x in g], F.col("__cap"))
    done = drawn.select(*(capped[spec.time.index(c)].cast(df.schema[c].dataType).alias(c) if c in spec.time else F.col(f"`{c}`") for c in names))
    return done, EventReport(patterns, small, pooled - len(small))


def cap(times: list[Column], gap: list[Column], most: Column) -> list[Column]:
    """No last time over most: the trailing block after the last positive gap is set to it, or the row is scaled down."""
    last = times[-1]
    start = F.lit(0)
    for j in range(1, len(gap)):
        start = F.when(gap[j] > 0, F.lit(j)).otherwise(start)
    before = F.lit(0.0)
    for j in range(1, len(gap)):
        before = F.when(start == j, times[j - 1]).otherwise(before)
    cut = (start == 0) | (before < most)
    return [F.when(last <= most, t).when(cut & (F.lit(j) >= start), most).when(cut, t).otherwise(t * most / last) for j, t in enumerate(times)]
