"""Leakage audit of a clone against its original: cell, value-set and joint checks over one row-joined table."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.kinds import kinds
from ..functions.patterns import CATEGORICAL, DATES, NUMERIC
from ..sources.scratch import cut
from .incidence import constant_within
from .ranking import hash_index

if TYPE_CHECKING:
    from ..plans.recipe import Recipe

# Excess in per cent and multiples of the standard deviation at which a finding is medium or high.
SAME_MEDIUM, SAME_HIGH, VALUE_SET_HIGH = (10, 4), (50, 4), 50
JOINT_MEDIUM, JOINT_HIGH, RARE_MEDIUM, RARE_HIGH = (5, 4), (20, 4), (1, 3), (3, 4)
DRAWS, DRAW_SEED = 20, "160"


def clears(excess: float | None, sd: float | None, bar: tuple[float, float]) -> bool:
    return excess is not None and sd is not None and excess >= bar[0] and excess >= bar[1] * sd


@dataclass(frozen=True)
class Finding:
    """What the classifier needs to know of a column."""

    role: str
    kind: str
    action: str
    mode: str
    pii: bool = False
    present: bool = True
    alias: str = "passthrough"
    exact: float | None = None
    freq_min: int | None = None
    coarsened: bool = False
    excess: float | None = None
    sd: float | None = None
    two_valued: bool = False
    linked: bool = False
    by_excess: bool = False
    grained: bool = False
    allow_kept_outcome: bool = False
    value_set: float | None = None


def classify(f: Finding) -> str:
    """The first rule that holds decides."""
    shared = f.mode == "collaborate"
    structural = f.role in ("design", "treatment", "id")
    open_ = shared and f.present and not f.linked and not structural
    graded = f.two_valued or f.by_excess
    if f.coarsened and f.present:
        return "medium" if shared else "low"
    if f.pii and f.present:
        return "high" if shared else "medium"
    if not shared:
        return "low"
    if f.role == "outcome" and f.present and f.action == "keep":
        return "medium" if f.allow_kept_outcome else "high"
    if f.role == "treatment" and f.alias in ("passthrough", "permuted"):
        return "high"
    if f.role == "covariate" and f.kind in CATEGORICAL and f.freq_min == 1:
        return "high"
    if open_ and (f.by_excess or f.grained) and (clears(f.excess, f.sd, SAME_HIGH) or (f.value_set or 0) >= VALUE_SET_HIGH):
        return "high"
    if not graded and f.exact is not None and ((f.role == "outcome" and f.exact > 1) or (f.role == "covariate" and f.kind in NUMERIC and f.exact > 5)):
        return "medium"
    if open_ and clears(f.excess, f.sd, SAME_MEDIUM):
        return "medium"
    return "medium" if f.action == "keep" and f.role != "design" and f.present else "low"


def paired(original: DataFrame, clone: DataFrame, rid: str) -> DataFrame:
    """One row for each original row: o|col and c|col."""
    o = original.select(F.col(f"`{rid}`").alias("__rid"), *(F.col(f"`{c}`").alias(f"o|{c}") for c in original.columns if c != rid))
    c = clone.select(F.col(f"`{rid}`").alias("__rid2"), *(F.col(f"`{x}`").alias(f"c|{x}") for x in clone.columns if x != rid))
    # a file's size says little of its rows in memory, and the driver would broadcast by it
    return o.join(c.hint("merge"), F.col("__rid") == F.col("__rid2")).drop("__rid2")


def exact_match(pairs: DataFrame, cols: list[str]) -> DataFrame:
    """col, comparable_n and exact_match_pct; one pass."""
    o, c = (lambda x: F.col(f"`o|{x}`")), (lambda x: F.col(f"`c|{x}`"))
    both = lambda x: o(x).isNotNull() & c(x).isNotNull()
    wide = pairs.agg(*(F.count(F.when(both(x), 1)).alias(f"n|{x}") for x in cols), *(F.count(F.when(both(x) & (o(x) == c(x)), 1)).alias(f"m|{x}") for x in cols))
    rows = F.array(*(F.struct(F.lit(x).alias("col"), F.col(f"`n|{x}`").alias("comparable_n"), F.when(F.col(f"`n|{x}`") > 0, 100 * F.col(f"`m|{x}`") / F.col(f"`n|{x}`")).alias("exact_match_pct")) for x in cols))
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def same_row(pairs: DataFrame, col: str, by: list[Column] | None = None, units: int | None = None) -> DataFrame:
    """One row: observed, baseline (what permuting within by would give), excess, sd and m."""
    o, c = F.col(f"`o|{col}`").cast("string"), F.col(f"`c|{col}`").cast("string")
    g = F.concat_ws("\r", *(F.coalesce(x.cast("string"), F.lit("\0")) for x in by)) if by else F.lit("all")
    rows = pairs.where(F.col(f"`o|{col}`").isNotNull() & F.col(f"`c|{col}`").isNotNull()).select(g.alias("g"), o.alias("x"), (o == c).cast("int").alias("hit"))
    cell = rows.groupBy("g", "x").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    group = cell.groupBy("g").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    total = group.agg(F.sum("n").alias("m"), F.sum("hits").alias("hits"), F.sum(F.col("sq") / F.col("n")).alias("chance"))
    share, chance = F.col("hits") / F.col("m"), F.col("chance") / F.col("m")
    eff = F.lit(units) if units else F.col("m")
    return total.select((100 * share).alias("observed"), (100 * chance).alias("baseline"), (100 * share - 100 * chance).alias("excess"), (100 * F.sqrt(chance * (1 - chance) / eff)).alias("sd"), F.col("m"))


def na_patterns(df: DataFrame, cols: list[str]) -> DataFrame:
    """pattern (a bitmap of nulls) and n."""
    bits = F.concat(*(F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in cols))
    return df.select(bits.alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


def na_uniqueness(df: DataFrame, cols: list[str]) -> DataFrame:
    return na_patterns(df, cols).agg((F.sum(F.when(F.col("n") == 1, 1).otherwise(0)) / F.sum("n")).alias("na_pattern_uniqueness"))


def value_set(original: DataFrame, clone: DataFrame, unit: list[str], col: str, rid: str) -> DataFrame:
    """One row: the share of the clone's unit values that are units' real values."""
    first = F.min_by(F.col(f"`{col}`"), F.when(F.col(f"`{col}`").isNotNull(), F.col(f"`{rid}`"))).alias("v")
    real, made = (x.groupBy(*(F.col(f"`{u}`") for u in unit)).agg(first).where("v IS NOT NULL") for x in (original, clone))
    hit = made.join(real.select(F.col("v").alias("r")).distinct(), F.col("v") == F.col("r"), "left")
    return hit.agg((100 * F.avg(F.col("r").isNotNull().cast("int"))).alias("pct"), F.count("*").alias("n"))


def _draw(rows: DataFrame, cols: list[str], by: dict[str, list[str]], draws: int, carry: list[str] | None = None) -> DataFrame:
    """Each draw's rows with the columns permuted: __draw, __rid, p|col and the carried columns.

    Rows times draws are shuffled once for each column and never broadcast: Spark's sizes don't know that explode multiplied them.
    """
    carry = [f"o|{c}" for c in carry or []]
    many = rows.withColumn("__draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    out = None
    for c in cols:
        strata = by.get(c, [])
        groups = [F.col(f"`o|{s}`").alias(f"__s{i}") for i, s in enumerate(strata)]
        keys = ["__draw", *(f"__s{i}" for i in range(len(strata)))]
        tag = F.concat_ws("#", F.col("__rid").cast("string"), F.col("__draw").cast("string"))
        held = carry if out is None else []
        own = many.select("__draw", "__rid", *groups, *(F.col(f"`{x}`") for x in held))
        to = hash_index(own, rng.digest(DRAW_SEED, f"draw-to:{c}", tag), "__k", keys, ["__rid"])
        source = hash_index(many.select("__draw", "__rid", F.col(f"`o|{c}`").alias("__v"), *groups), rng.digest(DRAW_SEED, f"draw-from:{c}", tag), "__k", keys, ["__rid"]).drop("__rid")
        on = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in [*keys, "__k"]]
        moved = to.alias("l").join(source.hint("merge").alias("r"), on).select(F.col("l.__draw").alias("__draw"), F.col("l.__rid").alias("__rid"), *(F.col(f"l.`{x}`").alias(x) for x in held), F.col("__v").alias(f"p|{c}"))
        out = moved if out is None else out.join(moved.hint("merge"), ["__draw", "__rid"])
    return out


def joint(pairs: DataFrame, content: list[str], fixed: list[str], by: dict[str, list[str]] | None = None, draws: int = DRAWS) -> DataFrame:
    """check, observed, baseline, excess and sd of same_row_joint and whole_row: all content columns of a row match its original,
    or any original with the same fixed columns; baselines are permutations of the content."""
    by = by or {}
    hit = F.lit(True)
    for c in content:
        hit &= F.col(f"`o|{c}`").eqNullSafe(F.col(f"`c|{c}`"))
    whole = [*fixed, *content]
    real = pairs.select(F.xxhash64(*(F.col(f"`o|{c}`").cast("string") for c in whole), F.concat(*(F.col(f"`o|{c}`").isNull().cast("string") for c in whole))).alias("h")).distinct()
    # the permuted rows keep their fixed columns
    drawn = _draw(pairs, content, by, draws, whole)
    drawn_hit = F.lit(True)
    for c in content:
        drawn_hit &= F.col(f"`o|{c}`").eqNullSafe(F.col(f"`p|{c}`"))

    def found(rows: DataFrame, names: list[str]) -> Column:
        return F.xxhash64(*(F.col(f"`{n}`").cast("string") for n in names), F.concat(*(F.col(f"`{n}`").isNull().cast("string") for n in names)))

    clone = pairs.select(F.lit(0).alias("__draw"), hit.alias("same"), found(pairs, [*(f"o|{c}" if f"c|{c}" not in pairs.columns else f"c|{c}" for c in fixed), *(f"c|{c}" for c in content)]).alias("h"))
    perm = drawn.select("__draw", drawn_hit.alias("same"), found(drawn, [*(f"o|{c}" for c in fixed), *(f"p|{c}" for c in content)]).alias("h"))
    rows = clone.unionByName(perm).join(real.withColumnRenamed("h", "rh"), F.col("h") == F.col("rh"), "left")
    each = rows.groupBy("__draw").agg((100 * F.avg(F.col("same").cast("int"))).alias("same_row_joint"), (100 * F.avg(F.col("rh").isNotNull().cast("int"))).alias("whole_row"), F.count("*").alias("n"))
    long = each.select("__draw", "n", F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("v")) for c in ("same_row_joint", "whole_row")))).alias("s")).select("__draw", "n", "s.*")
    own = F.max(F.when(F.col("__draw") == 0, F.col("v")))
    base = F.avg(F.when(F.col("__draw") > 0, F.col("v")))
    sd = F.greatest(F.coalesce(F.stddev_samp(F.when(F.col("__draw") > 0, F.col("v"))), F.lit(0.0)), 100 / F.max("n"))
    return long.groupBy("check").agg(own.alias("observed"), base.alias("baseline"), (own - base).alias("excess"), sd.alias("sd"))


def singletons(pairs: DataFrame, cols: list[str], other: str = "c") -> DataFrame:
    """One row: combinations that are unique in the original and in the clone."""
    side = lambda p, s: pairs.select(F.struct(*(F.col(f"`{p}|{c}`").alias(c) for c in cols)).alias("k"), F.lit(s).alias("side"))
    both = side("o", 0).unionByName(side(other, 1)).groupBy("k").agg(F.sum((F.col("side") == 0).cast("int")).alias("a"), F.sum((F.col("side") == 1).cast("int")).alias("b"))
    return both.agg(F.coalesce(F.sum(((F.col("a") == 1) & (F.col("b") == 1)).cast("int")), F.lit(0)).alias("cells"))


def rare_cross(pairs: DataFrame, cols: list[str], draws: int = DRAWS) -> DataFrame:
    """One row of the same columns as joint() gives: observed singletons against those of permuted originals."""
    drawn = _draw(pairs, cols, {}, draws)
    real = pairs.groupBy(*(F.col(f"`o|{c}`").alias(c) for c in cols)).agg(F.count("*").alias("n")).where("n = 1").drop("n")
    made = drawn.groupBy("__draw", *(F.col(f"`p|{c}`").alias(c) for c in cols)).agg(F.count("*").alias("n")).where("n = 1").drop("n")
    clone = pairs.groupBy(*(F.col(f"`c|{c}`").alias(c) for c in cols)).agg(F.count("*").alias("n")).where("n = 1").drop("n").withColumn("__draw", F.lit(0))
    every = made.unionByName(clone).alias("l")
    on = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in cols]
    hits = every.join(real.alias("r"), on, "left_semi").groupBy("__draw").agg(F.count("*").alias("v"))
    spine = pairs.sparkSession.range(0, draws + 1).withColumnRenamed("id", "d")
    each = spine.join(hits, F.col("d") == F.col("__draw"), "left").select("d", F.coalesce("v", F.lit(0)).cast("double").alias("v"))
    own, base = F.max(F.when(F.col("d") == 0, F.col("v"))), F.avg(F.when(F.col("d") > 0, F.col("v")))
    return each.agg(F.lit("rare_cross").alias("check"), own.alias("observed"), base.alias("baseline"), (own - base).alias("excess"), F.greatest(F.coalesce(F.stddev_samp(F.when(F.col("d") > 0, F.col("v"))), F.lit(0.0)), F.lit(0.5)).alias("sd"))


def unit_sizes(df: DataFrame, design: list[str]) -> DataFrame:
    """col, units, smallest and largest unit of each design column."""
    pairs = F.array(*(F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("u")) for c in design))
    sizes = df.select(F.explode(pairs).alias("p")).select("p.*").groupBy("col", "u").agg(F.count("*").alias("n"))
    return sizes.groupBy("col").agg(F.count("*").alias("units"), F.min("n").alias("smallest"), F.max("n").alias("largest"))


def grade(excess: float, sd: float, medium: tuple, high: tuple, mode: str) -> str:
    if mode != "collaborate":
        return "low"
    return "high" if clears(excess, sd, high) else "medium" if clears(excess, sd, medium) else "low"


def audit(original: DataFrame, clone: DataFrame, recipe: Recipe, rid: str, strata: list[str] | None = None, linked: tuple[str, ...] = ()) -> tuple[list[dict], list[dict]]:
    """Column rows and joint rows.  clone has the plan's names (before column aliases)."""
    plan, mode = recipe.plan, recipe.plan.mode
    seen = [c for c in clone.columns if c != rid]
    pairs = paired(original.select(rid, *(F.col(f"`{e.col}`") for e in plan.entries if e.col != rid)), _in_original_space(clone, recipe), rid)
    pairs = cut(pairs, "audit-pairs")
    own = kinds(original)
    coarse = {c for s in recipe.coords for c in (s["lat"], s["lon"])}
    units = {c: g for g in recipe.grain if g["synthesised"] == "unit" for c in g["cols"]}
    cols = [e.col for e in plan.entries if e.col != rid]
    base = original.agg(F.count(F.lit(1)).alias("n"), *(F.count_distinct(F.col(f"`{c}`")).alias(f"d|{c}") for c in cols if own[c] != "other"), *(F.count(F.col(f"`{c}`")).alias(f"n|{c}") for c in cols)).first()
    numeric = [c for c in cols if own[c] in NUMERIC and c in seen]
    whole = original.agg(*(F.coalesce(F.bool_and(F.col(f"`{c}`") == F.floor(F.col(f"`{c}`").cast("double"))), F.lit(False)).alias(c) for c in numeric)).first() if numeric else {}
    exact = {r["col"]: r for r in exact_match(pairs, numeric).collect()} if numeric else {}
    unique = na_uniqueness(original, cols).first()[0]
    design = plan.cols(role="design")
    rows = []
    for e in plan.entries:
        c = e.col
        if c == rid:
            continue
        present, kind = c in seen, own[c]
        mapped = recipe.map_kind(c)
        alias = "dropped" if not present else {"none": "passthrough", "permuted": "permuted"}.get(mapped, "aliased")
        two = kind in NUMERIC and base[f"d|{c}"] == 2
        by_excess = present and kind in NUMERIC and e.action == "scramble" and (c in units or (e.role in ("covariate", "outcome") and bool(whole[c])))
        same, value = None, None
        if present and (two or by_excess or kind in CATEGORICAL + DATES):
            groups = [F.col(f"`o|{s}`") for s in strata or [] if f"o|{s}" in pairs.columns] if (two or by_excess) and c not in units and e.action == "scramble" else None
            n_units = units[c]["n_units"] if c in units else _constant_units(original, c, [d for d in design if d != c])
            same = same_row(pairs, c, groups, n_units).first()
            same = same if same["m"] else None
        if c in units and mapped == "none" and not two and kind in NUMERIC and not whole[c]:
            value = value_set(original, clone, list(units[c]["unit"]), c, rid).first()["pct"]
        low = original.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`")).count().agg(F.min("count")).first()[0] if kind in CATEGORICAL else None
        f = Finding(e.role, kind, e.action or "", mode, e.pii_suspected, present, alias, exact[c]["exact_match_pct"] if c in exact else None, low, c in coarse, same["excess"] if same else None, same["sd"] if same else None, two, c in linked, by_excess, c in units, recipe.allow_kept_outcome, value)
        rows.append({
            "col": c, "role": e.role, "action": e.action, "kind": kind, "leakage_class": classify(f), "n_unique_levels": base[f"d|{c}"] if kind in CATEGORICAL else None, "freq_min": low, "exact_match_pct": f.exact,
            "comparable_n": exact[c]["comparable_n"] if c in exact else None, "na_pct": 100 * (base["n"] - base[f"n|{c}"]) / base["n"] if base["n"] else 0.0, "na_pattern_uniqueness": unique, "alias_status": alias,
            "notes": notes(f), "same_row_pct": same["observed"] if same else None, "baseline_pct": same["baseline"] if same else None, "excess_pct": f.excess,
        })
    found = _joint_rows(original, pairs, rows, strata or [], mode, linked)
    return rows, found


def _in_original_space(clone: DataFrame, recipe: Recipe) -> DataFrame:
    from .alias import translate

    for c in recipe.mapped():
        if c in clone.columns:
            clone = translate(clone, c, recipe.maps[c], "alias", "original")
    return clone


def _constant_units(df: DataFrame, col: str, design: list[str]) -> int | None:
    if not design:
        return None
    fits = [r["groups"] for r in constant_within(df, {d: [d] for d in design}, [col]).collect() if r[col]]
    return min(fits) if fits else None


def _joint_rows(original: DataFrame, pairs: DataFrame, rows: list[dict], strata: list[str], mode: str, linked: tuple[str, ...]) -> list[dict]:
    kept = [r for r in rows if r["alias_status"] != "dropped"]
    fixed = [r["col"] for r in kept if r["role"] in ("design", "treatment", "id") or (r["role"] == "text" and r["action"] == "alias") or r["col"] in linked]
    content = [r["col"] for r in kept if r["col"] not in fixed and r["kind"] != "other"]
    out = []
    if content:
        by = {r["col"]: [s for s in strata if f"o|{s}" in pairs.columns] for r in kept if r["col"] in content and r["kind"] in NUMERIC and r["action"] == "scramble"}
        for r in joint(pairs, content, fixed, by).collect():
            out.append(r.asDict() | {"cols": ", ".join(content), "leakage_class": grade(r["excess"], r["sd"], JOINT_MEDIUM, JOINT_HIGH, mode)})
    visible = [r["col"] for r in kept if r["role"] in ("covariate", "outcome") and r["kind"] in CATEGORICAL and r["alias_status"] in ("passthrough", "permuted")]
    if len(visible) >= 2:
        r = rare_cross(pairs, visible).first()
        out.append(r.asDict() | {"cols": ", ".join(visible), "leakage_class": grade(r["excess"], r["sd"], RARE_MEDIUM, RARE_HIGH, mode)})
    design = [r["col"] for r in kept if r["role"] == "design"]
    if design:
        for r in unit_sizes(original, design).where("units > 1 AND smallest < largest").collect():
            out.append({"check": "unit_sizes", "cols": r["col"], "observed": None, "baseline": None, "excess": None, "sd": None, "leakage_class": "info"})
    return out


def notes(f: Finding) -> str:
    said = []
    if f.pii and not f.coarsened:
        said.append("named like personal data")
    if f.coarsened:
        said.append("displaced in place")
    said += {"aliased": ["labels aliased"], "permuted": ["labels permuted, vocabulary visible"], "dropped": ["dropped"]}.get(f.alias, [])
    if f.alias == "passthrough" and f.action == "keep" and f.role != "design" and f.mode == "collaborate" and not f.coarsened:
        said.append("real outcome values" if f.role == "outcome" else "kept and visible")
    if f.freq_min == 1 and f.role == "covariate" and f.mode == "collaborate":
        said.append("a label occurs once")
    if f.exact is not None and f.exact > 1 and f.mode == "collaborate" and not f.two_valued and not f.by_excess:
        said.append(f"{f.exact:.1f}% of cells equal")
    if f.excess is not None and f.excess >= SAME_MEDIUM[0] and f.role not in ("design", "treatment", "id") and not f.linked:
        said.append(f"{f.excess:.1f}% more rows equal than by chance")
    return "; ".join(said) or "ok"


def report(rows: list[dict], joint_rows: list[dict], mode: str) -> str:
    """The audit in words: counts, the columns from high to low, and the checks of the whole table."""
    counts = {k: sum(r["leakage_class"] == k for r in rows) for k in ("high", "medium", "low")}
    said = [f"audit (mode {mode})", f"{counts['high']} high, {counts['medium']} medium, {counts['low']} low of {len(rows)} columns"]
    if rows and rows[0]["na_pattern_uniqueness"] is not None:
        said.append(f"rows with a pattern of missing values of their own: {100 * rows[0]['na_pattern_uniqueness']:.1f}%")
    for k in counts:
        some = [r for r in rows if r["leakage_class"] == k]
        said += [f"{k} ({len(some)})"] * bool(some) + [f"  {r['role']:<9} {r['col']:<32} {r['notes']}" for r in some]
    for r in joint_rows:
        figures = "" if r["excess"] is None else f": {r['excess']:.1f} more than by chance"
        said.append(f"  {'note' if r['leakage_class'] == 'info' else r['leakage_class']:<9} {r['check']} of {r['cols']}{figures}")
    return "\n".join(said)


def tally(rows: list[dict], joint_rows: list[dict]) -> dict[str, int]:
    every = [r["leakage_class"] for r in rows + joint_rows]
    return {k: every.count(k) for k in ("high", "medium", "low")}


def release_status(mode: str, rows: list[dict], joint_rows: list[dict]) -> str:
    counts = tally(rows, joint_rows)
    return "local" if mode != "collaborate" else "blocked" if counts["high"] else "review" if counts["medium"] else "clear"
