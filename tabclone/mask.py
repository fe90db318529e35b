"""Masking one table: a plan in, a clone with its recipe and audit out."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .errors import AuditMissing, BadConditional, BadOriginal, BadTable, BadEvents, BadLadder, BlockedWrite, ConditionalDegraded, FewRows, HighLeakage, HighOverride, MissingPlan, ModeUnset, TooFewRows, warn  # type: ignore[attr-defined]
from .functions import rng
from .functions.kinds import LEVELS, kinds, nan_to_null
from .functions.patterns import CATEGORICAL, DATES, NUMERIC
from .operators import alias, conditional, copula, events, geo, grain, hygiene, jitter, permute
from .operators.audit import audit, release_status, report
from .plans.plan import Plan
from .plans.recipe import Recipe, fingerprint
from .sources.scratch import cut

LEAST_ROWS = 5
RID = "__rid"


@dataclass
class Clone:
    data: DataFrame
    recipe: Recipe = field(repr=False)
    mode: str
    columns: list[dict] | None = None
    joint: list[dict] | None = None

    def public_roles(self) -> list[dict]:
        """The plan in the clone's names: column, role, action and kind; nothing private."""
        gone = self.recipe.dropped()
        return [{"col": self.recipe.names.get(e.col, e.col), "role": e.role, "action": e.action, "kind": e.kind} for e in self.recipe.plan.entries if e.col not in gone]

    def status(self) -> str:
        return release_status(self.mode, self.columns or [], self.joint or [])

    def gate(self, allow_high: bool = False) -> None:
        """Refuses to release a shared clone with a high finding, unless that is asked for, which the recipe records."""
        if self.mode == "collaborate" and self.status() == "blocked":
            if not allow_high:
                raise BlockedWrite("the audit has high findings", [r["col"] for r in self.columns or [] if r["leakage_class"] == "high"])
            self.recipe.allow_high = True
            warn(HighOverride, "released with high findings")


def audit_mask(done: Clone, original: DataFrame | None = None, key: list[str] | None = None, show: bool = True) -> tuple[list[dict], list[dict]]:
    """The audit of a clone: the stored one, or (a local clone has none) one against the original, whose rows meet the clone's by key.

    The key has to be in the clone, kept or aliased.
    """
    if done.columns is None:
        if original is None or not key:
            raise AuditMissing("no audit is stored with this clone; give the original and a key")
        recipe = done.recipe
        own = recipe._cleaned(original)
        if missing := [e.col for e in recipe.plan.entries if e.col not in own.columns]:
            raise BadOriginal(f"the original lacks columns of the plan: {missing}", missing)
        seen = done.data.withColumnsRenamed({v: k for k, v in recipe.names.items()})
        key = [recipe.clean_names.get(k, k) for k in key]
        if lost := [k for k in key if k not in seen.columns or (recipe.plan[k].action != "keep" and recipe.map_kind(k) == "none")]:
            raise BadOriginal(f"the clone doesn't have the key {lost}, kept or aliased", lost)
        # the clone's rows get their ids from the key in the original's values
        held = seen.withColumns({f"__{k}": F.col(f"`{k}`") for k in key})
        for k in key:
            if k in recipe.maps:
                held = alias.translate(held, f"__{k}", recipe.maps[k], "alias", "original")
        rows = unique(with_rid(held, [f"__{k}" for k in key]), key).select(RID, *(F.col(f"`{c}`") for c in seen.columns))
        done.columns, done.joint = audit(unique(with_rid(own, key), key), rows, recipe, RID, list(recipe.conditioning.get("used", ())), tuple(recipe.linked))
    if show:
        print(report(done.columns, done.joint or [], done.mode))
    return done.columns, done.joint or []


def with_rid(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """df with __rid: a text of the key columns, which have to be unique (several as a JSON array); or else a hash of the row and its number among equal rows."""
    if keys:
        texts = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\0")) for k in keys]
        return df.withColumn(RID, texts[0] if len(texts) == 1 else F.to_json(F.array(*texts)))
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    hashed = df.withColumn("__h", F.md5(F.to_json(row)))
    return hashed.withColumn(RID, F.concat_ws("#", "__h", F.row_number().over(Window.partitionBy("__h").orderBy("__h")).cast("string"))).drop("__h")


def unique(source: DataFrame, key: list[str]) -> DataFrame:
    """source, if its row ids are all different; a clone joins on them, so a repeated one would multiply rows."""
    if twice := source.groupBy(RID).count().where("count > 1").limit(1).collect():
        raise BadTable(f"the key {key} has a value for several rows", twice[0][RID])
    return source


def whole_valued(df: DataFrame, cols: list[str]) -> set[str]:
    """The columns all of whose values are whole numbers; one pass."""
    if not cols:
        return set()
    r = df.agg(*(F.coalesce(F.bool_and(F.col(f"`{c}`") == F.floor(F.col(f"`{c}`").cast("double"))), F.lit(False)).alias(c) for c in cols)).first()
    return {c for c in cols if r[c]}


def mask(df: DataFrame | hygiene.Conformance, plan: Plan | None, mode: str | None = None, seed: int | str | None = None, key: list[str] | None = None, clean: str = "auto", alias_names: bool | list[str] = False, use_conditional: bool = False, ladder: str = "hierarchy", coords: list[geo.CoordSpec] | None = None, event_specs: list[events.EventSpec] | None = None, use_grain: bool = True, allow_unmasked_coords: bool = False, allow_kept_outcome: bool = False, shared_maps: dict[str, DataFrame] | None = None, do_audit: bool | None = None) -> Clone:
    """Every column is kept, scrambled, aliased or dropped by plan.  Rows are told apart by key, if given, which has to be unique.

    Of a conformed table the recipe records merges and types, too, and replays them.
    """
    if plan is None:
        raise MissingPlan("masking needs a plan; propose one and review it")
    if ladder not in ("hierarchy", "levels"):
        raise BadLadder(f"a ladder is hierarchy or levels, not {ladder!r}")
    if not isinstance(use_conditional, bool):
        raise BadConditional("use_conditional is true or false")
    if mode is None and plan.mode is None:
        warn(ModeUnset, "no mode is given: the clone is for local use")
    seed = rng.check_seed(seed)
    conformed = df if isinstance(df, hygiene.Conformance) else None
    cleaning = replace(conformed.cleaning, data=nan_to_null(conformed.data)) if conformed else hygiene.clean(nan_to_null(df), clean)
    plan = plan.renamed(cleaning.names).validate(cleaning.data, mode)
    mode, shared = plan.mode, plan.mode == "collaborate"
    maps, permuted, linked = {}, [], dict(shared_maps or {})
    coords, event_specs = coords or [], event_specs or []
    key = [cleaning.names.get(k, k) for k in key] if key else None
    # without a key, ids come from a window over all rows, which every column would compute again
    source = unique(with_rid(cleaning.data, key), key) if key else cut(with_rid(cleaning.data), "mask-source")
    geo.guard(cleaning.data, plan, coords, allow_unmasked_coords)
    timed = [c for s in event_specs for c in s.time + s.status]
    for s in event_specs:
        events.validate(source, s)
        if bad := [c for c in s.time + s.status if plan[c].action != "scramble"]:
            raise BadEvents(f"event columns have to be scrambled: {bad}", bad)
    numeric = [c for c in plan.cols(("outcome", "covariate", "text"), "scramble", NUMERIC) if c not in timed and c not in linked]
    if (numeric or timed or plan.cols(action="scramble")) and (n := source.limit(LEAST_ROWS).count()) < LEAST_ROWS:
        if shared:
            raise TooFewRows(f"{n} rows are too few to re-simulate for others", n)
        warn(FewRows, f"only {n} rows: the clone may repeat them")
    grains = grain.resolve(grain.detect_grain(source, plan, tuple(timed) + tuple(linked)), use_grain, mode)
    by_unit = [c for g in grains if g.synthesised == "unit" for c in g.cols]
    numeric = [c for c in numeric if c not in by_unit]
    # every operator reads the source and gives (rid, its columns): the plan grows by one join each, whatever came before
    conditioning, strata = {}, []
    changes: list[DataFrame] = []
    own = kinds(source)
    types = {f.name: f.dataType for f in source.schema.fields}
    pick = lambda cols: source.select(RID, *(F.col(f"`{c}`") for c in dict.fromkeys(cols) if c != RID))
    protect = plan.cols("treatment")
    cond = plan.cols("treatment") + plan.cols("design", "keep") if use_conditional else []
    if numeric:
        drawn = pick(numeric + cond)
        if cond:
            rung = conditional.ladder(source, [c for c in source.columns if c in cond], protect, numeric, ladder)
            strata = list(rung.used)
            if rung.dropped or rung.fallback > 0:
                warn(ConditionalDegraded, f"conditioning leaves out {list(rung.dropped)}; {100 * rung.fallback:.1f}% of rows are pooled")
            conditioning = asdict(rung)
            drawn = copula.strata(drawn, strata)
            for c in numeric:
                effects, spread = conditional.shift_effects(source, c, list(rung.shifted)) if rung.shifted else ({}, 1.0)
                if gone := [t for t in rung.shifted if t not in effects]:
                    warn(ConditionalDegraded, f"{c} has too few rows for the effects of {gone}, which aren't kept")
                    conditioning.setdefault("unshifted", {})[c] = gone
                if effects:
                    drawn = conditional.shift_column(drawn, effects, f"__shift_{c}").withColumn(c, F.col(f"`{c}`") - F.col(f"__shift_{c}"))
                    mean = F.avg(c).over(Window.partitionBy("__stratum"))
                    drawn = drawn.withColumn(c, mean + (F.col(f"`{c}`") - mean) * spread)
            drawn = copula.resimulate(cut(drawn, "mask-strata"), numeric, RID, seed, by=["__stratum"])
            moved_by = [c for c in numeric if f"__shift_{c}" in drawn.columns]
            whole = whole_valued(source, [c for c in moved_by if own[c] != "integer"])
            for c in moved_by:
                x = F.col(f"`{c}`") + F.col(f"__shift_{c}")
                drawn = drawn.withColumn(c, (F.rint(x) if own[c] == "integer" or c in whole else x).cast(types[c]))
        else:
            drawn = copula.resimulate(drawn, numeric, RID, seed)
        if shared:
            for c in numeric:
                drawn = jitter.jitter(drawn, c, RID, seed, source)
        changes.append(drawn.select(RID, *(F.col(f"`{c}`") for c in numeric)))
    for s in event_specs:
        made, _ = events.synthesise(pick([*s.time, *s.status, *(protect if use_conditional else [])]), s, RID, seed, protect if use_conditional else None, shared)
        changes.append(made.select(RID, *s.time, *s.status))
    moved = [c for c in plan.cols(("covariate", "date", "text"), "scramble", CATEGORICAL + DATES) if c not in by_unit and c not in linked and c not in timed]
    moved += [c for c in plan.cols("covariate", "alias") if c not in by_unit and c not in linked]
    changes += [permute.permuted(source, c, RID, seed) for c in moved]
    for g in grains:
        if g.synthesised == "unit":
            made = grain.synthesise(pick([*g.unit, *g.cols]), g, RID, seed)
            if shared:
                for c in g.cols:
                    if own[c] in NUMERIC:
                        made = _unit_jitter(made, g, c, seed, source)
            changes.append(made.select(RID, *(F.col(f"`{c}`") for c in g.cols)))
    out = source
    for new in changes:
        out = permute.replaced(out, new, RID)
    for c in plan.cols("treatment", "scramble"):
        if c not in linked:
            maps[c] = alias.permuted_map(alias.levels(source, c), seed, c)
            permuted.append(c)
    treated = [c for c in plan.cols("treatment", "alias") if c not in linked]
    for c in treated:
        maps[c] = alias.alias_map(alias.levels(source, c), "trt_" if len(treated) == 1 else f"{c}_trt_", seed, c)
    for role, mark in (("design", "D"), ("id", "I"), ("text", "T"), ("covariate", "L")):
        for c in plan.cols(role, "alias"):
            if c in linked:
                continue
            maps[c] = alias.alias_map(alias.levels(source, c), f"{c}_{mark}", seed, c)
    maps |= {c: m for c, m in linked.items() if c in source.columns}
    for c, m in maps.items():
        out = alias.translate(out, c, m)
    for spec in coords:
        out = geo.geomask(out, spec, seed, RID)
    recipe = Recipe(plan, seed, RID, maps, {}, cleaning.names, cleaning.trimmed, {}, permuted, [asdict(s) for s in coords], [asdict(s) for s in event_specs], [asdict(g) for g in grains], conditioning, allow_kept_outcome)
    recipe.integrity = fingerprint(cleaning.data)
    if conformed:
        recipe.merges = conformed.merges if conformed.applied["merges"] else None
        recipe.types = conformed.types if conformed.applied["types"] else {}
        recipe.type_levels = conformed.levels if conformed.applied["types"] else {}
    recipe.linked = [c for c in linked if c in source.columns]
    for c, m in maps.items():
        if own[c] == "factor" and (was := source.schema[c].metadata.get(LEVELS)):
            # as many as the levels that the schema holds; aliases in their own order give the order of the levels away to nobody
            recipe.factors[c] = {"original": was, "clone": was if c in permuted else [r[0] for r in m.select("alias").orderBy("alias").collect()], "ordered": bool(source.schema[c].metadata.get("ordered"))}
    out = recipe.with_levels(out, "clone")
    kept = [c for c in cleaning.data.columns if c not in recipe.dropped()]
    out = out.select(RID, *(F.col(f"`{c}`") for c in kept))
    clone = Clone(out.drop(RID), recipe, mode)
    if shared if do_audit is None else do_audit:
        out = cut(out, "mask-clone")
        clone.data = out.drop(RID)
        clone.columns, clone.joint = audit(source, out, recipe, RID, strata, tuple(linked))
        if clone.status() == "blocked":
            warn(HighLeakage, f"high findings: {[r['col'] for r in clone.columns if r['leakage_class'] == 'high']}")
    # joins go by the names of links, which stay; a link counts as aliased whatever its plan says
    recipe.names = {c: n for c, n in alias.alias_names(kept, alias_names).items() if c not in recipe.linked}
    recipe.plan = replace(plan, entries=tuple(replace(e, action="alias") if e.col in recipe.linked else e for e in plan.entries))
    recipe.rid = None
    clone.data = clone.data.withColumnsRenamed(recipe.names)
    return clone


def _unit_jitter(df: DataFrame, g: grain.Grain, col: str, seed: str, source: DataFrame) -> DataFrame:
    """One move for all rows of a unit, within the source's resolution."""
    key = F.concat_ws("\r", *(F.coalesce(F.col(f"`{u}`").cast("string"), F.lit("\0")) for u in g.unit))
    keyed = df.withColumn("__unit", key)
    return jitter.jitter(keyed, col, "__unit", seed, source).drop("__unit")
