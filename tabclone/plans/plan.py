"""The masking plan: what every column is (role) and what is done to it (action), reviewed before it runs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..errors import AllKeep, BadPlan, EnvironmentDisclosure, ModeDowngrade, PlanModeMismatch, warn  # type: ignore[attr-defined]
from ..functions.kinds import kinds
from ..functions.patterns import ACTIONS, CATEGORICAL, DATES, DESIGN, ENV_EXACT, ENV_SITE, ENV_YEAR, ID, KINDS, NUMERIC, OUTCOME, PII, ROLES, TREATMENT, matches
from ..operators.profile import Profile, profile

MODES = ("local", "collaborate")
#: Units under which a shared clone draws no value for each unit.
LEAST_UNITS = 5


def default_action(role: str, kind: str, mode: str) -> str:
    shared = mode == "collaborate"
    if role == "treatment":
        return "alias" if shared and kind in CATEGORICAL + NUMERIC else "keep"
    if role == "outcome":
        return "scramble" if kind in NUMERIC else "keep"
    if role == "covariate":
        if kind == "other":
            return "keep"
        return "alias" if shared and kind in CATEGORICAL else "scramble"
    if role == "date":
        return "scramble"
    if role in ("id", "text"):
        return "drop" if shared else "keep"
    return "keep"


#: (role, action) -> the kinds it is valid for, besides keep and drop, which always are.
VALID: dict[tuple[str, str], tuple[str, ...]] = {
    ("design", "alias"): CATEGORICAL,
    ("treatment", "scramble"): CATEGORICAL + NUMERIC,
    ("treatment", "alias"): CATEGORICAL + NUMERIC,
    ("outcome", "scramble"): NUMERIC,
    ("covariate", "scramble"): CATEGORICAL + NUMERIC + DATES,
    ("covariate", "alias"): CATEGORICAL,
    ("date", "scramble"): DATES,
    ("id", "alias"): ("factor", "character") + NUMERIC,
    ("text", "scramble"): CATEGORICAL + NUMERIC + DATES,
    ("text", "alias"): ("factor", "character"),
}


def problem(role: str, action: str, kind: str) -> str | None:
    """Why an action isn't valid for a role and kind, if so."""
    if role not in ROLES or action not in ACTIONS or kind not in KINDS:
        return f"unknown role, action or kind: {role}, {action}, {kind}"
    if action in ("keep", "drop"):
        return None
    if kind == "other":
        return "columns of kind other can only be kept or dropped"
    if (role, action) not in VALID:
        return f"{role} columns can't be given the action {action}"
    return None if kind in VALID[role, action] else f"{action} of a {role} column needs one of: {', '.join(VALID[role, action])}"


def role_options(kind: str | None = None) -> list[dict]:
    """The grid of roles and actions with the kinds each is valid for, and why not for others; only what is valid for kind, if given."""
    rows = []
    for role in ROLES:
        for action in ACTIONS:
            why = {k: problem(role, action, k) for k in KINDS}
            fits = [k for k in KINDS if why[k] is None]
            # what is said of the role tells more than what is said of the kind other
            reasons = [w for k, w in sorted(why.items(), key=lambda x: x[0] == "other") if w]
            if kind is None or kind in fits:
                rows.append({"role": role, "action": action, "kinds": ", ".join(fits), "valid": bool(fits), "notes": reasons[0] if reasons else ""})
    return rows


@dataclass(frozen=True)
class Entry:
    col: str
    role: str
    action: str | None
    kind: str
    freq_or_range: str = ""
    pii_suspected: bool = False
    notes: str = ""


@dataclass(frozen=True)
class Plan:
    entries: tuple[Entry, ...]
    mode: str = "local"
    proposed: frozenset[str] = frozenset()  # columns still on the default action of their role
    design: object = field(default=None, compare=False)

    def __getitem__(self, col: str) -> Entry:
        for e in self.entries:
            if e.col == col:
                return e
        raise BadPlan(f"no column {col!r} in the plan", col)

    def cols(self, role: str | Iterable[str] | None = None, action: str | Iterable[str] | None = None, kind: Iterable[str] | None = None) -> list[str]:
        roles, actions = (x if x is None or not isinstance(x, str) else (x,) for x in (role, action))
        return [e.col for e in self.entries if (roles is None or e.role in roles) and (actions is None or e.action in actions) and (kind is None or e.kind in kind)]

    def set(self, cols: str | Iterable[str], role: str | None = None, action: str | None = None) -> Plan:
        """A new role resolves the default action anew; a given action is pinned."""
        names = [cols] if isinstance(cols, str) else list(cols)
        known = {e.col for e in self.entries}
        if missing := [c for c in names if c not in known]:
            raise BadPlan(f"columns not in the plan: {missing}", missing)
        if role is None and action is None:
            raise BadPlan("neither a role nor an action is given")
        out, pinned = [], set(self.proposed)
        for e in self.entries:
            if e.col in names:
                new_role = role or e.role
                new_action = action or (default_action(new_role, e.kind, self.mode) if role else e.action)
                if why := problem(new_role, new_action or "keep", e.kind):
                    raise BadPlan(f"{e.col}: {why}", e.col)
                pinned = pinned - {e.col} if action else pinned | {e.col}
                e = replace(e, role=new_role, action=new_action)
            out.append(e)
        return replace(self, entries=tuple(out), proposed=frozenset(pinned))

    def validate(self, df: DataFrame, mode: str | None = None) -> Plan:
        """Checks the plan against df, in df's order; missing actions become defaults, and proposed ones follow the mode."""
        mode = mode or self.mode
        if mode not in MODES:
            raise BadPlan(f"a mode is one of {MODES}, not {mode!r}")
        names = [e.col for e in self.entries]
        if dup := sorted({c for c in names if names.count(c) > 1}):
            raise BadPlan(f"columns named twice: {dup}", dup)
        if set(names) != set(df.columns):
            raise BadPlan(f"plan and table differ in {sorted(set(names) ^ set(df.columns))}", sorted(set(names) ^ set(df.columns)))
        now, out, wrong = kinds(df), [], []
        if mode != self.mode:
            warn(ModeDowngrade if mode == "local" else PlanModeMismatch, f"the plan was made for {self.mode} and runs as {mode}")
        for c in df.columns:
            e = replace(self[c], kind=now[c])
            if e.role not in ROLES:
                wrong.append(f"{c}: unknown role {e.role!r}")
                continue
            if e.action is None or (mode != self.mode and c in self.proposed and not e.pii_suspected):
                e = replace(e, action=default_action(e.role, e.kind, mode))
            if why := problem(e.role, e.action or "keep", e.kind):
                wrong.append(f"{c}: {why}")
            out.append(e)
        if wrong:
            raise BadPlan("; ".join(wrong), wrong)
        if out and all(e.action == "keep" for e in out):
            warn(AllKeep, "every column is kept: the clone is the original")
        return replace(self, entries=tuple(out), mode=mode)

    def renamed(self, names: dict[str, str]) -> Plan:
        if all(e.col in names.values() for e in self.entries):
            return self
        return replace(self, entries=tuple(replace(e, col=names.get(e.col, e.col)) for e in self.entries), proposed=frozenset(names.get(c, c) for c in self.proposed))

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(e.col, e.role, e.action, e.kind, e.freq_or_range, e.pii_suspected, e.notes) for e in self.entries]
        return spark.createDataFrame(rows, "col string, role string, action string, kind string, freq_or_range string, pii_suspected boolean, notes string")


def _classify(p: Profile, mode: str) -> Entry:
    shared = mode == "collaborate"
    if matches(p.col, PII):
        role = "text" if p.kind in ("character", "factor") else "date" if p.kind in DATES else "other" if p.kind == "other" else "covariate"
        return Entry(p.col, role, "drop", p.kind, p.summary(), True, "personal data by its name: dropped in both modes unless its role is set")
    if p.kind in DATES:
        role, note = "date", "dates are permuted over rows"
    elif matches(p.col, ID):
        role, note = "id", "an identifier by its name: " + ("dropped; alias it to keep links" if shared else "kept; alias it to hide values")
    elif matches(p.col, DESIGN):
        return Entry(p.col, "design", "keep", p.kind, p.summary(), False, "a design column by its name")
    elif matches(p.col, TREATMENT):
        role, note = "treatment", "a treatment by its name"
    elif p.kind in NUMERIC and matches(p.col, OUTCOME):
        role, note = "outcome", "an outcome by its name: re-simulated"
    elif p.kind == "character" and p.n and p.distinct / p.n > 0.5:
        role, note = "text", "free text by its number of values"
    elif p.kind == "other":
        role, note = "other", "no supported type: kept as it is"
    else:
        role, note = "covariate", "a covariate by default"
    return Entry(p.col, role, default_action(role, p.kind, mode), p.kind, p.summary(), False, note)


def _with_grain(plan: Plan, df: DataFrame) -> Plan:
    """Notes on columns with one value a unit, which are drawn once a unit; a shared clone needs so many units."""
    from ..operators.grain import detect_grain

    of = {c: ":".join(g.unit) for g in detect_grain(df, plan) if plan.mode == "local" or g.n_units >= LEAST_UNITS for c in g.cols}
    return replace(plan, entries=tuple(replace(e, notes=f"{e.notes}; one value for each {of[e.col]}, drawn once for each") if e.col in of else e for e in plan.entries))


def propose(df: DataFrame, mode: str = "local", detect: bool = True) -> Plan:
    """A plan from names, types and one profiling pass; a detected design may add to it, but never overrides a pinned action."""
    if mode not in MODES:
        raise BadPlan(f"a mode is one of {MODES}, not {mode!r}")
    entries = [_classify(p, mode) for p in profile(df)]
    plan = Plan(tuple(entries), mode, frozenset(e.col for e in entries))
    if detect:
        from ..operators.design import detect_design

        found = detect_design(df, plan)
        plan = replace(plan, design=found)
        for col, role in found.recommended:
            if plan[col].role in ("covariate", "text") and not plan[col].pii_suspected:
                plan = plan.set(col, role=role)
    plan = _with_grain(plan, df)
    if mode == "collaborate" and (kept := [e.col for e in plan.entries if e.kind in NUMERIC and e.action == "keep" and any(matches(e.col, p) for p in (ENV_EXACT, ENV_SITE, ENV_YEAR))]):
        warn(EnvironmentDisclosure, f"numeric environments are kept and visible: {kept}")
    return plan
