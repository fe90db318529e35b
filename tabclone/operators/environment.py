"""Multi-environment scope: which columns are the environment, how environments connect through treatments, and what groups them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidEnvironment  # type: ignore[attr-defined]
from ..functions.kinds import kinds
from ..functions.patterns import CATEGORICAL, ENV_EXACT, ENV_PRECOMPOSED, ENV_RESERVED, ENV_SITE, ENV_YEAR, GROUPING, matches
from .design import Answers, Design, Slice, detect_design, judged
from .incidence import components, incidence

if TYPE_CHECKING:
    from ..plans.plan import Plan

#: Components and environments that a report lists; it counts the others.
SHOWN = 1000
COVERAGE, REPLICATED, CONFINED, SHARED = 0.8, 0.5, 0.8, 0.05


@dataclass(frozen=True)
class Candidate:
    cols: tuple[str, ...]
    method: str
    confidence: str
    rank: int
    coverage: float = 0.0
    n_env: int = 0
    valid: bool = False


@dataclass
class Scope:
    status: str
    env: tuple[str, ...] = ()
    candidates: list[Candidate] = field(default_factory=list)
    supporting: list[tuple[str, ...]] = field(default_factory=list)
    connectivity: dict | None = None
    grouping: list[dict] = field(default_factory=list)
    per_env: list[dict] = field(default_factory=list)
    per_env_hidden: int = 0
    blocks: list[str] = field(default_factory=list)  # of the pooled rows, revised by those of the environments
    block_revision: str | None = None


def propose_environments(cols: list[str], treatments: list[str], plan: Plan | None = None) -> list[Candidate]:
    """Candidates by name, best first: exact, precomposed, site with year, site, year."""
    out = set(treatments) | {c for c in cols if matches(c, ENV_RESERVED)}
    if plan:
        out |= set(plan.cols(role=("outcome", "id", "text", "other"))) | set(plan.cols(action="drop")) | {e.col for e in plan.entries if e.pii_suspected}
    free = [c for c in cols if c not in out]
    exact, composed, site, year = ([c for c in free if matches(c, p)] for p in (ENV_EXACT, ENV_PRECOMPOSED, ENV_SITE, ENV_YEAR))
    found = [Candidate((c,), "exact", "high", 1) for c in exact] + [Candidate((c,), "precomposed", "high", 2) for c in composed]
    found += [Candidate((s, y), "site_year", "high", 3) for s in site for y in year]
    return found + [Candidate((c,), "site", "high", 4) for c in site] + [Candidate((c,), "year", "medium", 5) for c in year]


def evaluate(df: DataFrame, c: Candidate, treatment: str | None) -> Candidate:
    """Valid if rows are covered, environments number between 2 and the rows, and some treatment is in two of them.

    Without a treatment, only columns that are given or named exactly like an environment are.
    """
    full = F.lit(True)
    for x in c.cols:
        full &= F.col(f"`{x}`").isNotNull()
    r = df.agg(F.avg(full.cast("int")).alias("coverage"), F.count(F.when(full, 1)).alias("n_obs"), F.count_distinct(*(F.col(f"`{x}`") for x in c.cols)).alias("n_env")).first()
    ok = (r["coverage"] or 0) >= COVERAGE and 2 <= r["n_env"] < r["n_obs"]
    confidence = c.confidence
    if treatment is None:
        ok = ok and c.rank <= 1
    elif ok:
        inc = incidence(df, list(c.cols), treatment)
        ok = (inc.groupBy("t").count().agg(F.max("count")).first()[0] or 0) >= 2
        if c.method == "site":
            replicated = inc.groupBy("b").agg(F.max((F.col("n") >= 2).cast("int")).alias("r")).agg(F.avg("r")).first()[0]
            confidence = confidence if (replicated or 0) >= REPLICATED else "medium"
    return replace(c, coverage=r["coverage"] or 0.0, n_env=r["n_env"], valid=ok, confidence=confidence)


def same_partition(df: DataFrame, a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether two sets of columns part the rows alike: as many levels jointly as apart."""
    r = df.agg(F.count_distinct(*(F.col(f"`{x}`") for x in a)).alias("a"), F.count_distinct(*(F.col(f"`{x}`") for x in b)).alias("b"), F.count_distinct(*(F.col(f"`{x}`") for x in dict.fromkeys(a + b))).alias("ab")).first()
    return r["a"] == r["b"] == r["ab"]


def connectivity(inc: DataFrame) -> dict:
    """Components, their sizes and the overlap of treatments, from incidence(environment, treatment)."""
    if inc.isEmpty():
        return {"status": "not_computed", "reason": "no complete rows"}
    nodes = components(inc)
    side = F.substring("node", 1, 1)
    sizes = nodes.groupBy("component").agg(F.sum((side == "b").cast("int")).alias("n_env"), F.sum((side == "t").cast("int")).alias("n_treatments"))
    parts = [r.asDict() for r in sizes.orderBy("component").limit(SHOWN).collect()]
    n = sizes.count()
    return {"status": "connected" if n == 1 else "disconnected", "components": n, "sizes": parts, "sizes_hidden": n - len(parts), "overlap": overlap(inc).first().asDict()}


def overlap(inc: DataFrame) -> DataFrame:
    """One row: shares of treatments in one, two, three or more environments, and of empty cells."""
    each = inc.groupBy("t").agg(F.count("*").alias("k"))
    share = lambda c: F.avg(c.cast("int"))
    envs = inc.agg(F.count_distinct("b").alias("n_env"))
    told = each.agg(share(F.col("k") == 1).alias("one_environment"), share(F.col("k") == 2).alias("two_environments"), share(F.col("k") >= 3).alias("three_or_more"), F.sum("k").alias("filled"), F.count("*").alias("n_treatments"))
    return told.crossJoin(F.broadcast(envs)).select("one_environment", "two_environments", "three_or_more", (1 - F.col("filled") / (F.col("n_env") * F.col("n_treatments"))).alias("zero_cell_fraction"), "n_treatments")


def grouping(df: DataFrame, group: str, treatment: str) -> DataFrame:
    """One row: how far treatments are confined to one group, and what that makes of the grouping."""
    inc = incidence(df, group, treatment)
    each = inc.groupBy("t").agg(F.count("*").alias("k"))
    told = each.agg(F.count("*").alias("n_treatments"), F.avg((F.col("k") == 1).cast("int")).alias("confined_fraction"), F.coalesce(F.sum((F.col("k") > 1).cast("int")), F.lit(0)).alias("shared_treatments"))
    told = told.crossJoin(F.broadcast(inc.agg(F.count_distinct("b").alias("n_groups"))))
    fits = (F.col("n_groups") >= 2) & (F.col("confined_fraction") >= CONFINED) & (F.col("shared_treatments") <= F.greatest(F.lit(1), F.floor(SHARED * F.col("n_treatments"))))
    status = F.when(~F.coalesce(fits, F.lit(False)), "interleaved").when(F.col("shared_treatments") == 0, "exact_partition").otherwise("near_partition")
    return told.select(F.lit(group).alias("col"), "n_groups", "n_treatments", "confined_fraction", "shared_treatments", status.alias("status"))


def _slices(df: DataFrame, env: list[str]) -> DataFrame:
    """The rows that have an environment, with its label as __env in place of its columns."""
    label = F.concat_ws(":", *(F.col(f"`{e}`").cast("string") for e in env))
    return df.dropna(subset=env).withColumn("__env", label).drop(*env)


def per_environment(df: DataFrame, env: list[str], treatment: str, block: str | None) -> DataFrame:
    """A row for each environment from one grouped pass: rows, treatments, replication and blocks."""
    rows = _slices(df, env).dropna(subset=[treatment]).select(F.col("__env").alias("env"), F.col(f"`{treatment}`").alias("t"), (F.col(f"`{block}`") if block else F.lit(None).cast("string")).alias("b"))
    cell = rows.groupBy("env", "t", "b").agg(F.count("*").alias("n"))
    reps = cell.groupBy("env", "t").agg(F.sum("n").alias("reps")).groupBy("env").agg(F.count("*").alias("n_treatments"), F.min("reps").alias("min_reps"), F.max("reps").alias("max_reps"), F.sum("reps").alias("n_rows"))
    blocks = cell.where("b IS NOT NULL").groupBy("env").agg(F.count_distinct("b").alias("n_blocks"))
    return reps.join(blocks, "env", "left").na.fill(0, ["n_blocks"]).select("env", "n_rows", "n_treatments", "min_reps", "max_reps", "n_blocks")


def designs(df: DataFrame, env: list[str], treatments: list[str], plan: Plan | None = None) -> tuple[list[dict], int]:
    """The design of every environment by the whole detector, for the first SHOWN of them, and how many there are besides.

    Each question of a rule is one aggregate for all these environments at once, so jobs don't grow with their number.
    """
    rows = _slices(df, env)
    names = [r["__env"] for r in rows.select("__env").distinct().orderBy("__env").limit(SHOWN + 1).collect()]
    hidden = 0
    if len(names) > SHOWN:
        names = names[:SHOWN]
        hidden = rows.select("__env").distinct().count() - SHOWN
        rows = rows.where(F.col("__env").isin(names))
    answers = Answers(rows, "__env")
    out = []
    for name in names:
        part = Slice(answers, name)
        told = part.columns()
        varied = [c for c in answers.own if told[f"d|{c}"] > 1]
        own = [c for c in treatments if c in varied]
        row = {"env": name, "design": "none", "score": 0.0, "treatment": " + ".join(own), "blocks": "", "spatial": "", "n_rows": told["n"], "n_treatments": 0}
        if told["n"] >= 2 and varied:
            made = judged(part, plan)
            which = "spatial" if made.label == "row-column" else "blocks"
            row |= {"design": made.label, "score": float(made.scores.get(made.label, max(made.scores.values()))), which: (" x " if which == "spatial" else " : ").join(made.blocks)}
            row["n_treatments"] = 0 if not own else told[f"d|{own[0]}"] if len(own) == 1 else part.cells(own, own)["n_b"]
        out.append(row)
    return out, hidden


def revised_blocks(pooled: list[str], per_env: list[dict]) -> tuple[str, list[str]]:
    """The blocks on which all environments agree, or none, and what that makes of those of the pooled rows."""
    bases = {r["blocks"] for r in per_env}
    agreed = [b for b in bases.pop().split(" : ") if b] if len(bases) == 1 else []
    return "unchanged" if set(agreed) == set(pooled) else "consensus" if agreed else "cleared", agreed


def recommend(df: DataFrame, scope: Scope, mode: str) -> list[dict]:
    """What the scope asks of a plan: col, role, action and reason.  Labels of a sure environment are aliased in a shared clone;
    a doubtful one, and all that compete, stay as they are."""
    if scope.status in ("disabled", "single"):
        return []
    own, sure = kinds(df), scope.status == "multi"
    cols = scope.env if scope.status != "ambiguous" else tuple(dict.fromkeys(c for x in scope.candidates if x.valid for c in x.cols))
    reason = "the environment" if sure else "perhaps the environment: kept until env is given" if scope.env else "one of several possible environments: kept until env is given"
    return [{"col": c, "role": "design", "action": "alias" if sure and mode == "collaborate" and own[c] in CATEGORICAL else "keep", "reason": reason} for c in cols]


def overlay(plan: Plan, df: DataFrame, scope: Scope) -> Plan:
    """The plan with what the scope recommends, but for personal data and for actions that were given."""
    for r in recommend(df, scope, plan.mode):
        if r["col"] in plan.proposed and not plan[r["col"]].pii_suspected:
            plan = plan.set(r["col"], role=r["role"], action=r["action"])
    return plan


def detect_scope(df: DataFrame, plan: Plan | None = None, env: list[str] | bool | None = None, design: Design | None = None) -> Scope:
    """The environment given, none (False), or the best valid candidate; two of equal rank that part rows differently are ambiguous."""
    design = design or detect_design(df, plan)
    treatment = design.treatment[0] if design.treatment else None
    if env is False:
        return Scope("disabled")
    if env:
        if bad := [c for c in env if c not in df.columns]:
            raise InvalidEnvironment(f"no such columns: {bad}", bad)
        chosen = evaluate(df, Candidate(tuple(env), "explicit", "high", 0), treatment)
        if chosen.n_env < 2:
            raise InvalidEnvironment("the environment has fewer than two levels", env)
        told = [chosen]
    else:
        told = [evaluate(df, c, treatment) for c in propose_environments(df.columns, design.treatment, plan)]
    valid = sorted((c for c in told if c.valid), key=lambda c: c.rank)
    if not valid:
        return Scope("single", candidates=told)
    best = [c for c in valid if c.rank == valid[0].rank]
    chosen, others = best[0], best[1:]
    if any(not same_partition(df, chosen.cols, c.cols) for c in others):
        return Scope("ambiguous", candidates=told)
    scope = Scope("multi" if chosen.confidence == "high" else "review", chosen.cols, told, [c.cols for c in others])
    if treatment:
        scope.connectivity = connectivity(incidence(df, list(chosen.cols), treatment))
        groups = [c for c in df.columns if matches(c, GROUPING) and c not in chosen.cols]
        scope.grouping = [grouping(df, g, treatment).first().asDict() for g in groups]
        scope.per_env, scope.per_env_hidden = designs(df, list(chosen.cols), design.treatment, plan)
        scope.block_revision, scope.blocks = revised_blocks([] if design.label == "row-column" else design.blocks, scope.per_env)
    return scope
