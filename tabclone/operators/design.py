"""Detection of experimental designs: six scored rules over incidence aggregates, the simpler design winning near-ties."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import kinds
from ..functions.patterns import CATEGORICAL, DESIGN, NUMERIC, OUTCOME, SPATIAL_COL, SPATIAL_ROW, TREATMENT, matches
from .incidence import cells, constant_within, incidence, modal

if TYPE_CHECKING:
    from ..plans.plan import Plan

#: Simpler designs first.
ORDER = ("CRD", "RCBD", "factorial", "IBD/alpha-lattice", "row-column", "split-plot")
THRESHOLD, TIE = 0.5, 0.02


@dataclass
class Candidates:
    n: int
    levels: dict[str, int]
    factors: list[str]
    named_treatments: list[str]
    named_blocks: list[str]
    spatial: tuple[str, str] | None = None
    own_treatments: list[str] = field(default_factory=list)

    def treatment(self) -> str | None:
        for some in (self.own_treatments, self.named_treatments):
            if some:
                return some[0]
        free = [f for f in self.factors if f not in self.named_blocks and f not in (self.spatial or ())]
        if free:
            return max(free, key=lambda c: (self.levels[c], -self.factors.index(c)))
        return self.factors[0] if self.factors else None


@dataclass
class Design:
    label: str
    scores: dict[str, float]
    evidence: dict[str, dict]
    treatment: list[str] = field(default_factory=list)
    blocks: list[str] = field(default_factory=list)
    candidates: Candidates | None = None
    withheld: dict[str, str] = field(default_factory=dict)  # treatments that aren't applied to a plan, and why
    tie: float = TIE

    @property
    def recommended(self) -> list[tuple[str, str]]:
        return [(c, "treatment") for c in self.treatment if c not in self.withheld] + [(c, "design") for c in self.blocks]

    @property
    def close(self) -> list[str]:
        """The two best designs, where they are so near that a user may want to choose."""
        best = sorted((k for k, s in self.scores.items() if s > 0), key=lambda k: (-self.scores[k], ORDER.index(k)))[:2]
        return best if len(best) == 2 and self.label != "none" and self.scores[best[0]] - self.scores[best[1]] <= self.tie else []


class Answers:
    """What the rules ask of rows: every question is one aggregate, for the whole table or for all slices at once, and is asked once.

    by names the column that parts the rows into slices, of which the asker keeps a bounded number.
    """

    def __init__(self, df: DataFrame, by: str | None = None):
        self.df, self.by, self.kept = df, [by] if by else [], {}
        self.own = {c: k for c, k in kinds(df).items() if k in CATEGORICAL + NUMERIC and c != by}
        self.whole = [c for c, k in self.own.items() if k in NUMERIC and (matches(c, SPATIAL_ROW) or matches(c, SPATIAL_COL))]

    def ask(self, question: tuple, make: Callable[[], DataFrame]) -> dict[str | None, dict]:
        if question not in self.kept:
            self.kept[question] = {r[self.by[0]] if self.by else None: r.asDict() for r in make().collect()}
        return self.kept[question]


@dataclass
class Slice:
    """The answers for one slice, or for the whole table."""

    answers: Answers
    at: str | None = None

    def columns(self) -> dict:
        """n, the distinct values d|column, and whether the values of w|column are whole."""
        a = self.answers
        asked = [F.count(F.lit(1)).alias("n"), *(F.count_distinct(F.col(f"`{c}`")).alias(f"d|{c}") for c in a.own)]
        whole = (F.coalesce(F.bool_and(F.col(f"`{c}`") == F.floor(F.col(f"`{c}`").cast("double"))), F.lit(False)).alias(f"w|{c}") for c in a.whole)
        return a.ask(("columns",), lambda: a.df.groupBy(*a.by).agg(*asked, *whole))[self.at]

    def cells(self, block: list[str], treatment: list[str]) -> dict:
        a = self.answers
        told = a.ask(("cells", *block, None, *treatment), lambda: cells(incidence(a.df, block, treatment, a.by), a.by))
        r = dict(told.get(self.at, {"n_b": 0, "n_t": 0, "filled": 0, "lo": None, "hi": None, "n_rows": 0, "squares": 0}))
        r["empty"] = r["n_b"] * r["n_t"] - r["filled"]
        return r

    def modal(self, block: list[str], treatment: list[str], side: str) -> dict:
        a = self.answers
        return a.ask((side, *block, None, *treatment), lambda: modal(incidence(a.df, block, treatment, a.by), side, a.by))[self.at]

    def reps(self, t: str) -> dict:
        """The levels of t, their fewest, most and all rows, and the sum of squares."""
        a, n = self.answers, F.col("count")
        told = a.ask(("reps", t), lambda: a.df.where(F.col(f"`{t}`").isNotNull()).groupBy(*a.by, F.col(f"`{t}`")).count().groupBy(*a.by).agg(F.count("*").alias("k"), F.min(n).alias("lo"), F.max(n).alias("hi"), F.sum(n).alias("n"), F.sum(n * n).alias("sq")))
        return told.get(self.at, {"k": 0, "lo": None, "hi": None, "n": 0, "sq": 0})

    def pairs(self, x: str, y: str) -> int:
        a = self.answers
        return a.ask(("pairs", x, y), lambda: a.df.select(*a.by, F.col(f"`{x}`"), F.col(f"`{y}`")).distinct().groupBy(*a.by).agg(F.count("*").alias("n")))[self.at]["n"]

    def constant(self, unit: str) -> dict:
        """For each column, whether it has one value in every group of unit."""
        a = self.answers
        cols = [c for c in a.own if c != unit]
        one = (F.min(f"`{c}`").eqNullSafe(F.max(f"`{c}`")).alias(c) for c in cols)
        return a.ask(("constant", unit), lambda: a.df.groupBy(*a.by, F.col(f"`{unit}`")).agg(*one).groupBy(*a.by).agg(*(F.bool_and(f"`{c}`").alias(c) for c in cols)))[self.at]


def rows_of(df: DataFrame) -> Slice:
    return Slice(Answers(df))


def candidates(rows: Slice, plan: Plan | None = None) -> Candidates:
    """Columns that could be factors, from one aggregate over kinds, distinct counts and whole values."""
    own, whole, row = rows.answers.own, rows.answers.whole, rows.columns()
    n, levels = row["n"], {c: row[f"d|{c}"] for c in own}
    own_treatments = [c for c in plan.cols(role="treatment") if rows.at is None or levels.get(c, 0) > 1] if plan else []
    out = set() if plan is None else set(plan.cols(role=("outcome", "id", "text", "other"))) | set(plan.cols(action="drop"))
    few, half = max(2, math.ceil(math.sqrt(max(n, 1)))), max(2, n // 2)
    most = {"factor": n, "logical": n, "integer": few, "numeric": few, "character": half}
    factors = [c for c, k in own.items() if c not in out and 2 <= levels[c] <= most[k]]
    rows, cols = ([c for c in whole if matches(c, p) and row[f"w|{c}"] and levels[c] >= 2] for p in (SPATIAL_ROW, SPATIAL_COL))
    return Candidates(n, levels, factors, [c for c in factors if matches(c, TREATMENT)], [c for c in factors if matches(c, DESIGN)], (rows[0], cols[0]) if rows and cols else None, own_treatments)


def revised(rows: Slice, found: Candidates) -> tuple[Candidates, dict[str, str]]:
    """Without covariates: outcome-like names, and columns with one value for each level of a replicated design column."""
    units = [c for c in found.named_blocks if found.levels[c] * 2 <= found.n]
    free = [c for c in found.factors if c not in units and c not in found.own_treatments and not matches(c, TREATMENT) and not matches(c, DESIGN)]
    gone = {c: "named like an outcome" for c in free if matches(c, OUTCOME)}
    rest = [c for c in free if c not in gone]
    for u in units if rest else []:
        fixed = rows.constant(u)
        for c in rest:
            if fixed[c]:
                gone.setdefault(c, f"one value for each {u}")
    kept = [c for c in found.factors if c not in gone]
    return Candidates(found.n, found.levels, kept, [c for c in found.named_treatments if c in kept], [c for c in found.named_blocks if c in kept], found.spatial, found.own_treatments), gone


def spread(n_cells: int, total: float, squares: float) -> float:
    """The coefficient of variation of cells with this sum and sum of squares, empty ones included."""
    if n_cells < 1 or total <= 0:
        return math.inf
    mean = total / n_cells
    var = max(0.0, (squares - n_cells * mean * mean) / (n_cells - 1)) if n_cells > 1 else 0.0
    return math.sqrt(var) / mean


def _zero(reason: str) -> tuple[float, dict]:
    return 0.0, {"reason": reason}


def score_crd(rows: Slice, c: Candidates) -> tuple[float, dict]:
    if (t := c.treatment()) is None:
        return _zero("no treatment")
    reps = rows.reps(t)
    if reps["k"] < 2 or reps["lo"] < 2:
        return _zero("no replication")
    balance = max(0.0, 1 - spread(reps["k"], reps["n"], reps["sq"]))
    penalty = 0.0
    for b in c.factors:
        if b != t:
            s = rows.cells([b], [t])
            if s["n_b"] >= 2 and s["n_t"] >= 2 and s["empty"] == 0 and s["lo"] == s["hi"]:
                penalty = 0.6
                break
    return max(0.0, balance - penalty), {"treatment": [t], "blocks": [], "balance": balance, "penalty": penalty, "reps": (reps["lo"], reps["hi"])}


def score_rcbd(rows: Slice, c: Candidates) -> tuple[float, dict]:
    t = c.treatment()
    best = _zero("no balanced treatment and named block")
    for b in c.named_blocks if t else []:
        if b == t:
            continue
        s = rows.cells([b], [t])
        if s["n_b"] >= 2 and s["n_t"] >= 2 and s["empty"] == 0 and s["lo"] == s["hi"]:
            coverage = min(1.0, s["n_rows"] / max(c.n, 1))
            score = min(1.0, 0.85 * coverage + 0.1)
            if score > best[0]:
                best = score, {"treatment": [t], "blocks": [b], "coverage": coverage, "cell": s["lo"]}
    return best


def score_ibd(rows: Slice, c: Candidates) -> tuple[float, dict]:
    t = c.treatment()
    best = _zero("no regular incomplete blocks")
    free = [f for f in c.factors if f != t]
    for basis in [[f] for f in free] + [list(p) for p in combinations(free, 2)] if t else []:
        s = rows.cells(basis, [t])
        if s["n_b"] < 3 or s["n_t"] < 2:
            continue
        k, r = rows.modal(basis, [t], "b"), rows.modal(basis, [t], "t")
        if not (2 <= k["mode"] < s["n_t"] and r["mode"] >= 2 and k["share"] >= 0.9 and r["share"] >= 0.9):
            continue
        balanced = s["n_t"] * r["mode"] == s["n_b"] * k["mode"]
        score = 0.65 * (k["share"] + r["share"]) / 2 + 0.1 * (k["mode"] / s["n_t"] < 0.9) + 0.1 * all(b in c.named_blocks for b in basis) + 0.15 * balanced + 0.05 * (len(basis) == 2)
        if min(1.0, score) > best[0]:
            best = min(1.0, score), {"treatment": [t], "blocks": basis, "k": k["mode"], "r": r["mode"], "balanced": balanced}
    return best


def score_row_column(rows: Slice, c: Candidates) -> tuple[float, dict]:
    if c.spatial is None:
        return _zero("no pair of row and column")
    row, col = c.spatial
    fill = rows.pairs(row, col) / (c.levels[row] * c.levels[col])
    if (t := c.treatment()) is None:
        return 0.3 * fill, {"treatment": [], "blocks": [row, col], "fill": fill}
    balance = []
    for x in (row, col):
        s = rows.cells([x], [t])
        balance.append(max(0.0, 1 - spread(s["n_b"] * s["n_t"], s["n_rows"], s["squares"])))
    return min(1.0, 0.3 * fill + 0.35 * balance[0] + 0.35 * balance[1]), {"treatment": [t], "blocks": [row, col], "fill": fill, "balance": balance}


def score_split_plot(rows: Slice, c: Candidates) -> tuple[float, dict]:
    best = _zero("no block with whole and sub plots")
    free = [f for f in c.factors if f not in c.named_blocks]
    for b in c.named_blocks if len(c.factors) >= 3 else []:
        for pair in combinations(free, 2):
            if c.levels[pair[0]] == c.levels[pair[1]] or min(c.levels[pair[0]], c.levels[pair[1]], c.levels[b]) < 2:
                continue
            whole, sub = sorted(pair, key=lambda x: c.levels[x])
            s = rows.cells([b, whole], [sub])
            coverage, uniform = s["filled"] / (c.levels[b] * c.levels[whole] * c.levels[sub]), s["lo"] == s["hi"]
            score = min(1.0, 0.6 * coverage + 0.3 * uniform + 0.1)
            if score > best[0]:
                best = score, {"treatment": [whole, sub], "blocks": [b], "coverage": coverage, "uniform": uniform}
    return best


def score_factorial(rows: Slice, c: Candidates) -> tuple[float, dict]:
    best = _zero("no crossed pair of treatments")
    for a, b in combinations([f for f in c.factors if f not in c.named_blocks], 2):
        s = rows.cells([a], [b])
        if s["n_b"] < 2 or s["n_t"] < 2 or s["empty"]:
            continue
        balance = max(0.0, 1 - spread(s["filled"], s["n_rows"], s["squares"]))
        score = min(1.0, 0.7 * balance + 0.1 * (a in c.named_treatments) + 0.1 * (b in c.named_treatments))
        if score > best[0]:
            best = score, {"treatment": [a, b], "blocks": [], "balance": balance}
    return best


RULES = {"CRD": score_crd, "RCBD": score_rcbd, "factorial": score_factorial, "IBD/alpha-lattice": score_ibd, "row-column": score_row_column, "split-plot": score_split_plot}


def pick(scores: dict[str, float], threshold: float = THRESHOLD, tie: float = TIE) -> str:
    """The simplest design within tie of the best score, if that reaches the threshold."""
    best = max(scores.values(), default=0.0)
    return "none" if best < threshold else next(x for x in ORDER if scores.get(x, 0.0) >= best - tie)


def crossed(df: DataFrame, unit: str, col: str) -> bool:
    """More pairs than units and than values: both occur in several of the other."""
    r = cells(incidence(df, unit, col)).first()
    return r["filled"] > r["n_b"] and r["filled"] > r["n_t"]


def withheld(df: DataFrame, plan: Plan | None, found: Candidates, treatments: list[str]) -> dict[str, str]:
    """Why treatments that only the rules found are not applied: no such name, and no sign of being crossed with a design column."""
    own, out = kinds(df), {}
    roles = {e.col: e.role for e in plan.entries} if plan else {}
    gone = set(plan.cols(action="drop")) if plan else set()
    design = [c for c in df.columns if c not in gone and (roles.get(c) == "design" or (matches(c, DESIGN) and roles.get(c, "design") == "design"))]
    units = [u for u in design if 2 <= found.levels.get(u, 0) <= found.n / 2]
    for c in treatments:
        if matches(c, TREATMENT) or c in found.own_treatments:
            continue
        others = [u for u in units if u != c]
        if matches(c, DESIGN):
            out[c] = "named like a design column"
        elif own[c] in NUMERIC and not df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`")).count().where("count < 2").isEmpty():
            out[c] = "numbers with values that occur once are a measurement"
        elif not others:
            out[c] = "no design column crosses it"
        elif fixed := next((r["unit"] for r in constant_within(df, {u: [u] for u in others}, [c]).collect() if r[c]), None):
            out[c] = f"one value for each {fixed}"
        elif not any(crossed(df, u, c) for u in others):
            out[c] = "not crossed with any design column"
    return out


def judged(rows: Slice, plan: Plan | None = None, threshold: float = THRESHOLD, tie: float = TIE) -> Design:
    """The design of a slice, from the scores of all rules."""
    found, gone = revised(rows, candidates(rows, plan))
    told = {k: rule(rows, found) for k, rule in RULES.items()}
    scores = {k: s for k, (s, _) in told.items()}
    label = pick(scores, threshold, tie)
    evidence = {k: e for k, (_, e) in told.items()} | {"excluded": gone}
    own = evidence.get(label, {})
    return Design(label, scores, evidence, own.get("treatment", []), own.get("blocks", []), found, {}, tie)


def detect_design(df: DataFrame, plan: Plan | None = None, threshold: float = THRESHOLD, tie: float = TIE) -> Design:
    made = judged(rows_of(df), plan, threshold, tie)
    made.withheld = withheld(df, plan, made.candidates, made.treatment)
    return made
