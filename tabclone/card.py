"""The data card: counts of a clone for those who get it, each with where it comes from; written as deterministic YAML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import BadCard  # type: ignore[attr-defined]
from .functions.kinds import LEVELS, kinds
from .mask import Clone

VERSION = "0.1"


def card_columns(df: DataFrame) -> DataFrame:
    """col, kind, n_missing, missing_share (six decimals) and n_distinct; one pass."""
    own = {c: k for c, k in kinds(df).items() if k != "other"}
    x = lambda c: F.col(f"`{c}`")
    wide = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(x(c).isNull(), 1)).alias(f"m|{c}") for c in own), *(F.count_distinct(x(c)).alias(f"d|{c}") for c in own))
    rows = F.array(*(F.struct(F.lit(c).alias("col"), F.lit(k).alias("kind"), F.col(f"`m|{c}`").alias("n_missing"), F.round(F.col(f"`m|{c}`") / F.col("n"), 6).alias("missing_share"), F.col(f"`d|{c}`").alias("n_distinct")) for c, k in own.items()))
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def data_card(clone: Clone, name: str, env: str | None = None, spatial: tuple[str, str] | None = None, unit: str | None = None, primary_event: int = 1) -> dict:
    if not name or not name.strip():
        raise BadCard("a card needs a name")
    df = clone.data
    chosen = [c for c in (env, unit, *(spatial or ())) if c]
    if bad := [c for c in chosen if c not in df.columns]:
        raise BadCard(f"no such columns: {bad}", bad)
    roles = {r["col"]: r for r in clone.public_roles()}
    cols = []
    for r in card_columns(df).collect():
        field = df.schema[r["col"]]
        structure = roles[r["col"]]["role"] in ("design", "treatment") and roles[r["col"]]["action"] in ("keep", "alias")
        kind = "ordered" if (field.metadata or {}).get("ordered") else "factor" if LEVELS in (field.metadata or {}) else r["kind"]
        cols.append({"name": r["col"], "role": roles[r["col"]]["role"], "kind": kind, "missing": {"value": r["n_missing"], "source": "structure"}, "missing_share": {"value": r["missing_share"], "source": "structure"}, "distinct": {"value": r["n_distinct"], "source": "structure" if structure else "clone_estimate"}})
    card = {"card_version": VERSION, "name": name, "mode": clone.mode, "rows": {"value": df.count(), "source": "structure"}, "columns": cols}
    for k, v in (("environment", env), ("unit", unit), ("spatial", list(spatial) if spatial else None)):
        if v:
            card[k] = {"value": v, "source": "analyst"}
    if clone.recipe.events:
        if not 1 <= primary_event <= len(clone.recipe.events):
            raise BadCard(f"there is no event {primary_event}")
        spec = clone.recipe.events[primary_event - 1]
        named = [clone.recipe.names.get(s, s) for s in spec["status"]]
        counted = df.groupBy(F.concat_ws("/", *(F.col(f"`{s}`").cast("string") for s in named)).alias("p")).count().orderBy("p").collect()
        card["events"] = {"status": named, "patterns": [{"pattern": r["p"], "rows": r["count"]} for r in counted], "source": "structure"}
    return card


def to_yaml(value: object, depth: int = 0) -> str:
    """Keys in the order given, texts in quotes, shares with six decimals."""
    pad = "  " * depth
    if isinstance(value, dict):
        return "".join(f"{pad}{k}:{_inline(v) if not _nested(v) else chr(10) + to_yaml(v, depth + 1)}" for k, v in value.items())
    out = ""
    for v in value:
        if isinstance(v, dict):
            body = to_yaml(v, depth + 1)
            out += f"{pad}- {body[len(pad) + 2 :]}"
        else:
            out += f"{pad}-{_inline(v)}"
    return out


def _nested(v: object) -> bool:
    return isinstance(v, (dict, list)) and len(v) > 0


def _inline(v: object) -> str:
    if v is None:
        return " null\n"
    if isinstance(v, bool):
        return f" {str(v).lower()}\n"
    if isinstance(v, float):
        return f" {v:.6f}\n"
    if isinstance(v, int):
        return f" {v}\n"
    if isinstance(v, (dict, list)):
        return " {}\n" if isinstance(v, dict) else " []\n"
    text = str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    return f' "{text}"\n'


def write_card(card: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.write(to_yaml(card))


def replication_tile(df: DataFrame, block: str, treatment: str) -> DataFrame:
    """Plot data: rows for every pair of block and treatment, empty ones too (both sides are levels of a design)."""
    from .operators.incidence import incidence

    inc = incidence(df, block, treatment)
    grid = inc.select("b").distinct().join(inc.select("t").distinct())
    return grid.join(inc, ["b", "t"], "left").select("b", "t", F.coalesce("n", F.lit(0)).alias("n"))


def na_panel(df: DataFrame) -> DataFrame:
    """Plot data: missing cells of every column."""
    return card_columns(df).select("col", "n_missing", "missing_share")


def nesting(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Plot data of a nesting tree: inner levels and rows for each outer level."""
    x, y = F.col(f"`{outer}`").cast("string"), F.col(f"`{inner}`")
    return df.dropna(subset=[outer, inner]).groupBy(x.alias("outer")).agg(F.count_distinct(y).alias("n_inner"), F.count("*").alias("n"))


def frequencies(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(f"`{col}`").cast("string").alias("level")).agg(F.count("*").alias("n"))


def environments(df: DataFrame, env: list[str], treatment: str) -> DataFrame:
    """Plot data of the overview of environments: rows and treatments of each."""
    name = F.concat_ws(":", *(F.col(f"`{e}`").cast("string") for e in env))
    return df.dropna(subset=env).groupBy(name.alias("env")).agg(F.count("*").alias("n"), F.count_distinct(F.col(f"`{treatment}`")).alias("n_treatments"))


def spatial_tile(df: DataFrame, row: str, col: str, treatment: str) -> DataFrame:
    """Plot data of a field: rows, the (first) treatment and the number of treatments at every occupied position."""
    t = F.col(f"`{treatment}`")
    return df.dropna(subset=[row, col]).groupBy(F.col(f"`{row}`").alias("y"), F.col(f"`{col}`").alias("x")).agg(F.count("*").alias("n"), F.min(t.cast("string")).alias("treatment"), F.count_distinct(t).alias("n_treatments"))


def factorial_tile(df: DataFrame, a: str, b: str, outcome: str | None = None) -> DataFrame:
    """Plot data of two crossed treatments: rows and the outcome's mean for every pair, empty ones too."""
    x, y = F.col(f"`{a}`").cast("string").alias("a"), F.col(f"`{b}`").cast("string").alias("b")
    mean = F.avg(F.col(f"`{outcome}`")) if outcome else F.lit(None).cast("double")
    found = df.dropna(subset=[a, b]).groupBy(x, y).agg(F.count("*").alias("n"), mean.alias("mean"))
    grid = found.select("a").distinct().join(found.select("b").distinct())
    return grid.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"), "mean")
