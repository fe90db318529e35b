"""The private recipe of a clone: it replays the translation on the original, inverts it, and is never shown by accident."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadRecipeFile, IntegrityMismatch, MissingColumn, VersionNote, warn  # type: ignore[attr-defined]
from ..functions.kinds import as_factor, nan_to_null
from ..operators.alias import check, translate
from .plan import Entry, Plan

VERSION = "1"


def fingerprint(df: DataFrame, rid: str | None = None) -> str:
    """Where values are missing, whatever the order of rows: counts, and a sum of hashes of row id and null bitmap."""
    cols = sorted(c for c in df.columns if c != rid)
    bits = F.concat(*(F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in cols)) if cols else F.lit("")
    key = F.col(f"`{rid}`").cast("string") if rid else F.lit("")
    mark = F.conv(F.substring(F.md5(F.concat_ws("|", key, bits)), 1, 12), 16, 10).cast("decimal(38,0)")
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(mark).alias("s"), *(F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"m{i}") for i, c in enumerate(cols)))
    parts = F.concat_ws(",", F.lit("|".join(cols)), F.col("n").cast("string"), F.coalesce(F.col("s").cast("string"), F.lit("0")), *(F.col(f"m{i}").cast("string") for i in range(len(cols))))
    return r.select(F.sha2(parts, 256)).first()[0]


@dataclass
class Recipe:
    plan: Plan
    seed: str
    rid: str
    maps: dict[str, DataFrame] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)  # column names of the plan -> of the clone
    clean_names: dict[str, str] = field(default_factory=dict)  # original names -> of the plan
    trimmed: list[str] = field(default_factory=list)
    types: dict[str, str] = field(default_factory=dict)  # what conforming read text columns as
    permuted: list[str] = field(default_factory=list)
    coords: list[dict] = field(default_factory=list)
    events: list[dict] = field(default_factory=list)
    grain: list[dict] = field(default_factory=list)
    conditioning: dict = field(default_factory=dict)
    allow_kept_outcome: bool = False
    allow_high: bool = False
    integrity: str = ""
    type_levels: dict[str, list[str]] = field(default_factory=dict)
    merges: DataFrame | None = None  # labels that conforming merged
    linked: list[str] = field(default_factory=list)
    factors: dict[str, dict] = field(default_factory=dict)  # mapped factors: their levels before and after
    version: str = VERSION

    def __repr__(self) -> str:
        return f"Recipe({len(self.plan.entries)} columns, mode {self.plan.mode}, {len(self.maps)} maps; private)"

    def mapped(self) -> list[str]:
        return list(self.maps)

    def map_kind(self, col: str) -> str:
        return "none" if col not in self.maps else "permuted" if col in self.permuted else "aliased"

    def dropped(self) -> list[str]:
        return [e.col for e in self.plan.entries if e.action == "drop" and e.col not in self.maps]

    def _cleaned(self, df: DataFrame) -> DataFrame:
        """What masking did before it masked: names, trimming, one kind of missing value, merged labels and types."""
        from ..operators.hygiene import merged, trim_columns, typed

        done = nan_to_null(df.withColumnsRenamed({k: v for k, v in self.clean_names.items() if k in df.columns}))
        done = trim_columns(done, [c for c in self.trimmed if c in done.columns])
        return typed(merged(done, self.merges), self.types, self.type_levels)

    def with_levels(self, df: DataFrame, side: str) -> DataFrame:
        for c, own in self.factors.items():
            if c in df.columns:
                df = as_factor(df, c, own[side], own["ordered"])
        return df

    def forward(self, original: DataFrame, check_integrity: bool = True, eager: bool = False) -> DataFrame:
        """The original in the clone's labels and names, so that a finished pipeline runs on it.  A stream is never checked."""
        done = self._cleaned(original)
        kept = [e.col for e in self.plan.entries if e.col not in self.dropped()]
        if missing := [c for c in kept if c not in done.columns]:
            raise MissingColumn(f"columns of the recipe are missing: {missing}", missing)
        if check_integrity and not original.isStreaming and self.integrity and fingerprint(done, self.rid) != self.integrity:
            raise IntegrityMismatch("the table is not the one the recipe was made from: its missing values differ")
        done = done.select(*(F.col(f"`{c}`") for c in kept))
        for c, m in self.maps.items():
            if eager and not original.isStreaming:
                check(done, c, m)
            done = translate(done, c, m)
        return self.with_levels(done, "clone").withColumnsRenamed(self.names)

    def inverse(self, df: DataFrame, eager: bool = False) -> DataFrame:
        """A table in the clone's labels and names (any of its columns) back in the original's."""
        done = df.withColumnsRenamed({v: k for k, v in self.names.items() if v in df.columns})
        for c, m in self.maps.items():
            if c in done.columns:
                if eager and not df.isStreaming:
                    check(done, c, m, "alias")
                done = translate(done, c, m, "alias", "original")
        return self.with_levels(done, "original").withColumnsRenamed({v: k for k, v in self.clean_names.items() if v in done.columns})

    def reveal(self) -> dict:
        """The only way to see the maps and the seed."""
        return {"seed": self.seed, "maps": self.maps, "names": self.names}

    def save(self, path: str) -> None:
        """A folder: recipe.json beside a Parquet table for each map.  No code is stored."""
        spark = SparkSession.getActiveSession()
        own = {k: v for k, v in self.__dict__.items() if k not in ("plan", "maps", "merges")}
        own["plan"] = {"mode": self.plan.mode, "proposed": sorted(self.plan.proposed), "entries": [asdict(e) for e in self.plan.entries]}
        own["maps"], own["merges"] = list(self.maps), self.merges is not None
        if self.merges is not None:
            self.merges.write.parquet(f"{path}/merges")
        for i, m in enumerate(self.maps.values()):
            m.write.parquet(f"{path}/map-{i}")
        spark.createDataFrame([(json.dumps(own),)], "recipe string").coalesce(1).write.text(f"{path}/recipe")

    @staticmethod
    def load(path: str) -> Recipe:
        spark = SparkSession.getActiveSession()
        try:
            own = json.loads(spark.read.text(f"{path}/recipe", wholetext=True).first()[0])
            plan = own.pop("plan")
            maps, merges = own.pop("maps"), own.pop("merges", False)
        except Exception as e:
            raise BadRecipeFile(f"no recipe in {path}") from e
        if own["version"] != VERSION:
            warn(VersionNote, f"the recipe was written by version {own['version']}")
        entries = tuple(Entry(**e) for e in plan["entries"])
        return Recipe(plan=Plan(entries, plan["mode"], frozenset(plan["proposed"])), maps={c: spark.read.parquet(f"{path}/map-{i}") for i, c in enumerate(maps)}, merges=spark.read.parquet(f"{path}/merges") if merges else None, **own)
