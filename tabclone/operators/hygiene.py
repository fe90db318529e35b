"""Cleaning and conforming tables: legal names, trimmed labels, near-duplicates, merges and storage types."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AmbiguousMerge, BadTable, DuplicateNames, NameRepaired, warn  # type: ignore[attr-defined]
from ..functions.kinds import LEVELS, as_factor, kinds
from ..sources.scratch import cut

SPACE = "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$"
#: Reserved words that can't be names.
RESERVED = ("if", "else", "repeat", "while", "function", "for", "next", "break", "TRUE", "FALSE", "NULL", "Inf", "NaN", "NA", "in")
SHOWN = 20
#: Merges that a report spells out; it counts the others.
LISTED = 200


def legal_names(names: list[str]) -> dict[str, str]:
    """Trimmed, legal and unique names: other characters become _, a leading digit gets an X, repeats a number."""
    lower = [n.strip() for n in names]
    if dup := sorted({n for n in lower if lower.count(n) > 1}):
        raise DuplicateNames(f"names that are equal after trimming: {dup}", dup)
    out: dict[str, str] = {}
    used: set[str] = set()
    for raw, n in zip(names, lower, strict=True):
        n = re.sub(r"[^A-Za-z0-9_]", "_", n)
        if not n or not re.match(r"[A-Za-z]", n):
            n = "X" + n
        if n in RESERVED:
            n += "_"
        base, k = n, 1
        while n in used:
            n, k = f"{base}_{k}", k + 1
        used.add(n)
        out[raw] = n
    return out


def text_columns(df: DataFrame) -> list[str]:
    return [c for c, k in kinds(df).items() if k in ("character", "factor")]


def trimmed(col: str) -> Column:
    return F.regexp_replace(F.col(f"`{col}`"), SPACE, "")


def trim_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """df with trimmed texts; factors stay factors, with trimmed levels."""
    factors = {c: m for c in cols if LEVELS in (m := df.schema[c].metadata)}
    done = df.withColumns({c: trimmed(c) for c in cols})
    for c, m in factors.items():
        done = as_factor(done, c, list(dict.fromkeys(x.strip(" \t\r\n") for x in m[LEVELS])), bool(m.get("ordered")))
    return done


def label_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """col, label, n and first (its smallest row id, if df has one): one pass over all text columns."""
    rid = F.col("__rid") if "__rid" in df.columns else F.lit(None).cast("bigint")
    pairs = F.array(*(F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").alias("label")) for c in cols))
    long = df.select(F.explode(pairs).alias("p"), rid.alias("rid")).select("p.*", "rid").where("label IS NOT NULL")
    return long.groupBy("col", "label").agg(F.count("*").alias("n"), F.min("rid").alias("first"))


def trim_fixes(df: DataFrame, cols: list[str]) -> DataFrame:
    """Each label that trimming changes: col, original, fixed."""
    labels = label_counts(df, cols).select("col", F.col("label").alias("original"))
    return labels.withColumn("fixed", F.regexp_replace("original", SPACE, "")).where("original != fixed")


def near_duplicates(labels: DataFrame) -> DataFrame:
    """col, a, b (a < b) and kind of labels that differ in case only ("case") or by one edit that is no digit ("edit1").

    Labels meet on the hashes of themselves and of all their one-character deletions, so no pairs are formed that share neither.
    """
    own = labels.select("col", "label").distinct()
    deletions = F.expr("transform(sequence(1, length(label)), i -> concat(substring(label, 1, i - 1), substring(label, i + 1)))")
    keys = F.array_distinct(F.when(F.length("label") > 0, F.concat(F.array("label"), deletions)).otherwise(F.array("label")))
    near = own.select("col", "label", F.explode(keys).alias("key"))
    same = own.select("col", "label", F.concat(F.lit("\0case:"), F.lower("label")).alias("key"))
    met = near.unionByName(same)
    pairs = met.alias("x").join(met.alias("y"), (F.col("x.col") == F.col("y.col")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.label") < F.col("y.label")))
    pairs = pairs.select(F.col("x.col").alias("col"), F.col("x.label").alias("a"), F.col("y.label").alias("b")).distinct()
    # the edited character is the first where the two differ
    short, long = F.expr("CASE WHEN length(a) <= length(b) THEN a ELSE b END"), F.expr("CASE WHEN length(a) <= length(b) THEN b ELSE a END")
    common = F.expr("coalesce(array_min(filter(sequence(1, greatest(length(s), 1)), i -> substring(s, i, 1) != substring(l, i, 1))), length(s) + 1)")
    told = pairs.withColumn("s", short).withColumn("l", long).withColumn("at", common)
    digit = F.expr("substring(l, at, 1) RLIKE '[0-9]' OR (length(s) = length(l) AND substring(s, at, 1) RLIKE '[0-9]')")
    kind = F.when(F.lower("a") == F.lower("b"), "case").when((F.levenshtein("a", "b") == 1) & ~digit, "edit1")
    return told.withColumn("kind", kind).where("kind IS NOT NULL").select("col", "a", "b", "kind")


@dataclass
class Cleaning:
    """What clean() did: replay() does the same to another table with the original names."""

    data: DataFrame
    names: dict[str, str]
    mode: str
    trimmed: list[str] = field(default_factory=list)
    near: list[tuple] = field(default_factory=list)
    near_count: int = 0

    def replay(self, df: DataFrame) -> DataFrame:
        done = df.withColumnsRenamed({k: v for k, v in self.names.items() if k in df.columns})
        return trim_columns(done, [c for c in self.trimmed if c in done.columns])


def clean(df: DataFrame, mode: str = "auto", quiet: bool = True) -> Cleaning:
    """Legal names in every mode; auto also trims labels and reports near-duplicates, report only reports, off does neither."""
    if mode not in ("auto", "report", "off"):
        raise ValueError(f"a cleaning mode is auto, report or off, not {mode!r}")
    names = legal_names(df.columns)
    changed = {k: v for k, v in names.items() if k != v}
    if changed:
        warn(NameRepaired, f"names made legal: {changed}")
    done = Cleaning(df.withColumnsRenamed(changed), names, mode)
    cols = text_columns(done.data)
    if mode == "auto" and cols:
        done.trimmed = cols
        done.data = trim_columns(done.data, cols)
    if mode != "off" and cols and not quiet:
        near = near_duplicates(label_counts(done.data, cols))
        done.near_count = near.count()
        done.near = [tuple(r) for r in near.orderBy("col", "b", "a").limit(SHOWN).collect()]
    return done


def storage_checks(df: DataFrame, cols: list[str]) -> DataFrame:
    """For each text column: n, n_values (distinct), all_numeric and all_dates over its non-empty values; one pass."""
    asked = []
    for c in cols:
        x = F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`"))
        number = F.trim(x).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
        date = F.when(x.isNotNull(), x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.expr(f"try_to_date(`{c}`, 'yyyy-MM-dd')").isNotNull())
        asked += [F.count(x).alias(f"n|{c}"), F.count_distinct(x).alias(f"d|{c}"), F.coalesce(F.bool_and(number), F.lit(False)).alias(f"f|{c}"), F.coalesce(F.bool_and(date), F.lit(False)).alias(f"t|{c}")]
    wide = df.agg(*asked)
    rows = F.array(*(F.struct(F.lit(c).alias("col"), F.col(f"`n|{c}`").alias("n"), F.col(f"`d|{c}`").alias("n_values"), F.col(f"`f|{c}`").alias("all_numeric"), F.col(f"`t|{c}`").alias("all_dates")) for c in cols))
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def infer_storage(df: DataFrame, cols: list[str] | None = None, max_levels: int = 20) -> DataFrame:
    """storage_checks and the type they lead to: numeric, date, factor or text."""
    kind = F.when(F.col("n") == 0, "text").when(F.col("all_numeric"), "numeric").when(F.col("all_dates"), "date").when((F.col("n_values") <= max_levels) & (F.col("n_values") < F.col("n")), "factor").otherwise("text")
    return storage_checks(df, cols or text_columns(df)).withColumn("type", kind)


def merge_decisions(counts: DataFrame, least_length: int = 4) -> DataFrame:
    """For each near-duplicate pair: whether and how it merges.  The more frequent label wins, a tie of case goes to the one seen
    first, a tie of an edit is refused, and so is an edit in a label shorter than least_length."""
    pairs = near_duplicates(counts)
    n = counts.select("col", "label", "n", "first")
    a, b = n.withColumnsRenamed({"label": "a", "n": "n_a", "first": "first_a"}), n.withColumnsRenamed({"label": "b", "n": "n_b", "first": "first_b"})
    both = pairs.join(a, ["col", "a"]).join(b, ["col", "b"])
    short = (F.col("kind") == "edit1") & (F.least(F.length("a"), F.length("b")) < least_length)
    tie = F.col("n_a") == F.col("n_b")
    to_a = (F.col("n_a") > F.col("n_b")) | (tie & (F.col("first_a") < F.col("first_b")))
    winner = F.when(short | (tie & (F.col("kind") == "edit1")), None).when(to_a, F.col("a")).otherwise(F.col("b"))
    reason = F.when(short, "short").when(tie & (F.col("kind") == "edit1"), "tie").otherwise("merged")
    done = both.withColumn("to", winner).withColumn("from", F.when(F.col("to") == F.col("a"), F.col("b")).when(F.col("to") == F.col("b"), F.col("a")))
    return done.withColumn("reason", reason).select("col", "a", "b", "kind", "n_a", "n_b", "from", "to", "reason")


def merge_closure(edges: DataFrame) -> DataFrame:
    """col, from, to and ambiguous: every edge followed to its sink; a label with several sinks is ambiguous and stays.

    Each round is written, so that the plan doesn't grow; edges that go round in a circle are refused.
    """
    edges = cut(edges.select("col", "from", "to").distinct(), "merge-edges")
    paths, sinks = edges, None
    for left in range(edges.count(), -1, -1):
        open_ = paths.alias("p").join(edges.alias("e"), (F.col("p.col") == F.col("e.col")) & (F.col("p.to") == F.col("e.from")))
        ended = paths.alias("p").join(edges.alias("e"), (F.col("p.col") == F.col("e.col")) & (F.col("p.to") == F.col("e.from")), "left_anti")
        sinks = ended if sinks is None else sinks.unionByName(ended)
        paths = cut(open_.select(F.col("p.col").alias("col"), F.col("p.from").alias("from"), F.col("e.to").alias("to")).distinct(), "merge-paths")
        if paths.isEmpty():
            break
        if not left:  # a path can't be longer than there are edges
            raise BadTable("merges go round in a circle", [r[0] for r in paths.select("from").limit(5).collect()])
    ends = sinks.distinct().groupBy("col", "from").agg(F.sort_array(F.collect_set("to")).alias("ends"))
    return ends.select("col", "from", F.array_join("ends", " | ").alias("to"), (F.size("ends") > 1).alias("ambiguous"))


def apply_merges(df: DataFrame, col: str, merges: DataFrame) -> DataFrame:
    own = merges.where((F.col("col") == col) & ~F.col("ambiguous")).select(F.col("from").alias("__from"), F.col("to").alias("__to"))
    joined = df.join(own, F.col(f"`{col}`") == F.col("__from"), "left")
    return joined.select(*((F.coalesce("__to", F.col(f"`{c}`")).alias(c) if c == col else F.col(f"`{c}`")) for c in df.columns))


def merged(df: DataFrame, merges: DataFrame | None) -> DataFrame:
    for c in sorted(r[0] for r in merges.select("col").distinct().collect()) if merges is not None else ():
        if c in df.columns:
            df = apply_merges(df, c, merges)
    return df


@dataclass
class Conformance:
    """A conformed table, and what it takes to conform another one alike; mask() takes it in place of a table."""

    data: DataFrame
    cleaning: Cleaning
    merges: DataFrame | None
    types: dict[str, str]
    applied: dict[str, bool]
    assumptions: list[str]
    levels: dict[str, list[str]] = field(default_factory=dict)

    def replay(self, df: DataFrame) -> DataFrame:
        done = merged(self.cleaning.replay(df), self.merges if self.applied["merges"] else None)
        return typed(done, self.types, self.levels) if self.applied["types"] else done


def typed(df: DataFrame, types: dict[str, str], levels: dict[str, list[str]] | None = None) -> DataFrame:
    def cast(c: str, t: str) -> Column:
        x = F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`"))
        return x.cast("double") if t == "numeric" else F.to_date(x, "yyyy-MM-dd")

    done = df.withColumns({c: cast(c, t) for c, t in types.items() if t in ("numeric", "date") and c in df.columns})
    for c, t in types.items():
        if t == "factor" and c in df.columns:
            done = as_factor(done, c, (levels or {}).get(c, []))
    return done


def conform(df: DataFrame, merge_labels: str = "report", types: str = "report", max_levels: int = 20, clean_mode: str = "auto") -> Conformance:
    """Cleans, decides types and merges, and applies those asked for ("apply"); "report" only says what would be done."""
    cleaning = clean(df, clean_mode)
    cols = text_columns(cleaning.data)
    found = {r["col"]: r["type"] for r in infer_storage(cleaning.data, cols, max_levels).collect()} if cols else {}
    said = [f"{c}: read as {t}" + ("" if types == "apply" else " (not applied)") for c, t in found.items()]
    merges, data = None, cleaning.data
    labels = [c for c, t in found.items() if t == "factor"]
    if labels and merge_labels != "off":
        decided = merge_decisions(label_counts(data, labels))
        merges = merge_closure(decided.where("to IS NOT NULL"))
        merges = cut(merges, "merges")
        tally = merges.agg(F.count("*").alias("n"), F.count_if("ambiguous").alias("open")).first()
        shown = merges.orderBy(F.desc("ambiguous"), "col", "from").limit(LISTED).collect()
        done = "merged" if merge_labels == "apply" else "not applied"
        said += [f"{r['col']}: {r['from']!r} is read as {r['to']!r}" + (" (ambiguous, not merged)" if r["ambiguous"] else f" ({done})") for r in shown]
        if tally["n"] > len(shown):
            said.append(f"and {tally['n'] - len(shown)} more merges, which the table of merges has")
        if tally["open"]:
            some = [f"{r['col']}: {r['from']!r} could be {r['to']}" for r in shown if r["ambiguous"]]
            warn(AmbiguousMerge, f"{tally['open']} labels could merge with several others: {'; '.join(some)}")
        if merge_labels == "apply":
            data = merged(data, merges)
    # at most max_levels for each factor
    levels = {c: [r[0] for r in data.select(F.col(f"`{c}`").alias("v")).where("v IS NOT NULL AND v != ''").distinct().orderBy("v").collect()] for c in labels} if types == "apply" else {}
    if types == "apply":
        data = typed(data, found, levels)
    return Conformance(data, cleaning, merges, found, {"merges": merge_labels == "apply", "types": types == "apply"}, said, levels)
