"""Reading and writing tables and sets of tables: CSV, TSV, Parquet, ORC and JSON by Spark, workbooks through pandas if it can."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadSet, BadSheets, ExistingTarget  # type: ignore[attr-defined]
from ..mask import Clone

FORMATS = {"csv": ",", "tsv": "\t", "parquet": None, "orc": None, "json": None}
#: Texts that stand for a missing value.
MISSING = ("", "NA")
#: Rows of a sheet with its header, and characters of its name.
SHEET_ROWS, SHEET_NAME = 1048576, 31


def read_table(spark: SparkSession, path: str, kind: str | None = None, infer: bool = True) -> DataFrame:
    """One table; text files have a header, and both MISSING texts are null."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in FORMATS:
        raise BadSet(f"no known format: {path}", path)
    if FORMATS[kind] is None:
        return spark.read.format(kind).load(path)
    # values are read as texts first: a reader knows one null text only
    raw = spark.read.csv(path, header=True, sep=FORMATS[kind], inferSchema=False)
    cleaned = raw.select(*(F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns))
    return inferred(cleaned) if infer else cleaned


def inferred(df: DataFrame) -> DataFrame:
    """Text columns whose values are all whole numbers, numbers or truth values get that type; one pass."""
    asked = []
    for i, c in enumerate(df.columns):
        x = F.col(f"`{c}`")
        asked += [F.coalesce(F.bool_and(x.rlike(p)), F.lit(False)).alias(f"{k}{i}") for k, p in (("l", r"^[+-]?[0-9]{1,18}$"), ("d", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), ("b", r"^(?i)(true|false|T|F)$"))]
    r = df.agg(*asked).first()
    kind = lambda i: next((t for k, t in (("l", "bigint"), ("d", "double"), ("b", "boolean")) if r[f"{k}{i}"]), None)
    return df.select(*(F.col(f"`{c}`").cast(kind(i)).alias(c) if kind(i) else F.col(f"`{c}`") for i, c in enumerate(df.columns)))


def check_set(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Names are there and no automatic ones; every table has columns and a row."""
    if not tables:
        raise BadSet("no tables")
    for name, t in tables.items():
        if not name or not isinstance(t, DataFrame) or not t.columns:
            raise BadSet(f"no valid table: {name!r}", name)
        if auto := [c for c in t.columns if re.fullmatch(r"\.\.\.[0-9]+", c)]:
            raise BadSet(f"{name}: columns without a name: {auto}", auto)
        if t.isEmpty():
            raise BadSet(f"{name} has no rows", name)
    return tables


def read_set(spark: SparkSession, source: str | dict[str, DataFrame], sheets: list[str] | None = None, pattern: str | None = None) -> dict[str, DataFrame]:
    """A folder (one table a file), a workbook, or tables that are there already.  Every file is a scan of its own: schemas differ."""
    if isinstance(source, dict):
        return check_set(source)
    if source.lower().endswith((".xlsx", ".xls")):
        import pandas as pd

        found = pd.read_excel(source, sheet_name=None)  # needs an engine that may not be installed
        if bad := [s for s in sheets or [] if s not in found]:
            raise BadSheets(f"no such sheets: {bad}", bad)
        return check_set({k: spark.createDataFrame(v) for k, v in found.items() if not sheets or k in sheets})
    if sheets:
        raise BadSheets("only a workbook has sheets")
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise BadSet(f"a set is a folder or a workbook, not {source}", source)
    out: dict[str, DataFrame] = {}
    for name in sorted(s.getPath().getName() for s in fs.listStatus(path)):
        stem, _, kind = name.rpartition(".")
        if kind.lower() not in FORMATS or (pattern and not re.search(pattern, name)):
            continue
        if stem in out:
            raise BadSet(f"two files give a table {stem}", stem)
        out[stem] = read_table(spark, f"{source.rstrip('/')}/{name}", kind.lower())
    return check_set(out)


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in FORMATS:
        raise BadSet(f"no known format: {path}", path)
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if FORMATS[kind] is None:
        writer.format(kind).save(path)
    else:
        writer.csv(path, header=True, sep=FORMATS[kind], nullValue="NA")


def write_clone(clone: Clone, path: str, overwrite: bool = False, allow_high: bool = False) -> None:
    """The clone alone, never its recipe, after the release gate."""
    clone.gate(allow_high)
    write_table(clone.data, path, overwrite)


def write_workbook(tables: dict[str, DataFrame], path: str, overwrite: bool = False) -> None:
    """One sheet a table, written by the driver; tables with more rows than a sheet holds are refused.  Needs an engine of pandas."""
    import pandas as pd

    if not overwrite and os.path.exists(path):
        raise ExistingTarget(f"{path} is there already", path)
    if bad := [n for n in tables if not n or len(n) > SHEET_NAME or re.search(r"[\[\]:*?/\\]", n)]:
        raise BadSheets(f"no valid names of sheets: {bad}", bad)
    if bad := [n for n, t in tables.items() if t.limit(SHEET_ROWS).count() == SHEET_ROWS]:
        raise BadSet(f"tables with more rows than a sheet holds: {bad}", bad)
    try:
        writer = pd.ExcelWriter(path)
    except (ImportError, ValueError) as e:
        raise BadSet("pandas has no engine that writes workbooks here") from e
    with writer:
        for n, t in tables.items():
            t.toPandas().to_excel(writer, sheet_name=n, index=False)


def write_set(clones: dict[str, Clone], path: str, kind: str = "csv", overwrite: bool = False, allow_high: bool = False) -> None:
    """A folder of tables, or one workbook with a sheet for each."""
    for c in clones.values():
        c.gate(allow_high)
    if path.lower().endswith(".xlsx"):
        return write_workbook({n: c.data for n, c in clones.items()}, path, overwrite)
    if not overwrite and "://" not in path and os.path.isdir(path) and any(n.endswith(f".{kind}") for n in os.listdir(path)):
        raise ExistingTarget(f"{path} holds {kind} tables already", path)
    for name, c in clones.items():
        write_table(c.data, f"{path.rstrip('/')}/{name}.{kind}", overwrite)
