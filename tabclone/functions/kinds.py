"""The kind of a column from its Spark type; ordered vocabularies travel in field metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = "levels"


def kind(field: T.StructField) -> str:
    t = field.dataType
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)):
        return "datetime"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, T.BooleanType):
        return "logical"
    if isinstance(t, T.StringType):
        return "factor" if LEVELS in (field.metadata or {}) else "character"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "numeric"
    return "other"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind(f) for f in df.schema.fields}


def as_factor(df: DataFrame, name: str, levels: list[str], ordered: bool = False) -> DataFrame:
    return df.withMetadata(name, {LEVELS: levels, "ordered": ordered})


def nan_to_null(df: DataFrame) -> DataFrame:
    """One kind of missing value: NaN becomes null in floating-point columns."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(F.isnan(F.col(f"`{c}`")), None).otherwise(F.col(f"`{c}`")) for c in floats}) if floats else df
