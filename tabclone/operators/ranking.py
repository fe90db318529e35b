"""Global positions without a single sorted partition.

Rows are put in buckets that are in order (by hash prefix, or by value bounds from quantiles), numbered within their bucket, and
moved up by the sizes of the buckets before.  Both have as many buckets as the shuffle partitions ask for, so that a bucket is
never more than a task's work; the number changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The fewest and the most buckets of values.
BUCKETS = (8, 512)


def _offset(rows: DataFrame, by: list[str], bucket: str, weight: Column) -> DataFrame:
    """For each group and bucket: the weight of the buckets before it, and of the whole group."""
    sizes = rows.groupBy(*by, bucket).agg(weight.alias("__size"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.sum("__size").over(w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__size")
    return sizes.select(*by, bucket, before.cast("bigint").alias("__before"), F.sum("__size").over(w).cast("bigint").alias("__total"))


def hash_index(rows: DataFrame, digest: Column, into: str, by: list[str] | None = None, tie: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """rows with into: the position from 1 (within by) in the order of a hex digest; columns that only the digest needs may be left out."""
    by = by or []
    # hex digits: 256 buckets, and at least four for each partition (65536 at most, whose sizes are broadcast)
    digits = 2
    while digits < 4 and 16**digits < 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        digits += 1
    names = [c for c in rows.columns if c not in (without or [])]
    # bytes are in the order of their hex digits, at half the size
    kept = rows.withColumn("__hex", digest).select(*names, F.unhex("__hex").alias("__digest"), F.conv(F.substring("__hex", 1, digits), 16, 10).cast("int").alias("__bucket"))
    within = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy("__digest", *(tie or [])))
    offsets = _offset(kept, by, "__bucket", F.count("*")).drop("__total")
    on = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in [*by, "__bucket"]]
    joined = kept.withColumn("__within", within).alias("l").join(F.broadcast(offsets).alias("r") if not by else offsets.alias("r"), on)
    return joined.select(*(F.col(f"l.`{c}`") for c in names), (F.col("__before") + F.col("__within")).alias(into))


def bounds(rows: DataFrame, value: str) -> list[float]:
    """Values that part rows about evenly; they set only the work of each task, never a result."""
    buckets = min(BUCKETS[1], max(BUCKETS[0], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = rows.agg(F.percentile_approx(F.col(f"`{value}`").cast("double"), [i / buckets for i in range(1, buckets)], 10_000)).first()[0]
    return sorted(set(found or []))


def bucket_of(value: Column, cuts: list[float]) -> Column:
    """The number of cuts at or below value, as a balanced conditional."""

    def part(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value >= F.lit(cuts[mid]), part(mid + 1, hi)).otherwise(part(lo, mid))

    return part(0, len(cuts))


def value_table(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Each distinct value (within by): __first and __last, its positions from 1, and __total (non-null values of the group)."""
    by = by or []
    cuts = bounds(rows, value)
    counts = rows.where(F.col(f"`{value}`").isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__bucket", bucket_of(F.col(f"`{value}`").cast("double"), cuts))
    last = F.sum("__n").over(Window.partitionBy(*by, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    offsets = _offset(counts, by, "__bucket", F.sum("__n"))
    on = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in [*by, "__bucket"]]
    joined = counts.withColumn("__within", last).alias("l").join(offsets.alias("r"), on)
    end = F.col("__before") + F.col("__within")
    return joined.select(*(F.col(f"l.`{c}`") for c in [*by, value]), (end - F.col("__n") + 1).alias("__first"), end.alias("__last"), F.col("__total"))


def average_rank(rows: DataFrame, value: str, into: str, by: list[str] | None = None, source: DataFrame | None = None) -> DataFrame:
    """rows with into: the average-tie rank over source's (or rows') non-null values divided by their number and 1."""
    by = by or []
    table = value_table(rows if source is None else source, value, by).withColumn(into, ((F.col("__first") + F.col("__last")) / 2) / (F.col("__total") + 1)).drop("__first", "__last", "__total")
    on = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in by] + [F.col(f"l.`{value}`") == F.col(f"r.`{value}`")]
    return rows.alias("l").join(table.alias("r"), on, "left").select(*(F.col(f"l.`{c}`") for c in rows.columns), F.col(into))
