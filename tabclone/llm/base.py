"""What the corpus operators share: scratch tables, batches of bounded size and runs of sorted rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch sent to a Python worker; a single longer text still travels whole.
BATCH_BYTES = 8 << 20


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches of Python stages by bytes, so that long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def scratch(spark: SparkSession) -> str:
    """The shared folder for written tables: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="tabclone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def place(spark: SparkSession, tag: str) -> str:
    return f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = place(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_key(col: str | Column) -> Column:
    """Sixteen bytes that stand for a text, the first of its SHA-256 (no two texts are known to share them); a null text counts as the empty one."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")), 256), 1, 32))


#: A group of fewer rows is never hot.
HOT = 512


def spread_join(rows: DataFrame, groups: DataFrame, on: list[str], n: str) -> DataFrame:
    """rows joined with groups, a written table with one row for each value of on and the number n of rows that have it.

    A group of more rows than a quarter of a partition (of HOT at least) is hot; there are four of them a partition at most, so
    they are broadcast, and their rows stay where they are.  All others meet by hash.  rows is read twice; nulls meet nothing.
    """
    bar = max(HOT, rows.count() // (4 * shuffles(rows.sparkSession)))
    hot, cold = groups.where(F.col(n) > bar), groups.where(F.col(n) <= bar)
    if hot.isEmpty():
        return rows.join(cold, on)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches where the bytes of column go over most; each row stays whole."""
    for rb in batches:
        if rb.num_rows == 0:
            continue
        at, size, lens = 0, 0, pa.compute.binary_length(rb.column(column)).fill_null(0).to_pylist()
        for i, n in enumerate(lens):
            if size + n > most and i > at:
                yield rb.slice(at, i - at)
                at, size = i, 0
            size += n
        yield rb.slice(at)


def gathered(batches: Iterable[pa.RecordBatch], column: str, least: int) -> Iterator[pa.RecordBatch]:
    """Joins neighbouring batches until the bytes of column reach least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for rb in batches:
        if rb.num_rows == 0:
            continue
        held.append(rb)
        size += pa.compute.sum(pa.compute.binary_length(rb.column(column))).as_py() or 0
        if size >= least:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def large_text(col: pa.Array) -> pa.Array:
    """Strings with 64-bit offsets and no nulls: joined batches may pass 2 GB."""
    return pa.compute.fill_null(col.cast(pa.large_string()), "")


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by keys; a run may span batches.  Holds one run at a time."""
    held: list[pa.Table] = []
    last = None
    for rb in batches:
        if rb.num_rows == 0:
            continue
        t = pa.Table.from_batches([rb])
        cols = [rb.column(k).to_pylist() for k in keys]
        at, n = 0, rb.num_rows
        rows = list(zip(*cols, strict=True))
        while at < n:
            end = at + 1
            while end < n and rows[end] == rows[at]:
                end += 1
            if held and rows[at] != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(at, end - at))
            last, at = rows[at], end
    if held:
        yield pa.concat_tables(held)


def pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Texts cut at spaces and line ends: a code for each piece, the number of pieces of each text, and the distinct pieces."""
    split = pa.compute.split_pattern(pa.compute.replace_substring(texts, "\n", " "), " ")
    coded = split.flatten().dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), np.diff(np.asarray(split.offsets)), coded.dictionary


def gather(flat: np.ndarray, lens: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The slices of flat that codes name, one after another; lens has the length of each slice."""
    n = lens[codes]
    ends, starts = np.cumsum(n), np.cumsum(lens) - lens
    return flat[np.repeat(starts[codes] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def spread(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of values over neighbouring groups of the given sizes, some of which may be empty."""
    sums = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]
