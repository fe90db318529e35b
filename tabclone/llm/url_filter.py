"""URL filters by a sort-merge range join.

A host is reversed by labels, with a dot after each (www.example.com: "com.example.www."), so that a host and all its subdomains
are the keys with one prefix: an interval.  Pages and rules are dealt out together by ranges of that key; a rule goes to every
range that its interval meets.  Each task sweeps its sorted rows and keeps a stack of the rules' hosts that hold the current key,
innermost last; under each host, its sorted path prefixes are nested intervals, too, and a binary search with links to the
enclosing prefix finds the longest that fits.  Of the rules that fit, the longest (host and path) wins.

The range bounds come from a bounded sample of the pages, about BOUND_ROWS for each range, drawn by hash, which sets only how
even the ranges are.  Ranges are cut within a host, too (by the url's hash), so that a hot host is shared out.

Defined cases: a null url, or one without "://", has an empty host and path and fits no rule; repeated rows and null ids give a
row each; of rules with equal host and path, the alphabetically last verdict holds; empty tables of pages or rules are fine;
further columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

#: Pages sampled for each range, and ranges for each shuffle partition.
BOUND_ROWS, RANGES = 16, 4
ROWS = "bucket int, key string, kind int, path string, page_id bigint, host string, rule string, verdict string"
SCHEMA = "page_id bigint, host string, path string, rule string, verdict string"


def host_path(url: str) -> tuple[Column, Column]:
    rest = F.expr(f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END")
    lower = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def host_key(host: str) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), "."), F.lit("."))


class Paths:
    """The rules of one host: sorted path prefixes, each linked to the one that encloses it."""

    def __init__(self, key: str):
        self.key, self.paths, self.rules, self.up = key, [], [], []

    def add(self, path: str, rule: str, verdict: str) -> None:
        """Paths come in ascending order."""
        if self.paths and self.paths[-1] == path:
            self.rules[-1] = (rule, verdict)
            return
        k = len(self.paths) - 1
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.up[k]
        self.paths.append(path)
        self.rules.append((rule, verdict))
        self.up.append(k)

    def longest(self, path: str) -> tuple[str, str] | None:
        k = bisect_right(self.paths, path) - 1
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.up[k]
        return self.rules[k] if k >= 0 else None


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, the rule that holds (or null) and its verdict (or default); rules has host, path and verdict."""
    spark = pages.sparkSession
    base.tune(spark)
    n = base.shuffles(spark)
    host, path = host_path("url")
    read = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"))
    rows = read.select("page_id", host.alias("host"), path.alias("path"), F.xxhash64("url", "page_id").alias("tie")).withColumn("key", host_key("host"))
    ranges = RANGES * n
    # one count of the pages gives the share that is drawn
    share = BOUND_ROWS * ranges / max(1, read.count())
    drawn = rows.where(F.pmod(F.xxhash64("tie"), F.lit(1 << 30)) < share * (1 << 30))
    sample = sorted((r.key, r.tie) for r in drawn.select("key", "tie").collect())
    bounds = spark.sparkContext.broadcast(sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)} if sample else []))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bounds.value
        for rb in batches:
            place = zip(rb.column("key").to_pylist(), rb.column("tie").to_pylist(), strict=True)
            bucket = pa.array([bisect_right(own, x) for x in place], pa.int32())
            yield _rows(rb, bucket, 1)

    def copy(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bounds.value
        for rb in batches:
            # no key sorts between k... and its last dot's successor
            spans = [(bisect_left(own, (k,)), bisect_left(own, (k[:-1] + "/",))) for k in rb.column("key").to_pylist()]
            at = pa.array([i for i, (a, b) in enumerate(spans) for _ in range(a, b + 1)], pa.int64())
            yield _rows(rb.take(at), pa.array([x for a, b in spans for x in range(a, b + 1)], pa.int32()), 0)

    named = rules.select(F.col("host").cast("string").alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("verdict").cast("string").alias("verdict")).where("host <> ''")
    ruled = named.select(host_key("host").alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict")
    both = rows.mapInArrow(deal, ROWS).unionByName(ruled.mapInArrow(copy, ROWS))
    dealt = both.repartition(n, "bucket").sortWithinPartitions("bucket", "key", "kind", "path", "verdict")

    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, stack = None, []
        for rb in batches:
            found = []
            cols = [rb.column(c).to_pylist() for c in ("bucket", "key", "kind", "path", "rule", "verdict")]
            for b, key, kind, path, rule, verdict in zip(*cols, strict=True):
                if b != bucket:
                    bucket, stack = b, []
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1].key != key:
                        stack.append(Paths(key))
                    stack[-1].add(path, rule, verdict)
                    continue
                fits = [x for s in stack if (x := s.longest(path))]
                found.append(max(fits, key=lambda x: len(x[0])) if fits else (None, default))
            pages = rb.filter(pa.compute.equal(rb.column("kind"), 1))
            out = {c: pages.column(c) for c in ("page_id", "host", "path")}
            yield pa.RecordBatch.from_pydict(out | {"rule": pa.array([x[0] for x in found], pa.string()), "verdict": pa.array([x[1] for x in found], pa.string())})

    return dealt.mapInArrow(sweep, SCHEMA)


def _rows(rb: pa.RecordBatch, bucket: pa.Array, kind: int) -> pa.RecordBatch:
    have = set(rb.schema.names)
    take = lambda c, t: rb.column(c) if c in have else pa.nulls(rb.num_rows, t)
    return pa.RecordBatch.from_pydict({
        "bucket": bucket, "key": rb.column("key"), "kind": pa.array([kind] * rb.num_rows, pa.int32()), "path": rb.column("path"),
        "page_id": take("page_id", pa.int64()), "host": take("host", pa.string()), "rule": take("rule", pa.string()), "verdict": take("verdict", pa.string()),
    })
