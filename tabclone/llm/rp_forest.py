"""Approximate nearest neighbours: a forest of random-projection trees, searched through one shared priority queue.

The trees are fitted on the driver to a bounded sample (SAMPLE_VALUES numbers at most, drawn by hash) and broadcast; every row is
then indexed, by its leaf in each tree.  A query opens nodes of all trees in the order of one queue, whose key is the smallest
margin on the way, until the leaves it has reached hold a budget of sampled vectors (overlaps between trees counted).  The budget
is measured, not fixed: CALIBRATION of the queries are compared with every row of the table, and the budget is the least with
which their search reaches TARGET of their true neighbours.  So clustered tables are searched in few leaves and tables without
any structure in most of theirs.  Leaves are as fine as the sample allows while a query opens VISITS of them at most, on average.

Queries meet the rows of their leaves in one shuffle.  A leaf of many rows is dealt out in parts of about PART_VALUES numbers by
the hash of the vector, and its queries go to each part; a task holds the rows of one part, and queries pass by in batches.
Exact distances in double precision leave each query's nearest of the part; the nearest of all parts follow.  A query brings a
bound along, the distance within which its leaves hold enough sampled vectors; what lies farther can't be among its nearest found
and stays behind, so that a query's results don't grow with the leaves it opens.

Equal vectors are one row to the index, with the smallest ids that a result can need; so a vector that a third of all rows
share fills no leaf, and no answer is lost.

Defined cases: a vector that is null, has null or non-finite components, is zero, or is not as long as most vectors takes no
part, nor do rows with a null id; repeated rows count once; ties go to the smaller id; with fewer candidates than asked for, all
that were found are returned; an empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import base

#: Numbers in the sample, trees, and the least sampled vectors of a leaf.
SAMPLE_VALUES, TREES, LEAF = 1 << 22, 12, 96
#: Queries that the budget is measured on, the share of their neighbours to reach, and the leaves that a query should open at most.
CALIBRATION, TARGET, VISITS = 64, 0.96, 600
#: The most leaves of a tree, tried in turn, and numbers in a part of a leaf.
LEAVES, PART_VALUES = (512, 128), 1 << 20
_ROWS = "leaf bigint, part int, kind int, query bigint, bound double, ids array<bigint>, v array<double>"


@dataclass
class Forest:
    """Nodes of all trees in one table; children below 0 are leaves, numbered from -1 down."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: list[int]
    sizes: list[int]

    def leaves(self, v: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(v), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(v), root)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                side = np.einsum("ij,ij->i", self.normals[node], v[inner]) > self.offsets[node]
                at[inner] = self.children[node, side.astype(int)]
            out[:, t] = -1 - at
        return out

    def search(self, q: np.ndarray, want: float) -> list[int]:
        return self.order(q, want)[0]

    def order(self, q: np.ndarray, want: float = np.inf) -> tuple[list[int], list[int]]:
        """Leaves as the queue reaches them, and the sampled vectors held before each, while that is less than want."""
        margins = self.normals @ q - self.offsets if len(self.normals) else np.zeros(0)
        heap = [(-np.inf, r) for r in self.roots]
        heapq.heapify(heap)
        found, before, held = [], [], 0
        while heap and held < want:
            key, node = heapq.heappop(heap)
            if node < 0:
                found.append(-1 - node)
                before.append(held)
                held += self.sizes[-1 - node]
                continue
            m = margins[node]
            # the near side keeps the key, the far side lies at least the margin away
            near, far = self.children[node, int(m > 0)], self.children[node, int(m <= 0)]
            heapq.heappush(heap, (key, int(near)))
            heapq.heappush(heap, (max(key, abs(m)), int(far)))
        return found, before

    def budget(self, q: np.ndarray, true: list[np.ndarray], target: float) -> tuple[float, float]:
        """The least budget that reaches target of the true neighbours of all queries q, and the leaves that a query then opens."""
        needed, orders = [], []
        for v, near in zip(q, true, strict=True):
            found, before = self.order(v)
            at = np.zeros(len(self.sizes), np.int64)
            at[found] = before
            orders.append(np.array(before))
            if len(near):
                needed.extend(at[self.leaves(near)].min(1).tolist())
        if not needed:
            return np.inf, float(len(self.sizes))
        want = sorted(needed)[max(0, int(np.ceil(target * len(needed))) - 1)] + 1
        return want, float(np.mean([(x < want).sum() for x in orders]))


def fit(sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    normals, offsets, children, sizes, roots = [], [], [], [], []

    def build(rows: np.ndarray) -> int:
        if len(rows) <= leaf:
            sizes.append(len(rows))
            return -len(sizes)
        a, b = sample[rng.choice(rows, 2, replace=False)]
        normal = a - b
        norm = np.linalg.norm(normal)
        normal = normal / norm if norm else rng.standard_normal(sample.shape[1])
        p = sample[rows] @ normal
        cut = np.median(p)
        right = p > cut
        if not right.any():
            right = p >= cut
        if right.all():  # nothing tells them apart
            sizes.append(len(rows))
            return -len(sizes)
        me = len(normals)
        normals.append(normal)
        offsets.append(cut)
        children.append([0, 0])
        children[me] = [build(rows[~right]), build(rows[right])]
        return me

    for _ in range(trees):
        roots.append(build(np.arange(len(sample))))
    shape = sample.shape[1]
    return Forest(np.array(normals).reshape(-1, shape), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), roots, sizes)


def valid(vector: str) -> Column:
    return F.expr(f"{vector} IS NOT NULL AND size({vector}) > 0 AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists({vector}, x -> x <> 0)")


def nearest(rows: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", trees: int = TREES, leaf: int = LEAF, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest of each row that queries (on vec_id) picks."""
    spark = rows.sparkSession
    base.tune(spark)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    own = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & valid("v"))
    dims = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], schema)
    d = dims[0]["d"]
    own = own.where(F.size("v") == d)
    keyed = own.withColumn("a", F.xxhash64("v")).withColumn("b", F.xxhash64(F.lit(1), "v"))
    # a result needs at most the k smallest ids of equal vectors, and one more for the query itself
    ranked = keyed.dropDuplicates(["vec_id", "a", "b"]).withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    distinct = base.cut(ranked.groupBy("a", "b").agg(F.first("v").alias("v"), F.sort_array(F.collect_set("vec_id")).alias("ids")), "ann-vectors")
    most, total = max(1024, SAMPLE_VALUES // d), distinct.count()
    # by hash: the share that gives about so many rows, and the smallest of those
    share = min(1.0, 1.2 * most / max(1, total))
    drawn = distinct.where(F.pmod("a", F.lit(1 << 30)) < share * (1 << 30)).select("a", "b", "v").orderBy("a", "b").limit(most)
    sample = np.array([r["v"] for r in drawn.select("v").toLocalIterator()], np.float64).reshape(-1, d)
    asked = own.where(queries).dropDuplicates(["vec_id", "v"])
    tried = np.array([r["v"] for r in asked.select("v", F.xxhash64(F.lit(2), "v").alias("h")).orderBy("h", "v").limit(CALIBRATION).collect()], np.float64).reshape(-1, d)
    true = _truth(distinct, tried, k)
    for leaves in LEAVES:
        fitted = fit(sample, trees, max(leaf, len(sample) // leaves))
        want, visits = fitted.budget(tried, true, target)
        if visits <= VISITS:
            break
    # rows of a leaf in proportion to its sampled ones
    parts = np.ceil(np.array(fitted.sizes) * (total * d / max(1, len(sample)) / PART_VALUES)).astype(np.int64).clip(1)
    # the sampled vectors of each leaf; as large as the sample, whatever the table
    at = fitted.leaves(sample)
    order = np.argsort(at, axis=None, kind="stable")
    members = (order // trees).astype(np.int32), np.searchsorted(at.ravel()[order], np.arange(len(fitted.sizes) + 1))
    forest = spark.sparkContext.broadcast((fitted, parts, sample, members))

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts, *_ = forest.value
        for rb in batches:
            v = rb.column("v").flatten().to_numpy().reshape(-1, d)
            at = np.repeat(np.arange(rb.num_rows), trees)
            leaves = own.leaves(v).ravel()
            yield _batch(leaves, (rb.column("a").to_numpy()[at] >> 8) % parts[leaves], 0, pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.float64()), rb.column("ids").take(pa.array(at)), rb.column("v").take(pa.array(at)))

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts, sample, (inside, ends) = forest.value
        for rb in batches:
            for i, q in enumerate(rb.column("v").flatten().to_numpy().reshape(-1, d)):
                found = np.array(own.search(q, want), np.int64)
                near = sample[np.unique(np.concatenate([inside[ends[x] : ends[x + 1]] for x in found]))]
                bound = np.partition(np.sqrt(((near - q) ** 2).sum(1)), k)[k] if len(near) > k else np.inf
                leaves = np.repeat(found, parts[found])
                part = np.arange(len(leaves)) - np.repeat(np.cumsum(parts[found]) - parts[found], parts[found])
                at = pa.array(np.full(len(leaves), i))
                yield _batch(leaves, part, 1, rb.column("vec_id").take(at), pa.array(np.full(len(at), bound * (1 + 1e-12))), pa.nulls(len(at), pa.list_(pa.int64())), rb.column("v").take(at))

    both = distinct.select("a", "ids", "v").mapInArrow(index, _ROWS).unionByName(asked.mapInArrow(ask, _ROWS))
    dealt = both.repartition(base.shuffles(spark), "leaf", "part").sortWithinPartitions("leaf", "part", "kind")
    some = dealt.mapInArrow(lambda batches: _rank(batches, d, k), "query_id bigint, vec_id bigint, score double")
    each = some.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    top = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", top).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _truth(distinct: DataFrame, q: np.ndarray, k: int) -> list[np.ndarray]:
    """The k nearest other vectors of each of a few vectors, from one scan: each task keeps its own k nearest, and the k nearest of those go to the driver."""
    d = q.shape[1]
    sent = distinct.sparkSession.sparkContext.broadcast(q)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        far, near = np.full((len(q), k), np.inf), np.zeros((len(q), k, d))
        for rb in batches:
            v = rb.column("v").flatten().to_numpy().reshape(-1, d)
            for i, x in enumerate(q):
                new = np.sqrt(((v - x) ** 2).sum(1))
                new[new == 0] = np.inf
                some = np.argsort(new, kind="stable")[:k]
                every = np.concatenate([far[i], new[some]])
                best = np.argsort(every, kind="stable")[:k]
                near[i], far[i] = np.concatenate([near[i], v[some]])[best], every[best]
        at, rank = np.nonzero(np.isfinite(far))
        yield pa.RecordBatch.from_pydict({"q": pa.array(at, pa.int32()), "far": far[at, rank], "v": pa.array(list(near[at, rank]), pa.list_(pa.float64()))})

    found: list[list] = [[] for _ in q]
    if len(q):
        top = F.row_number().over(Window.partitionBy("q").orderBy("far", "v"))
        # queries x k rows
        for r in distinct.select("v").mapInArrow(scan, "q int, far double, v array<double>").withColumn("r", top).where(F.col("r") <= k).collect():
            found[r["q"]].append(r["v"])
    return [np.array(x, np.float64).reshape(-1, d) for x in found]


def _batch(leaves: np.ndarray, part: np.ndarray, kind: int, query: pa.Array, bound: pa.Array, ids: pa.Array, v: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"leaf": leaves, "part": pa.array(part.astype(np.int32)), "kind": pa.array(np.full(len(leaves), kind, np.int32)), "query": query, "bound": bound, "ids": ids, "v": v})


def _rank(batches: Iterable[pa.RecordBatch], d: int, k: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by leaf and part, candidates first: the k nearest of each query in each part (and what ties allow)."""
    slot, held, ready = None, [], None
    for rb in batches:
        if not rb.num_rows:
            continue
        keys = np.stack([rb.column(c).to_numpy() for c in ("leaf", "part", "kind")])
        starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0)))
        for a, b in zip(starts, [*starts[1:], rb.num_rows], strict=True):
            if slot != (here := tuple(keys[:2, a])):
                slot, held, ready = here, [], None
            run = rb.slice(a, b - a)
            v = run.column("v").flatten().to_numpy().reshape(-1, d)
            if keys[2, a] == 0:
                held.append((v, run.column("ids").to_pylist()))
                continue
            if not held:
                continue
            if ready is None:
                c = np.concatenate([x for x, _ in held])
                ready = c, (c * c).sum(1), [y for _, x in held for y in x]
            yield _nearest_of(run.column("query").to_numpy(), run.column("bound").to_numpy(), v, *ready, k)


def _nearest_of(names: np.ndarray, bounds: np.ndarray, q: np.ndarray, c: np.ndarray, cc: np.ndarray, ids: list[list[int]], k: int) -> pa.RecordBatch:
    out: tuple[list, list, list] = ([], [], [])
    step = max(1, (1 << 22) // len(c))
    for i in range(0, len(q), step):
        some = q[i : i + step]
        qq = (some * some).sum(1)
        # products find what may be near, up to their rounding; differences tell
        about = qq[:, None] + cc[None] - 2 * (some @ c.T)
        # the query's own class holds its own id: one class more than asked for is always enough
        edge = np.partition(about, k, axis=1)[:, k] if len(c) > k + 1 else np.full(len(some), np.inf)
        near = about <= (np.minimum(edge, bounds[i : i + step] ** 2) + 1e-11 * (qq + cc.max()))[:, None]
        for j in range(len(some)):
            row = np.flatnonzero(near[j])
            far = np.sqrt(((some[j] - c[row]) ** 2).sum(1)).tolist()
            mine = names[i + j]
            best = sorted((f, y) for f, x in zip(far, row.tolist(), strict=True) for y in ids[x] if y != mine and f <= bounds[i + j])[:k]
            out[0].extend([mine] * len(best))
            out[1].extend(y for _, y in best)
            out[2].extend(f for f, _ in best)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])
