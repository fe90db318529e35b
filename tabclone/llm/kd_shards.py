"""Sharding by k-d tree: leaves of near-equal bytes from recursive splits at distributed weighted medians.

All nodes of a level are split together.  A node that is to become several shards is split along its widest dimension (the
largest spread after scaling each dimension by its spread over all rows) where the bytes below are in proportion to the
shards below.  The split point is found by histograms: each round sums the bytes by BINS equal bins of each node's open interval
and goes on within the bin that holds the wanted point, until a bin weighs less than TOLERANCE of a shard.  Where many rows share
one value, rounds go on within that value along a hash of the row, so that no tie or group of copies has to stay in one shard.
Only sums go to the driver: at most shards x BINS a round, whatever the number of rows.  No dimension is an order on the rows:
the tree's splits are applied to each row as one conditional expression.

Defined cases: a null text has 8 bytes (its row alone); a null in a dimension counts as the smallest value; rows that are equal
in everything share a place and so a shard; an empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import base

#: Bins of a round, what a bin may weigh of a shard at the end, and the most rounds for each split.
BINS, TOLERANCE, ROUNDS = 1024, 0.002, 12


@dataclass
class Node:
    """Shards first to first + count - 1; where it is split, its dimension and the point: below goes left."""

    first: int
    count: int
    low: dict[str, float] = field(default_factory=dict)
    high: dict[str, float] = field(default_factory=dict)
    weight: float = 0.0
    dim: str = ""
    value: float = 0.0
    tie: float | None = None
    left: Node | None = None
    right: Node | None = None

    def above(self) -> Column:
        """Whether a row lies above the split."""
        x = F.col(self.dim)
        return x >= F.lit(self.value) if self.tie is None else (x > F.lit(self.value)) | ((x == F.lit(self.value)) & (F.col("tie") >= F.lit(self.tie)))

    def place(self) -> Column:
        if self.left is None:
            return F.lit(self.first)
        return F.when(self.above(), self.right.place()).otherwise(self.left.place())

    def leaves(self) -> list[Node]:
        return [self] if self.left is None else self.left.leaves() + self.right.leaves()


def _bounds(rows: DataFrame, root: Node, dims: list[str]) -> None:
    """Fills in the weight and the extent of every leaf."""
    asked = [F.sum("size").alias("w"), *(f(d).alias(f"{k}_{d}") for d in dims for k, f in (("lo", F.min), ("hi", F.max)))]
    found = {r["node"]: r for r in rows.groupBy(root.place().alias("node")).agg(*asked).collect()}
    for n in root.leaves():
        if r := found.get(n.first):
            n.weight, n.low, n.high = float(r["w"]), {d: r[f"lo_{d}"] for d in dims}, {d: r[f"hi_{d}"] for d in dims}


def _split(rows: DataFrame, root: Node, dims: list[str], scale: dict[str, float], each: float) -> bool:
    """Splits every leaf that holds several shards; False if there was none."""
    todo = {n.first: n for n in root.leaves() if n.count > 1}
    if not todo:
        return False
    open_: dict[int, dict] = {}
    for k, n in todo.items():
        n.dim = max(dims, key=lambda d: (n.high.get(d, 0) - n.low.get(d, 0)) / scale[d])
        lo, hi = n.low.get(n.dim, 0.0), n.high.get(n.dim, 0.0)
        open_[k] = {"on": n.dim, "lo": lo, "hi": hi, "want": n.weight * (n.count // 2) / n.count, "at": None} if hi > lo else {"on": "tie", "lo": 0.0, "hi": 1.0, "want": n.weight * (n.count // 2) / n.count, "at": lo}
    place = root.place()
    for _ in range(ROUNDS):
        if not (live := {k: s for k, s in open_.items() if "cut" not in s}):
            break
        bin_ = F.lit(None).cast("int")
        for k, s in live.items():
            x, step = F.col(s["on"]), (s["hi"] - s["lo"]) / BINS
            inside = (F.col("node") == k) & (x >= s["lo"]) & (x <= s["hi"])
            if s["at"] is not None:
                inside &= F.col(todo[k].dim) == F.lit(s["at"])
            bin_ = F.when(inside, F.least(F.floor((x - s["lo"]) / step), F.lit(BINS - 1)).cast("int")).otherwise(bin_)
        sums: dict[int, dict[int, tuple]] = {}
        asked = [F.sum("size").alias("w"), *(f(d).alias(f"{k}_{d}") for d in [*dims, "tie"] for k, f in (("lo", F.min), ("hi", F.max)))]
        for r in rows.withColumn("node", place).withColumn("bin", bin_).where("bin IS NOT NULL").groupBy("node", "bin").agg(*asked).collect():
            sums.setdefault(r["node"], {})[r["bin"]] = (float(r["w"]), r[f"lo_{open_[r['node']]['on']}"], r[f"hi_{open_[r['node']]['on']}"])
        for k, s in live.items():
            below = 0.0
            bins = sorted(sums.get(k, {}).items())
            for i, (_b, (w, lo, hi)) in enumerate(bins):
                if below + w >= s["want"] or i == len(bins) - 1:
                    break
                below += w
            else:
                s["cut"] = s["lo"]
                continue
            if w <= TOLERANCE * each or (s["on"] == "tie" and hi <= lo):  # the nearer side of the bin
                after = bins[i + 1][1][1] if i + 1 < len(bins) else s["hi"]
                s["cut"] = lo if s["want"] - below <= below + w - s["want"] else after
            elif hi <= lo:  # many rows with one value: on along the hash
                s |= {"on": "tie", "lo": 0.0, "hi": 1.0, "want": s["want"] - below, "at": lo}
            else:
                s |= {"lo": lo, "hi": hi, "want": s["want"] - below}
    for k, n in todo.items():
        s = open_[k]
        cut = s.get("cut", s["lo"])
        n.value, n.tie = (s["at"], cut) if s["at"] is not None else (cut, None)
        n.left, n.right = Node(n.first, n.count // 2), Node(n.first + n.count // 2, n.count - n.count // 2)
    return True


def grow(rows: DataFrame, shards: int, dims: list[str]) -> Node:
    """The tree over rows with a size, a tie in [0, 1) and the dimensions, all doubles but size."""
    root = Node(0, shards)
    _bounds(rows, root, dims)
    scale = {d: (root.high.get(d, 0) - root.low.get(d, 0)) or 1.0 for d in dims}
    each = root.weight / shards
    while _split(rows, root, dims, scale, each):
        _bounds(rows, root, dims)
    return root


def shard(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", dims: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, size (bytes of the text and 8), text_crc32, law, shard and slot (a gapless number from 0 within the shard).

    dims names the metadata dimensions and gives each as a numeric column of docs; by default the id and the text's bytes.
    Slots are numbered in sub-buckets whose bases are summed from counts, so no task sorts a whole shard.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint") + 8
    dims = dims or {"id": F.col(doc_id), "bytes": size}
    # no split falls on a null or NaN: both count as the smallest value
    own = {f"dim_{k}": F.coalesce(F.nanvl(c.cast("double"), F.lit(-1.0)), F.lit(-1.0)) for k, c in dims.items()}
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"), *(c.alias(k) for k, c in own.items()))
    rows = base.cut(rows.withColumn("tie", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(1 << 40)) / float(1 << 40)), "kd-rows")
    root = grow(rows, shards, list(own))
    buckets = max(1, base.shuffles(spark) // 4)
    placed = rows.select("doc_id", "size", "text_crc32", root.place().cast("int").alias("shard"), F.pmod(F.xxhash64("tie"), F.lit(buckets)).cast("int").alias("sub"))
    counts = placed.groupBy("shard", "sub").agg(F.count("*").alias("n"))
    before = counts.select("shard", "sub", (F.sum("n").over(Window.partitionBy("shard").orderBy("sub")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32")) - 1
    # before has shards x buckets rows, whatever the number of documents
    numbered = placed.withColumn("within", within).join(F.broadcast(before), ["shard", "sub"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("within")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
