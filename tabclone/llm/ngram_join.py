"""N-gram Jaccard join by MinHash banding, verified on the full n-gram sets.

Texts are equal or not by 128 bits of the SHA-256 of all their bytes; equal ones are one class member to the join, with a number
of copies.  Each distinct text has the set of its runs of NGRAM words (lower case, cut at white space; a shorter text is one
run), each as 64 bits of hash, and a signature of bands x rows minima, chosen so that a pair at the threshold shares a band with the target probability.  Distinct texts meet by
band hash.  A bucket all of whose members also share an earlier band is passed over; in the others, each pair that shares no
earlier band is verified once, on the full sets.  A large bucket is dealt out as pairs of blocks, so that no task holds more
than two blocks, and pairs are counted where they are verified: out come each text's number of links and a spanning forest of
the block, never all pairs.  Classes are the components of these links.

No hash deals all rows of a large group to one task: hot buckets, classes and texts meet what is joined with them by broadcast
(base.spread_join), and of equal texts one row alone, found by its id, lends its text.

Defined cases: a null text counts as an empty one; texts without a word are similar to none but equal texts; a document's id in
results is its own, null or repeated; repeated rows count as copies; a class is named by the smallest id in it (null if it has
none); a pair whose similarity is just the threshold is linked, and order plays no part; a text of any length has its full set,
and travels alone in its batch if it is long; an empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .components import components

NGRAM, THRESHOLD = 5, 0.8
#: The probability with which a pair at the threshold is found, and the most minima of a signature.
RECALL, MINIMA = 0.9995, 128
#: Members of a block.
BLOCK = 768


@lru_cache
def banding(threshold: float, recall: float = RECALL, most: int = MINIMA) -> tuple[int, int]:
    """Bands and rows: the most rows a band (fewest needless candidates) whose bands reach the recall within so many minima."""
    found = [(math.ceil(math.log(1 - recall) / math.log(1 - threshold**r)), r) for r in range(1, most + 1) if threshold**r > 1e-6]
    return max((x for x in found if x[0] * x[1] <= most), key=lambda x: x[1])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(texts: pa.Array, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each text (with repeats), and how many each has."""
    codes, counts, table = base.pieces(pc.utf8_lower(texts))
    cut = [p.split() for p in table.to_pylist()]
    each = np.fromiter(map(len, cut), np.int64, len(cut))
    flat = np.fromiter((xxhash.xxh3_64_intdigest(w) for x in cut for w in x), np.uint64, int(each.sum()))
    words = base.gather(flat, each, codes)
    lens = base.spread(each[codes], counts)
    return _windows(words, lens, n)


def _windows(words: np.ndarray, lens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.where(lens >= n, lens - n + 1, np.minimum(lens, 1))
    first = np.repeat(np.cumsum(lens) - lens - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
    size = np.repeat(np.minimum(lens, n), m)
    h = size.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    for k in range(n):
        h = np.where(size > k, _mix(h * np.uint64(0x9E3779B97F4A7C15) + padded[first + k]), h)
    return h, m


def signatures(h: np.ndarray, m: np.ndarray, bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """Texts x bands: a hash of each band's minima; texts without n-grams get what their row number hashes to."""
    out = np.zeros((len(m), bands), np.uint64)
    has = m > 0
    starts = (np.cumsum(m) - m)[has]
    if not len(starts):
        return out
    odd = np.random.default_rng(seed).integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    work = np.empty_like(h)
    for b in range(bands):
        band = np.full(len(starts), b + 1, np.uint64)
        for r in range(rows):
            np.multiply(h, odd[b * rows + r], out=work)
            np.bitwise_xor(work, work >> np.uint64(32), out=work)
            band = _mix(band * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(work, starts))
        out[has, b] = band
    return out


def join(docs: DataFrame, threshold: float = THRESHOLD, ngram: int = NGRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, key (16 bytes that stand for its text), root (the key that stands for its class), class_id
    (the class's smallest doc_id, a label that classes share where ids repeat or are null), copies (equal texts, itself included), and
    n_links (documents at or above the threshold, itself excluded)."""
    spark = docs.sparkSession
    base.tune(spark)
    bands, rows = banding(threshold)
    own = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), base.text_key(f"`{text}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in base.gathered(base.slices(batches, "text", base.BATCH_BYTES), "text", base.BATCH_BYTES // 2):
            h, m = grams(base.large_text(rb.column("text")), ngram)
            found = signatures(h, m, bands, rows).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(m > 0, bands, 0)))), pa.int32()), pa.array(found[m > 0].ravel()))
            yield pa.RecordBatch.from_pydict({"doc_id": rb.column("doc_id"), "key": rb.column("key"), "bands": lists})

    signed = base.cut(own.mapInArrow(sign, "doc_id bigint, key binary, bands array<bigint>"), "ngram-signatures")
    texts = base.cut(signed.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "ngram-texts")
    # slim rows until it is known which texts meet any other
    met = texts.select("key", F.posexplode("bands").alias("band", "h"))
    shared = base.cut(met.groupBy("band", "h").agg(F.count("*").alias("members")).where("members > 1"), "ngram-shared")
    meeting = base.cut(base.spread_join(met, shared, ["band", "h"], "members"), "ngram-meeting").join(texts.select("key", "least", "copies", "bands"), "key")
    # a bucket whose members all share an earlier band has nothing to add
    earlier = F.expr(" OR ".join(f"(band > {j} AND min(bands[{j}]) = max(bands[{j}]))" for j in range(bands - 1)) or "false")
    buckets = base.cut(meeting.groupBy("band", "h").agg(earlier.alias("seen"), F.count("*").alias("n")).where("NOT seen").select("band", "h", "n"), "ngram-open")
    placed = base.cut(base.spread_join(meeting, buckets, ["band", "h"], "n").drop("n"), "ngram-buckets")
    sets = _sets(_lenders(own, placed.select("key", "least").distinct()), ngram)
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    mine = F.when(blocks > 1, F.pmod(F.xxhash64("key"), blocks)).otherwise(F.lit(0)).cast("int")
    pairs = F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, mine) AS low, greatest(x, mine) AS high))")
    rows_ = placed.withColumn("blocks", blocks).withColumn("mine", mine).select("key", "copies", "bands", "band", "h", "mine", F.explode(pairs).alias("p")).select("key", "copies", "bands", "band", "h", "mine", "p.low", "p.high")
    keys = ["band", "h", "low", "high"]
    # each text's set travels once for each bucket that needs it
    dealt = rows_.join(sets, "key").repartition(base.shuffles(spark), *keys).sortWithinPartitions(*keys)
    checked = base.cut(dealt.mapInArrow(lambda b: _verify(b, threshold), "key binary, links bigint, other binary"), "ngram-links")
    links = checked.where("other IS NULL").groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(checked.where("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b")), "ngram-components")
    known = base.cut(texts.select("key", "least", "copies").join(links, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "ngram-roots")
    named = base.cut(known.groupBy("root").agg(F.min("least").alias("class_id"), F.count("*").alias("n")), "ngram-classes")
    told = base.spread_join(known, named, ["root"], "n")
    classed = base.cut(told.select("key", "root", "class_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links")), "ngram-texts-classed")
    return base.spread_join(signed.select("doc_id", "key"), classed, ["key"], "copies").select("doc_id", "key", "root", "class_id", "copies", "n_links")


def _lenders(own: DataFrame, needed: DataFrame) -> DataFrame:
    """key and text, once for each needed key: copies of a text are dealt out by their ids, too, and the one of the least id stays."""
    told = lambda df, c: df.withColumn("id", F.coalesce(c, F.lit(0))).withColumn("no_id", F.col(c).isNull())
    on = ["key", "id", "no_id"]
    return told(own, "doc_id").join(told(needed, "least").select(*on), on, "left_semi").groupBy(*on).agg(F.first("text").alias("text")).select("key", "text")


def _sets(texts: DataFrame, ngram: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in base.slices(batches, "text", base.BATCH_BYTES):
            h, m = grams(base.large_text(rb.column("text")), ngram)
            ends = np.cumsum(m)
            parts = [np.unique(h[e - n : e]).tobytes() for e, n in zip(ends, m, strict=True)]
            yield pa.RecordBatch.from_pydict({"key": rb.column("key"), "grams": pa.array(parts, pa.binary())})

    return texts.mapInArrow(run, "key binary, grams binary")


def _verify(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    out: tuple[list, list, list] = ([], [], [])
    for run in base.runs(batches, ["band", "h", "low", "high"]):
        for got, new in zip(out, _block(run.combine_chunks(), threshold), strict=True):
            got.extend(new)
        if len(out[0]) > 20_000:
            yield _links(out)
            out = ([], [], [])
    if out[0]:
        yield _links(out)


def _links(out: tuple[list, list, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["key", "links", "other"])


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share."""
    n = len(sets)
    if n == 2:
        both = np.concatenate(sets)
        both.sort()
        x = np.array([[len(sets[0]), 0], [0, len(sets[1])]])
        x[0, 1] = x[1, 0] = (both[1:] == both[:-1]).sum()
        return x
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, ids, df = np.unique(flat, return_inverse=True, return_counts=True)
    total = np.zeros((n, n), np.float32)
    some = df[ids] > 1  # what only one set has is in no intersection
    ids, owner = ids[some], owner[some]
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    column = np.cumsum(np.append(0, ids[1:] != ids[:-1])) if len(ids) else ids
    width = int(column[-1]) + 1 if len(ids) else 0
    for a in range(0, width, 4096):
        i, j = np.searchsorted(column, [a, a + 4096])
        x = np.zeros((n, min(4096, width - a)), np.float32)
        x[owner[i:j], column[i:j] - a] = 1
        total += x @ x.T
    return np.rint(total).astype(np.int64)


def _block(run: pa.Table, threshold: float) -> tuple[list, list, list]:
    """Links of each text, then a spanning forest, for the pairs of one bucket's block pair that share no earlier band."""
    n = run.num_rows
    if n < 2:
        return [], [], []
    band, low, high = (run[c][0].as_py() for c in ("band", "low", "high"))
    sets = [np.frombuffer(x, np.uint64) for x in run["grams"].to_pylist()]
    size = np.array([len(s) for s in sets])
    share = common(sets)
    union = size[:, None] + size[None] - share
    linked = share >= threshold * union - 1e-9
    np.fill_diagonal(linked, False)
    if band:
        sig = run["bands"].combine_chunks().flatten().to_numpy().reshape(n, -1)[:, :band]
        for j in range(band):
            linked &= sig[:, j][:, None] != sig[:, j][None]
    if low != high:  # pairs within a block are verified where the block meets itself
        mine = run["mine"].to_numpy()
        linked &= mine[:, None] != mine[None]
    keys = run["key"].to_pylist()
    copies = run["copies"].to_numpy()
    weight = linked @ copies
    has = np.flatnonzero(weight)
    forest = _forest(linked)
    return [keys[i] for i in has] + [keys[a] for a, _ in forest], [int(weight[i]) for i in has] + [None] * len(forest), [None] * len(has) + [keys[b] for _, b in forest]


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that span each component, found breadth first."""
    seen = ~linked.any(1)
    found = []
    for s in range(len(linked)):
        if seen[s]:
            continue
        seen[s] = True
        queue = [s]
        while queue:
            a = queue.pop()
            new = np.flatnonzero(linked[a] & ~seen)
            seen[new] = True
            found.extend((int(x), s) for x in new)
            queue.extend(new.tolist())
    return found


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, ngram: int = NGRAM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each class: the one of the smallest id, and of rows equal in id and text one."""
    classes = join(docs, threshold, ngram, doc_id, text)
    # a class without any id keeps the text of its smallest key
    best = classes.groupBy("key").agg(F.first("root").alias("root"), F.min("doc_id").alias("least"))
    first = best.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("no"), "least", "key")).alias("f")).select(F.col("f.key").alias("key"), F.col("f.least").alias("least"))
    columns = docs.columns
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), base.text_key(f"`{text}`").alias("key"), F.col(f"`{doc_id}`").cast("bigint").alias("least"))
    # by text and id, so that copies of a text don't meet in one task
    on = ["key", "id", "no_id"]
    told = lambda df: df.withColumn("id", F.coalesce("least", F.lit(0))).withColumn("no_id", F.col("least").isNull())
    met = told(held).join(told(first).select(*on), on, "left_semi").groupBy(*on).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return met.select(*(F.col(f"row.`{c}`").alias(c) for c in columns))
