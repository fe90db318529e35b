"""Token-id files: bit-plane shuffled, zstandard-compressed, with a chunk index.

Documents are dealt out by ranges of their id and sorted; each range becomes one part, which is a list of segments.  A segment
holds whole documents: their ids and lengths, and the token ids in chunks of CHUNK ids.  A chunk is transposed into planes (the
four bytes of each id, or its 32 bits) and each plane is compressed by itself; the index has the size of every plane, so that
any chunk can be read alone.  Segments are rows of a Parquet table, so that Spark's committer puts whole parts in place when an
executor is lost, and so that any store that Spark reads will do.

Defined cases: a null or empty text is the end id alone; null ids come first; rows with equal ids follow by their text's hash;
repeated rows are all kept; an empty table gives an empty set of files; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import base
from .library_bpe import encoder

CHUNK = 1 << 14
SEGMENT = 1 << 19
LEVEL = 3
SCHEMA = "part int, segment int, at bigint, n_ids bigint, doc_ids array<bigint>, doc_lens array<bigint>, planes string, index array<int>, payload binary"


def shuffle(ids: np.ndarray, planes: str) -> list[bytes]:
    """The planes of a chunk, least significant first; a plane of zeros is empty."""
    ids = np.ascontiguousarray(ids, "<u4")
    if planes == "byte":
        rows = ids.view(np.uint8).reshape(-1, 4).T
    elif planes == "bit":
        rows = np.packbits(np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").T, axis=1)
    else:
        raise ValueError("planes are of bytes or bits")
    return [r.tobytes() if r.any() else b"" for r in rows]


def unshuffle(rows: list[bytes], n: int, planes: str) -> np.ndarray:
    width = n if planes == "byte" else -(-n // 8)
    full = np.stack([np.frombuffer(r, np.uint8) if r else np.zeros(width, np.uint8) for r in rows])
    if planes == "bit":
        full = np.packbits(np.unpackbits(full, axis=1, count=n).T, axis=1, bitorder="little")
    else:
        full = np.ascontiguousarray(full.T)
    return full.reshape(-1).view("<u4")


def compress(ids: np.ndarray, planes: str = "byte", chunk: int = CHUNK, level: int = LEVEL) -> tuple[list[int], bytes]:
    """The index (bytes of each plane of each chunk) and the compressed planes, one after another."""
    z = zstandard.ZstdCompressor(level=level)
    parts = [z.compress(p) if p else b"" for i in range(0, len(ids), chunk) for p in shuffle(ids[i : i + chunk], planes)]
    return [len(p) for p in parts], b"".join(parts)


def decompress(index: list[int], payload: bytes, n: int, planes: str = "byte", chunk: int = CHUNK) -> np.ndarray:
    z, each = zstandard.ZstdDecompressor(), 4 if planes == "byte" else 32
    ends = np.cumsum([0, *index])
    rows = [z.decompress(payload[a:b]) if b > a else b"" for a, b in zip(ends[:-1], ends[1:], strict=True)]
    out = [unshuffle(rows[k * each : (k + 1) * each], min(chunk, n - i), planes) for k, i in enumerate(range(0, n, chunk))]
    return np.concatenate([np.zeros(0, "<u4"), *out])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, planes: str = "byte", doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes all documents, each with end_id after it, and writes them to path in ascending order of doc_id."""
    spark = docs.sparkSession
    base.tune(spark)
    spec = spark.sparkContext.broadcast(tokenizer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, segment, at = encoder(spec.value), TaskContext.get().partitionId(), 0, 0
        for rb in base.gathered(base.slices(batches, "text", base.BATCH_BYTES), "text", base.BATCH_BYTES):
            ids, lens = enc.encode(base.large_text(rb.column("text")))
            ends = np.cumsum(lens + 1)
            flat = np.full(int(ends[-1]), end_id, "<u4")
            own = np.ones(len(flat), bool)
            own[ends - 1] = False
            flat[own] = ids
            names, first = rb.column("doc_id"), 0
            while first < len(lens):
                begin = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, begin + SEGMENT, "right")))
                piece = flat[begin : int(ends[last - 1])]
                index, payload = compress(piece, planes)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int32()), "segment": pa.array([segment], pa.int32()), "at": [at], "n_ids": [len(piece)],
                    "doc_ids": pa.array([names.slice(first, last - first).to_pylist()], pa.list_(pa.int64())), "doc_lens": pa.array([lens[first:last] + 1], pa.list_(pa.int64())),
                    "planes": [planes], "index": pa.array([index], pa.list_(pa.int32())), "payload": pa.array([payload], pa.binary()),
                })
                segment, at, first = segment + 1, at + len(piece), last

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(base.shuffles(spark), F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    dealt.select("doc_id", "text").mapInArrow(run, SCHEMA).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens and its ids, as little-endian unsigned 32-bit integers.

    What lies before a part is summed over the parts, of which there are as many as there were ranges; that table is broadcast.
    """
    base.tune(spark)
    files = spark.read.schema(SCHEMA).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = files.join(F.broadcast(before), "part").select((F.col("at") + F.col("before")).alias("at"), "n_ids", "doc_ids", "doc_lens", "planes", "index", "payload")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i in range(rb.num_rows):
                r = rb.slice(i, 1)
                lens = r.column("doc_lens").flatten().to_numpy()
                ids = decompress(r.column("index").flatten().to_pylist(), r.column("payload")[0].as_py(), r.column("n_ids")[0].as_py(), r.column("planes")[0].as_py())
                offsets = np.concatenate(([0], np.cumsum(lens)))
                if offsets[-1] >= 1 << 29:  # segments are far smaller, so this is one document
                    raise ValueError("a document of 2^29 ids or more is longer than a binary value can be")
                data = pa.BinaryArray.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
                yield pa.RecordBatch.from_pydict({"doc_id": r.column("doc_ids").flatten(), "start": offsets[:-1] + r.column("at")[0].as_py(), "n_tokens": lens, "ids": data})

    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
