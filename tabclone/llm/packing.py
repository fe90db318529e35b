"""Packing by power-of-two decomposition.

A document's ids (with the end id) are cut, from the front, into as many pieces of the full length as fit and then into the
binary digits of the rest, longest first.  Every piece is a sequence of its own whose length is a power of two: no sequence
crosses documents and none needs padding.  Pieces of equal length form a bucket, from which batches of one shape are drawn.

Defined cases: a null or empty text is the end id alone (one piece of length 1); repeated rows and repeated or null ids are
packed row by row; an empty table gives no piece; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import base
from .library_bpe import encoder

SEQUENCE = 2048
#: Sequence ids are the task's number times this, and a count.
TASK_IDS = 1 << 40
SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, bucket int, ids binary"


def cuts(n: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of the pieces of documents with n ids, one after another, and the number of pieces of each."""
    if longest & (longest - 1):
        raise ValueError("the sequence length must be a power of two")
    powers = longest >> np.arange(1, longest.bit_length())
    digits = np.column_stack([n // longest, (n[:, None] & powers) > 0]).astype(np.int64)
    lengths = np.broadcast_to(np.append(longest, powers), digits.shape)
    return np.repeat(lengths.ravel(), digits.ravel()), digits.sum(1)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, longest: int = SEQUENCE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents, with their ids as little-endian unsigned 32-bit integers.

    tokenizer is the content of a byte-level tokenizer file.  No shuffle: each task encodes and cuts what it reads.
    """
    spark = docs.sparkSession
    base.tune(spark)
    spec = spark.sparkContext.broadcast(tokenizer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sequence = encoder(spec.value), TaskContext.get().partitionId() * TASK_IDS
        for rb in base.gathered(base.slices(batches, "text", base.BATCH_BYTES), "text", base.BATCH_BYTES):
            ids, lens = enc.encode(base.large_text(rb.column("text")))
            ends = np.cumsum(lens + 1)
            flat = np.full(int(ends[-1]), end_id, "<u4")
            own = np.ones(len(flat), bool)
            own[ends - 1] = False
            flat[own] = ids
            length, pieces = cuts(lens + 1, longest)
            doc = np.repeat(np.arange(len(lens)), pieces)
            at = np.cumsum(length) - length
            first = ends - lens - 1
            offsets = np.append(at, len(flat)) * 4
            out = {
                "doc_id": rb.column("doc_id").take(pa.array(doc)), "start": at - first[doc], "length": length, "doc_tokens": lens[doc] + 1,
                "sequence_id": sequence + np.arange(len(doc)), "offset": np.zeros(len(doc), np.int64), "bucket": np.log2(length).astype(np.int32),
            }
            sequence += len(doc)
            payload = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)])
            for i in range(0, len(doc), 4096):
                yield pa.RecordBatch.from_pydict({k: v[i : i + 4096] for k, v in out.items()} | {"ids": payload[i : i + 4096].cast(pa.binary())})

    return docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"cast(`{text}` as string) text").mapInArrow(run, SCHEMA)
