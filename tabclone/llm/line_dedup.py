"""Line dedup by runs of lines.

Candidates are, from each line on and up to each line, the shortest run of whole lines that holds LONG words.  They depend on
nothing outside them, and every passage of LONG words or more is the union of those inside it, so it goes whole whatever stands
around it.  Shorter repeats are found by content-defined chunks of several lines: a rolling hash over the hashes of the last
WINDOW lines ends a chunk where it is 0 modulo DIVISOR.  Both go over blank lines, so that short paragraphs make a run; the bytes
compared hold the blank lines inside.

A candidate is removed wherever it occurs but for its first occurrence (smallest document id, then position).  Candidates share
a 128-bit hash; one goes only if its bytes equal those of the first.

Occurrences are counted with map-side partial sums.  The firsts of hot chunks (those that hold more than a quarter of a partition
of all rows, so at most four for each partition) are broadcast; the rows of all others are dealt out by hash, as hashes and
positions only.  Texts travel once, to meet their chunks' decisions.  The byte comparison then joins the repeated chunks alone
with their firsts, a hot chunk in as many parts as its count asks for; its result is the chunks that differ, which stay: hardly
any, so it is written first.

Defined cases: a null text stays null, an empty one empty; blank lines go where both sides of them go in one run,
and stay otherwise; rows equal in id and text are one document to the method (each gets the same text, which keeps a chunk first
seen there); null ids come first; an empty table gives an empty one; a column with the name of the new one gives way to it, and
other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

#: Lines of the rolling hash, the mean length of chunks in lines, and the words that make a run of lines a passage.
WINDOW, DIVISOR, LONG = 2, 3, 50
#: Occurrences of a chunk that are compared in one part.
PART = 512
_MASK = (1 << 64) - 1
_MULTIPLIER = 0x9E3779B97F4A7C15
_OUT = pow(_MULTIPLIER, WINDOW, 1 << 64)
CHUNKS = "key binary, id bigint, h binary, pos int, len int"


def chunks(text: str) -> Iterator[tuple[int, int]]:
    """Start and end (in characters, line ends inside included) of the runs of lines that may be removed, by start, each once."""
    found: set[tuple[int, int]] = set()
    run: list[tuple[int, int, int]] = []
    at = 0
    for line in text.split("\n"):
        n = len(line.split())
        if n:  # runs go over blank lines, which count nowhere
            run.append((at, at + len(line), n))
        at += len(line) + 1
    _content(text, run, found)
    _passages(run, found)
    # of repeated lines, a run that overlaps its equal would take lines of what is kept: both are one longer run
    first: dict[str, int] = {}
    whole: set[tuple[int, int]] = set()
    for a, b in sorted(found):
        f = first.setdefault(text[a:b], a)
        whole.add((a if f == a or a > f + b - a else f, b))
    yield from sorted(whole)


def _content(text: str, run: list[tuple[int, int, int]], found: set[tuple[int, int]]) -> None:
    """Chunks that end where the hash of the last WINDOW lines says so; a chunk of one short line goes on."""
    first = rolled = 0
    last = [0] * WINDOW  # hashes of the last WINDOW lines, in a ring
    for i, (a, b, n) in enumerate(run):
        if n >= LONG:
            if i - first > 1:
                found.add((run[first][0], run[i - 1][1]))
            first, rolled, last = i + 1, 0, [0] * WINDOW
            continue
        h = xxhash.xxh3_64_intdigest(text[a:b])
        rolled = (rolled * _MULTIPLIER + h - last[i % WINDOW] * _OUT) & _MASK
        last[i % WINDOW] = h
        if i > first and (rolled >> 32) % DIVISOR == 0:
            found.add((run[first][0], b))
            first = i + 1
    if len(run) - first > 1:
        found.add((run[first][0], run[-1][1]))


def _passages(run: list[tuple[int, int, int]], found: set[tuple[int, int]]) -> None:
    """From each line on, and up to each line, the shortest run of LONG words: together they cover every longer run."""
    i = total = 0
    for _, b, n in run:
        total += n
        if total < LONG:
            continue
        # the run that ends a line earlier began at i, or was too short
        if total - n < LONG:
            found.add((run[i][0], b))
        while total - run[i][2] >= LONG:
            total -= run[i][2]
            i += 1
            found.add((run[i][0], b))
        found.add((run[i][0], b))


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        key, name, h, pos, size = [], [], [], [], []
        for i, text in enumerate(rb.column("text").to_pylist()):
            for a, b in chunks(text or ""):
                key.append(i)
                h.append(xxhash.xxh3_128_digest(text[a:b]))
                pos.append(a)
                size.append(b - a)
        at = pa.array(key, pa.int64())
        yield pa.RecordBatch.from_pydict({"key": rb.column("key").take(at), "id": rb.column("id").take(at), "h": pa.array(h, pa.binary()), "pos": pa.array(pos, pa.int32()), "len": pa.array(size, pa.int32())})


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the spans, which may overlap, each with one line end beside it."""
    parts, at = [], 0
    for pos, n in sorted(spans):
        parts.append(text[at:pos])
        at = max(at, pos + n + 1)
    rest = text[at:]
    joined = "".join(parts)
    return joined + rest if rest else joined.removesuffix("\n") if at > len(text) else joined


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str | None = None) -> DataFrame:
    """docs with the repeated chunks gone from text; into names a column for the number of characters removed, if given."""
    spark = docs.sparkSession
    base.tune(spark)
    columns = docs.columns
    ident = F.unhex(F.md5(F.concat_ws("\0", F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("-")), F.col(f"`{text}`"))))
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), ident.alias("key"))
    texts = held.select("key", F.col(f"row.`{doc_id}`").cast("bigint").alias("id"), F.col(f"row.`{text}`").cast("string").alias("text"))
    found = base.cut(texts.mapInArrow(_find, CHUNKS), "line-chunks")
    # null ids sort first in a struct; one document is one occurrence at each position
    place = F.struct("id", "key", "pos", "len")
    counted = found.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("first != last")
    repeated = base.cut(counted.select("h", "first", F.ceil(F.col("n") / PART).cast("int").alias("parts"), "n"), "line-repeated")
    met = base.spread_join(found, repeated, ["h"], "n")
    spans = met.groupBy("key").agg(F.collect_set(F.struct("h", "pos", "len", (place == F.col("first")).alias("is_first"), "parts")).alias("spans"))
    marked = base.cut(held.join(spans, "key", "left"), "line-marked")
    pieces = marked.where("spans IS NOT NULL").select("key", F.col(f"row.`{text}`").cast("string").alias("text"), F.explode("spans").alias("s")).select("key", "s.*", F.expr("substring(text, s.pos + 1, s.len)").alias("piece"))
    # the first of a hot chunk goes to each of its parts
    kept = pieces.where("is_first").groupBy("h").agg(F.first("piece").alias("other"), F.first("parts").alias("parts")).select("h", "other", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    others = pieces.where("NOT is_first").withColumn("part", F.pmod(F.xxhash64("key", "pos"), F.col("parts")).cast("int"))
    differ = others.join(kept, ["h", "part"]).where("piece != other").select("key", "pos", "len").distinct()
    stay = base.cut(differ.groupBy("key").agg(F.collect_set(F.struct("pos", "len")).alias("stay")), "line-stay")
    joined = marked.join(stay, "key", "left")
    gone = F.expr("filter(coalesce(spans, array()), s -> NOT s.is_first AND NOT coalesce(exists(stay, x -> x.pos = s.pos AND x.len = s.len), false))")
    return _rebuilt(joined.withColumn("gone", gone), columns, text, into)


def _rebuilt(rows: DataFrame, columns: list[str], text: str, into: str | None) -> DataFrame:
    body = F.col(f"row.`{text}`").cast("string")
    # only texts with something to cut travel to Python
    some = F.when(F.size("gone") > 0, body)
    done = rows.withColumn("text", F.coalesce(F.pandas_udf(_cut_out, "string")(some, F.expr("transform(gone, s -> s.pos)"), F.expr("transform(gone, s -> s.len)")), body))
    out: list[Column] = [F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in columns if not into or c.lower() != into.lower()]
    if into:
        out.append((F.coalesce(F.char_length(body), F.lit(0)) - F.coalesce(F.char_length("text"), F.lit(0))).alias(into))
    return done.select(*out)


def _cut_out(texts: pd.Series, pos: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _without(t, list(zip(p, n, strict=True))) for t, p, n in zip(texts, pos, size, strict=True)], dtype=object)
