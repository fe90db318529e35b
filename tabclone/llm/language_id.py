"""Language identification of mixed-language text.

Script ranges narrow each word to the languages that were seen in its script; character trigrams (with word ends) score it under
each of those; Viterbi over the words, with a penalty for each switch, labels spans.  A document's language is the one of most
letters on that path, its score the share of those letters.

Training counts trigrams in at most PER_LANGUAGE documents of each language, drawn by hash; the counts of that bounded sample
reach the driver one partition at a time, and the model (languages x TABLE floats) is broadcast.

Defined cases: a text that is null or has no letter is "und" with score 0; letters of scripts that no language was seen in score
alike under all of them, and the language of most training letters wins ties; repeated rows and null ids are labelled row by
row; an empty table gives an empty one; with no labelled row every text is "und"; a column with the name of the new one gives way
to it, and other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

UNKNOWN = "und"
#: Documents of each language that training reads, about; entries of the trigram table; smoothing counts; the most that one
#: word may tell for or against a language, and what a switch costs, both in natural logarithms.
PER_LANGUAGE, TABLE, SMOOTH, MOST, SWITCH = 400, 1 << 16, 0.5, 8.0, 12.0
#: A script belongs to a language from this share of its letters on.
SCRIPT_SHARE = 0.01
#: First code points of scripts, in order; what lies between two belongs to the first.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Other"), (0x0E00, "Thai"),
    (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"),
    (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"),
)
_FIRST = np.array([a for a, _ in SCRIPTS])
_NAMES = list(dict.fromkeys(n for _, n in SCRIPTS))
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPTS])
#: A letter, then letters and the marks on them, such as the vowel signs of Indic scripts.
WORD = r"\p{L}[\p{L}\p{M}]*"
_words = regex.compile(WORD).findall


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of at least a letter: a table entry for each letter and its neighbours, the script of each first letter, and the lengths."""
    joined = " " + " ".join(words) + " "
    points = np.frombuffer(joined.lower().encode("utf-32-le"), "<u4").astype(np.int64)
    if len(points) != len(joined):  # a letter whose lower case has several characters
        words = [w.lower() for w in words]
        points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), "<u4").astype(np.int64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    hashed = (points[:-2] * 0x9E3779B1 + points[1:-1] * 0x85EBCA6B + points[2:] * 0xC2B2AE35) & 0xFFFFFFFF
    entries = ((hashed ^ (hashed >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> 16
    at = np.flatnonzero(points[1:-1] != 0x20)
    first = np.cumsum(lens + 1) - lens
    return entries[at], _SCRIPT[np.searchsorted(_FIRST, points[first], "right") - 1], lens


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # table entry x language
    scripts: np.ndarray  # script x language: may a word of this script be of this language?

    def score(self, words: list[str]) -> np.ndarray:
        """Words x languages: scores relative to the best, from -MOST to 0."""
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        entries, scripts, lens = _trigrams(words)
        starts = np.cumsum(lens) - lens
        total = np.add.reduceat(self.scores[entries], starts, axis=0)
        may = self.scripts[scripts]
        may |= ~may.any(1, keepdims=True)
        known = self.scripts[scripts].any(1, keepdims=True)
        total = np.where(known, total, 0)
        total = np.where(may, total, -np.inf)
        return np.maximum(total - total.max(1, keepdims=True), -MOST).astype(np.float32)


def draw(docs: DataFrame, lang: str, text: str, per_language: int) -> DataFrame:
    """About per_language labelled texts of each language, chosen by hash: one count, then one filtered scan."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    share = F.lit(None).cast("double")
    for r in docs.where(F.col(lang).isNotNull()).groupBy(F.col(lang).cast("string").alias("lang")).count().collect():
        share = F.when(F.col("lang") == r["lang"], F.lit(per_language / r["count"])).otherwise(share)
    return rows.where(F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 30)) < share * (1 << 30))


def train(docs: DataFrame, lang: str = "lang", text: str = "text", per_language: int = PER_LANGUAGE) -> Model:
    """docs holds the rows that may be learnt from; rows without a language are skipped."""
    counts: dict[str, np.ndarray] = {}
    letters: dict[str, np.ndarray] = {}
    for r in draw(docs, lang, text, per_language).toLocalIterator():
        if not (words := _words(r["text"])):
            continue
        entries, scripts, lens = _trigrams(words)
        own = counts.setdefault(r["lang"], np.zeros(TABLE))
        np.add.at(own, entries, 1)
        letters.setdefault(r["lang"], np.zeros(len(_NAMES)))
        letters[r["lang"]] += np.bincount(scripts, lens, len(_NAMES))
    languages = sorted(counts, key=lambda x: (-letters[x].sum(), x))
    if not languages:
        return Model([], np.zeros((TABLE, 0), np.float32), np.zeros((len(_NAMES), 0), bool))
    table = np.stack([np.log((counts[x] + SMOOTH) / (counts[x].sum() + SMOOTH * TABLE)) for x in languages], 1)
    scripts = np.stack([letters[x] >= SCRIPT_SHARE * letters[x].sum() for x in languages], 1)
    return Model(languages, table.astype(np.float32), scripts)


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best path of each run of words: a label for each row of scores; counts has the lengths of the runs.

    All runs advance together, a word at a time; the longest come first, so that those still running are a prefix.
    """
    path = np.zeros(len(scores), np.int16)
    order = np.argsort(-counts, kind="stable")
    lens = counts[order]
    starts = (np.cumsum(counts) - counts)[order]
    if not len(lens) or lens[0] == 0:
        return path
    running = np.searchsorted(-lens, -np.arange(1, lens[0] + 1), "right")
    back = np.zeros(scores.shape, np.int16)
    value = scores[starts[: running[0]]].copy()
    ends = np.zeros(len(lens), np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t in range(1, lens[0] + 1):
        n = running[t] if t < lens[0] else 0
        if n < len(value):  # these end here
            ends[n : len(value)] = value[n:].argmax(1)
            value = value[:n]
        if n == 0:
            break
        best = value.argmax(1)
        top = value[np.arange(n), best] - switch
        stay = value >= top[:, None]
        at = starts[:n] + t
        back[at] = np.where(stay, own, best[:, None].astype(np.int16))
        value = np.where(stay, value, top[:, None]) + scores[at]
    state = np.zeros(0, np.int16)
    for t in range(lens[0] - 1, -1, -1):
        n = running[t]
        if n > len(state):
            state = np.concatenate([state, ends[len(state) : n]])
        at = starts[:n] + t
        path[at] = state
        state = back[at, state] if t else state
    return path


def _paths(model: Model, texts: pa.Array, switch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all words of the texts in order: label and number of letters; and the number of words of each text."""
    codes, counts, table = base.pieces(texts)
    cut = [_words(p) for p in table.to_pylist()]
    each = np.fromiter(map(len, cut), np.int64, len(cut))
    words: dict[str, int] = {}
    flat = np.fromiter((words.setdefault(w, len(words)) for x in cut for w in x), np.int64, int(each.sum()))
    scores = model.score(list(words))
    letters = np.fromiter(map(len, words), np.int64, len(words))
    seq = base.gather(flat, each, codes)
    n = base.spread(each[codes], counts)
    return viterbi(scores[seq], n, switch), letters[seq], n


def label(docs: DataFrame, model: Model, text: str = "text", switch: float = SWITCH, into: str = "language") -> DataFrame:
    """docs with one more column: a struct of lang_pred, score (0 to 1) and n_spans."""
    spark = docs.sparkSession
    base.tune(spark)
    own = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, n_spans int")
    def tell(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield _told(own.value, base.large_text(pa.array(part, pa.large_string(), from_pandas=True)), switch)

    return docs.withColumn(into, tell(F.col(f"`{text}`").cast("string")))


def _told(model: Model, texts: pa.Array, switch: float) -> pd.DataFrame:
    k = len(model.languages)
    if not k:
        return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "n_spans": 0})
    path, letters, n = _paths(model, texts, switch)
    doc = np.repeat(np.arange(len(texts)), n)
    share = np.bincount(doc * k + path, letters, len(texts) * k).reshape(-1, k)
    total = share.sum(1)
    best = share.argmax(1)
    new = np.append(True, (path[1:] != path[:-1]) | (doc[1:] != doc[:-1]))[: len(path)]
    names = np.array([*model.languages, UNKNOWN], object)
    return pd.DataFrame({"lang_pred": names[np.where(total > 0, best, k)], "score": share.max(1) / np.maximum(total, 1), "n_spans": np.bincount(doc[new], minlength=len(texts)).astype(np.int32)})


def spans(docs: DataFrame, model: Model, text: str = "text", switch: float = SWITCH) -> DataFrame:
    """docs with one more column, spans: start and end (in characters), and language, of each run of words of one language."""
    spark = docs.sparkSession
    base.tune(spark)
    own = spark.sparkContext.broadcast(model)
    at = regex.compile(WORD).finditer

    @F.pandas_udf("array<struct<start: int, end: int, language: string>>")
    def tell(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for t in part.fillna(""):
                found = [(m.start(), m.end()) for m in at(t)]
                runs: list[dict] = []
                if found and own.value.languages:
                    path = viterbi(own.value.score([t[a:b] for a, b in found]), np.array([len(found)]), switch)
                    for (a, b), x in zip(found, path.tolist(), strict=True):
                        name = own.value.languages[x]
                        if runs and runs[-1]["language"] == name:
                            runs[-1]["end"] = b
                        else:
                            runs.append({"start": a, "end": b, "language": name})
                out.append(runs)
            yield pd.Series(out)

    return docs.withColumn("spans", tell(F.col(f"`{text}`").cast("string")))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id's text, modulo 5, is 0; a null id is not held out, nor learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 5 == 0, F.lit(False))
