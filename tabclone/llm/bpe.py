"""BPE encoding and decoding with batched numpy merge rounds.

The distinct words of a batch lie in one flat array of symbols.  A round looks all neighbouring pairs up by binary search over
the sorted pair keys, finds the lowest rank in each word, merges every occurrence of that pair in the word (from the left, where
occurrences overlap) and drops the words that have no known pair left.  A new symbol only occurs in pairs of a higher rank than
the pair it came from, so a round for all occurrences equals merging them one by one.

Reads tokenizer files of the BPE kind with byte letters, an optional end-of-word suffix, the normalizers NFC, white space to
one space and lower case, and a pattern whose words hold no white space.  Decoding joins the tokens with spaces, as a file
without a decoder asks for.

Pieces of plain characters (PLAIN) are normalized and cut by Python; all others by the library's own normalizer and pre-tokenizer,
since versions of Unicode differ on what is a letter and what its lower case is.  The merges are always the numpy rounds.

Defined cases: a null or empty text has no ids and decodes to the empty text; strings of special tokens become their ids;
rows are independent, so repeated rows and ids don't matter; an empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from . import base

SCHEMA = "doc_id bigint, ids array<int>, decoded string"
#: Characters that are in their normal form, and of one kind and lower case in every version of Unicode.
PLAIN = "[\\t\\r\\x21-\\x7e\u00a1-\u012f\u0131-\u024f\u2013-\u201e\u2026\u20ac]*"
#: No pair of a word has a rank.
NONE = np.iinfo(np.int64).max
_codecs: dict[int, "Codec"] = {}


def codec(spec: str) -> "Codec":
    key = hash(spec)
    if key not in _codecs:
        _codecs[key] = Codec(spec)
    return _codecs[key]


def _letters() -> list[str]:
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Codec:
    def __init__(self, spec: str):
        file = json.loads(spec)
        model, vocab = file["model"], file["model"]["vocab"]
        if model.get("continuing_subword_prefix") or file["decoder"] is not None:
            raise ValueError("no tokenizer file of this kind")
        kinds = [x["type"] for x in file["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"unknown normalizers: {kinds}")
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(spec)
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.plain = regex.compile(PLAIN).fullmatch
        self.words = regex.compile(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        suffix, letters = model.get("end_of_word_suffix") or "", _letters()
        self.bytes = {x: b for b, x in enumerate(letters)}
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.final = np.array([vocab[x + suffix] for x in letters], np.int64)
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.size = max(names) + 1
        self.names = pa.array([names.get(i, "") for i in range(self.size)], pa.large_string())
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)[order]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and the number of ids of each."""
        raw = [w.encode() for w in words]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym, word = self.inner[data], np.repeat(np.arange(len(raw)), lens)
        last = np.cumsum(lens)[lens > 0] - 1
        sym[last] = self.final[data[last]]
        done_sym, done_word = [], []
        while len(sym):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            key = np.append(sym[:-1] * self.size + sym[1:], -1)
            key[starts[1:] - 1] = -1  # no pair crosses words
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.where(self.keys[at] == key, self.ranks[at], NONE)
            best = np.minimum.reduceat(rank, starts)
            low = np.repeat(best, np.diff(starts, append=len(sym)))
            open_ = low != NONE
            hit = np.flatnonzero((rank == low) & open_)
            # of occurrences that overlap, as in "aaa", the first, third, ... of a run are merged
            fresh = np.append(True, np.diff(hit) != 1)[: len(hit)]
            turn = np.arange(len(hit)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[turn % 2 == 0]
            sym[hit] = self.made[at[hit]]
            done_sym.append(sym[~open_])
            done_word.append(word[~open_])
            open_[hit + 1] = False
            sym, word = sym[open_], word[open_]
        if not done_sym:
            return np.zeros(0, np.int64), lens
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(raw))

    def _cut(self, text: str) -> list[str]:
        if self.plain(text):
            return self.words(text.lower())
        # words come in the letters that stand for bytes
        return [bytes(map(self.bytes.__getitem__, w)).decode() for w, _ in self.split(self.normal(text))]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a large_string array without nulls, and the number of ids of each text."""
        odd = np.zeros(len(texts), bool)
        for s in self.special:
            odd |= np.asarray(pc.match_substring(texts, s))
        plain = texts.filter(pa.array(~odd))
        codes, counts, table = base.pieces(plain)
        cut = [self._cut(p) for p in table.to_pylist()]
        each = np.fromiter(map(len, cut), np.int64, len(cut))
        words: dict[str, int] = {}
        flat = np.fromiter((words.setdefault(w, len(words)) for x in cut for w in x), np.int64, int(each.sum()))
        whole = [[self.special[p] if p in self.special else self._cut(p) for p in self.at_special.split(t)] for t in texts.filter(pa.array(odd)).to_pylist()] if odd.any() else []
        for t in whole:
            for p in t:
                if isinstance(p, list):
                    for w in p:
                        words.setdefault(w, len(words))
        ids, lens = self.encode_words(list(words))
        by_piece = base.spread(lens[flat], each)
        of_pieces = base.gather(ids, lens, flat)
        out = base.gather(of_pieces, by_piece, codes)
        sizes = np.zeros(len(texts), np.int64)
        sizes[~odd] = base.spread(by_piece[codes], counts)
        if whole:
            ends = np.cumsum(sizes)
            parts, at = [], 0
            for i, t in zip(np.flatnonzero(odd), whole, strict=True):
                own = np.concatenate([np.zeros(0, np.int64), *(base.gather(ids, lens, np.array([words[w] for w in p], np.int64)) if isinstance(p, list) else [p] for p in t)])
                parts += [out[at : ends[i]], own]
                at, sizes[i] = int(ends[i]), len(own)
            out = np.concatenate([*parts, out[at:]])
        return out.astype(np.int32), sizes

    def decode(self, ids: np.ndarray, lens: np.ndarray) -> pa.Array:
        """The text of each run of ids: its tokens, with spaces between them."""
        offsets = pa.array(np.concatenate(([0], np.cumsum(lens))), pa.int64())
        return pc.binary_join(pa.LargeListArray.from_arrays(offsets, self.names.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))


def encode_decode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the ids of each whole text and the text decoded from them; tokenizer is the content of the file."""
    spark = docs.sparkSession
    base.tune(spark)
    spec = spark.sparkContext.broadcast(tokenizer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec.value)
        for rb in base.gathered(base.slices(batches, "text", base.BATCH_BYTES), "text", base.BATCH_BYTES):
            ids, lens = own.encode(base.large_text(rb.column("text")))
            ends = np.cumsum(lens)
            for i in range(0, len(lens), 512):
                n = lens[i : i + 512]
                part = ids[int(ends[i] - lens[i]) : int(ends[i] + n[1:].sum())]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(part, pa.int32()))
                yield pa.RecordBatch.from_pydict({"doc_id": rb.column("doc_id").slice(i, len(n)), "ids": lists, "decoded": own.decode(part, n).cast(pa.string())})

    return docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"cast(`{text}` as string) text").mapInArrow(run, SCHEMA)
