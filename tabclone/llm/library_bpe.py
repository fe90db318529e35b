"""The tokenizers library over batches of texts, each distinct piece once.

A byte-level tokenizer cuts words off before it merges, and a single space before anything but white space always begins a
word.  So the ids of a text are those of its pieces between spaces, in order, each piece with its space.  The distinct pieces
of a batch are cut into words by the published pattern, and the library's model merges each distinct word once.  What is not
that plain goes through the library whole: pieces with characters on which two pattern engines might disagree, and texts with
runs of white space that hold spaces, or with strings of special tokens.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The published pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters in every version of Unicode, then at most full stops and commas.
SIMPLE = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+[.,]*$"
PLAIN = "^[\t\n\r\x20-\x7e\u00a1-\u024f\u2013-\u201e\u2026\u20ac]*$"

#: Words that are joined for one call, and calls in a batch.
JOINED, CALLS = 400, 25
EMPTY = pa.scalar("", pa.large_string())
_encoders: dict[int, "LibraryEncoder"] = {}


def encoder(spec: str) -> "LibraryEncoder":
    """The worker's encoder for a tokenizer file's content; built once for each process."""
    key = hash(spec)
    if key not in _encoders:
        _encoders[key] = LibraryEncoder(spec)
    return _encoders[key]


class LibraryEncoder:
    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        from tokenizers import pre_tokenizers

        # words come cut, in the letters that stand for bytes; the letter of a line end is a word between them
        self.merge = Tokenizer(self.tok.model)
        self.letters = byte_letters()
        self.merge.pre_tokenizer = pre_tokenizers.Split(self.letters[10], "isolated")
        self.end = self.tok.token_to_id(self.letters[10])
        self.words = regex.compile(PATTERN).findall

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a large_string array without nulls, in one uint32 array, and the number of ids of each text."""
        n = len(texts)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        split = pc.split_pattern(texts, " ")
        at = np.asarray(split.offsets)
        at, values = at - at[0], split.flatten()
        coded = values.dictionary_encode()
        codes, table = np.asarray(coded.indices).astype(np.int64), coded.dictionary
        pieces = table.to_pylist()
        first = np.zeros(len(codes), bool)
        first[at[:-1]] = True
        owner = np.repeat(np.arange(n), np.diff(at))
        bad = np.fromiter((not p or p[0].isspace() for p in pieces), bool, len(pieces))
        odd = np.zeros(n, bool)
        odd[owner[bad[codes] & ~first]] = True
        for s in self.special:
            odd |= np.asarray(pc.match_substring(texts, s))
        # the first piece of a text has no space before it: it is looked up apart
        used = np.zeros(len(pieces), bool)
        used[codes[~first & ~odd[owner]]] = True
        inner, sizes = self._pieces(table.filter(pa.array(used)))
        heads = np.flatnonzero(~odd)
        head_ids = [e.ids for e in self._batch([pieces[i] for i in codes[at[heads]]])]
        whole = [self.tok.encode(texts[int(i)].as_py(), add_special_tokens=False).ids for i in np.flatnonzero(odd)]
        apart = [np.array(x, np.uint32) for x in (*head_ids, *whole)]
        flat = np.concatenate([inner, *apart])
        done = len(sizes)
        sizes = np.concatenate([sizes, np.fromiter(map(len, apart), np.int64, len(apart))])
        slot = np.full(len(pieces), -1)
        slot[used] = np.arange(used.sum())
        slots = slot[codes]
        slots[at[heads]] = done + np.arange(len(heads))
        slots[at[np.flatnonzero(odd)]] = done + len(heads) + np.arange(len(whole))
        keep = first | ~odd[owner]
        slots, owner = slots[keep], owner[keep]
        lens = np.bincount(owner, sizes[slots], n).astype(np.int64)
        return gather(flat, np.cumsum(sizes) - sizes, sizes, slots), lens

    def _batch(self, texts: list[str]) -> list:
        return self.tok.encode_batch_fast(texts, add_special_tokens=False) if texts else []

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces, each with a space before it, and the number of ids of each."""
        n = len(pieces)
        simple = np.asarray(pc.match_substring_regex(pieces, SIMPLE))
        plain = np.asarray(pc.match_substring_regex(pieces, PLAIN)) & ~np.asarray(pc.match_substring(pieces, "\0"))
        some = pieces.filter(pa.array(simple))
        bodies = pc.utf8_rtrim(some, ".,")
        tails = pc.replace_substring_regex(some, "^[^.,]+", "")
        has = np.asarray(pc.binary_length(tails)) > 0
        counts = np.ones(n, np.int64)
        counts[simple] += has
        rest = np.flatnonzero(plain & ~simple)
        cut = [self.words(" " + p) for p in pieces.take(pa.array(rest)).to_pylist()]
        counts[rest] = [len(x) for x in cut]
        whole = np.flatnonzero(~plain & ~simple)
        at = np.cumsum(counts) - counts
        lead = pc.binary_join_element_wise(EMPTY, bodies, pa.scalar(" ", pa.large_string()))
        every = pa.concat_arrays([lead, tails.filter(pa.array(has)), pa.array([w for x in cut for w in x], pa.large_string())])
        coded = every.dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        flat, lens = self._merged(coded.dictionary.to_pylist())
        apart = [np.array(e.ids, np.uint32) for e in self._batch([" " + p for p in pieces.take(pa.array(whole)).to_pylist()])]
        flat = np.concatenate([flat, *apart])
        lens = np.concatenate([lens, np.fromiter(map(len, apart), np.int64, len(apart))])
        seq = np.empty(int(counts.sum()), np.int64)
        one = np.flatnonzero(simple)
        a, b = len(one), len(one) + int(has.sum())
        seq[at[one]] = codes[:a]
        seq[at[one[has]] + 1] = codes[a:b]
        inner = np.zeros(len(seq), bool)
        inner[np.repeat(np.isin(np.arange(n), rest), counts)] = True
        seq[inner] = codes[b:]
        seq[at[whole]] = len(lens) - len(whole) + np.arange(len(whole))
        owner = np.repeat(np.arange(n), counts)
        return gather(flat, np.cumsum(lens) - lens, lens, seq), np.bincount(owner, lens[seq], n).astype(np.int64)

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of cut words, and the number of ids of each."""
        ids, lens = [np.zeros(0, np.uint32)], np.zeros(len(words), np.int64)
        whole = [i for i, w in enumerate(words) if "\n" in w]
        own = dict(zip(whole, (e.ids for e in self._batch([words[i] for i in whole])), strict=True))
        easy = [w for i, w in enumerate(words) if i not in own] if own else words
        groups = [easy[i : i + JOINED] for i in range(0, len(easy), JOINED)]
        counts = [np.zeros(0, np.int64)]
        for i in range(0, len(groups), CALLS):
            joined = ["\n".join([*g, ""]).encode().decode("latin-1").translate(self.letters) for g in groups[i : i + CALLS]]
            for e in self.merge.encode_batch_fast(joined, add_special_tokens=False):
                got = np.array(e.ids, np.uint32)
                ends = got == self.end
                at = np.flatnonzero(ends)
                counts.append(np.diff(at, prepend=-1) - 1)
                ids.append(got[~ends])
        # words with line ends come last in ids, and keep their places in lens
        hard = np.zeros(len(words), bool)
        hard[whole] = True
        lens[~hard] = np.concatenate(counts)
        lens[whole] = [len(own[i]) for i in whole]
        flat = np.concatenate([*ids, *(np.array(own[i], np.uint32) for i in whole)])
        if not whole:
            return flat, lens
        places = np.argsort(hard, kind="stable")
        starts = np.empty(len(words), np.int64)
        starts[places] = np.cumsum(lens[places]) - lens[places]
        return gather(flat, starts, lens, np.arange(len(words))), lens


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The slices of flat that codes name, one after another."""
    n = lens[codes]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[codes] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
