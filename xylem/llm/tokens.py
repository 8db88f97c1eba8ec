"""Token ids of whole texts with a public tokenizer, encoding each distinct piece of a text once.

A tokenizer with the NORMALIZER and PRE_TOKENIZER below drops white space and never lets a token cross it, so a text's ids are those of
its words end to end. Words are cut further where its pre-tokenizer cuts for certain: between ASCII letters, digits and other signs.
Pieces are told apart by a 64-bit hash; the library encodes each new one, and ids are gathered by array operations. Any other tokenizer
file has the library encode whole texts.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from itertools import chain

import numpy as np
import pandas as pd

from xylem.llm.text import LOWER, flat, span_hashes, word_bounds

#: Most pieces that a worker's cache holds before it starts anew.
CACHE_PIECES = 600_000
END_ID = 1

# classes of bytes: 0 space, 1 letter, 2 digit, 3 other ASCII sign, 4 part of a longer character, 5 apostrophe
_CLASS = np.full(256, 3, np.uint8)
_CLASS[128:] = 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = 1
_CLASS[97:123] = 1
_CLASS[39] = 5
#: Whether a piece ends between two neighbouring classes.
_CUT = np.zeros((6, 6), bool)
for _a, _b in ((1, 2), (2, 1), (2, 2), (1, 3), (3, 1), (2, 3), (3, 2), (4, 2), (1, 5), (2, 5)):
    _CUT[_a, _b] = True
_CUT[0], _CUT[:, 0] = True, True
_CUT = _CUT.ravel()


#: What pieces rely on (fixed values): the parts of a tokenizer file that cut and change texts before its model.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_chars() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable Latin-1, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


class Encoder:
    """A tokenizer with a cache of the ids of pieces; one for each worker process."""

    _own: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        marks = [t["content"] for t in parts["added_tokens"]]
        #: Whether ids of pieces end to end are those of the text.
        self.by_pieces = parts["normalizer"] == NORMALIZER and parts["pre_tokenizer"] == PRE_TOKENIZER and parts["model"]["type"] == "BPE" and parts["truncation"] is None and all(m.startswith("<|") for m in marks)
        self.chars = byte_chars()
        suffix = parts["model"].get("end_of_word_suffix")
        self.by_pieces = self.by_pieces and bool(suffix)
        vocabulary = self.tokenizer.get_vocab()
        #: Whether an id ends a word.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self._clear()

    def _clear(self):
        # keys in order with their entries' numbers; an entry's place in ``ids`` and length by its number
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.n, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> np.ndarray:
        """Add pieces to the cache; their entries' numbers. Those that are surely one pre-token, unchanged by the normalizer, go to the tokenizer's model at once."""
        if len(self.keys) + len(keys) > CACHE_PIECES and len(self.keys):
            raise OverflowError
        plain, one, other, chars = [], [], [], self.chars
        for i, p in enumerate(pieces):
            if p.isalpha():
                if p.isascii():  # these bytes stand for themselves
                    plain.append(p)
                    one.append(i)
                    continue
                if p.islower() and max(p) < "\u0250" and unicodedata.is_normalized("NFC", p):
                    plain.append(p.encode().decode("latin-1").translate(chars))
                    one.append(i)
                    continue
            other.append(i)
        ids, n = [None] * 2, np.zeros(len(pieces), np.int64)
        ids[0] = np.fromiter([x.id for x in chain.from_iterable(map(self.tokenizer.model.tokenize, plain))], np.int32)
        last = np.flatnonzero(self.ends[ids[0]])  # each has one token that ends a word
        if len(last) != len(one) or len(one) and last[-1] != len(ids[0]) - 1:
            raise ValueError("a word without a token that ends it")
        n[np.array(one, np.int64)] = np.diff(last, prepend=-1)
        found = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i] for i in other], add_special_tokens=False)]
        n[np.array(other, np.int64)] = [len(x) for x in found]
        ids[1] = np.fromiter(chain.from_iterable(found), np.int32)
        order = np.array(one + other, np.int64)
        at = np.empty(len(pieces), np.int64)
        at[order] = len(self.ids) + np.cumsum(n[order]) - n[order]
        numbers = len(self.at) + np.arange(len(pieces))
        self.ids, self.at, self.n = np.r_[self.ids, *ids], np.r_[self.at, at], np.r_[self.n, n]
        order = np.argsort(keys)
        where = np.searchsorted(self.keys, keys[order])
        self.keys, self.entry = np.insert(self.keys, where, keys[order]), np.insert(self.entry, where, numbers[order])
        return numbers

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a string column end to end, each document's with END_ID after it, and the documents' offsets."""
        if not self.by_pieces:
            return self._whole(column)
        raw, offs = flat(column)
        raw = LOWER[raw]
        if b"<|" in raw.tobytes():  # special tokens are found before all else: cut at white space only
            starts, ends, _ = word_bounds(raw, offs)
        else:
            kind = _CLASS[raw]
            cut = np.ones(len(raw) + 1, bool)
            if len(raw):
                cut[1:-1] = _CUT[kind[:-1] * np.uint8(6) + kind[1:]]
            cut[offs] = True
            edges = np.flatnonzero(cut)
            starts, ends = edges[:-1], edges[1:]
            full = kind[starts] != 0
            starts, ends = starts[full], ends[full]
        first = np.searchsorted(starts, offs)
        codes, keys = pd.factorize(span_hashes(raw, starts, ends))
        entry = self._find(keys)
        if (new := np.flatnonzero(entry < 0)).size:
            where = np.full(len(keys), -1, np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]
            text = raw.tobytes()
            pieces = [text[starts[i] : ends[i]].decode("utf-8", "replace") for i in where[new]]
            try:
                entry[new] = self._learn(keys[new], pieces)
            except OverflowError:
                self._clear()
                pieces = [text[starts[i] : ends[i]].decode("utf-8", "replace") for i in where]
                entry = self._learn(keys, pieces)
        at, n = self.at[entry][codes], self.n[entry][codes]
        ends_of = np.r_[0, np.cumsum(n)]
        before = np.repeat(np.arange(len(offs) - 1), np.diff(first))  # an end id for each document before
        doc_offs = ends_of[first] + np.arange(len(offs))
        out = np.full(doc_offs[-1], END_ID, np.int32)
        each = np.arange(ends_of[-1])
        out[each + np.repeat(before, n)] = self.ids[each + np.repeat(at - ends_of[:-1], n)]
        return out, doc_offs

    def _whole(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Like encode(), by the library over whole texts."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
        offs = np.r_[0, np.cumsum([len(x) + 1 for x in found], dtype=np.int64)]
        return np.fromiter((i for x in found for i in (*x, END_ID)), np.int32, int(offs[-1])), offs

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entries' numbers of keys, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.entry[at], -1)


def crc(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
