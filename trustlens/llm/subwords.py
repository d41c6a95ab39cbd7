"""Subword ids of many texts with the ``tokenizers`` library, each distinct word encoded once.

The vocabulary's pre-tokenizer never joins characters across ASCII white space, so a text's
ids are the ids of its words in order. Words are looked up by 64-bit hash in sorted arrays
that hold a bounded number of words per Python worker; only words not seen yet reach the
library, and plain words (letters, then perhaps marks) go there many at a time in one string.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import pyarrow as pa

from trustlens.llm.words import row_slices, spans, text_buffer, word_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one worker per core

VOCABULARY = "word_bpe_49k.json"
#: id that ends each document
END_ID = 2
#: words that a worker remembers (some 30 bytes each)
REMEMBERED = 3_000_000
_PLAIN = re.compile(r"([^\W\d_]+)([.,;:!?|)]*)\Z")
_SPECIAL = "<|"


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?)"]] = True


def units(raw, starts, ends, bounds):
    """Words with one closing mark cut off where an ASCII letter or digit stands before it;
    the pre-tokenizer always cuts there."""
    if len(starts) == 0:
        return starts, ends, bounds
    cut = _MARK[raw[ends - 1]] & (ends - starts > 1)
    cut &= _ALNUM[raw[np.maximum(ends - 2, 0)]]
    more = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(cut, out=more[1:])
    place = np.arange(len(starts)) + more[:-1]
    s, e = np.empty(len(starts) + int(more[-1]), np.int64), np.empty(len(starts) + int(more[-1]), np.int64)
    s[place], e[place] = starts, ends - cut
    s[place[cut] + 1], e[place[cut] + 1] = ends[cut] - 1, ends[cut]
    return s, e, bounds + more[bounds]


class Encoder:
    """``Encoder.of(path)`` gives this worker's encoder of a vocabulary file."""

    _by_path: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.size = max(vocab.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.clear()

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    @classmethod
    def loaded(cls) -> list["Encoder"]:
        """The encoders that this worker has."""
        return list(cls._by_path.values())

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)
        self.used = 0

    def _one_by_one(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, ids per word)."""
        parts, pieces, odd = [], np.ones(len(words), np.int64), []
        for i, w in enumerate(words):
            m = _PLAIN.match(w)
            if m is None or _SPECIAL in w or not unicodedata.is_normalized("NFC", w):
                odd.append(i)
                parts.append("a")
            elif m[2]:
                parts.append(f"{m[1]} {m[2]}")
                pieces[i] = 2
            else:
                parts.append(w)
        joined = self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0]
        ids = np.asarray(joined.ids, np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != int(pieces.sum()):  # a letter that lower-cases to several characters
            got = self._one_by_one(words)
            return np.concatenate([np.asarray(g, np.uint32) for g in got]), np.array([len(g) for g in got], np.int64)
        stop = last[np.cumsum(pieces) - 1] + 1
        lens = np.diff(stop, prepend=0)
        if not odd:
            return ids, lens
        begin = stop - lens
        got = self._one_by_one([words[i] for i in odd])
        out, a = [], 0
        for i, g in zip(odd, got, strict=True):
            out += [ids[a:begin[i]], np.asarray(g, np.uint32)]
            a, lens[i] = stop[i], len(g)
        out.append(ids[a:])
        return np.concatenate(out), lens

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        flat, lens = self._encode_words(words)
        if len(self.keys) + len(keys) > REMEMBERED:
            self.clear()
        if self.used + len(flat) > len(self.flat):
            grown = np.zeros(max(2 * len(self.flat), self.used + len(flat), 1 << 16), np.uint32)
            grown[:self.used] = self.flat[:self.used]
            self.flat = grown
        self.flat[self.used:self.used + len(flat)] = flat
        at = self.used + np.cumsum(lens) - lens
        self.used += len(flat)
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.at = np.insert(self.at, place, at)
        self.count = np.insert(self.count, place, lens.astype(np.int32))

    def encode_rows(self, col: pa.Array):
        """For runs of rows: (first row, one past the last, ids of all of them, bounds by row)."""
        offsets, data = text_buffer(col)
        for a, b in row_slices(offsets):
            raw = data[offsets[a]:offsets[b]]
            starts, ends, bounds = units(raw, *spans(offsets[a:b + 1] - offsets[a], raw))
            ids, per_unit = self.encode_units(raw, starts, ends)
            total = np.zeros(len(per_unit) + 1, np.int64)
            np.cumsum(per_unit, out=total[1:])
            yield a, b, ids, total[bounds]

    def documents(self, col: pa.Array):
        """As ``encode_rows``, each row's ids followed by the end id."""
        for a, b, ids, bounds in self.encode_rows(col):
            yield a, b, np.insert(ids, bounds[1:], np.uint32(END_ID)), bounds + np.arange(b - a + 1)

    def encode_units(self, raw, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units [start, end) of ``raw``, and how many each has."""
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        h = word_hashes(raw, starts, ends)
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = self.keys[place] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            known = len(self.keys) + int(new.sum()) <= REMEMBERED
            todo = new if known else np.ones(len(keys), bool)  # it starts anew: all of this run again
            if not known:
                self.clear()
            data = raw.tobytes()
            words = [data[s:e].decode("utf-8", "replace") for s, e in
                     zip(starts[first[todo]].tolist(), ends[first[todo]].tolist(), strict=True)]
            self._learn(keys[todo], words)
            place = np.searchsorted(self.keys, keys)
        count, at = self.count[place][inverse].astype(np.int64), self.at[place][inverse]
        stop = np.cumsum(count)
        return self.flat[np.arange(int(stop[-1])) + np.repeat(at - stop + count, count)], count
