"""Token ids of whole texts: the library encodes every distinct piece once per process, numpy puts texts together.

The tokenizers cut a text into pieces before merging and never merge across white space, nor between a letter and the
punctuation after it.  The words of a slice of texts are hashed at once and looked up in an open-addressing table; only
new pieces go to the library, many in one text with a mark between them.  Texts with uneven white space, characters whose class differs between regular expression
engines, or the opening of a special token are encoded whole by the library.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from tidewatch.llm.common import BYTE, LOWER, U64, mix, span_hashes, word_spans

SLOTS = 1 << 22  # places of the table; it starts anew when it is half full

# White space besides space and line end, as the tokenizers' patterns see it; punctuation that ends words.
ODD = re.compile(r"<\||[\t\r\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
# The same in bytes: a slice without any of these is even.
ODD_BYTE = np.zeros(256, dtype=bool)
ODD_BYTE[[9, 11, 12, 13, 28, 29, 30, 31]] = True
ODD_BYTES = [x.encode() for x in ("<|", "\x85", "\xa0", "\u1680", "\u180e", "\u205f", "\u3000", "\ufeff")] + ["\u2000".encode()[:2]]
ENDINGS = ".,;:!?%&*#$|)\"-=/"
TAIL = np.zeros(256, dtype=np.int64)  # number of every ending, 0 for other bytes
TAIL[[ord(c) for c in ENDINGS]] = np.arange(1, len(ENDINGS) + 1)
TAIL_BASE = len(ENDINGS) + 1
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
FIRST, SPACED, NEW_LINE = (U64(x) for x in (0, 0x5851F42D4C957F2D, 0x14057B7EF767814F))
BEFORE = ("", " ", "")  # the id of a line end is put before the others by hand
SPACE_LETTER = "Ġ"  # how byte-level vocabularies write a space
TOGETHER = 500  # new pieces per text that the library gets


class Encoder:
    """``keeps_space``: the tokenizer takes the space before a word along (byte-level); else it drops white space and case."""

    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keeps_space = keeps_space
        # what stands between pieces, and the one id it becomes: white space parts words in both tokenizers
        self.between, self.mark = ("\n", "\n") if keeps_space else (" | ", "|")
        self.mark_id = self._each([self.mark])[0][0]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(SLOTS, dtype=U64)
        self.entry = np.zeros(SLOTS, dtype=np.int32)
        self.ids = np.zeros(1 << 20, dtype=np.uint32)
        self.offset = np.zeros(SLOTS // 2 + 1, dtype=np.int64)
        self.count = 1  # entry 0 has no ids
        self.tail_entry = np.full(TAIL_BASE**3, -1, dtype=np.int64)
        self.tail_entry[0] = 0

    def _each(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and their number per piece.

        Plain letters are one piece of the tokenizer's pattern, so its model merges them at once; the rest goes through the
        whole tokenizer.
        """
        out: list[list[int]] = [[]] * len(texts)
        merge, rest = self.tokenizer.model.tokenize, []
        for i, x in enumerate(texts):
            if x.isascii() and x.lstrip(" ").isalpha():
                out[i] = [t.id for t in merge(x.replace(" ", SPACE_LETTER) if self.keeps_space else x.lower())]
            else:
                rest.append(i)
        for i in range(0, len(rest), TOGETHER):
            for k, ids in zip(rest[i : i + TOGETHER], self._together([texts[k] for k in rest[i : i + TOGETHER]]), strict=True):
                out[k] = ids
        sizes = np.fromiter(map(len, out), dtype=np.int64, count=len(out))
        return np.fromiter((i for x in out for i in x), dtype=np.uint32, count=int(sizes.sum())), sizes

    def _together(self, texts: list[str]) -> list[list[int]]:
        """Ids of pieces that the library gets as one text."""
        found = self._each([self.between.join(texts)])[0]
        marks = [-1, *(i for i, x in enumerate(found) if x == self.mark_id), len(found)]
        if len(marks) != len(texts) + 1 or any(self.mark in x for x in texts):  # a piece has the mark in itself
            return self._each(texts)
        return [found[a + 1 : b] for a, b in zip(marks[:-1], marks[1:], strict=True)]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of every key, -1 if unknown."""
        out = np.full(len(keys), -1, dtype=np.int64)
        at = (keys & U64(SLOTS - 1)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.entry[at[hit]]
            go = ~hit & (there != 0)
            left, at = left[go], (at[go] + 1) & (SLOTS - 1)
        return out

    def _store(self, flat: np.ndarray, sizes: np.ndarray) -> int:
        """Append entries; the first of them."""
        first, entry = self.offset[self.count], self.count
        while first + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[first : first + len(flat)] = flat
        self.offset[entry + 1 : entry + 1 + len(sizes)] = first + np.cumsum(sizes)
        self.count += len(sizes)
        return entry

    def _add(self, keys: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """New, distinct keys."""
        entry = self._store(flat, sizes)
        at, left = (keys & U64(SLOTS - 1)).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == 0
            _, one = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            put = np.zeros(len(at), dtype=bool)
            put[one] = True
            put &= free
            self.keys[at[put]] = keys[left[put]]
            self.entry[at[put]] = entry + left[put]
            left, at = left[~put], (at[~put] + 1) & (SLOTS - 1)

    def _tails(self, codes: np.ndarray) -> np.ndarray:
        """Entries of the endings."""
        new = np.unique(codes)
        new = new[self.tail_entry[new] < 0]
        if len(new):
            digits = [[c // TAIL_BASE**k % TAIL_BASE for k in (2, 1, 0)] for c in new.tolist()]
            found = self._each(["".join(ENDINGS[d - 1] for d in x if d) for x in digits])
            first = self._store(np.array([i for x in found for i in x], dtype=np.uint32), np.array([len(x) for x in found]))
            self.tail_entry[new] = first + np.arange(len(new))
        return self.tail_entry[codes]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the first id of every text, from UTF-8 bytes and their offsets."""
        raw = data.tobytes()
        starts, ends, bounds = word_spans(data, offsets)
        whole = self._uneven(data, raw, offsets, starts, ends, bounds)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        if whole.any():
            plain = ~whole[doc]
            starts, ends, doc = starts[plain], ends[plain], doc[plain]
        core, codes, open_ = ends.copy(), np.zeros(len(starts), dtype=np.int64), np.arange(len(starts))
        for n in (1, 2, 3):
            open_ = open_[ends[open_] - n > starts[open_]]
            number = TAIL[data[ends[open_] - n]]
            open_, number = open_[number > 0], number[number > 0]
            core[open_] -= 1
            codes[open_] += number * TAIL_BASE ** (n - 1)
        joined = ~LETTER[data[core - 1]]
        core[joined], codes[joined] = ends[joined], 0
        mode = np.zeros(len(starts), dtype=np.int64)
        if self.keeps_space and len(starts):
            inner = starts > offsets[doc]
            mode[inner] = np.where(data[starts[inner] - 1] == 10, 2, 1)
        mark = np.array([FIRST, SPACED, NEW_LINE])
        keys = mix(span_hashes(data, starts, core, BYTE if self.keeps_space else LOWER) ^ mark[mode]) | U64(1)
        entries = np.empty((len(starts), 2), dtype=np.int64)
        entries[:, 0] = self._find(keys)
        at = np.flatnonzero(entries[:, 0] < 0)
        if len(at):
            new, where = np.unique(keys[at], return_index=True)
            at = at[where]
            if self.count + len(new) + TAIL_BASE**3 >= SLOTS // 2:
                self._clear()
                new, at = np.unique(keys, return_index=True)
            texts = [BEFORE[m] + raw[i:j].decode() for m, i, j in zip(mode[at].tolist(), starts[at].tolist(), core[at].tolist(), strict=True)]
            flat, sizes = self._library(texts)
            lines = np.flatnonzero(mode[at] == 2)
            flat = np.insert(flat, (np.cumsum(sizes) - sizes)[lines], self.mark_id)
            sizes[lines] += 1
            self._add(new, flat, sizes)
            entries[:, 0] = self._find(keys)
        entries[:, 1] = self._tails(codes)
        entries = entries.ravel()
        sizes = self.offset[entries + 1] - self.offset[entries]
        total = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.offset[entries] - total[:-1], sizes)]
        firsts = total[2 * np.searchsorted(doc, np.arange(len(offsets)))]
        return self._merged(data, offsets, whole, ids, firsts) if whole.any() else (ids, firsts)

    def _uneven(self, data, raw, offsets, starts, ends, bounds) -> np.ndarray:
        """Texts that the library must see whole."""
        n = len(offsets) - 1
        out = np.zeros(n, dtype=bool)
        if ODD_BYTE[data].any() or any(x in raw for x in ODD_BYTES):
            out |= [ODD.search(raw[a:b].decode()) is not None for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        if self.keeps_space:  # exactly one space or line end between words, none around
            length, words = np.diff(offsets), np.diff(bounds)
            inside = np.concatenate(([0], np.cumsum(ends - starts)))
            out |= length - (inside[bounds[1:]] - inside[bounds[:-1]]) != np.maximum(words - 1, 0)
            full = np.flatnonzero(words)
            out[full] |= (starts[bounds[full]] != offsets[full]) | (ends[bounds[full + 1] - 1] != offsets[full + 1])
        return out

    def _merged(self, data, offsets, whole, ids, firsts) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        parts, sizes = [], []
        for d in range(len(whole)):
            if whole[d]:
                parts.append(np.array(self._each([raw[offsets[d] : offsets[d + 1]].decode()])[0], dtype=np.uint32))
            else:
                parts.append(ids[firsts[d] : firsts[d + 1]])
            sizes.append(len(parts[-1]))
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(sizes)))


@lru_cache(maxsize=2)
def encoder(path: str, keeps_space: bool) -> Encoder:
    return Encoder(path, keeps_space)
