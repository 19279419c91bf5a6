"""Token ids of whole texts, through the tokenizers library.

Texts are cut where the vocabulary's own pre-tokenisation always cuts: at white
space, and between a letter or digit and trailing punctuation. Each distinct
piece is encoded by the library once for a while; a bounded cache, sorted by the
pieces' 64-bit fingerprints, holds its ids, and the ids of a block of texts are
gathered from it at once. Texts in which white space takes part in a longer run
are encoded whole, so the ids equal those of the library on the whole text.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np

from . import textscan as ts

#: Pieces in the cache: 24 bytes each and 4 for each of their ids.
CACHE_ENTRIES = 3_000_000
_TRAILING = np.zeros(256, bool)
_TRAILING[list(b".,;:!?*$%&#|")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_BLANK = np.zeros(256, bool)
_BLANK[[10, 32]] = True
#: What a fingerprint is combined with if the piece comes after a blank.
_PREFIXED = np.uint64(0xA5A5F00D5EED1234)


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings are ordinary text
    return tokenizer


class Encoder:
    """Ids of texts; `spaceless` vocabularies drop white space, others keep it."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        self.whole = _load(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.spaceless = bool(described["normalizer"])
        self.plain = None
        if self.spaceless:  # for pieces that the normaliser leaves as they are
            self.plain = _load(path)
            self.plain.normalizer = None
        self.cache_entries = cache_entries
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _ids(self, tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _encode(self, texts: list[str]) -> list[list[int]]:
        if self.plain is None:
            return self._ids(self.whole, texts)
        is_plain = [t.isprintable() and t == t.lower() and (t.isascii() or unicodedata.is_normalized("NFC", t)) for t in texts]
        plain = iter(self._ids(self.plain, [t for t, ok in zip(texts, is_plain, strict=True) if ok]))
        rest = iter(self._ids(self.whole, [t for t, ok in zip(texts, is_plain, strict=True) if not ok]))
        return [next(plain if ok else rest) for ok in is_plain]

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Add pieces whose keys are sorted and new."""
        ids = self._encode(texts)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        more = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        if self.used + len(more) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(self.flat), len(more)) * 2, np.uint32)])
        self.flat[self.used : self.used + len(more)] = more
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.begin = np.insert(self.begin, at, self.used + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.used += len(more)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the bounds of each text."""
        n = len(offsets) - 1
        # a capital followed by a combining mark may compose where its small letter doesn't
        lower = self.spaceless and not ((data == 0xCC) | (data == 0xCD)).any()
        s = ts.scan(data, offsets, ts.SPACE, lower=lower)
        index = np.arange(len(data))
        body = np.maximum.accumulate(np.where(_TRAILING[s.data], -1, index))[s.end - 1] + 1 if len(s.end) else s.end
        cut = (body > s.start) & (body < s.end) & _ALNUM[s.data[np.maximum(body, 1) - 1]] if len(s.end) else np.zeros(0, bool)
        body = np.where(cut, body, s.end)
        start, end = np.concatenate([s.start, body[cut]]), np.concatenate([body, s.end[cut]])
        key = ts.range_hash(s.prefix, start, end)
        prefixed = np.zeros(len(start), bool)
        odd = np.zeros(n, bool)
        if not self.spaceless:
            words = len(s.start)
            prefixed[:words] = (s.start > offsets[s.doc]) & (data[s.start - 1] == 32)
            odd = _odd_spaces(data, offsets)
            last = np.zeros(len(data) + 1, bool)
            last[offsets] = True
            after = np.zeros(len(data), bool)
            after[:-1] = ts.IS_SPACE_WORD[data[1:]]
            blank = np.flatnonzero(_BLANK[data] & ((data == 10) | ~after | last[1:]))
            start, end = np.concatenate([start, blank]), np.concatenate([end, blank + 1])
            key = np.concatenate([np.where(prefixed, ts.mix(key ^ _PREFIXED), key), data[blank].astype(np.uint64)])
            prefixed = np.concatenate([prefixed, np.zeros(len(blank), bool)])
        doc = np.searchsorted(offsets, start, "right") - 1
        if odd.any():
            fine = ~odd[doc]
            start, end, key, prefixed, doc = start[fine], end[fine], key[fine], prefixed[fine], doc[fine]
        unique, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        missing = np.ones(len(unique), bool)
        if len(self.keys):
            missing = self.keys[np.minimum(at, len(self.keys) - 1)] != unique
        if missing.any():
            if len(self.keys) + missing.sum() > self.cache_entries:
                self._clear()
                missing[:] = True
            raw, new = s.data.tobytes(), first[missing]
            texts = [(" " if p else "") + raw[a:b].decode() for a, b, p in zip(start[new].tolist(), end[new].tolist(), prefixed[new].tolist(), strict=True)]
            self._learn(unique[missing], texts)
            at = np.searchsorted(self.keys, unique)
        begin, size = self.begin[at][inverse], self.size[at][inverse]
        whole: list[np.ndarray] = []
        if odd.any():
            raw = data.tobytes()
            which = np.flatnonzero(odd)
            whole = [np.array(x, np.uint32) for x in self._ids(self.whole, [raw[offsets[k] : offsets[k + 1]].decode() for k in which.tolist()])]
            start, doc = np.concatenate([start, offsets[which]]), np.concatenate([doc, which])
            begin, size = np.concatenate([begin, np.full(len(which), -1)]), np.concatenate([size, [len(x) for x in whole]])
        order = np.argsort(start, kind="stable")
        begin, size = begin[order], size[order]
        ends = np.cumsum(size)
        out = self.flat[np.repeat(np.maximum(begin, 0) - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)] if not whole else self._gather(begin, size, ends, whole)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, np.concatenate([self.size[at][inverse], [len(x) for x in whole]]), n).astype(np.int64))])
        return out, bounds

    def _gather(self, begin: np.ndarray, size: np.ndarray, ends: np.ndarray, whole: list[np.ndarray]) -> np.ndarray:
        """As in `encode`, with the ids of texts that were encoded whole."""
        out = np.zeros(ends[-1], np.uint32)
        kept = begin >= 0
        many = size[kept]
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out[np.repeat((ends - size)[kept], many) + within] = self.flat[np.repeat(begin[kept], many) + within]
        for at, ids in zip((ends - size)[~kept].tolist(), whole, strict=True):
            out[at : at + len(ids)] = ids
        return out


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id after each text."""
    n = len(bounds) - 1
    after = bounds + np.arange(n + 1)
    out = np.full(len(ids) + n, end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
    return out, after


def _odd_spaces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with white space other than blanks and newlines, with three of these
    in a row, or with two at the end."""
    n = len(data)
    odd = np.zeros(n + 1, np.int64)
    if not n:
        return np.zeros(len(offsets) - 1, bool)
    blank = (data == 32) | (data == 10)
    flag = (data < 32) & (data != 10) & (data > 8) & ((data < 14) | (data > 27))
    b1, b2 = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    b1[:-1], b2[:-2] = data[1:], data[2:]
    flag |= (data == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
    flag |= (data == 0xE1) & (b1 == 0x9A) & (b2 == 0x80) | (data == 0xE1) & (b1 == 0xA0) & (b2 == 0x8E)
    flag |= (data == 0xE2) & ((b1 == 0x80) & ((b2 <= 0x8F) | (b2 >= 0xA8) & (b2 <= 0xAF)) | (b1 == 0x81) & (b2 == 0x9F))
    flag |= (data == 0xE3) & (b1 == 0x80) & (b2 == 0x80)
    flag[:-2] |= blank[:-2] & blank[1:-1] & blank[2:]
    odd[1:] = np.cumsum(flag)
    out = np.diff(odd[offsets]) > 0
    size, last = np.diff(offsets), offsets[1:] - 1
    two = size >= 2
    out[two] |= blank[last[two]] & blank[last[two] - 1]
    return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary, kept between tasks."""
    return Encoder(path)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
