"""Byte-level BPE ids by the tokenizers library, with a cache of whole pre-tokens.

The library's model encodes each distinct pre-token once per worker; texts are cut into pre-tokens
as arrays. Texts outside the plain case (apostrophes, which start contractions, special tokens,
scripts beyond Armenian, odd control characters) go through the library as they are, and so does
everything where a tokenizer isn't plain byte-level BPE.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa

from ._bytes import Texts, ragged, span_hashes

#: Pre-tokens that a worker remembers, as 64-bit hashes; it starts anew beyond that.
REMEMBER = 1_500_000
#: Characters below this are cut here: those of the lead bytes below ``ODD_LEAD``.
PLAIN, ODD_LEAD = 0x580, 0xD6
_OTHER, _LETTER, _NUMBER, _SPACE, _END = range(5)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    import regex

    out = np.zeros(PLAIN, np.uint8)
    for cls, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        out[[c for c in range(PLAIN) if regex.match(pattern, chr(c))]] = cls
    return out


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE has for each byte: itself if printable, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    table = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Memory:
    """Ids of pre-tokens by hash, in sorted arrays: a large part, and a small one that is merged into it now and then."""

    def __init__(self, kind: np.dtype):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)) for _ in range(2)]
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each hash's ids are in the pool, how many they are, and which hashes are unknown."""
        at, size, there = np.zeros(len(hashes), np.int32), np.zeros(len(hashes), np.int32), np.zeros(len(hashes), bool)
        for keys, ats, sizes in self.parts:
            if len(keys):
                i = np.searchsorted(keys, hashes)
                i[i == len(keys)] = 0
                hit = keys[i] == hashes
                at[hit], size[hit] = ats[i[hit]], sizes[i[hit]]
                there |= hit
        return at, size, ~there

    def add(self, hashes: np.ndarray, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Remember the ids of sorted new hashes."""
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((i for x in ids for i in x), self.kind, int(sizes.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), self.kind)])
        self.pool[self.used : self.used + len(flat)] = flat
        ats = (self.used + np.cumsum(sizes) - sizes).astype(np.int32)
        self.used += len(flat)
        recent = self._merged(self.parts[1], (hashes, ats, sizes))
        self.parts = [self.parts[0], recent] if len(recent[0]) < 100_000 else [self._merged(self.parts[0], recent), tuple(x[:0] for x in recent)]
        return ats, sizes

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        where = np.searchsorted(a[0], b[0])
        return tuple(np.insert(x, where, y) for x, y in zip(a, b, strict=True))

    def __len__(self) -> int:
        return sum(len(p[0]) for p in self.parts)


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and model["type"] == "BPE" and not model.get("dropout") and not model.get("unk_token")
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.model, self.letters = self.tokenizer.model, dict(enumerate(_byte_letters()))
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known = Memory(self.kind)

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text, without special tokens; null counts as empty."""
        column = column.fill_null("")
        texts = Texts(column)
        slow = np.ones(texts.n, bool) if not self.plain else self._odd(texts)
        out: list = [None] * texts.n
        if slow.any():
            at = np.flatnonzero(slow)
            for i, e in zip(at.tolist(), self.tokenizer.encode_batch_fast([column[int(i)].as_py() for i in at], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, self.kind)
        if not slow.all():
            fast = Texts(column.filter(pa.array(~slow))) if slow.any() else texts
            for i, ids in zip(np.flatnonzero(~slow).tolist(), self._encode_plain(fast), strict=True):
                out[i] = ids
        return out

    def _odd(self, texts: Texts) -> np.ndarray:
        buf = texts.buf
        bad = (buf == 0x27) | (buf >= ODD_LEAD) | ((buf >= 0x1C) & (buf <= 0x1F))
        bad[1:] |= (buf[1:] == 0x85) & (buf[:-1] == 0xC2)
        odd = np.zeros(texts.n, bool)
        odd[texts.doc_of(np.flatnonzero(bad))] = True
        raw = buf.tobytes()
        for mark in self.special:
            at = raw.find(mark)
            while at >= 0:
                odd[texts.doc_of(np.array([at]))[0]] = True
                at = raw.find(mark, at + 1)
        return odd

    def _encode_plain(self, texts: Texts) -> list[np.ndarray]:
        buf = texts.buf
        at = np.flatnonzero((buf & 0xC0) != 0x80).astype(np.int32)  # of each character
        points = buf[at].astype(np.uint16)
        two = np.flatnonzero(points >= 0xC0)
        points[two] = (points[two] & 0x1F) << 6 | (buf[at[two] + 1] & 0x3F)
        cls = _classes()[points]
        ends = np.searchsorted(at, (texts.at[1:] - 1).astype(np.int32))
        cls[ends] = _END
        space = cls == _SPACE
        changed = np.ones(len(cls), bool)
        np.not_equal(cls[1:], cls[:-1], out=changed[1:])
        # A blank goes with what follows it; of other white space the last character stands alone.
        start = changed.copy()
        start[1:] &= ~((points[:-1] == 0x20) & space[:-1] & ~space[1:])
        start[:-1] |= space[:-1] & ~space[1:] & (cls[1:] != _END)
        start[ends] = True
        first = np.flatnonzero(start)
        real = cls[first[:-1]] != _END  # each text's end starts a token of its own, which is none
        s, e = at[first[:-1]][real], at[first[1:]][real]
        hashes, example, inverse = np.unique(span_hashes(buf, s, e), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBER:
            self.known.clear()
        where, lengths, new = self.known.find(hashes)
        if new.any():
            raw, tokenize, letters = buf.tobytes(), self.model.tokenize, self.letters
            spans = zip(s[example[new]].tolist(), e[example[new]].tolist(), strict=True)
            where[new], lengths[new] = self.known.add(hashes[new], [[t.id for t in tokenize(raw[a:b].decode("latin-1").translate(letters))] for a, b in spans])
        each = lengths[inverse]
        flat = self.known.pool[ragged(where[inverse], each)]
        owners = np.searchsorted(s, texts.at[1:].astype(np.int32))
        counts = np.r_[0, np.cumsum(each, dtype=np.int64)][owners]
        return np.split(flat, counts[:-1])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    return Encoder(path)
