"""Words, hashes and shingles of many UTF-8 texts at once, as numpy arrays.

A batch of texts is one byte array in which a blank follows each text, so no run of
word bytes crosses from one text into the next. Hashes are 64-bit polynomials over a
random table of byte values, taken from running sums and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once, where single texts are no longer.
PIECE = 1 << 20
MAX64 = np.uint64(0xFFFFFFFFFFFFFFFF)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def byte_set(inside: str) -> np.ndarray:
    """256 booleans for a byte-level regular-expression class."""
    import re

    rx = re.compile(f"[{inside}]".encode("latin-1"), re.S)
    return np.array([bool(rx.fullmatch(bytes([b]))) for b in range(256)])


#: Runs of anything but white space.
NON_SPACE = byte_set(r"^\x20\x09-\x0D")
#: Runs of ASCII letters and digits and of everything beyond ASCII, after lower-casing A-Z.
ALNUM = byte_set(r"^\x00-\x2F\x3A-\x60\x7B-\x7F") | byte_set(r"A-Z")
_LOWER = np.arange(256)
_LOWER[65:91] += 32


@lru_cache(maxsize=8)
def _table(lower: bool, seed: int = 7) -> np.ndarray:
    table = np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return table[_LOWER] if lower else table


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below n."""
    key = int(base)
    have = _powers.get(key)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE + 4096)
        have = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (base, np.uint64(pow(key, -1, 1 << 64))))
        if size <= 4 * PIECE:  # those of a very long text are not kept
            _powers[key] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text, of one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0), dtype=np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield batch.slice(start)


class Texts:
    """The texts of one piece."""

    def __init__(self, column: pa.Array):
        column = column.fill_null("")
        size = column.offset
        width = np.int64 if pa.types.is_large_string(column.type) else np.int32
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, width)[size : size + len(column) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        n = len(column)
        self.n = n
        buf = np.full(len(raw) + n, 32, np.uint8)
        keep = np.ones(len(buf), bool)
        keep[offsets[1:] + np.arange(n)] = False
        buf[keep] = raw
        self.buf = buf
        #: Text i is buf[at[i]:at[i + 1] - 1].
        self.at = offsets + np.arange(n + 1)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, positions, side="right") - 1

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value for each byte, by text."""
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
        return total[self.at[1:]] - total[self.at[:-1]]


class Words:
    """Maximal runs of the bytes in ``inside``: start and end in the piece, text index, and index of each text's first word."""

    def __init__(self, texts: Texts, inside: np.ndarray):
        hit = inside[texts.buf]
        hit[texts.at[1:] - 1] = False
        edge = np.diff(hit.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, texts.at)
        self.doc = np.repeat(np.arange(texts.n), np.diff(self.first))
        self.texts = texts

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(self.texts.buf, self.start, self.end, lower)

    def grams(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """Hash of the k words from each word on; only those in ``inside(k)`` lie within one text."""
        return gram_hashes(hashes, k)

    def inside(self, k: int) -> np.ndarray:
        """Whether k words from this one on are in its text."""
        return np.arange(len(self)) + k <= self.first[1:][self.doc] if len(self) else np.zeros(0, bool)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    up, down = powers(_P, len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_table(lower)[buf] * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes)
    up, down = powers(_Q, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=total[1:])
    end = np.minimum(np.arange(n) + k, n)
    return mix((total[end] - total[:-1]) * down[:-1] + np.uint64(k))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of each length, one after another."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
