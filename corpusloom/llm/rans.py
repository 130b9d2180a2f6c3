"""Static range asymmetric numeral system on interleaved lanes, in numpy.

Symbol i of a block goes to lane i mod lanes, and all lanes step together. A lane's state is 64 bits,
at least 2**31, and moves 32 bits to the block's words whenever the next symbol wouldn't fit. Encoding
runs backwards, so decoding reads the words forwards; the states at every ``STRIDE`` steps are
checkpoints at which decoding can begin.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Frequencies of a table add up to 2**PRECISION.
PRECISION = 18
LANES, STRIDE = 1024, 128
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


@dataclass
class Table:
    """Shared frequencies: symbols, their widths and where each begins."""

    frequency: np.ndarray
    start: np.ndarray
    symbol_of: np.ndarray

    @classmethod
    def of(cls, frequency: np.ndarray) -> Table:
        frequency = frequency.astype(np.uint64)
        start = np.cumsum(frequency) - frequency
        return cls(frequency, start.astype(np.uint64), np.repeat(np.arange(len(frequency), dtype=np.uint16 if len(frequency) <= 1 << 16 else np.uint32), frequency.astype(np.int64)))


def scaled(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Counts scaled to whole numbers that add up to 2**precision, at least 1 for every count above 0."""
    total = 1 << precision
    seen = counts > 0
    if not seen.any():
        counts, seen = np.ones(1, np.int64), np.ones(1, bool)
    if seen.sum() > total:
        raise ValueError("more symbols than the precision has room for")
    exact = counts * (total - seen.sum()) / counts.sum()
    out = np.floor(exact).astype(np.int64) + seen
    left = total - out.sum()
    out[np.argsort(-(exact - np.floor(exact)) - np.where(seen, 0.0, -2.0), kind="stable")[:left]] += 1
    return out


def lanes_for(n: int) -> int:
    return int(min(LANES, max(1, n // 64)))


def encode(symbols: np.ndarray, table: Table, precision: int = PRECISION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (uint32), and at each checkpoint the states (uint64, one row each) and the number of words before it."""
    n = len(symbols)
    lanes = lanes_for(n)
    steps = -(-n // lanes)
    state = np.full(lanes, _LOW)
    bits = np.uint64(precision)
    words: list[np.ndarray] = []
    states, marks = [], []
    for step in range(steps - 1, -1, -1):
        s = symbols[step * lanes : (step + 1) * lanes]
        f, c, x = table.frequency[s], table.start[s], state[: len(s)]
        full = x >= f << (np.uint64(63) - bits)
        words.append((x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        x = np.where(full, x >> _WORD, x)
        q = x // f
        state[: len(s)] = (q << bits) + (x - q * f) + c
        if step % STRIDE == 0:
            states.append(state.copy())
            marks.append(len(words))
    counts = np.array([len(w) for w in reversed(words)], np.int64)
    before = np.r_[0, np.cumsum(counts)]
    at = before[[len(words) - m for m in reversed(marks)]] if marks else np.zeros(0, np.int64)
    flat = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    return flat, np.array(states[::-1], np.uint64).reshape(-1, lanes), at


def decode(words: np.ndarray, states: np.ndarray, at: np.ndarray, n: int, table: Table, precision: int = PRECISION, first: int = 0, last: int | None = None) -> np.ndarray:
    """Symbols of the checkpoints from ``first`` to before ``last`` (all by default); each part can be decoded by itself."""
    lanes = lanes_for(n)
    steps = -(-n // lanes)
    last = len(at) if last is None else last
    begin, stop = first * STRIDE, min(last * STRIDE, steps)
    if stop <= begin:
        return np.zeros(0, np.uint32)
    out = np.empty(min(stop * lanes, n) - begin * lanes, np.uint32)
    state, place = states[first].copy(), int(at[first])
    mask, bits = np.uint64((1 << precision) - 1), np.uint64(precision)
    done = 0
    for step in range(begin, stop):
        size = min(lanes, n - step * lanes)
        x = state[:size]
        slot = x & mask
        s = table.symbol_of[slot]
        out[done : done + size] = s
        done += size
        x = table.frequency[s] * (x >> bits) + slot - table.start[s]
        low = np.flatnonzero(x < _LOW)
        if len(low):
            x[low] = x[low] << _WORD | words[place : place + len(low)]
            place += len(low)
        state[:size] = x
    return out
