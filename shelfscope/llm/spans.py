"""Words, lines and n-grams of many texts at once, as numpy arrays of byte offsets and rolling hashes.

A block is the UTF-8 of several texts laid end to end.  A span's hash is a
difference of prefix sums of ``value[i] * B**i`` times ``B**-start``, modulo
2**64, so the hash of any span costs two lookups.  Separators are ASCII bytes
only, so byte positions never cut a character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
VALUES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)  # one number per byte value

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: White space of the contracts: space and U+0009 to U+000D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False

#: Digits, lower-case ASCII letters and everything outside ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[10] = False

_powers: dict[str, np.ndarray] = {}
MOST_POWERS = 1 << 22  # longest table that is kept; longer ones are for one very long text


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**(n-1); grown by doubling and kept for the life of the worker up to a length."""
    key = str(base)
    if n > MOST_POWERS:
        table = np.full(n, base, np.uint64)
        table[0] = 1
        return np.cumprod(table, out=table)
    if key not in _powers or len(_powers[key]) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        table = np.full(size, base, np.uint64)
        table[0] = 1
        _powers[key] = np.cumprod(table)
    return _powers[key][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of ``values[start:end]`` for every span."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=sums[1:])
    spans = (sums[ends] - sums[starts]) * powers(len(values) + 1, INVERSE)[starts]
    return mixed(spans + (ends - starts).astype(np.uint64))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts end to end, and where each text starts (one more for the end); null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside``, broken at the borders of texts."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    borders = at[at < n]
    first[borders] |= inside[borders]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = at[at > 0] - 1
    last[ends] |= inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def owners(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of the text each span lies in."""
    return np.searchsorted(at, starts, "right") - 1


def per_text(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Counts (or whole-number sums) of spans by text."""
    return np.bincount(owner, weights, n).astype(np.int64)


def first_of(owner: np.ndarray, n: int) -> np.ndarray:
    """Where each text's spans begin in a list of spans in order (one more for the end)."""
    return np.searchsorted(owner, np.arange(n + 1))


class Words:
    """The words of a block: spans, hashes, and the text each belongs to."""

    def __init__(self, data: np.ndarray, at: np.ndarray, kind: np.ndarray, lower: bool):
        self.n_texts = len(at) - 1
        self.data = LOWER[data] if lower else data
        self.starts, self.ends = runs(kind[self.data], at)
        self.owner = owners(self.starts, at)
        self.hashes = rolling(VALUES[self.data], self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every n-word window that stays inside one text."""
        firsts = np.arange(max(0, len(self) - n + 1))
        firsts = firsts[self.owner[firsts] == self.owner[firsts + n - 1]] if len(firsts) else firsts
        return firsts, rolling(self.hashes, firsts, firsts + n)
