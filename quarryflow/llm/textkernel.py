"""Vectorised word and n-gram hashes of an Arrow text column.

A word's hash is made of its bytes, eight at a time, each mixed in by a bijection that no
polynomial identity fits, from a seed that a job draws anew: whoever writes a text can not know
which words would clash.  Spans of words are polynomials modulo 2**64 over these hashes.  All runs
over numpy arrays that span the rows of a batch, so a word costs a few array passes and no Python step.
"""

from __future__ import annotations

import hashlib
import os
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .common import text_bytes

#: An odd multiplier, hence invertible modulo 2**64.
WORD_BASE = 0xD6E8FEB86659FD93
#: Words hashed at once; bytes up to which a word is hashed with the others.
PIECE, LONG_WORD = 1 << 17, 256

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def fresh_seed() -> int:
    """A seed for the hashes of one job: every pass of the job must use the same."""
    return int.from_bytes(os.urandom(8), "little")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word data[start:end], with its length."""
    out = np.empty(len(starts), dtype=np.uint64)
    lane = np.arange(8)
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    masks = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
    for low in range(0, len(starts), PIECE):
        at, size = starts[low : low + PIECE], (ends - starts)[low : low + PIECE]
        h = mix(size.astype(np.uint64) * np.uint64(WORD_BASE) + np.uint64(seed))
        active = np.flatnonzero(size <= LONG_WORD)
        done = 0
        while len(active):
            chunk = np.ascontiguousarray(padded[(at[active] + done)[:, None] + lane]).view("<u8").ravel()
            h[active] = mix((h[active] ^ (chunk & masks[np.minimum(size[active] - done, 8)])) + np.uint64(WORD_BASE))
            done += 8
            active = active[size[active] > done]
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            digest = hashlib.blake2b(data[at[i] : at[i] + size[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest()
            h[i] = int.from_bytes(digest, "little")
        out[low : low + PIECE] = h
    return out


class Words(NamedTuple):
    #: 64-bit hash of each word of all rows.
    hashes: np.ndarray
    #: Word index at which each row starts; one more entry than rows.
    offsets: np.ndarray
    #: Byte range of each word in ``data``.
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the spans [starts, ends) from one prefix array: sum of symbol * base**(offset in span)."""
    n = len(symbols)
    prefix = np.empty(n + 1, dtype=np.uint64)
    prefix[0] = 0
    np.cumsum(symbols * powers(base, n), out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * powers(pow(base, -1, 1 << 64), n + 1)[starts]


def words_of(text: pa.Array, lower: bool = False, seed: int = 0) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every row, hashed; ``lower`` maps A-Z to a-z first."""
    data, rows = text_bytes(text)
    if lower:
        data = _LOWER[data]
    inside = ~_IS_SPACE[data]
    n = len(data)
    first = inside.copy()
    last = inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = rows[(rows > 0) & (rows < n)]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    hashes = word_hashes(data, starts, ends, seed)
    return Words(hashes, np.searchsorted(starts, rows), starts, ends, data)


def ngram_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of the n words from each word on, and which of them lie within one row."""
    total = len(words.hashes)
    count = max(0, total - n + 1)
    at = np.arange(count)
    room = np.repeat(words.offsets[1:], np.diff(words.offsets))[:count] - at
    return span_hashes(words.hashes, at, at + n, WORD_BASE), room >= n


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, from prefix and suffix minima of blocks."""
    count = len(values) - width + 1
    if count <= 0:
        return values[:0]
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])
