"""Words and five-word shingles of whole texts, over byte buffers in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from tessera.llm.common import mix, pieces

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64
#: Seeded odd multipliers: a byte's value, a byte's place, a word's place.
_rng = np.random.default_rng(2024)
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
STEP = U(0x9E3779B97F4A7C15)
BACK = U(pow(int(STEP), -1, 2**64))
PLACE = _rng.integers(0, 2**63, 16, dtype=np.uint64) * U(2) + U(1)
TOKEN = U((1 << 56) - 1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, r in enumerate((STEP, BACK)):
            p = np.full(n, r)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of consecutive texts: start and end bytes, 64-bit hashes, and the
    range of words of each text (first[i] to first[i + 1])."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words(low: np.ndarray, offs: np.ndarray) -> Words:
    """low: the lower-cased bytes of texts laid end to end."""
    n = len(low)
    gap = SPACE[low]
    before = np.ones(n, bool)
    before[1:] = gap[:-1]
    after = np.ones(n, bool)
    after[:-1] = gap[1:]
    edges = offs[(offs > 0) & (offs < n)]
    before[edges] = True
    after[edges - 1] = True
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    up, down = _places(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[low] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(start, end, h, np.searchsorted(start, offs))


def grams(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """56-bit hashes of all word n-grams and the range of each text. A text of
    fewer words than size has its whole sequence as one; one of none has none."""
    n, count = len(w.hash), np.diff(w.first)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h[: max(0, n - j)] += w.hash[j:] * PLACE[j]
    text = np.repeat(np.arange(len(count)), count)
    ok = np.arange(n) + size <= w.first[1:][text] if n else np.zeros(0, bool)
    for i in np.flatnonzero((count > 0) & (count < size)):
        a, k = w.first[i], int(count[i])
        h[a] = np.append(w.hash[a : a + k] * PLACE[:k], PLACE[8 + k]).sum(dtype=np.uint64)
        ok[a] = True
    held = np.zeros(n + 1, np.int64)
    np.cumsum(ok, out=held[1:])
    return mix(h[ok]) & TOKEN, held[w.first]


def distinct(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens of each text in ascending order, for 256 texts at most."""
    n = np.diff(first)
    key = np.sort(tokens | np.repeat(np.arange(len(n), dtype=np.uint64), n) << U(56))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    return key & TOKEN, np.searchsorted(key >> U(56), np.arange(len(n) + 1, dtype=np.uint64))


def digests(low: np.ndarray, offs: np.ndarray, w: Words, seed: int) -> list[bytes]:
    """A 128-bit digest of each text's word sequence, spaces evened out."""
    gap = SPACE[low]
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    even = np.where(gap, np.uint8(0x20), low)[keep]
    at = np.zeros(len(low) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    at, raw = at[offs], even.tobytes()
    salt = seed.to_bytes(8, "little")
    return [hashlib.blake2b(raw[a:b].strip(b" "), digest_size=16, salt=salt).digest() for a, b in zip(at[:-1], at[1:], strict=True)]


def text_blocks(data: np.ndarray, offs: np.ndarray, most_bytes: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, lower-cased bytes, offsets) of at most 256 texts."""
    for a, b in pieces(offs, most_bytes, 256):
        yield a, b, LOWER[data[offs[a] : offs[b]]], offs[a : b + 1] - offs[a]
