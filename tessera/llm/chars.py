"""Words of texts as bytes between spaces, for character n-gram models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from tessera.llm.common import pieces
from tessera.llm.shingles import LOWER, SPACE

M = np.uint32(0x9E3779B1)


@dataclass
class Frame:
    """byte: all texts, A-Z lower-cased, white space as 0x20, with spaces before
    and after each text. start, end: bytes of each word. first: the range of
    words of each text."""

    byte: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def frame(data: np.ndarray, offs: np.ndarray) -> Frame:
    n = len(offs) - 1
    low = LOWER[data]
    low[SPACE[low]] = 0x20
    out = np.full(len(data) + 2 * n + 4, 0x20, np.uint8)
    out[np.arange(len(data)) + np.repeat(2 * np.arange(n) + 2, np.diff(offs))] = low
    word = out != 0x20
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    return Frame(out, start, end, np.searchsorted(start, offs + 2 * np.arange(n + 1)))


def frames(data: np.ndarray, offs: np.ndarray, most_bytes: int = 4 << 20) -> Iterator[tuple[int, int, Frame]]:
    for a, b in pieces(offs, most_bytes, 1 << 16):
        yield a, b, frame(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])


def ngrams(byte: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A bucket of `bits` bits for the n bytes from each place on."""
    h = np.full(max(0, len(byte) - n + 1), n, np.uint32)
    for j in range(n):
        h = (h ^ byte[j : len(byte) - n + 1 + j]) * M
        h ^= h >> np.uint32(15)
    return (h * M) >> np.uint32(32 - bits)


def spell(f: Frame) -> np.ndarray:
    """A 32-bit hash of each word, by a sum of its bytes at their places."""
    power = np.cumprod(np.full(512, 0x01000193, np.uint32))
    at = np.arange(len(f.byte))
    place = at - np.repeat(np.append(0, f.start), np.diff(np.append(np.append(0, f.start), len(at))))
    values = (f.byte.astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B)
    total = np.zeros(len(f.byte) + 1, np.uint32)
    np.cumsum(np.where(f.byte == 0x20, np.uint32(0), values * power[place % 512]), dtype=np.uint32, out=total[1:])
    h = (f.end - f.start).astype(np.uint32) + total[f.end] - total[f.start]
    h ^= h >> np.uint32(15)
    h = h * M
    return h ^ (h >> np.uint32(13))


def whole(f: Frame, bits: int) -> np.ndarray:
    """A bucket for each whole word."""
    return (spell(f) * M) >> np.uint32(32 - bits)


def once(f: Frame) -> np.ndarray:
    """The places of words that their text has not had before, in order."""
    size = np.diff(f.first)
    text = np.repeat(np.arange(len(size), dtype=np.uint64), size)
    _, at = np.unique(text << np.uint64(32) | spell(f), return_index=True)
    return np.sort(at)
