"""Words of whole Arrow batches of texts as numpy arrays, without a Python loop over texts or words.

A word is a run of letters, digits, underscores and non-ASCII bytes, in lower case (ASCII and Latin-1 letters).  Its hash is a polynomial of its
bytes modulo 2**64, taken from one running sum over the batch, so all words cost a few passes over the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; a single longer text is taken alone.
AT_ONCE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    if _b >= 0x80 or chr(_b).isalnum() or _b == 0x5F:
        _CLASS[_b] = ord(chr(_b).lower()) if _b < 0x80 else _b
_VALUE = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer for 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BACK)):
            p = np.full(max(n, AT_ONCE + 1), base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS


@dataclass
class Words:
    hashes: np.ndarray  # uint64, a word each
    first: np.ndarray  # index of each text's first word, and the number of words at the end
    starts: np.ndarray  # places in bytes
    ends: np.ndarray
    bytes: np.ndarray  # lower-cased bytes

    def __len__(self) -> int:
        return len(self.first) - 1


def pieces(texts: pa.Array, at_once: int = AT_ONCE) -> Iterator[tuple[int, pa.Array]]:
    """(index of the first, texts) of parts of at most at_once bytes, nulls made empty."""
    texts = pc.fill_null(texts, "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.empty(0, np.int64)
    at = 0
    while at < len(texts):
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + at_once, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


def words_of(texts: pa.Array) -> Words:
    """texts: a string array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    low = _CLASS[data]
    if len(low) > 1:
        big = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][big] += 0x20
    inside = low > 0
    edge = np.empty(len(low) + 1, bool)
    edge[0], edge[-1] = False, True
    edge[1:-1] = ~inside[:-1]
    begin = edge[:-1]
    begin[offsets[:-1][offsets[:-1] < len(low)]] = True
    starts = np.flatnonzero(inside & begin)
    end = np.ones(len(low), bool)
    if len(low):
        end[:-1] = ~inside[1:] | begin[1:]
    ends = np.flatnonzero(inside & end) + 1
    powers, back = _powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_VALUE[low] * powers[: len(low)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * back[starts])
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends, low)


def shingles_of(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of `width` words; a shorter text with words has one, of all its words."""
    n = len(words.hashes)
    counts = np.diff(words.first)
    text = np.repeat(np.arange(len(words)), counts)
    if not n:
        return np.empty(0, np.uint64), text
    run = np.zeros(n, np.uint64)
    left = np.repeat(words.first[1:], counts) - np.arange(n)  # words to the text's end
    for k in range(width):
        step = run * np.uint64(0x100000001B3)
        step[: n - k] += words.hashes[k:]
        run = np.where(left > k, step, run)
    keep = (left >= width) | ((np.repeat(counts, counts) < width) & (np.arange(n) == np.repeat(words.first[:-1], counts)))
    return mixed(run[keep]), text[keep]
