"""Words of many texts at once, as 64-bit hashes over the texts' UTF-8 bytes (numpy, no loop over words)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tessera.llm.shared import mix

#: Odd multiplier of the rolling polynomials.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text taken at once; a longer text is a block of its own.
BLOCK = 1 << 20

_BYTES = np.arange(256)
#: Words of white-space kind: everything but space and \t to \r.
SPACED = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Words of letters: a-z, A-Z and every byte of a character beyond ASCII.
LETTERS = ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | (_BYTES >= 0x80)
#: Words of letters and digits.
ALNUM = LETTERS | ((_BYTES >= 0x30) & (_BYTES <= 0x39))
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def byte_values(lower: bool = True) -> np.ndarray:
    """A pseudo-random odd number for each byte, the same in every process."""
    v = mix(np.arange(1, 257, dtype=np.uint64) * BASE) | np.uint64(1)
    return v[LOWER] if lower else v


def powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.cumprod(p)


@dataclass
class Words:
    """The words of texts lo to hi - 1: first and last byte in ``data``, hash, index of the text (from 0 within the block)."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # of each text, the index of its first word; one more at the end


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, bytes, bounds): consecutive texts whose bytes lie together; a null text has no bytes."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(texts: pa.Array, kind: np.ndarray) -> Iterator[Words]:
    """``kind`` says for each byte whether it belongs to a word; A-Z count as a-z."""
    values, power = byte_values(), powers(BASE, 64)
    for lo, hi, data, bounds in blocks(texts):
        inside = kind[data]
        before = np.empty(len(data), bool)
        before[1:] = inside[:-1]
        before[bounds[:-1][bounds[:-1] < len(data)]] = False
        start = np.flatnonzero(inside & ~before)
        after = np.empty(len(data), bool)
        after[:-1] = inside[1:]
        after[bounds[1:][bounds[1:] > 0] - 1] = False
        end = np.flatnonzero(inside & ~after) + 1
        size = end - start
        if len(size) and size.max() > len(power):
            power = powers(BASE, int(size.max()))
        at = np.flatnonzero(inside)
        first_byte = np.cumsum(size) - size
        value = values[data[at]] * power[np.arange(len(at)) - np.repeat(first_byte, size)]
        h = mix(np.add.reduceat(value, first_byte) + size.astype(np.uint64)) if len(size) else np.zeros(0, np.uint64)
        first = np.searchsorted(start, bounds)
        doc = np.repeat(np.arange(hi - lo), np.diff(first))
        yield Words(lo, hi, data, bounds, start, end, h, doc, first)


def folded(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive words, from the first one's place."""
    n = len(h) - k + 1
    out = h[: max(n, 0)].copy()
    for j in range(1, k):
        out = out * BASE + h[j : j + max(n, 0)]
    return mix(out)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the k-word shingles of each text in order (a shorter text is one shingle, one without words has none)."""
    count = np.diff(w.first)
    if not len(w.hash):
        return np.zeros(0, np.uint64), np.zeros(len(count) + 1, np.int64)
    number = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    first = np.concatenate(([0], np.cumsum(number)))
    at = np.repeat(w.first[:-1], number) + np.arange(first[-1]) - np.repeat(first[:-1], number)
    out = np.zeros(first[-1], np.uint64)
    whole = np.repeat(count >= k, number)
    if len(w.hash) >= k:
        every = folded(w.hash, k)
        out[whole] = every[at[whole]]
    for d in np.flatnonzero((count > 0) & (count < k)):
        out[first[d]] = folded(w.hash[w.first[d] : w.first[d + 1]], int(count[d]))[0]
    return out, first
