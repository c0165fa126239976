"""Words and shingles of many texts at once, as numpy columns over the Arrow buffers of a batch."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from haplodeck.llm.workers import once_per_worker

#: Text handled at a time; a longer single text is handled alone.
CHUNK_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Words(NamedTuple):
    hashes: np.ndarray  # uint64, one per word
    first: np.ndarray  # first word of each text; one entry more than texts
    starts: np.ndarray  # byte positions within the chunk
    ends: np.ndarray
    data: np.ndarray  # the chunk's bytes, A-Z lower-cased on request


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(n, CHUNK_BYTES) + 1

    def make():
        one = np.full(size, _BASE, np.uint64)
        back = np.full(size, _BASE_INVERSE, np.uint64)
        one[0] = back[0] = 1
        return np.multiply.accumulate(one), np.multiply.accumulate(back)

    if n <= CHUNK_BYTES:
        return once_per_worker(("powers",), make)
    return make()


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of runs of texts with about `most` bytes; null is empty."""
    texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    if not len(texts):
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield at, to, raw[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


#: ASCII punctuation, for callers that compare words without it.
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, apart: bytes = b"") -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of each text; the bytes of `apart` part words too."""
    blank = np.zeros(256, bool)
    blank[[0x20, *range(9, 14), *apart]] = True
    if lower:
        table = np.arange(256, dtype=np.uint8)
        table[65:91] += 32
        data = table[data]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~blank[data]
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    edges = offsets[:-1][offsets[:-1] < n]
    begins[edges] = inside[1:-1][edges]
    edges = offsets[1:][offsets[1:] > 0] - 1
    stops[edges] = inside[1:-1][edges]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    power, back = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _BASE)
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends, data)


def starts_of_words(w: Words, k: int) -> np.ndarray:
    """Hash of the first k bytes of every word, of the whole word if it is shorter."""
    power, back = _powers(len(w.data))
    sums = np.zeros(len(w.data) + 1, np.uint64)
    np.cumsum((w.data.astype(np.uint64) + np.uint64(1)) * power[:len(w.data)], out=sums[1:])
    return mixed((sums[np.minimum(w.starts + k, w.ends)] - sums[w.starts]) * back[w.starts] + np.uint64(k))


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of every run of k words within a text; place is the run's first word."""
    n = len(w.hashes)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        total += w.hashes[i:n - k + 1 + i] * mixed(np.array([i + 1], np.uint64))[0]
    last = np.repeat(w.first[1:], np.diff(w.first))[:n - k + 1]
    place = np.flatnonzero(np.arange(n - k + 1) + k <= last)
    return mixed(total[place]), place


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes as int64); a text of fewer words is one shingle, one
    without words has none."""
    for at, to, data, offsets in chunks(texts):
        w = words(data, offsets)
        hashes, place = grams(w, k)
        bounds = np.searchsorted(place, w.first)
        signed = hashes.view(np.int64)
        for i in range(to - at):
            own = signed[bounds[i]:bounds[i + 1]]
            if len(own):
                yield at + i, np.unique(own)
            elif w.first[i + 1] > w.first[i]:
                few = w.hashes[w.first[i]:w.first[i + 1]]
                marks = mixed(np.arange(1, len(few) + 1, dtype=np.uint64) + np.uint64(1000 * len(few)))
                yield at + i, mixed((few * marks).sum(keepdims=True, dtype=np.uint64)).view(np.int64)
            else:
                yield at + i, own
