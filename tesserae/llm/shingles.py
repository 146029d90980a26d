"""Word shingles of a text as sets of 64-bit hashes, for a slice of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
#: Bytes of text that are hashed at once.
RUN = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def slices(column: pa.Array, run: int = RUN) -> Iterator[pa.Array]:
    """The column in pieces of about ``run`` bytes of text, of one row at least."""
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    at, n = 0, len(column)
    while at < n:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + run, side="right")) - 1)
        yield column.slice(at, min(end, n) - at)
        at = min(end, n)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each text begins in them, with the end; a null text has none."""
    wide = pa.types.is_large_string(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[ends[0] : ends[-1]] if body is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def word_hashes(column: pa.Array, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words, one after another, after A-Z became a-z, and how many words each text has.

    Words are runs of bytes other than those marked in ``between``, the six white-space bytes unless told otherwise; a
    null text has none. A word's hash is the sum of a random number for each pair of byte and place, so one pass over
    the bytes hashes all words.
    """
    data, ends = text_bytes(column)
    inside = ~between[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = ends[:-1][ends[:-1] < ends[1:]]
    begins[edges] = inside[edges]  # a text's first byte begins a word whatever stands before
    first = np.flatnonzero(begins)
    count = np.diff(np.searchsorted(first, ends))
    letters = np.cumsum(inside)[first] - 1 if len(first) else first  # of each word's first byte among the words' bytes
    data = _LOWER[data[inside]]
    bounds = np.append(letters, len(data))
    out = np.empty(len(first), np.uint64)
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + RUN, side="right")) - 1)
        own = bounds[a : b + 1] - bounds[a]
        size = np.diff(own)
        place = np.arange(own[-1]) - np.repeat(own[:-1], size)
        h = np.cumsum(mix((data[bounds[a] : bounds[b]].astype(np.uint64) + (place.astype(np.uint64) << _U(8))) * _STEP + _STEP))
        h = np.append(_U(0), h)
        out[a:b] = mix((h[own[1:]] - h[own[:-1]]) + size.astype(np.uint64))
        a = b
    return out, count


def windows(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words; with fewer than k words, one for all of them; none without words."""
    n = len(ids)
    if not n:
        return ids
    width = min(k, n)
    h = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        h = mix(h * _STEP + ids[i : n - width + 1 + i])
    return h


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    for piece in slices(column):
        ids, count = word_hashes(piece)
        h = windows(ids, k) if len(ids) >= k else ids
        at = 0
        for n in count.tolist():
            s = h[at : at + n - k + 1] if n >= k else windows(ids[at : at + n], k)
            if len(s) > 1:
                s = np.sort(s)
                new = np.empty(len(s), bool)
                new[0] = True
                np.not_equal(s[1:], s[:-1], out=new[1:])
                s = s[new]
            yield s
            at += n


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit id of the set: equal sets have equal ids."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))
