"""64-bit fingerprints of sentences and their blocks. Fingerprints are signed longs; only bits matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

# Fixed values of the 64-bit FNV-1a hash.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
BLOCKS = 4
BLOCK_BITS = 16
MAX_DISTANCE = 4
_RUN = 100_000  # bigrams whose bits are counted at once


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def bigram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bigrams as numbers, one after another, and how many each text has; a single character stands for
    itself."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    after = np.append(chars[1:], np.uint64(0))
    last = np.zeros(len(chars), bool)
    ends = np.cumsum(size)
    last[ends[size > 0] - 1] = True
    own = np.where(last, np.uint64(0), after + np.uint64(1))  # 0: no second character
    keep = ~last
    keep[ends[size == 1] - 1] = True
    return ((chars << np.uint64(21)) | own)[keep], np.where(size > 1, size - 1, size)


def bigram_text(code: int) -> str:
    a, b = code >> 21, code & 0x1FFFFF
    return chr(a) + (chr(b - 1) if b else "")


def counted_codes(codes: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in ascending order, and how often each is there."""
    if times is None:
        codes, order = np.sort(codes), None
    else:
        order = np.argsort(codes)
        codes = codes[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1])))
    count = np.diff(np.append(first, len(codes))) if order is None else np.add.reduceat(times[order], first) if len(first) else times
    return codes[first], count


def _hash_bigram(code: int) -> int:
    return fnv1a(bigram_text(code).encode())


def _simhashes(texts: list[str]) -> np.ndarray:
    """Each distinct bigram is hashed once; of a text's bigrams the bits are counted in one segmented sum. The 64 counters of
    a text stand side by side in words of 64 bits, each as wide as the text's number of bigrams needs."""
    grams, count = bigram_codes(texts)
    out = np.zeros(len(texts), np.int64)
    if not len(grams):
        return out
    distinct, _ = counted_codes(grams)
    where = np.searchsorted(distinct, grams)
    hashes = np.array([_hash_bigram(c) for c in distinct.tolist()], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    above = 0
    for width, most in (("<u1", 0xFF), ("<u2", 0xFFFF), ("<u4", 0xFFFFFFFF)):
        mine = (count > above) & (count <= most)
        above, some = most, np.flatnonzero(mine)
        if not len(some):
            continue
        lanes = np.ascontiguousarray(bits.astype(width)).view("<u8")
        own = where if len(some) == len(texts) else where[np.repeat(mine, count)]
        begins = np.concatenate(([0], np.cumsum(count[some])))
        at = 0
        while at < len(some):
            end = max(at + 1, int(np.searchsorted(begins, begins[at] + _RUN, side="right")) - 1)
            ones = np.add.reduceat(lanes[own[begins[at] : begins[end]]], begins[at:end] - begins[at], axis=0).view(width)
            out[some[at:end]] = np.packbits(2 * ones.astype(np.int64) > count[some[at:end], None], axis=1, bitorder="little").view("<i8").reshape(-1)
            at = end
    return out


@F.pandas_udf(LongType())
def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The bits on which most bigrams of a text agree; ties and empty texts give 0. Null stays null."""
    for s in batches:
        null = s.isna()
        yield pd.Series(_simhashes(s.where(~null, "").tolist()), dtype="Int64").mask(null.reset_index(drop=True))


# else a filter on fingerprints is moved before their column, and all are made twice
simhash = simhash.asNondeterministic()


@F.pandas_udf(StringType())
def fnv1a_hex(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The hash of a text's UTF-8 bytes, in hexadecimal."""
    for s in batches:
        yield s.map(lambda x: None if x is None else f"{fnv1a(x.encode()):016x}")


def blocks(fp: Column) -> Column:
    """The fingerprint's four blocks of 16 bits, lowest first."""
    return F.array(*(F.shiftrightunsigned(fp, i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int") for i in range(BLOCKS)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
