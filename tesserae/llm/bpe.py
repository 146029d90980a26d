"""Byte-level BPE by rank tables: two-tier encoding, and decoding.

A pre-token that is itself in the vocabulary is resolved by a minimal perfect hash; any other is merged with a heap
over linked bytes. Both give what repeated merging of the lowest-ranked, leftmost pair gives.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, distinct_words, spread, tidy
from .shingles import slices

SLICE = 1 << 22  # bytes of text that are encoded at once

_M = (1 << 64) - 1


class PerfectHash:
    """A minimal perfect hash by displacement: each of n keys has a place of its own in 0 .. n - 1.

    Keys fall into n / 2 buckets. Buckets, largest first, get the first seed whose hashes put their keys on free
    places; a bucket of one key gets a free place outright. Lookups compare the key at the place, so other keys are
    told apart.
    """

    def __init__(self, items: dict[bytes, int]) -> None:
        self.n = n = len(items)
        self.buckets = nb = max(1, n // 2)
        buckets: list[list[bytes]] = [[] for _ in range(nb)]
        for key in items:
            buckets[xxhash.xxh3_64_intdigest(key) % nb].append(key)
        self.seed = [0] * nb  # below 0: the place is -seed - 1
        self.keys: list[bytes | None] = [None] * n
        free = n
        for b in sorted(range(nb), key=lambda b: (-len(buckets[b]), b)):
            own = buckets[b]
            if len(own) > 1:
                d, places = 1, []
                while len(set(places)) < len(own):
                    places = [xxhash.xxh3_64_intdigest(key, d) % n for key in own]
                    if any(self.keys[p] is not None for p in places):
                        places = []
                    d += 1
                self.seed[b] = d - 1
                for p, key in zip(places, own):
                    self.keys[p] = key
            elif own:
                free -= 1
                while self.keys[free] is not None:
                    free -= 1
                self.seed[b], self.keys[free] = -free - 1, own[0]
        self.values = [items[k] for k in self.keys]

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        d = self.seed[xxhash.xxh3_64_intdigest(key) % self.buckets]
        p = xxhash.xxh3_64_intdigest(key, d) % self.n if d >= 0 else -d - 1
        return self.values[p] if self.keys[p] == key else None


class Codec:
    """Encodes and decodes by a rank table and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 100_000) -> None:
        self.ranks, self.table = ranks, PerfectHash(ranks)
        self.find = regex.compile(pattern).findall
        self.memo, self.pieces = Memo(memo), Memo(memo)
        tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            tokens[i] = b
        self.bytes = pa.array(tokens, pa.large_binary())
        self.texts = pa.array([f" {i}".encode() for i in range(len(tokens))], pa.large_binary())

    def merge(self, piece: bytes) -> list[int]:
        """Tier two: a heap of the pairs' ranks over a linked list of the piece's bytes; O(n log n)."""
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))  # of the part that starts here; 0 if merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue  # one of the two parts has been merged since
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def piece(self, piece: str) -> bytes:
        """Tier one, then tier two; the memo before them only saves doing one piece twice. Ids are uint32."""
        try:
            return self.pieces[piece]
        except KeyError:
            data = piece.encode()
            whole = self.table.get(data)
            ids = self.pieces[piece] = array("I", (whole,) if whole is not None else self.merge(data)).tobytes()
            return ids

    def encode(self, text: str) -> bytes:
        """The ids of the text, each match of the pattern by itself."""
        return b"".join(map(self.piece, self.find(text)))

    def word(self, word: str) -> bytes | None:
        """The ids of a space and ``word``; None if the space or the word's end might belong to other white space."""
        try:
            return self.memo[word]
        except KeyError:
            safe = word and not word[0].isspace() and not word[-1].isspace()
            ids = self.memo[word] = self.encode(f" {word}") if safe else None
            return ids

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin, with the end.

        A single space between two other characters always starts a pre-token, so texts are cut there and each
        distinct word of the slice is encoded once; a text with other white space beside a space is split by the
        pattern as a whole.
        """
        self.memo.room()
        self.pieces.room()
        codes, words, ends = distinct_words(texts)
        made = [self.word(w) for w in words]
        first, size, n = ends[:-1], np.diff(ends), len(words)
        heads = [words[i] for i in codes[first].tolist()]
        codes = codes.copy()
        codes[first] = n + np.arange(len(first))  # a text's first word has no space before it
        bad = np.array([h[-1:].isspace() or (not h and m > 1) for h, m in zip(heads, size.tolist())], bool)
        odd = np.array([m is None for m in made] + [False] * len(first), bool)[codes]
        bad[np.searchsorted(ends, np.flatnonzero(odd), side="right") - 1] = True
        whole = iter(texts.filter(pa.array(bad)).to_pylist())
        made += [self.encode(next(whole) if b else h) for b, h in zip(bad.tolist(), heads)]
        keep = ~np.repeat(bad, size)
        keep[first[bad]] = True  # a text that is split as a whole is one entry
        ends = np.concatenate(([0], np.cumsum(np.where(bad, 1, size))))
        body, at = spread([m or b"" for m in made], codes[keep], ends)
        return np.frombuffer(body, np.uint32), at // 4

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes of all texts' ids, one after another, and where each text's begin, with the end."""
        return spread(self.bytes, ids, ends)

    def decimals(self, ids: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The same of the ids' decimals, each after a space."""
        return spread(self.texts, ids, ends)

    def forget(self) -> None:
        """Call at the end of a task."""
        self.memo.forget()
        self.pieces.forget()


def ranks_of(path: str) -> dict[bytes, int]:
    """The ranks of a file whose lines are base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, made once in each worker."""
    return Codec(ranks_of(path), pattern)


def encode_bpe(df: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 and, if asked for,
    ids (array<int>) and decoded (binary). A null text is an empty one: no ids, hashes of nothing. Null and equal
    doc_ids are kept, rows stay one to one; other columns play no part. A map over the rows: nothing is shuffled.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path, pattern)
        digest = lambda body, at, skip: pa.array([hashlib.sha256(body[a + skip : b] if b > a else b"").hexdigest() for a, b in zip(at.tolist(), at[1:].tolist())], pa.string())
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1), SLICE):
                ids, ends = code.batch(texts)
                body, bounds = code.decode(ids, ends)
                arrays = [batch.column(0).slice(at, len(texts)), pa.array(np.diff(ends)), digest(*code.decimals(ids, ends), 1), digest(body, bounds, 0)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32))))
                    arrays.append(pa.array([bytes(body[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())], pa.binary()))
                    names += ["ids", "decoded"]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(arrays, names)
        code.forget()

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(tidy(run), schema)
