"""Substring dedup by content-defined windows: texts are cut where a gear rolling hash is least of its neighbourhood
(winnowing), and windows from a cut to the first cut ``span`` bytes on are looked up by digest.

Whether a place is a cut depends on the ``within`` bytes beside it and the hash's ``REACH`` bytes only, not on cuts
before it. So a passage that stands in two texts has the same cuts in both, but for REACH + ``within`` bytes at its
beginning and ``within`` at its end, and all windows between them are equal. Windows begin at every cut, so the ends of
a repeat are as fine as the chunks between cuts, while what is compared is never a chunk of a word or two, which occurs
everywhere.

Texts are handled in blocks of documents. A block sends each distinct digest once, with the place of its first
occurrence, to the partition of the digest; that answers which of them occurred earlier elsewhere. So a very common
window is one entry of each block. Digests have 128 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prefix, shuffle_partitions, stored
from .shingles import mix

WINDOW = 16  # bytes that the gear hash sums
REACH = 12  # of them, bytes that decide about a cut: the low bits of the hash
_NONE = -(1 << 63)
#: The gear table, from a rule; 0 for the byte 0, which parts texts that are hashed together.
GEAR = mix(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
GEAR[0] = 0
#: Of cuts at one hash less than _NEAR bytes apart, as in a repeated letter or short word, one in _THIN stays.
_NEAR, _THIN = 8, 8
_OF_WINDOW = 1  # seed of windows' digests: no chunk is taken for a window of one chunk


@dataclass(frozen=True)
class Chunks:
    """Sizes in bytes. ``within``: a cut is where the hash is least of so many places in a row. ``span``: least size of
    a window. A repeat is a run of chunks seen before, in windows seen before, with ``run`` bytes or more. ``block``: bytes of text in a
    block."""

    within: int = 32
    span: int = 48
    run: int = 96
    block: int = 16_000_000

    @property
    def least(self) -> int:
        return 1

    @property
    def most(self) -> int:
        """No chunk is larger."""
        return self.within + _NEAR * _THIN


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: sum of gear[byte] << age over the last 16 bytes, modulo 2**32, by doubling."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def _slide(a: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` (a ufunc) of each ``width`` values in a row, by doubling."""
    n = 1
    while 2 * n <= width:
        a, n = least(a[:-n], a[n:]), 2 * n
    return least(a[: n - width], a[width - n :]) if n < width else a


def chunk_ends(texts: list[bytes], options: Chunks) -> list[list[int]]:
    """Ends of the chunks of each text; never inside a character."""
    w = options.within
    gap = bytes(max(WINDOW, w))
    whole = np.frombuffer(gap + b"".join(t + gap for t in texts), np.uint8)
    inside, starts, at = np.zeros(len(whole), bool), [], len(gap)
    for t in texts:
        starts.append(at)
        inside[at : at + len(t)] = True
        at += len(t) + len(gap)
    low = gear(whole) & np.uint32((1 << REACH) - 1)
    rank = low * np.uint32(0x9E3779B1) | np.uint32(1)
    rank[:-1][whole[1:] & 0xC0 == 0x80] = 0xFFFFFFFF
    rank[~inside] = 0  # windows that leave a text choose nothing in it
    edge = np.zeros(w - 1, np.uint32)
    chosen = _slide(np.concatenate((edge, _slide(rank, w, np.minimum), edge)), w, np.maximum)
    place = np.flatnonzero((chosen == rank) & inside)
    again = np.zeros(len(place), bool)
    again[1:] = (rank[place[1:]] == rank[place[:-1]]) & (np.diff(place) < _NEAR)
    number = np.arange(len(place))
    place = place[(number - np.maximum.accumulate(np.where(again, 0, number))) % _THIN == 0] + 1
    lo = np.searchsorted(place, starts)
    hi = np.searchsorted(place, [s + len(t) for s, t in zip(starts, texts)])
    return [(place[a:b] - s).tolist() + [len(t)] * (len(t) > 0) for t, s, a, b in zip(texts, starts, lo, hi)]


def windows(ends: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of a text: own, first and last chunk. A chunk's window runs from it to the first chunk that ends
    ``span`` bytes on; a smaller text is one window. The last chunk's ends the text, so that copies count whole."""
    n = len(ends)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    begin = np.concatenate(([0], ends[:-1]))
    last = np.searchsorted(ends, begin + span)
    own = np.flatnonzero(last < n)
    if not len(own):
        return np.array([0]), np.array([0]), np.array([n - 1])
    last = last[own]
    if last[-1] == n - 1:
        return own, own, last
    return np.append(own, n - 1), np.append(own, own[-1]), np.append(last, n - 1)


_SCHEMA = "kind int, part int, block long, a binary, b binary, c binary"


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def _pack_sorted(x: np.ndarray) -> bytes:
    """Sorted numbers below 2**32, by their differences."""
    return _pack(np.diff(x, prepend=0).astype(np.uint32))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.uint32), dtype=np.int64)


def _ask(rows: DataFrame, options: Chunks, parts: int) -> DataFrame:
    """kind 0: a block's documents (ids and row numbers, numbers of chunks, sizes of chunks); kind 1: its digests for one part
    (digests, document ids, positions; a chunk's position is twice its number in the block, that of its window one
    more); kind 2: the positions of what occurred before in the block."""
    names = ["kind", "part", "block", "a", "b", "c"]

    def row(*values) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names)

    def finish(block: int, ids: list, count: list, sizes: list, places: list, digests: bytearray, numbers: list) -> Iterator[pa.RecordBatch]:
        yield row(0, block % parts, block, _pack(np.array([*ids, *numbers], np.int64)), _pack(np.array(count, np.int64)), _pack(np.concatenate(sizes)))
        d = np.frombuffer(bytes(digests), ">u8").astype(np.uint64).reshape(-1, 2)
        if not len(d):
            return
        place = np.concatenate(places)
        doc = np.repeat(np.array(ids, np.int64), count)[place >> 1]
        order = np.lexsort((place, doc, d[:, 1], d[:, 0]))
        s = d[order]
        first = np.ones(len(s), bool)
        first[1:] = (s[1:] != s[:-1]).any(axis=1)
        if not first.all():
            yield row(2, block % parts, block, None, None, _pack_sorted(np.sort(place[order[~first]])))
        own = order[first]
        own = own[np.argsort(place[own])]
        part = ((d[own, 0] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        edge = np.searchsorted(part[by], np.arange(parts + 1))
        for p in range(parts):
            take = own[by[edge[p] : edge[p + 1]]]
            if len(take):
                yield row(1, p, block, d[take].tobytes(), _pack(np.diff(doc[take], prepend=0)), _pack_sorted(place[take]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, at = TaskContext.get().partitionId() << 24, 0, 0
        held = ids, count, sizes, places, digests, numbers = [], [], [], [], bytearray(), []
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = [t.encode() for t in part.column(1).to_pylist()]
                ids += part.column(0).to_pylist()
                numbers += part.column(2).to_pylist()
                for t, ends in zip(texts, chunk_ends(texts, options)):
                    e = np.array(ends, np.int64)
                    own, first, last = windows(e, options.span)
                    begin = np.concatenate(([0], e))[first].tolist()
                    digests += b"".join([xxhash.xxh3_128_digest(t[a:b]) for a, b in zip([0, *ends], ends)])
                    digests += b"".join([xxhash.xxh3_128_digest(t[a:b], _OF_WINDOW) for a, b in zip(begin, e[last].tolist())])
                    count.append(len(e))
                    sizes.append(np.diff(e, prepend=0).astype(np.uint32))
                    places += [2 * (np.arange(len(e)) + at), 2 * (own + at) + 1]
                    at += len(e)
                    size += len(t)
                if size >= options.block:
                    yield from finish(block, *held)
                    block, size, at = block + 1, 0, 0
                    for x in held:
                        x.clear()
        if ids:
            yield from finish(block, *held)

    return rows.mapInArrow(run, _SCHEMA)


def _answer(asked: DataFrame, parts: int) -> DataFrame:
    """For each block, the positions of chunks and windows whose digest has its first occurrence in another block;
    and its other rows. All come by one shuffle, so that digests are on disk once."""
    names = ["block", "a", "b", "c", "later"]

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([values[0]], pa.int64()), *(pa.array([v], pa.binary()) for v in values[1:])], names)

    def finish(held: list) -> Iterator[pa.RecordBatch]:
        d = np.concatenate([np.frombuffer(a, np.uint64).reshape(-1, 2) for _, a, _, _ in held])
        doc = np.concatenate([np.cumsum(np.frombuffer(zlib.decompress(b), np.int64)) for _, _, b, _ in held])
        place = np.concatenate([_unpack_sorted(c) for _, _, _, c in held])
        block = np.repeat(np.array([x[0] for x in held], np.int64), [len(x[1]) // 16 for x in held])
        order = np.lexsort((place, block, doc, d[:, 1], d[:, 0]))
        s = d[order]
        later = np.zeros(len(s), bool)
        later[1:] = (s[1:] == s[:-1]).all(axis=1)
        hit = order[later]
        hit = hit[np.lexsort((place[hit], block[hit]))]
        blocks, at = np.unique(block[hit], return_index=True)
        for b, x in zip(blocks.tolist(), np.split(place[hit], at[1:])):
            yield row(b, None, None, None, _pack_sorted(x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for kind, part, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if kind != 1:
                    yield row(*rest, None) if kind == 0 else row(rest[0], None, None, None, rest[3])
                    continue
                if held and part != now:
                    yield from finish(held)
                    held = []
                now = part
                held.append(rest)
        if held:
            yield from finish(held)

    return asked.repartitionById(parts, F.col("part") % parts).sortWithinPartitions("part", "block").mapInArrow(run, "block long, a binary, b binary, c binary, later binary")


def find_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, options: Chunks = Chunks()) -> DataFrame:
    """A row for each document: doc_id, repeated (whether it has a repeat), repeat_bytes, repeats (array of start, end in
    bytes: runs of seen chunks that lie in windows that occurred before, of ``options.run`` bytes or more), n_bytes,
    n_chunks, n_seen (chunks that occurred before), seen_bytes, and, where ``row_col`` names a long column, that as row.

    "Before" is in a document of a smaller id, or earlier in the same one; of rows with one id, one comes first, by
    its place in the input. A null text is an empty one without chunks; null ids come before all others; other
    columns play no part; an empty table gives an empty one. Passages are found whole but for some bytes at their
    ends; those shorter than a run and these bytes are left alone. Where an executor is lost, its rows are read again:
    the input should give a partition's rows in the same order then, as files do; else ``stored`` it first.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    number = F.col(row_col).cast("long") if row_col else F.lit(0).cast("long")
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), number.alias("number"))
    # parts of a partition are sorted one by one
    answers = _answer(_ask(rows, options, 4 * parts), parts)

    def close(key: tuple, table: pa.Table) -> pa.Table:
        packed = [x for x in zip(*(table[c].to_pylist() for c in ("a", "b", "c"))) if x[0] is not None]
        ids, count = (np.frombuffer(zlib.decompress(x), np.int64) for x in packed[0][:2])
        sizes = np.frombuffer(zlib.decompress(packed[0][2]), np.uint32).astype(np.int64)
        known = np.zeros(2 * len(sizes), bool)
        for x in table["later"].to_pylist():
            if x is not None:
                known[_unpack_sorted(x)] = True
        out: dict[str, list] = {c: [] for c in ("doc_id", "repeated", "repeat_bytes", "repeats", "n_bytes", "n_chunks", "n_seen", "seen_bytes", "row")}
        at = 0
        for k, number, n in zip(ids.tolist(), ids[len(count) :].tolist(), count.tolist()):
            size, s, again = sizes[at : at + n], known[2 * at : 2 * (at + n) : 2], known[2 * at + 1 : 2 * (at + n) : 2]
            at += n
            e = np.cumsum(size)
            own, lo, hi = windows(e, options.span)
            hit = again[own]
            cover = np.cumsum(np.bincount(lo[hit], minlength=n + 1) - np.bincount(hi[hit] + 1, minlength=n + 1))[:n] > 0
            cover &= s
            edge = np.flatnonzero(np.diff(np.concatenate(([False], cover, [False])).astype(np.int8)))
            begin = np.concatenate(([0], e))
            runs = [(int(begin[a]), int(e[b - 1])) for a, b in zip(edge[::2], edge[1::2])]
            runs = [r for r in runs if r[1] - r[0] >= options.run]
            values = (None if k == _NONE else k, bool(runs), sum(b - a for a, b in runs), [{"start": a, "end": b} for a, b in runs], int(e[-1]) if n else 0, n, int(s.sum()), int(size[s].sum()), number)
            for c, v in zip(out, values):
                out[c].append(v)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = {"repeats": span, "repeated": pa.bool_()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    made = answers.groupBy("block").applyInArrow(close, "doc_id long, repeated boolean, repeat_bytes long, repeats array<struct<start:long,end:long>>, n_bytes long, n_chunks long, n_seen long, seen_bytes long, row long")
    return made if row_col else made.drop("row")


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", options: Chunks = Chunks()) -> DataFrame:
    """The rows of ``df`` without their repeats; all other columns as they are. Rows are numbered and written to the shared
    folder first, so that rows which share an id keep to their own repeats."""
    p = prefix(df, "r")
    rows = stored(df.withColumn(p + "row", F.monotonically_increasing_id()), "numbered")
    found = find_repeats(rows, id_col=id_col, text_col=text_col, row_col=p + "row", options=options).where("repeated").select(F.col("row").alias(p + "of"), F.col("repeats").alias(p + "cut"))
    x = rows.join(stored(found, "repeats"), F.col(p + "row") == F.col(p + "of"), "left")
    data, cut = F.col(text_col).cast("binary"), F.col(p + "cut")
    n = F.size(cut)

    def piece(i: Column) -> Column:
        """What lies before the i-th repeat; for i = n, after the last."""
        a = F.when(i > 0, F.get(cut, i - 1)["end"]).otherwise(F.lit(0).cast("long"))
        b = F.when(i < n, F.get(cut, i)["start"]).otherwise(F.octet_length(data).cast("long"))
        return F.substring(data, (a + 1).cast("int"), (b - a).cast("int")).cast("string")

    text = F.array_join(F.transform(F.sequence(F.lit(0), n), piece), "")
    return x.withColumn(text_col, F.when(cut.isNotNull(), text).otherwise(F.col(text_col))).select(*df.columns)
