"""Token ids in patched frame-of-reference blocks.

A file holds the ids of consecutive documents as one sequence, cut into blocks of 128 ids. A block stores its
minimum and the ids' differences from it, packed at the width that ``percentile`` of the differences need; of the
rest, the low bits are packed likewise, and position and high bits stand in the block's exception list. The footer
holds where each block starts and, for each document, its id and where its ids start, so that a reader can decode
any document without the others.

File: ``b"TPFOR1\\0\\0"``, blocks, footer, then a trailer of five little-endian uint64 (ids, blocks, documents, byte
offset of the footer, magic). Block: minimum (uint32), width (uint8), number of exceptions (uint8), the packed bits
(16 bytes for each bit of width), exceptions' positions (uint8 each), their high bits (uint32 each). Footer: block
starts (uint64 each), document ids (int64 each), null flags of the ids (uint8 each), document starts (uint64 each).
"""

from __future__ import annotations

import json
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, arrow_path, distinct_words, shuffle_partitions, spread
from .shingles import slices

BLOCK = 128
MAGIC = b"TPFOR1\0\0"
_MAGIC_INT = int.from_bytes(MAGIC, "little")
_HEAD = 6
_RUN = 1 << 20  # ids packed or unpacked at once
SLICE = 1 << 22  # bytes of text that are encoded at once


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(n, 128) uint32 below 2**width -> (n, 16 * width) bytes."""
    v = np.ascontiguousarray(values.T).astype(np.uint64)
    out = np.zeros((2 * width, v.shape[1]), np.uint64)
    for i in range(BLOCK):
        lane, shift = divmod(i * width, 64)
        out[lane] |= v[i] << np.uint64(shift)
        if shift + width > 64:
            out[lane + 1] |= v[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8").view(np.uint8).reshape(len(values), 16 * width)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    """The inverse of :func:`_pack`."""
    n = len(packed)
    lanes = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").reshape(n, 2 * width).T)
    mask = np.uint64((1 << width) - 1)
    out = np.empty((BLOCK, n), np.uint32)
    for i in range(BLOCK):
        lane, shift = divmod(i * width, 64)
        x = lanes[lane] >> np.uint64(shift)
        if shift + width > 64:
            x |= lanes[lane + 1] << np.uint64(64 - shift)
        out[i] = x & mask
    return out.T


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs; exact for uint32."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def pack_blocks(ids: np.ndarray, percentile: float = 0.9) -> tuple[bytes, np.ndarray]:
    """Pack uint32 ids (a multiple of 128, or the padded end) -> bytes and each block's start in them."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", np.zeros(0, np.int64)
    x = np.full(n * BLOCK, ids[-1], np.uint32)
    x[: len(ids)] = ids
    x = x.reshape(n, BLOCK)
    least = x.min(axis=1)
    x = x - least[:, None]
    rank = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    width = _bits(np.partition(x, rank, axis=1)[:, rank])
    high = (x.astype(np.uint64) >> width.astype(np.uint64)[:, None]).astype(np.uint32)
    row, pos = np.nonzero(high)
    count = np.bincount(row, minlength=n)
    size = _HEAD + 16 * width + 5 * count
    ends = np.cumsum(size)
    start = ends - size
    buf = np.zeros(int(ends[-1]), np.uint8)
    head = np.zeros(n, np.dtype([("least", "<u4"), ("width", "u1"), ("count", "u1")]))
    head["least"], head["width"], head["count"] = least, width, count
    buf[start[:, None] + np.arange(_HEAD)] = head.view(np.uint8).reshape(n, _HEAD)
    for w in np.unique(width):
        if w:
            g = np.flatnonzero(width == w)
            low = x[g] & np.uint32((1 << int(w)) - 1)
            buf[(start[g] + _HEAD)[:, None] + np.arange(16 * w)] = _pack(low, int(w))
    if len(row):
        k = np.arange(len(row)) - (np.cumsum(count) - count)[row]
        at = start[row] + _HEAD + 16 * width[row]
        buf[at + k] = pos
        buf[(at + count[row] + 4 * k)[:, None] + np.arange(4)] = high[row, pos].astype("<u4").view(np.uint8).reshape(-1, 4)
    return buf.tobytes(), start


def unpack_blocks(data: bytes, start: np.ndarray) -> np.ndarray:
    """The ids of whole blocks that start at ``start`` in ``data`` (the last one padded)."""
    n = len(start)
    if not n:
        return np.zeros(0, np.uint32)
    buf = np.frombuffer(data, np.uint8)
    head = np.ascontiguousarray(buf[start[:, None] + np.arange(_HEAD)]).view(np.dtype([("least", "<u4"), ("width", "u1"), ("count", "u1")])).reshape(n)
    width, count = head["width"].astype(np.int64), head["count"].astype(np.int64)
    x = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            g = np.flatnonzero(width == w)
            x[g] = _unpack(buf[(start[g] + _HEAD)[:, None] + np.arange(16 * w)], int(w))
    if count.any():
        row = np.repeat(np.arange(n), count)
        k = np.arange(len(row)) - (np.cumsum(count) - count)[row]
        at = start[row] + _HEAD + 16 * width[row]
        high = np.ascontiguousarray(buf[(at + count[row] + 4 * k)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
        pos = buf[at + k]
        x[row, pos] |= (high.astype(np.uint64) << width[row].astype(np.uint64)).astype(np.uint32)
    return (x + head["least"][:, None]).reshape(-1)


class Writer:
    """Writes one file document by document; holds a bounded run of ids and the index."""

    def __init__(self, stream, percentile: float = 0.9) -> None:
        self.stream, self.percentile = stream, percentile
        self.at, self.ids, self.held, self.held_bytes = len(MAGIC), 0, [], 0
        self.starts: list[np.ndarray] = []
        self.doc_ids: list[int | None] = []
        self.doc_starts: list[int] = []
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian uint32."""
        self.doc_ids.append(doc_id)
        self.doc_starts.append(self.ids)
        self.ids += len(ids) // 4
        self.held.append(ids)
        self.held_bytes += len(ids)
        if self.held_bytes >= 4 * _RUN:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data = b"".join(self.held)
        cut = len(data) if last else len(data) - len(data) % (4 * BLOCK)
        for i in range(0, cut, 4 * _RUN):
            packed, start = pack_blocks(np.frombuffer(data[i : min(cut, i + 4 * _RUN)], "<u4"), self.percentile)
            self.starts.append(start + self.at)
            self.stream.write(packed)
            self.at += len(packed)
        self.held = [data[cut:]]
        self.held_bytes = len(data) - cut

    def close(self) -> None:
        self._flush(True)
        starts = np.concatenate(self.starts) if self.starts else np.zeros(0, np.int64)
        self.stream.write(starts.astype("<u8").tobytes())
        self.stream.write(np.array([x or 0 for x in self.doc_ids], "<i8").tobytes())
        self.stream.write(np.array([x is None for x in self.doc_ids], np.uint8).tobytes())
        self.stream.write(np.array(self.doc_starts, "<u8").tobytes())
        self.stream.write(struct.pack("<5Q", self.ids, len(starts), len(self.doc_ids), self.at, _MAGIC_INT))


class Reader:
    """Reads one file by its index."""

    def __init__(self, stream) -> None:
        self.stream = stream
        stream.seek(stream.size() - 40)
        self.ids, blocks, docs, self.footer, magic = struct.unpack("<5Q", stream.read(40))
        if magic != _MAGIC_INT:
            raise ValueError("not a file of packed token ids")
        stream.seek(self.footer)
        take = lambda n, kind: np.frombuffer(stream.read(n * np.dtype(kind).itemsize), kind)
        self.starts, ids, null = take(blocks, "<u8").astype(np.int64), take(docs, "<i8"), take(docs, "u1")
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, null)]
        self.doc_starts = np.append(take(docs, "<u8").astype(np.int64), self.ids)

    def blocks(self, first: int, end: int) -> np.ndarray:
        """The ids of blocks first .. end - 1."""
        if first >= end:
            return np.zeros(0, np.uint32)
        lo = int(self.starts[first])
        hi = int(self.starts[end]) if end < len(self.starts) else self.footer
        self.stream.seek(lo)
        return unpack_blocks(self.stream.read(hi - lo), self.starts[first:end] - lo)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document; decodes its blocks only."""
        a, b = int(self.doc_starts[k]), int(self.doc_starts[k + 1])
        first = a // BLOCK
        return self.blocks(first, -(-b // BLOCK) if b > a else first)[a - first * BLOCK : b - first * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """doc_id, start in the file and pieces of the ids of every document, one after another; bounded memory."""
        held, base, step = np.zeros(0, np.uint32), 0, _RUN // BLOCK

        def pieces(a: int, b: int) -> Iterator[np.ndarray]:
            nonlocal held, base
            while a < b:
                if a >= base + len(held):
                    first = a // BLOCK
                    held, base = self.blocks(first, min(len(self.starts), first + step)), first * BLOCK
                end = min(b, base + len(held))
                yield held[a - base : end - base]
                a = end

        for k, doc_id in enumerate(self.doc_ids):
            a, b = int(self.doc_starts[k]), int(self.doc_starts[k + 1])
            yield doc_id, a, pieces(a, b)


#: The normaliser and the splitter under which a text's ids are those of its words.
_NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class WordEncoder:
    """Encodes whole texts with the tokenizers library.

    Where the tokenizer drops white space and splits as ``_SPLITTER`` says, which is checked when it is loaded, a
    text's ids are those of its pieces between spaces or line feeds, in order; each distinct piece of a slice of texts
    is encoded once. A piece of visible ASCII and Latin letters, whose normal form is its lower case, is split here and
    its parts go to the tokenizer's model; any other piece goes through the whole tokenizer. Under any other
    tokenizer, so do whole texts.
    """

    PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str, size: int = 100_000) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.memo, self.parts = Tokenizer.from_file(path), Memo(size), Memo(size)
        self.model = self.tokenizer.model
        visible = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.visible = {i: visible.pre_tokenize_str(chr(i))[0][0] for i in range(0xC0, 0x100)}
        self.by_words = self._by_words(json.loads(self.tokenizer.to_str()))

    @staticmethod
    def _by_words(made: dict) -> bool:
        split = {"type": "Split", "pattern": {"Regex": _SPLITTER}, "behavior": "Removed", "invert": True}
        own = (made["pre_tokenizer"] or {}).get("pretokenizers") or [None, {}]
        level = own[1].get("type") == "ByteLevel" and not own[1].get("add_prefix_space") and not own[1].get("use_regex")
        added = all(t["content"].startswith("<|") and " " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in made["added_tokens"])
        return made["normalizer"] == _NORMALISER and len(own) == 2 and own[0] == split and level and added and made["model"]["type"] == "BPE" and not (made["truncation"] or made["padding"])

    def part(self, part: str) -> bytes:
        try:
            return self.parts[part]
        except KeyError:
            seen = part if part.isascii() else part.translate(self.visible)
            ids = self.parts[part] = _packed([t.id for t in self.model.tokenize(seen)])
            return ids

    def learn(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self.part(word.lower())
        if self.PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join(map(self.part, self.PARTS.findall(word.lower())))
        return self.whole(word)

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        try:
            return self.memo[word]
        except KeyError:
            ids = self.memo[word] = self.learn(word)
            return ids

    def __call__(self, texts: pa.Array) -> Iterator[bytes | memoryview]:
        """The ids of each text as little-endian uint32."""
        for own in slices(texts, SLICE):
            if not self.by_words:
                yield from map(self.whole, own.to_pylist())
                continue
            self.memo.room()
            self.parts.room()
            codes, words, ends = distinct_words(pc.replace_substring(own, "\n", " "))
            body, at = spread(list(map(self.word, words)), codes, ends)
            yield from (body[a:b] for a, b in zip(at.tolist(), at[1:].tolist()))

    def forget(self) -> None:
        self.memo.forget()
        self.parts.forget()


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    """Made once in each worker."""
    return WordEncoder(path)


def write_ids(df: DataFrame, out_dir: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, percentile: float = 0.9, partitions: int | None = None) -> list[tuple[int, int, int]]:
    """Encode every text, append ``end_id``, and write the ids to ``out_dir`` in ascending order of ``id_col``.

    File k holds the k-th range of documents. A task writes to a name of its own attempt and then moves the file
    into place, so lost executors and repeated attempts leave one whole file. Null ids come first, equal ids are
    kept, in the order of their texts' hashes, which part them where they are many; a null text is an empty one; other columns play no part. Returns the number,
    documents and ids of each file with documents; an empty table gives an empty list.
    """
    spark = df.sparkSession
    n = partitions or shuffle_partitions(spark)
    doc = F.col(id_col).cast("long").alias("doc_id")
    rows = df.select(doc, F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("of_text", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "of_text").sortWithinPartitions("doc_id", "of_text", "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = arrow_path(out_dir)
        writer, encode, end = None, None, np.array([end_id], "<u4").tobytes()
        own, place = f"{base}/_attempt-{task.taskAttemptId()}", f"{base}/ids-{task.partitionId():06d}.pfor"
        for batch in batches:
            if writer is None and batch.num_rows:
                fs.create_dir(base, recursive=True)
                stream, encode = fs.open_output_stream(own), word_encoder(tokenizer)
                writer = Writer(stream, percentile)
            if writer is not None:
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                    writer.add(doc_id, bytes(ids) + end)
        if writer is not None:
            encode.forget()
            writer.close()
            stream.close()
            fs.move(own, place)
            yield pa.RecordBatch.from_pydict({"file": pa.array([task.partitionId()], pa.int32()), "docs": pa.array([len(writer.doc_ids)], pa.int64()), "ids": pa.array([writer.ids], pa.int64())})

    made = rows.mapInArrow(write, "file int, docs long, ids long").collect()  # a row for each file
    return sorted((r["file"], r["docs"], r["ids"]) for r in made)


def read_ids(spark: SparkSession, out_dir: str, files: list[tuple[int, int, int]], *, with_ids: bool = True) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if
    asked for, the ids. One task reads one file, a bounded run of blocks at a time."""
    before, starts = 0, []
    for file, _, ids in files:
        starts.append((file, before))
        before += ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = arrow_path(out_dir)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                file, first = starts[k]
                with fs.open_input_file(f"{base}/ids-{file:06d}.pfor") as stream:
                    rows: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []} | ({"ids": []} if with_ids else {})
                    held = 0
                    for doc_id, at, pieces in Reader(stream).documents():
                        crc, n, kept = 0, 0, []
                        for piece in pieces:
                            crc, n = zlib.crc32(piece.astype("<u4", copy=False).tobytes(), crc), n + len(piece)
                            if with_ids:
                                kept.append(piece.astype(np.int32))
                        for name, value in (("doc_id", doc_id), ("start", first + at), ("n_tokens", n), ("ids_crc32", crc)):
                            rows[name].append(value)
                        if with_ids:
                            rows["ids"].append(np.concatenate(kept) if kept else np.zeros(0, np.int32))
                        held += n if with_ids else 64
                        if held >= _RUN:
                            yield _batch(rows)
                            rows, held = {c: [] for c in rows}, 0
                    yield _batch(rows)

    n = len(starts)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(load, schema)


def _batch(rows: dict[str, list]) -> pa.RecordBatch:
    arrays = {c: pa.array(v, pa.int64()) for c, v in rows.items() if c != "ids"}
    if "ids" in rows:
        arrays["ids"] = pa.array(rows["ids"], pa.list_(pa.int32()))
    return pa.RecordBatch.from_pydict(arrays)
