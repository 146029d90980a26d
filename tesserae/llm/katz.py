"""A Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights, partitioned tables.

Texts are cut into chunks of some million tokens. A chunk keeps its tokens in a file of the shared folder and asks
the tables, which are partitioned by n-gram hash, about its distinct n-grams: it sends sorted hashes with its own
training counts and gets totals back in that order. So the corpus' counts meet in the tables' partitions and no task
or driver ever holds a whole table; a frequent n-gram is one entry of each chunk, however often it occurs.

p_m(w | h) = d(c) c(h w) / c(h) if h w was seen, else alpha(h) p_{m-1}(w | h'); p_1 gives what its discounts free to
the one event "a word not seen". alpha(h) makes the probabilities of all words after h add up to one: for it the
seen words' p_m and p_{m-1} are summed, by the one chunk that owns an n-gram, and these sums meet in the tables.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_path, shared_dir, shuffle_partitions, stored
from .shingles import mix, slices, word_hashes

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
_U = np.uint64
#: Bytes of text whose n-grams a part of the tables has at most: some two million entries of chunks.
PART_BYTES = 32 << 20


@dataclass(frozen=True)
class Katz:
    """``order``: longest n-gram. ``discounted``: counts up to this are discounted. ``chunk``: tokens in a chunk."""

    order: int = 2
    discounted: int = 5
    chunk: int = 4_000_000


# ---- packing ----


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted distinct uint64: differences by byte planes; the high planes, mostly zero, are compressed."""
    d = np.diff(keys, prepend=_U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    low, high = np.ascontiguousarray(d[:5]).tobytes(), zlib.compress(np.ascontiguousarray(d[5:]).tobytes(), 1)
    return len(keys).to_bytes(8, "little") + low + high


def unpack_sorted(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    d = np.empty((8, n), np.uint8)
    d[:5] = np.frombuffer(data, np.uint8, 5 * n, 8).reshape(5, n)
    d[5:] = np.frombuffer(zlib.decompress(data[8 + 5 * n :]), np.uint8).reshape(3, n)
    return np.cumsum(np.ascontiguousarray(d.T).view("<u8").reshape(n), dtype=np.uint64)


def pack_counts(x: np.ndarray) -> bytes:
    """Mostly small non-negative integers, by byte planes."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zlib.compress(planes.tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.int64)


# ---- a chunk ----


def _distinct(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values, and at each position the index of its value, in four bytes: a chunk is far shorter than
    two thousand million tokens, and several of these are held at once."""
    order = np.argsort(g)
    g = g[order]
    new = np.ones(len(g), bool)
    np.not_equal(g[1:], g[:-1], out=new[1:])
    types = g[new]
    del g
    inverse = np.empty(len(order), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return types, inverse


def _extended(before: np.ndarray, token: np.ndarray, m: int) -> np.ndarray:
    """The hash of an m-gram from that of its first m - 1 tokens and the last one."""
    return mix(before * _U(0x9E3779B97F4A7C15) + token + _U(m))


class Chunk:
    """Documents as one sequence of hashes; each document is START, its words, END."""

    def __init__(self, keys: np.ndarray, null: np.ndarray, lengths: np.ndarray, tokens: np.ndarray) -> None:
        self.keys, self.null, self.lengths, self.tokens = keys, null, lengths, tokens
        ends = np.cumsum(lengths)
        self.starts = ends - lengths
        held = [zlib.crc32(b"" if z else str(k).encode()) % 5 == 1 for k, z in zip(keys.tolist(), null.tolist())]
        self.held = np.array(held, bool)
        self.doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.train = ~self.held[self.doc]
        self.is_start = np.zeros(len(tokens), bool)
        self.is_start[self.starts] = True

    def to_bytes(self) -> bytes:
        vocabulary, local = _distinct(self.tokens)
        parts = [pack_sorted(vocabulary), zlib.compress(np.ascontiguousarray(local.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1), self.keys.astype("<i8").tobytes(), self.null.astype(np.uint8).tobytes(), self.lengths.astype("<i8").tobytes()]
        return b"".join(len(p).to_bytes(8, "little") + p for p in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Chunk:
        parts, at = [], 0
        while at < len(data):
            n = int.from_bytes(data[at : at + 8], "little")
            parts.append(data[at + 8 : at + 8 + n])
            at += 8 + n
        planes = np.frombuffer(zlib.decompress(parts[1]), np.uint8).reshape(4, -1)
        local = np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
        return cls(np.frombuffer(parts[2], "<i8"), np.frombuffer(parts[3], np.uint8).astype(bool), np.frombuffer(parts[4], "<i8"), unpack_sorted(parts[0])[local])

    def grams(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each level: the sorted distinct n-grams, and at each position the index of the one that ends there.
        Before a document's beginning stand further STARTs."""
        g, before = self.tokens, START
        for m in range(1, order + 1):
            if m > 1:
                previous = np.empty_like(g)
                previous[1:] = g[:-1]
                previous[self.starts] = before
                g, before = _extended(previous, self.tokens, m), _extended(np.array([before]), np.array([START]), m)[0]
            yield _distinct(g)


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's range of hashes begins in the sorted keys, and the end."""
    edges = np.array([(p << 64) // parts for p in range(parts)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def _path(folder: str, chunk: int) -> tuple:
    fs, base = arrow_path(folder)
    return fs, f"{base}/chunk-{chunk}.bin"


def _load(folder: str, chunk: int) -> Chunk:
    fs, path = _path(folder, chunk)
    with fs.open_input_file(path) as f:
        return Chunk.from_bytes(f.read())


_MESSAGE = "level int, part int, chunk long, keys binary, counts binary"


def _messages(rows: DataFrame, folder: str, model: Katz, parts: int) -> DataFrame:
    """Write the chunks and ask for the counts of their n-grams."""

    def finish(number: int, held: list) -> Iterator[pa.RecordBatch]:
        keys, null, lengths, tokens = zip(*held)
        chunk = Chunk(np.array(keys, np.int64), np.array(null, bool), np.array(lengths, np.int64), np.concatenate(tokens))
        held.clear()
        del tokens
        fs, path = _path(folder, number)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        own = f"{path}.{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(own) as f:
            f.write(chunk.to_bytes())
        fs.move(own, path)
        for level, (types, inverse) in enumerate(chunk.grams(model.order), 1):
            count = np.bincount(inverse[chunk.train], minlength=len(types))
            del inverse
            cuts = _cuts(types, parts)
            for p in range(parts):
                s = slice(cuts[p], cuts[p + 1])
                if cuts[p] < cuts[p + 1]:
                    yield pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([p], pa.int32()), pa.array([number], pa.int64()), pa.array([pack_sorted(types[s])], pa.binary()), pa.array([pack_counts(count[s])], pa.binary())], ["level", "part", "chunk", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, seen = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            keys, at = batch.column(0).to_pylist(), 0
            for piece in slices(batch.column(1)):
                hashes, count = word_hashes(piece)
                own_keys, at = keys[at : at + len(piece)], at + len(piece)
                for key, own in zip(own_keys, np.split(hashes, np.cumsum(count)[:-1]), strict=True):
                    tokens = np.concatenate(([START], own, [END])).astype(np.uint64)
                    held.append((key or 0, key is None, len(tokens), tokens))
                    seen += len(tokens)
                    if seen >= model.chunk:
                        yield from finish(number, held)
                        number, held, seen = number + 1, [], 0
        if held:
            yield from finish(number, held)

    return rows.mapInArrow(run, _MESSAGE)


def _start_keys(order: int) -> list[np.uint64]:
    """The hash of m STARTs, for each m: contexts only, not n-grams that the model predicts."""
    out = [START]
    for m in range(2, order + 1):
        out.append(_extended(np.array([out[-1]]), np.array([START]), m)[0])
    return out


def _count(messages: DataFrame, model: Katz, parts: int) -> DataFrame:
    """The tables: totals of each part, answered to each chunk (total, shared by chunks, owned by this one), and
    what the discounts need (chunk null): tokens, types and counts of counts."""
    starts = _start_keys(model.order)
    top = model.discounted + 1

    def finish(level: int, part: int, held: list) -> Iterator[pa.RecordBatch]:
        keys = [unpack_sorted(k) for _, k, _ in held]
        types, inverse = _distinct(np.concatenate(keys))
        counts = np.concatenate([unpack_counts(c) for _, _, c in held])
        total = np.zeros(len(types), np.int64)
        np.add.at(total, inverse, counts)
        first = np.full(len(types), len(inverse), np.int64)
        np.minimum.at(first, inverse, np.arange(len(inverse)))
        owned = first[inverse] == np.arange(len(inverse))
        at = 0
        for (chunk, _, _), k in zip(held, keys):
            s = slice(at, at + len(k))
            at += len(k)
            yield pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), pa.array([pack_counts(2 * total[inverse[s]] + owned[s])], pa.binary()), pa.nulls(1, pa.list_(pa.int64()))], ["level", "part", "chunk", "answer", "stats"])
        real = total[types != starts[level - 1]]
        stats = [int(real.sum()), int((real > 0).sum()), *(int((real == r).sum()) for r in range(1, top + 1))]
        yield pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([part], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([stats], pa.list_(pa.int64()))], ["level", "part", "chunk", "answer", "stats"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for level, part, chunk, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (level, part) != at:
                    yield from finish(*at, held)
                    held = []
                at = (level, part)
                held.append((chunk, keys, counts))
        if held:
            yield from finish(*at, held)

    # each table part is a task of its own
    own = (F.col("level") - 1) * parts + F.col("part")
    return messages.repartitionById(model.order * parts, own).sortWithinPartitions("level", "part", "chunk").mapInArrow(run, "level int, part int, chunk long, answer binary, stats array<long>")


def discounts(n_r: list[int]) -> np.ndarray:
    """Good-Turing discounts d_0 (unused), d_1 .. d_k by Katz, from counts of counts n_1 .. n_{k+1}; a ratio that
    is not in (0, 1] counts as 1."""
    k = len(n_r) - 1
    d = np.ones(k + 1)
    if n_r[0] > 0:
        a = (k + 1) * n_r[k] / n_r[0]
        for r in range(1, k + 1):
            if n_r[r - 1] > 0 and a < 1:
                x = ((r + 1) * n_r[r] / (r * n_r[r - 1]) - a) / (1 - a)
                d[r] = x if 0 < x <= 1 else 1.0
    return d


@dataclass
class Stats:
    """Tokens, types and discounts of each level."""

    tokens: int
    types: int
    d: list[np.ndarray]
    unknown: float  # p_1 of a word not seen
    scale: float  # of p_1: 1, or less where no discount frees anything


def _stats(rows: list, model: Katz) -> Stats:
    levels = [np.sum([r["stats"] for r in rows if r["level"] == m] or [[0] * (model.discounted + 3)], axis=0) for m in range(1, model.order + 1)]
    d = [discounts([int(x) for x in s[2:]]) for s in levels]
    n = int(levels[0][0])
    freed = sum((1 - d[0][r]) * r * int(levels[0][1 + r]) for r in range(1, model.discounted + 1))
    if n and freed > 1e-9 * n:
        return Stats(n, int(levels[0][1]), d, freed / n, 1.0)
    return Stats(n, int(levels[0][1]), d, 1 / (n + 1), n / (n + 1))


class Scored:
    """A chunk with the tables' answers: probabilities of its distinct n-grams, level by level."""

    def __init__(self, chunk: Chunk, answers: dict[int, np.ndarray], stats: Stats, model: Katz) -> None:
        self.chunk, self.grams, self.stats, self.model = chunk, list(chunk.grams(model.order)), stats, model
        self.total = {m: answers[m] >> 1 for m in range(1, model.order + 1)}
        self.owned = {m: (answers[m] & 1).astype(bool) for m in range(1, model.order + 1)}
        c = self.total[1]
        known = stats.scale * self.discount(1, c) * c / max(1, stats.tokens)
        self.p = {1: np.where(c > 0, known, stats.unknown)}
        self.contexts: dict[int, np.ndarray] = {}
        self.rep: dict[int, np.ndarray] = {}

    def discount(self, m: int, c: np.ndarray) -> np.ndarray:
        d = np.append(self.stats.d[m - 1], 1.0)
        return d[np.minimum(c, self.model.discounted + 1)]

    def level(self, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the distinct m-grams: p_m if seen (before the context's scale), p_{m-1} of their suffix, index of
        their context, and whether they are n-grams that are predicted."""
        types, inverse = self.grams[m - 1]
        rep = np.zeros(len(types), np.int64)
        at = np.flatnonzero(~self.chunk.is_start)
        rep[inverse[at]] = at
        event = np.zeros(len(types), bool)
        event[inverse[at]] = True
        lower = self.grams[m - 2][1]
        context = np.where(event, lower[np.maximum(rep - 1, 0)], 0)
        c, h = self.total[m], self.total[m - 1][context]
        seen = np.where(event & (c > 0), self.discount(m, c) * c / np.maximum(h, 1), 0.0)
        return seen, self.p[m - 1][lower[rep]], context, event

    def sums(self, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The (m-1)-grams' hashes and, of the n-grams after them that this chunk owns, the sums of p_m and p_{m-1}."""
        seen, below, context, event = self.level(m)
        use = event & self.owned[m] & (seen > 0)
        n = len(self.grams[m - 2][0])
        return self.grams[m - 2][0], np.bincount(context[use], seen[use], n), np.bincount(context[use], below[use], n)

    def close(self, m: int, alpha: np.ndarray, scale: np.ndarray) -> None:
        seen, below, context, _ = self.level(m)
        self.p[m] = np.where(seen > 0, seen * scale[context], alpha[context] * below)


def weights(seen: np.ndarray, below: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha and scale of contexts. Without a seen n-gram alpha is 1. Where the discounts free nothing, the seen
    n-grams are scaled as if the context had occurred once more. Where the seen words have all of p_{m-1}, alpha
    would be free; then the seen ones get everything."""
    scale = np.where((total > 0) & (seen > 1 - 1e-9), total / (total + 1.0), 1.0)
    rest = 1 - below
    scale = np.where((total > 0) & (rest <= 1e-12) & (seen > 0), 1 / np.maximum(seen, 1e-300), scale)
    alpha = np.where(total > 0, (1 - seen * scale) / np.maximum(rest, 1e-12), 1.0)
    return np.maximum(alpha, 0.0), scale


def _gather(table: pa.Table, order: int) -> dict[int, np.ndarray]:
    parts: dict[int, list] = {m: [] for m in range(1, order + 1)}
    for level, part, blob in zip(table["level"].to_pylist(), table["part"].to_pylist(), table["answer"].to_pylist()):
        parts[level].append((part, unpack_counts(blob)))
    return {m: np.concatenate([x for _, x in sorted(v, key=lambda y: y[0])]) for m, v in parts.items()}


def _gather_weights(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out: dict[int, list] = {}
    for level, part, blob in zip(table["level"].to_pylist(), table["part"].to_pylist(), table["answer"].to_pylist()):
        if level < 0:
            out.setdefault(-level, []).append((part, np.frombuffer(blob, "<f8").reshape(2, -1)))
    made = {m: np.concatenate([x for _, x in sorted(v, key=lambda y: y[0])], axis=1) for m, v in out.items()}
    return {m: (x[0], x[1]) for m, x in made.items()}


def _split(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    level = np.array(table["level"].to_pylist())
    return table.filter(pa.array(level > 0)), table.filter(pa.array(level < 0))


def _open(table: pa.Table, folder: str, stats: Stats, model: Katz, upto: int) -> Scored:
    """The chunk of a group of answers, closed up to level ``upto``."""
    counts, made = _split(table)
    scored = Scored(_load(folder, table["chunk"][0].as_py()), _gather(counts, model.order), stats, model)
    have = _gather_weights(made)
    for m in range(2, upto + 1):
        scored.close(m, *have[m])
    return scored


def _weights(answers: DataFrame, folder: str, stats: Stats, model: Katz, m: int, parts: int) -> DataFrame:
    """The backoff weights of level m, answered to each chunk (as level -m)."""

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        scored = _open(table, folder, stats, model, m - 1)
        types, seen, below = scored.sums(m)
        total = scored.total[m - 1]
        cuts = _cuts(types, parts)
        own = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
        sl = [slice(cuts[p], cuts[p + 1]) for p in own]
        some = (seen > 0) | (below > 0)
        pick = [np.flatnonzero(some[s]) for s in sl]
        return pa.table({
            "part": pa.array(own, pa.int32()),
            "chunk": pa.array([chunk] * len(own), pa.int64()),
            "keys": pa.array([pack_sorted(types[s]) for s in sl], pa.binary()),
            "total": pa.array([pack_counts(total[s]) for s in sl], pa.binary()),
            "at": pa.array([i.astype("<u4").tobytes() for i in pick], pa.binary()),
            "sums": pa.array([np.stack([seen[s][i], below[s][i]]).astype("<f8").tobytes() for s, i in zip(sl, pick)], pa.binary()),
        })

    def finish(part: int, held: list) -> Iterator[pa.RecordBatch]:
        keys = [unpack_sorted(x[1]) for x in held]
        types, inverse = _distinct(np.concatenate(keys))
        sums, total, at = np.zeros((2, len(types))), np.zeros(len(types), np.int64), 0
        places = []
        for (_, _, t, i, s), k in zip(held, keys):
            own = inverse[at : at + len(k)]
            at += len(k)
            places.append(own)
            total[own] = unpack_counts(t)
            i = np.frombuffer(i, "<u4")
            sums[:, own[i]] += np.frombuffer(s, "<f8").reshape(2, -1)
        alpha, scale = weights(sums[0], sums[1], total)
        for (chunk, *_), own in zip(held, places):
            yield pa.RecordBatch.from_arrays([pa.array([-m], pa.int32()), pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), pa.array([np.stack([alpha[own], scale[own]]).astype("<f8").tobytes()], pa.binary())], ["level", "part", "chunk", "answer"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, chunk, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if held and part != now:
                    yield from finish(now, held)
                    held = []
                now = part
                held.append((chunk, *rest))
        if held:
            yield from finish(now, held)

    asked = answers.groupBy("chunk").applyInArrow(ask, "part int, chunk long, keys binary, total binary, at binary, sums binary")
    return asked.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "chunk").mapInArrow(run, "level int, part int, chunk long, answer binary")


def _parts(rows: DataFrame) -> int:
    """Parts of the tables: as many as shuffles have, more for larger texts, so that what a task holds does not grow."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(shuffle_partitions(rows.sparkSession), -(-size // PART_BYTES))


def score(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: Katz = Katz()) -> DataFrame:
    """Train on four fifths of the documents (crc32 of the id as text, modulo 5, is not 1) and score them all.

    Returns doc_id, held_out, n_tokens (words and one end), n_known, train_tokens, base_score (unigrams with 0.5
    added) and score (log10 of the model's probability of words and end). A null text is an empty one and has its
    end; a null id counts as the empty text; rows with one id are separate documents; other columns play no part.
    Without training documents every word is unknown. An empty table gives an empty one.
    """
    spark = df.sparkSession
    folder = shared_dir(spark, "katz")
    rows = df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    parts = _parts(rows)
    counted = stored(_count(_messages(rows, folder, model, parts), model, parts), "katz-counts")
    stats = _stats(counted.where("chunk is null").collect(), model)  # a row for each level and part
    answers = counted.where("chunk is not null").select("level", "part", "chunk", "answer")
    for m in range(2, model.order + 1):
        answers = answers.unionByName(stored(_weights(answers, folder, stats, model, m, parts), f"katz-weights-{m}"))

    def final(key: tuple, table: pa.Table) -> pa.Table:
        scored = _open(table, folder, stats, model, model.order)
        chunk, n = scored.chunk, len(scored.chunk.lengths)
        use = ~chunk.is_start
        doc = chunk.doc[use]
        word, gram, c = scored.grams[0][1][use], scored.grams[model.order - 1][1][use], scored.total[1]
        # logarithms of distinct words and n-grams, then their places
        base = np.log10((c + 0.5) / (stats.tokens + 0.5 * (stats.types + 1)))
        with np.errstate(divide="ignore"):  # of a START no probability is asked
            p = np.log10(scored.p[model.order])
        return pa.table({
            "doc_id": pa.array(chunk.keys, pa.int64(), mask=chunk.null),
            "held_out": pa.array(chunk.held),
            "n_tokens": pa.array(chunk.lengths - 1, pa.int64()),
            "n_known": pa.array(np.bincount(doc, (c > 0)[word], n).astype(np.int64)),
            "train_tokens": pa.array(np.full(n, stats.tokens, np.int64)),
            "base_score": pa.array(np.bincount(doc, base[word], n)),
            "score": pa.array(np.bincount(doc, p[gram], n)),
        })

    return answers.groupBy("chunk").applyInArrow(final, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
