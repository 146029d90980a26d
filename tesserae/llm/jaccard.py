"""Exact join of documents by the Jaccard similarity of their word shingles, with set-relation skipping.

1. Equal sets become one class; the rest is about classes.
2. Index: a set's tokens are ordered from rare to frequent by a sketch of fixed size (any order is exact, this one
   keeps lists short). Two similar sets share a token among the first few; these go to inverted lists, sorted by
   set size, then by position in the set.
3. Stars: in each list and band of sizes, the set of smallest id leads. A set is compared with that of its leaders which
   leads most sets, and with the one it shares most tokens with; then with that set of the star which is most similar
   to its leader. An answer holds what the
   set lacks of its leader and what it has beside. These answers serve all others: sets that are linked to one leader
   are connected whatever their own similarity is, and the overlap of two sets follows from their answers by the same
   leader: what the leader has, less what either lacks, and what both have beside, which is bounded by hashes.
4. Rest: lists are scanned for pairs that the answers leave open: not connected yet, sizes allow the similarity (the
   scan skips blocks of smaller sets), no common leader rules it out, and they share as many of their first tokens
   as similar sets must. These pairs are verified.
5. Components of all links give the answer for each document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, prefix, shuffle_partitions, stored, tidy
from .components import components
from .shingles import mix, set_id, shingle_sets

CELLS = 1 << 22  # of the frequency sketch: four megabytes once it is broadcast
BLOOM = 1 << 27  # bits of the filter of wanted documents, at most; beyond that it passes more than it need
SLICES = 64  # parts of that filter, each made by one task
LIST = 2000  # longest piece of a list that one group holds
PART = 1_000_000  # entries of the index in one task, about
HOT = 250_000  # entries of one token in one task, about
LARGE = 32  # sets of a star that is taken for a large group's
LEADERS = 6  # whose answers on a set serve the scan, at most
_NONE = -(1 << 63)


def least_shared(na, nb, num: int, den: int):
    """How many tokens two similar sets of these sizes share among their first ones, at least. Of two sets with an
    overlap of ``need``, the first n - need + l tokens of each share l or more."""
    need = -(-num * (na + nb) // (num + den))
    own = lambda n: -(-num * n // den)  # noqa: E731  # what the index leaves out, less one
    return np.maximum(1, np.minimum(need - own(na) + 1, need - own(nb) + 1))


def _prefix(s: np.ndarray, rank: np.ndarray, num: int, den: int) -> np.ndarray:
    """The tokens of which a similar set must share one, in the global order."""
    n = len(s)
    size = n - -(-num * n // den) + 1
    level = rank[(s % np.uint64(CELLS)).astype(np.int64)]
    if level.any():
        return s[np.lexsort((s, level))[:size]]
    return s[:size]


def _first_pass(rows: DataFrame, k: int) -> DataFrame:
    """key, n, cid of each document (kind 0) and the tasks' frequency sketches (kind 1), in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        for batch in batches:
            n, cid, seen = [], [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                cid.append(set_id(s) if len(s) else None)
                seen.append((s % np.uint64(CELLS)).astype(np.int32))
            m = len(n)
            if m:
                cells += np.bincount(np.concatenate(seen), minlength=CELLS).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), batch.column(0), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.nulls(m, pa.binary())], ["kind", "key", "n", "cid", "blob"])
        step = CELLS // 16
        for b in range(16):
            part = cells[b * step : (b + 1) * step]
            if part.any():
                blob = zlib.compress(part.astype(np.uint64).tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([b], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([blob], pa.binary())], ["kind", "key", "n", "cid", "blob"])

    return rows.mapInArrow(tidy(run), "kind int, key long, n long, cid long, blob binary")


def _rank(sketches: DataFrame, parts: int) -> tuple[np.ndarray, int]:
    """The sketch's cells as levels: 0 for all that is not clearly above the mean, then powers of two; and the first
    level whose tokens are in more than ``HOT`` sets, so that their lists are split."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(blob), np.uint64)
                total[b] = total[b] + x if b in total else x
        for b, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["key", "blob"])

    made = sketches.select("key", "blob")
    for n in (parts, 1):  # tasks' sketches meet in many tasks first
        made = made.repartition(16 * n, "key", F.pmod(F.xxhash64("blob"), F.lit(n))).mapInArrow(tidy(merge), "key long, blob binary")
    cells = np.zeros((16, CELLS // 16), np.float32)
    for r in made.collect():  # 16 rows
        cells[r["key"]] = np.frombuffer(zlib.decompress(r["blob"]), np.uint64)
    # other tokens of a cell add up to the mean, give or take its root
    mean = float(cells.mean(dtype=np.float64))
    usual = mean + 5 * mean**0.5 + 3
    hot = max(1, int(np.ceil(np.log2(HOT / usual))) + 1)
    return np.maximum(0, np.ceil(np.log2(np.maximum(cells, 1) / usual))).astype(np.uint8).reshape(-1), hot


def _pieces(token: np.ndarray, level: np.ndarray, hot: int) -> np.ndarray:
    """In how many pieces the list of each token lies: 1 unless it is hot."""
    over = level[(token % np.uint64(CELLS)).astype(np.int64)].astype(np.int64) - hot
    return np.left_shift(1, np.clip(over + 1, 0, 20))


def _index(rows: DataFrame, k: int, rank, hot: int, num: int, den: int, parts: int) -> DataFrame:
    """Blocks of prefix tokens, dealt by token (of a hot token also by set): part, and arrays of token, id, size and
    position. A block has one entry of a set and token, however many copies of the set its task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, held, seen, known = rank.value, [], 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            token, cid, n, pos = (np.concatenate(x) for x in zip(*held))
            piece = cid.view(np.uint64) % _pieces(token, level, hot).astype(np.uint64)
            part = ((token >> np.uint64(32)) + piece) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
            own = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
            take = [order[cuts[p] : cuts[p + 1]] for p in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *(pa.array([x[i].tobytes() for i in take], pa.binary()) for x in (token, cid, n, pos))], ["part", "token", "cid", "n", "pos"])

        for batch in batches:
            for s in shingle_sets(batch.column(0), k):
                if not len(s) or (own_id := set_id(s)) in known:
                    continue
                known.add(own_id)
                p = _prefix(s, level, num, den)
                m = len(p)
                held.append((p, np.full(m, own_id, np.int64), np.full(m, len(s), np.int32), np.arange(m, dtype=np.int32)))
                seen += m
                if seen >= 1_000_000:
                    yield from flush()
                    held, seen, known = [], 0, set()
        if held:
            yield from flush()

    return rows.mapInArrow(tidy(run), "part int, token binary, cid binary, n binary, pos binary")


def _lists(index: DataFrame, rank, hot: int, num: int, den: int, parts: int) -> DataFrame:
    """From the inverted lists: star pairs (kind 0: a, b, n = tokens they must share, pos = tokens they share here),
    the entries of lists with two sets of fitting sizes (kind 1: a = id, b = token, n, pos), and the leaders of hot
    tokens' pieces (kind 2: a = id, b = token, n, pos = band of sizes)."""
    names = ["kind", "a", "b", "n", "pos"]
    band = np.log(den / num)

    def rows_of(kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        for i in range(0, len(columns[0]), 100_000):
            own = [pa.array(np.ascontiguousarray(c[i : i + 100_000]), t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own[0]), kind, np.int32)), *own], names)

    def finish(held: list) -> Iterator[pa.RecordBatch]:
        token, cid, n, pos = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held), (np.uint64, np.int64, np.int32, np.int32)))
        held.clear()
        order = np.lexsort((cid, n, token))
        token, cid, n, pos = token[order], cid[order], n[order], pos[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])  # copies of one set
        token, cid, n, pos = token[new], cid[new], n[new], pos[new]
        # an entry counts if a neighbour in its list has a fitting size; of a hot token this part has a piece only
        split = _pieces(token, rank.value, hot) > 1
        near = split.copy()
        fits = (token[1:] == token[:-1]) & (n[:-1].astype(np.int64) * den >= n[1:].astype(np.int64) * num)
        near[1:] |= fits
        near[:-1] |= fits
        token, cid, n, pos, split = token[near], cid[near], n[near], pos[near], split[near]
        if not len(token):
            return
        size_band = np.floor(np.log(n) / band).astype(np.int64)
        order = np.lexsort((cid, size_band, token))
        t, z, c, own_n = token[order], size_band[order], cid[order], n[order]
        first = np.ones(len(t), bool)
        first[1:] = (t[1:] != t[:-1]) | (z[1:] != z[:-1])
        heads = np.flatnonzero(first)
        lead = heads[np.cumsum(first) - 1]
        other = c[lead] != c
        least = least_shared(own_n[lead].astype(np.int64), own_n.astype(np.int64), num, den)
        star = np.zeros(int(other.sum()), np.dtype([("a", "i8"), ("b", "i8"), ("least", "i4")]))
        star["a"], star["b"], star["least"] = c[lead][other], c[other], least[other]
        star, count = np.unique(star, return_counts=True)
        yield from rows_of(0, star["a"], star["b"], star["least"], count.astype(np.int32))
        yield from rows_of(1, cid, token.view(np.int64), n, pos)
        heads = heads[split[order][heads]]
        yield from rows_of(2, c[heads], t[heads].view(np.int64), own_n[heads], z[heads].astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for part, *blobs in zip(*columns):
                if held and part != at:
                    yield from finish(held)
                    held = []
                at = part
                held.append(blobs)
        if held:
            yield from finish(held)

    return index.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(tidy(run), "kind int, a long, b long, n int, pos int")


def _bloom_bits(keys: np.ndarray, size: int) -> list[np.ndarray]:
    x = keys.view(np.uint64)
    return [(mix(x + np.uint64(i)) % np.uint64(size)).astype(np.int64) for i in range(3)]


def _slice_of(key: str):
    return F.pmod(F.xxhash64(key), F.lit(SLICES)).cast("int")


def _bloom(keys: DataFrame) -> np.ndarray:
    """A filter that passes every key of the (one-column) table, and few others: slices of packed bits. Its size follows
    the number of keys up to ``BLOOM`` bits."""
    size = 1 << 10
    while size * SLICES < min(BLOOM, 16 * keys.count()):
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = None, None
        for batch in batches:
            own, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for b in np.unique(own).tolist():
                if b != now:
                    if bits is not None:
                        yield _packed(now, bits)
                    now, bits = b, np.zeros(size, bool)
                for at in _bloom_bits(key[own == b], size):
                    bits[at] = True
        if bits is not None:
            yield _packed(now, bits)

    def _packed(b: int, bits: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], ["slice", "bits"])

    sliced = keys.select(_slice_of("key").alias("slice"), "key").repartition(SLICES, "slice").sortWithinPartitions("slice")
    out = np.zeros((SLICES, size // 8), np.uint8)
    for r in sliced.mapInArrow(tidy(run), "slice int, bits binary").collect():  # SLICES rows, of BLOOM bits together
        out[r["slice"]] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out


def _texts(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """cid and text of one document of each wanted class. rows: key, text; wanted: key, cid."""
    bits = rows.sparkSession.sparkContext.broadcast(_bloom(wanted.select("key")))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose key may be wanted, with their class; one key may stand before several texts. Copies of a row pass once
        in a task, and those that are left do no harm."""
        own, seen = bits.value, set()
        size = 8 * own.shape[1]
        for batch in batches:
            part = batch.column(2).to_numpy(zero_copy_only=False)
            keep = np.ones(batch.num_rows, bool)
            for at in _bloom_bits(batch.column(0).to_numpy(zero_copy_only=False), size):
                keep &= (own[part, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            if not keep.any():
                continue
            some = batch.select([0, 1]).filter(pa.array(keep))
            keys, cids, new = some.column(0).to_pylist(), [], []
            for key, s in zip(keys, shingle_sets(some.column(1), k)):
                cids.append(set_id(s) if len(s) else None)
                new.append(cids[-1] is not None and (key, cids[-1]) not in seen)
                if new[-1]:
                    seen.add((key, cids[-1]))
            out = pa.RecordBatch.from_arrays([some.column(0), pa.array(cids, pa.int64()), some.column(1)], ["key", "cid", "text"])
            yield out.filter(pa.array(new, pa.bool_()))

    found = rows.select("key", "text", _slice_of("key").alias("slice")).mapInArrow(tidy(pick), "key long, cid long, text string")
    return found.join(wanted, ["key", "cid"]).select("cid", "text")


def _hash_bits(n: int) -> int:
    """Places that the tokens a set has beside a leader of n tokens are hashed to."""
    return max(64, 1 << (8 * n - 1).bit_length())


def _places(n: int) -> str:
    """The type of the places in an answer by a leader of n tokens."""
    return "<u2" if n <= 8192 else "<u4"


def _verify(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """pairs: a, b -> a, b, na, nb, both (size of the intersection), lacks (places of a's tokens that b lacks) and beside
    (hashes of b's tokens that a lacks)."""
    names = ["a", "b", "na", "nb", "both", "lacks", "beside"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            a = batch.column(0).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, sb in enumerate(shingle_sets(batch.column(3), k)):
                if a[i] != last[0]:
                    last = (a[i], next(shingle_sets(batch.column(2).slice(i, 1), k)))
                sa = last[1]
                at = np.minimum(np.searchsorted(sa, sb), max(0, len(sa) - 1))
                shared = sa[at] == sb if len(sa) else np.zeros(len(sb), bool)
                has = np.zeros(len(sa), bool)
                has[at[shared]] = True
                kind = _places(len(sa))
                beside = sb[~shared] % np.uint64(_hash_bits(len(sa)))
                for c, x in zip(out, (len(sa), len(sb), int(shared.sum()), np.flatnonzero(~has).astype(kind).tobytes(), beside.astype(kind).tobytes())):
                    c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(out, kinds))], names)

    left = texts.select(F.col("cid").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("cid").alias("b"), F.col("text").alias("tb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a long, b long, na long, nb long, both long, lacks binary, beside binary")


class _Leader:
    """The answers by one leader of some of a group's rows, as bits."""

    def __init__(self, n: int, rows: list[int], both: list[int], lacks: list[bytes], beside: list[bytes]) -> None:
        self.n, self.rows, self.both = n, np.array(rows), np.array(both, np.int64)
        self.of = {r: i for i, r in enumerate(rows)}
        self.lacks = self._bits(lacks, n)
        self.beside = self._bits(beside, _hash_bits(n))
        self.unseen = np.array([len(x) // np.dtype(_places(n)).itemsize for x in beside], np.int64) - np.bitwise_count(self.beside).sum(axis=1, dtype=np.int64)

    def _bits(self, places: list[bytes], size: int) -> np.ndarray:
        out = np.zeros((len(places), -(-size // 64)), "<u8")
        for i, x in enumerate(places):
            at = np.frombuffer(x, _places(self.n)).astype(np.uint64)
            np.bitwise_or.at(out[i], (at >> np.uint64(6)).astype(np.int64), np.left_shift(np.uint64(1), at & np.uint64(63)))
        return out

    def most_shared(self, row: int, others: slice) -> np.ndarray:
        """The most tokens that a row can share with others: what both have of the leader, and what both have beside, where
        hashes count a token too often, never too seldom."""
        i = self.of[row]
        lacked = np.bitwise_count(self.lacks[others] & self.lacks[i]).sum(axis=1, dtype=np.int64)
        beside = np.bitwise_count(self.beside[others] & self.beside[i]).sum(axis=1, dtype=np.int64)
        return self.both[others] + self.both[i] - self.n + lacked + beside + np.minimum(self.unseen[others], self.unseen[i])


def _scan(rows: list[tuple], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The open pairs of one group (token, i, j, cid, n, pos, root, near, own), sorted by size, then position: smaller and
    larger id, and how many of their first tokens they must share."""
    cid, n, root, own = (np.array([r[c] for r in rows], np.int64) for c in (3, 4, 6, 8))
    across = rows[0][1] != rows[0][2]
    known: dict[int, tuple[int, list, list, list, list]] = {}
    for i, r in enumerate(rows):
        for q in r[7] or []:
            x = known.setdefault(q["leader"], (q["na"], [], [], [], []))
            for c, v in zip(x[1:], (i, q["both"], q["lacks"], q["beside"])):
                c.append(v)
    leaders = [_Leader(x[0], *x[1:]) for x in known.values() if len(x[1]) > 1]
    by_row: dict[int, list[_Leader]] = {}
    for x in leaders:
        for i in x.rows.tolist():
            by_row.setdefault(i, []).append(x)
    out: tuple[list, ...] = ([], [], [])
    for y in range(1, len(rows)):
        first = int(np.searchsorted(n[:y], -(-num * n[y] // den)))  # smaller sets before are skipped
        ok = root[first:y] != root[y]
        if across:
            ok &= own[first:y] != own[y]
        if not ok.any():
            continue
        for x in by_row.get(y, []):
            part = slice(int(np.searchsorted(x.rows, first)), int(np.searchsorted(x.rows, y)))
            z = x.rows[part]
            ok[z - first] &= (num + den) * x.most_shared(y, part) >= num * (n[z] + n[y])
        z = first + np.flatnonzero(ok)
        if len(z):
            out[0].append(np.minimum(cid[z], cid[y]))
            out[1].append(np.maximum(cid[z], cid[y]))
            out[2].append(least_shared(n[z], n[y], num, den))
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(x or none) for x in out)


def _open_pairs(entries: DataFrame, labels: DataFrame, answers: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of one list that might be similar and that the stars' answers leave open.

    entries: cid, token, n, pos. labels: v, root. answers: cid, near (array of leader, na, both, lacks, beside)."""
    x = entries.join(labels.select(F.col("v").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    own = x.groupBy("token", "root").agg(F.count("*").alias("size"))
    mixed = own.groupBy("token").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.max("size").alias("in_main"), F.sum("size").alias("size")).where("size > in_main")
    x = x.join(mixed, "token").join(answers, "cid", "left")
    # a long list is cut into blocks; pairs of blocks are groups of bounded size. The largest component's sets are
    # connected already, so its blocks meet those of the others only
    is_main = F.col("root") == F.col("main")
    outer, inner = (F.ceil(c / LIST).cast("int") for c in (F.col("size") - F.col("in_main"), F.col("in_main")))
    place = lambda n: F.pmod(F.xxhash64("cid"), n).cast("int")
    x = x.withColumn("own", F.when(is_main, outer + place(inner)).otherwise(place(outer)))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_main, outer).otherwise(outer + inner) - 1)))
    x = x.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cid", "n", "pos", "root", "near", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, found, held = None, [], [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and r[:3] != key:
                    found.append(_scan(rows, num, den))
                    held += len(found[-1][0])
                    rows = []
                    if held >= 200_000:
                        yield _pairs(found)
                        found, held = [], 0
                key = r[:3]
                rows.append(r)
        if rows:
            found.append(_scan(rows, num, den))
        if found:
            yield _pairs(found)

    def _pairs(found: list) -> pa.RecordBatch:
        """Each pair once, with the number of lists in which it was met."""
        a, b, least = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((b, a))
        a, b, least = a[order], b[order], least[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        return pa.RecordBatch.from_arrays([*(pa.array(x[first], pa.int64()) for x in (a, b, least)), pa.array(np.diff(np.append(first, len(a))), pa.int64())], ["a", "b", "least", "shared"])

    parts = shuffle_partitions(entries.sparkSession)
    x = x.repartition(parts, "token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "pos").mapInArrow(tidy(run), "a long, b long, least long, shared long")
    # every list that both sets are in has been scanned, so the sum is all that they share
    return x.groupBy("a", "b").agg(F.max("least").alias("least"), F.sum("shared").alias("shared")).where("shared >= least").select("a", "b")


def _labelled(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """rows: key (long, not null), text -> key, n, cid, root (null for empty sets)."""
    spark = rows.sparkSession
    parts = shuffle_partitions(spark)
    first = stored(_first_pass(rows, k), "sets")
    levels, hot = _rank(first.where("kind = 1"), max(1, parts // 16))
    rank = spark.sparkContext.broadcast(levels)
    own = first.where("kind = 0").select("key", "n", "cid")
    entries = own.agg(F.sum(F.col("n") - F.ceil(F.col("n") * num / den) + 1)).first()[0] or 0
    index_parts = max(parts, -(-int(entries) // PART))
    lists = stored(_lists(_index(rows.select("text"), k, rank, hot, num, den, index_parts), rank, hot, num, den, index_parts), "lists")
    star = lists.where("kind = 0").groupBy("a", "b").agg(F.max("n").alias("least"), F.sum("pos").alias("shared"))
    # the leader that leads most sets first, so that the sets of a large group have one in common; then the one most alike.
    # A leader may lead only some of the lists that both are in, so half of the tokens is asked for there; what is left
    # out here is not lost: the scan of open pairs meets it
    star = stored(star, "stars")
    x = star.join(star.groupBy("a").agg(F.count("*").alias("led")), "a").withColumn("fits", F.expr("2 * shared >= least"))
    x = x.where(F.col("fits") | (F.col("led") >= LARGE))
    large = F.row_number().over(Window.partitionBy("b").orderBy(F.col("led").desc(), "a"))
    alike = F.row_number().over(Window.partitionBy("b").orderBy(F.col("fits").desc(), F.col("shared").desc(), "a"))
    x = x.withColumn("large", large).withColumn("alike", alike)
    stars = x.where(((F.col("large") == 1) & (F.col("led") >= LARGE)) | ((F.col("alike") == 1) & F.col("fits"))).select("a", "b")
    # the leaders of a hot token's pieces are compared with the first of them
    heads = lists.where("kind = 2").select(F.col("a").alias("cid"), F.col("b").alias("token"), F.col("pos").alias("band"))
    top = heads.groupBy("token", "band").agg(F.min("cid").alias("top"))
    stars = stars.unionByName(heads.join(top, ["token", "band"]).where("cid <> top").select(F.col("top").alias("a"), F.col("cid").alias("b")))
    stars = stored(stars.distinct(), "stars")
    discard(star)
    entries = lists.where("kind = 1").select(F.col("a").alias("cid"), F.col("b").alias("token"), "n", "pos")
    classes = own.where("n > 0").groupBy("cid").agg(F.min("key").alias("key"))

    def texts_of(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
        wanted = stored(classes.join(ids, "cid"), "wanted")
        texts = stored(_texts(rows, wanted, k), "texts")
        discard(wanted)
        return texts

    texts = texts_of(stars)
    linked = (den + num) * F.col("both") >= num * (F.col("na") + F.col("nb"))
    similar = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    first_answers = stored(_verify(stars, texts, k), "answers")
    # the set of a star that is most similar to its leader is nearer to the middle of the others, which meet it next
    middle = first_answers.groupBy("a").agg(F.max_by("b", F.struct(similar, "b")).alias("middle"))
    again = first_answers.join(middle, "a").where("b <> middle").select(F.col("middle").alias("a"), "b").distinct().join(stars, ["a", "b"], "left_anti")
    more_answers = stored(_verify(again, texts, k), "answers")
    checked = first_answers.unionByName(more_answers)
    links = checked.where(linked).select("a", "b")
    labels = components(links)
    # each set's nearest leaders; a leader is its own
    near = F.struct(similar.alias("similar"), F.col("a").alias("leader"), "na", "both", "lacks", "beside")
    own_answer = F.struct(F.lit(1.0).alias("similar"), F.col("a").alias("leader"), "na", F.col("na").alias("both"), F.lit(b"").alias("lacks"), F.lit(b"").alias("beside"))
    near = checked.where(similar >= 0.25).select(F.col("b").alias("cid"), near.alias("q")).unionByName(checked.select("a", "na").distinct().select(F.col("a").alias("cid"), own_answer.alias("q")))
    rank = F.row_number().over(Window.partitionBy("cid").orderBy(F.col("q.similar").desc(), "q.leader"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= LEADERS)
    answers = near.groupBy("cid").agg(F.collect_list(F.struct("q.leader", "q.na", "q.both", "q.lacks", "q.beside")).alias("near"))
    rest = stored(_open_pairs(entries, labels, answers, num, den), "open")
    discard(texts, stars)
    if rest.isEmpty():
        roots = labels
    else:
        texts = texts_of(rest)
        more = stored(_verify(rest, texts, k).where(linked).select("a", "b"), "more-links")
        discard(texts)
        roots = components(labels.select(F.col("v").alias("a"), F.col("root").alias("b")).unionByName(more))
    discard(first_answers, more_answers, lists, rest)
    x = own.join(roots.select(F.col("v").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    x = stored(x, "labels")
    discard(first)
    return x


def jaccard_components(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """A row for each document: doc_id, n_shingles and component_id, the smallest doc_id that links reach.

    Two documents link when den * |intersection| >= num * |union| of their sets of ``words``-word shingles. Every
    link between different texts counts towards the components; copies are one class and are not paired. A
    document without words has an empty set and links with nothing: its component is its own id. Rows with one id
    stay separate rows; a null id is reported as null and is no component's smallest unless it is alone there.
    Other columns play no part; an empty table gives an empty one.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE))
    rows = df.select(key.alias("key"), F.col(text_col).alias("text"))
    x = _labelled(rows, words, num, den)
    least = x.where(F.col("n") > 0).groupBy("root").agg(F.min(F.when(F.col("key") != _NONE, F.col("key"))).alias("component_id"))
    x = x.join(least, "root", "left")
    own = F.when(F.col("key") != _NONE, F.col("key"))
    return x.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", own).alias("component_id"))


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each component stays: that of the smallest id. Documents without words link with nothing and
    all stay. Ids should be unique: of rows that share the kept id, one of each text stays. All columns as they are."""
    p = prefix(df, "j")
    found = jaccard_components(df, id_col=id_col, text_col=text_col, words=words, num=num, den=den)
    heads = found.where("n_shingles > 0 and doc_id <=> component_id").select(F.col("doc_id").alias(p + "id")).distinct()
    blank = F.length(F.translate(F.coalesce(F.col(text_col), F.lit("")), " \t\n\x0b\f\r", "")) == 0
    some = df.where(~blank).join(heads, F.col(id_col).cast("long").eqNullSafe(F.col(p + "id")), "left_semi")
    return some.dropDuplicates([id_col, text_col]).unionByName(df.where(blank))
