"""Approximate nearest neighbours by cosine: low-dimensional stable projections in kd-trees, verified until a
chi-square test stops the search.

Vectors of length one are projected on a few Gaussian directions; the ratio of a squared projected to the squared
true distance then follows a chi-square law. A kd-tree over a sample's projections cuts the space into cells, whose
bounding boxes are counted over all rows; in a cell, each partition has a kd-tree of its own. Points come in ascending
projected distance and are verified with their original vectors. The search ends when a vector nearer than the k-th
found so far would have shown up earlier with at least the wanted confidence. A query first searches where it lies
itself; with that limit it then goes to those partitions only whose boxes can hold a nearer vector.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored


@dataclass(frozen=True)
class Search:
    """``directions`` (even) of projection, ``confidence`` of the stopping test, ``leaf``: points in a leaf, ``rows``:
    vectors of a partition, about, ``sample``: vectors that the cells are fitted on, about (all rows are indexed),
    ``block``: points that are verified between two tests."""

    directions: int = 16
    confidence: float = 0.96
    leaf: int = 32
    rows: int = 8192
    sample: int = 20_000
    block: int = 16
    seed: int = 5


def chi2_cdf(x: float, m: int) -> float:
    """P(chi-square with m degrees of freedom <= x), m even."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, m // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total if half < 700 else 1.0


def chi2_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, m) < p else (lo, mid)
    return hi


def directions(dim: int, search: Search) -> np.ndarray:
    return np.random.default_rng([search.seed, dim]).standard_normal((dim, search.directions))


class Tree:
    """A kd-tree over projected points, kept as its leaves: an order of the points, bounds and boxes."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        order, bounds, todo = np.arange(len(points)), [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            own = order[a:b]
            if b - a <= leaf:
                bounds.append((a, b))
                continue
            x = points[own]
            axis = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
            half = (b - a) // 2
            order[a:b] = own[np.argpartition(x[:, axis], half)]
            todo += [(a, a + half), (a + half, b)]
        self.order, self.bounds = order, np.array(bounds)
        self.low = np.array([points[order[a:b]].min(axis=0) for a, b in bounds])
        self.high = np.array([points[order[a:b]].max(axis=0) for a, b in bounds])

    def leaves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves by ascending squared distance of their boxes, and these distances: nothing in a later leaf is nearer."""
        d = gaps(self.low, self.high, q)
        order = np.argsort(d, kind="stable")
        return order, d[order]


def gaps(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of boxes from a point."""
    gap = np.maximum(0, np.maximum(low - q, q - high))
    return (gap * gap).sum(axis=1)


class Part:
    """The vectors of one partition and dimension, with their tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, search: Search) -> None:
        self.search = search
        norm = np.sqrt((vectors * vectors).sum(axis=1))
        self.points = (vectors / norm[:, None]) @ directions(vectors.shape[1], search)
        self.tree = Tree(self.points, search.leaf)
        order = self.tree.order
        self.points, self.ids, self.vectors, self.norm = self.points[order], ids[order], np.ascontiguousarray(vectors[order]), norm[order]
        self.stop = chi2_quantile(search.confidence, search.directions)

    def incremental(self, p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Points and their squared projected distances, nearest first; leaves are opened as far as needed."""
        leaves, near = self.tree.leaves(p)
        at, step = 0, 2
        points, far = np.zeros(0, np.int64), np.zeros(0)
        while at < len(leaves) or len(points):
            own = leaves[at : at + step]
            more = np.concatenate([np.arange(a, b) for a, b in self.tree.bounds[own]]) if len(own) else np.zeros(0, np.int64)
            at, step = at + len(own), 2 * step
            d = self.points[more] - p
            points, far = np.concatenate((points, more)), np.concatenate((far, (d * d).sum(axis=1)))
            order = np.argsort(far, kind="stable")
            points, far = points[order], far[order]
            # what lies beyond the next leaf's box waits
            n = int(np.searchsorted(far, near[at], side="right")) if at < len(near) else len(points)
            for i in range(0, n, self.search.block):
                yield points[i : min(n, i + self.search.block)], far[i : min(n, i + self.search.block)]
            points, far = points[n:], far[n:]

    def nearest(self, own: int, q: np.ndarray, k: int, least: float = -math.inf) -> tuple[list[tuple[float, int]], int]:
        """(-score, id) of the k nearest found with a score of ``least`` or more, best first, and how many vectors were
        verified. ``least``: a k-th score that has been found elsewhere."""
        norm = math.sqrt(float((q * q).sum()))
        p = (q / norm) @ directions(len(q), self.search)
        ids, scores, verified = np.zeros(0, np.int64), np.zeros(0), 0
        limit = max(0.0, 2 - 2 * least)
        for points, far in self.incremental(p):
            if far[0] > self.stop * limit:
                break
            s = (self.vectors[points] * q).sum(axis=1) / (self.norm[points] * norm)
            verified += len(points)
            keep = (self.ids[points] != own) & (s >= (scores[-1] if len(ids) >= k else least))
            if keep.any():
                ids, scores = np.concatenate((ids, self.ids[points][keep])), np.concatenate((scores, s[keep]))
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) >= k:
                    limit = min(limit, max(0.0, 2 - 2 * float(scores[-1])))
        return [(-float(s), int(i)) for s, i in zip(scores, ids)], verified


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, offsets = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets, offsets[1:])]


@dataclass
class Cells:
    """The cells of one dimension: planes (axis, place, left, right; a child below 0 is cell -child - 1), and of each
    cell the box of all its rows and how many partitions it has."""

    planes: list[tuple[int, float, int, int]]
    n: int
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    subs: np.ndarray | None = None

    @classmethod
    def fit(cls, points: np.ndarray, n: int) -> Cells:
        """Halve the sample at its widest axis until there are ``n`` cells."""
        out, leaves = cls([], 1), [(-1, False, points)]
        while out.n < n and leaves[0][2].shape[0] > 1:
            parent, right, own = leaves.pop(0)
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            place = float(np.median(own[:, axis]))
            low = own[:, axis] < place
            if not low.any():  # all the same here: the cell stays whole
                leaves.append((parent, right, own[:1]))
                continue
            if parent >= 0:
                plane = list(out.planes[parent])
                plane[3 if right else 2] = len(out.planes)
                out.planes[parent] = tuple(plane)
            number = len(out.planes)
            out.planes.append((axis, place, -1, -1))
            leaves += [(number, False, own[low]), (number, True, own[~low])]
            out.n += 1
        cell = 0
        for parent, right, _ in leaves:
            if parent >= 0:
                plane = list(out.planes[parent])
                plane[3 if right else 2] = -cell - 1
                out.planes[parent] = tuple(plane)
            cell += 1
        return out

    def of(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64) if self.planes else np.full(len(points), -1, np.int64)
        if self.planes:
            axis, place, left, right = (np.array(x) for x in zip(*self.planes))
            while (open_ := at >= 0).any():
                i = np.flatnonzero(open_)
                node = at[i]
                at[i] = np.where(points[i, axis[node]] < place[node], left[node], right[node])
        return -at - 1


def search(df: DataFrame, queries: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, options: Search = Search()) -> DataFrame:
    """For each row that ``queries`` holds for, its k nearest of all other rows: query_id, rank, vec_id, score, and how
    many vectors were verified for the query.

    All usable rows are indexed; of equal vectors the k + 1 of smallest ids, as ties go to the smaller id and no others
    can be in an answer. Rows lie in cells of the projected space, and in partitions of a cell by a hash of their id, so
    that none grows with a hot region. Fewer than k rows give fewer answers. A query is not compared with rows of its id
    or of another dimension. Rows equal in id and vector count once; rows without an id or with an unusable vector (see
    :func:`usable`) take no part; an empty table gives an empty one.
    """
    spark = df.sparkSession
    kind = df.schema[vector_col].dataType.simpleString()
    vector = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.transform(F.col(vector_col), lambda x: x.cast("double"))
    kind = kind if kind == "array<float>" else "array<double>"
    base = df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    base = base.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    total = base.count()
    # a filter on the rank is applied before the exchange too, so a vector that is very often there gathers nowhere
    copy = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    kept = base.select("id", "v", copy.alias("copy")).where(F.col("copy") <= k + 1).select("id", "v").dropDuplicates(["id", "v"])
    asked = base.where("q").select("id", "v").dropDuplicates(["id", "v"])
    rows = kept.withColumn("q", F.lit(False)).unionByName(asked.withColumn("q", F.lit(True))).withColumn("own", F.xxhash64("v"))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [(v / math.sqrt(float((v * v).sum()))) @ directions(len(v), options) for v in _vectors(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([len(v) for v in _vectors(batch.column(0))], pa.int32()), pa.array(points, pa.list_(pa.float64()))], ["dim", "p"])

    share = options.sample / max(1, total)
    sample = base.where(F.pmod(F.xxhash64(F.lit(options.seed), "id"), F.lit(1_000_000)) < 1_000_000 * share)
    points: dict[int, list] = {}
    for r in sample.select("v").mapInArrow(project, "dim int, p array<double>").collect():  # about ``sample`` rows
        points.setdefault(r["dim"], []).append(r["p"])
    most = max(1, -(-total // options.rows))
    cells = {dim: Cells.fit(np.array(p), min(most, max(1, len(p) // 8))) for dim, p in points.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's dimension and cell."""
        for batch in batches:
            own = _vectors(batch.column(1))
            dim = np.array([len(v) for v in own], np.int64)
            cell = np.zeros(len(own), np.int64)
            made: list = [None] * len(own)
            for d in np.unique(dim).tolist():
                i = np.flatnonzero(dim == d)
                x = np.array([own[j] for j in i])
                p = (x / np.sqrt((x * x).sum(axis=1))[:, None]) @ directions(d, options)
                cell[i] = cells[d].of(p) if d in cells else 0
                for j, y in zip(i.tolist(), p):
                    made[j] = y
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(4)), pa.array(dim, pa.int32()), pa.array(cell, pa.int32()), pa.array(made, pa.list_(pa.float32()))], ["id", "v", "q", "own", "dim", "cell", "p"])

    placed = stored(rows.mapInArrow(assign, f"id long, v {kind}, q boolean, own long, dim int, cell int, p array<float>"), "placed")
    # boxes and sizes: a row for each cell and dimension
    axes = range(options.directions)
    boxes = placed.where("not q").groupBy("dim", "cell").agg(F.count("*").alias("n"), F.array(*(F.min(F.col("p")[i]) for i in axes)).alias("low"), F.array(*(F.max(F.col("p")[i]) for i in axes)).alias("high")).collect()
    found: dict[int, dict] = {}
    for r in sorted(boxes, key=lambda r: (r["dim"], r["cell"])):
        own = found.setdefault(r["dim"], {"cell": [], "low": [], "high": [], "subs": []})
        for c, x in (("cell", r["cell"]), ("low", r["low"]), ("high", r["high"]), ("subs", -(-r["n"] // options.rows))):
            own[c].append(x)
    index = {d: {c: np.array(x) for c, x in own.items()} for d, own in found.items()}
    stop = chi2_quantile(options.confidence, options.directions)

    def subs_of(dim: int, cell: int) -> int:
        own = index.get(dim)
        at = int(np.searchsorted(own["cell"], cell)) if own is not None else 0
        return int(own["subs"][at]) if own is not None and at < len(own["cell"]) and own["cell"][at] == cell else 1

    def sub(n: int, dim: int, cell: int) -> int:
        return zlib.crc32(str(n).encode()) % subs_of(dim, cell)

    names = ["dim", "cell", "sub", "kind", "id", "own", "least", "v"]
    message = f"dim int, cell int, sub int, kind int, id long, own long, least double, v {kind}"

    def dealt(rows: list[tuple], vectors: pa.Array) -> pa.RecordBatch:
        """rows: what stands before the vector, which is that of the input's row of the last number."""
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
        take = pa.array([r[-1] for r in rows], pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)), vectors.take(take)], names)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (kind 0) and queries (kind 1) where they lie."""
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))
            yield dealt([(dim, cell, sub(n, dim, cell), int(q), n, own, -math.inf, i) for i, (n, q, own, dim, cell) in enumerate(zip(*columns))], batch.column(1))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the score they found at home, to every other partition that can hold a nearer vector."""
        for batch in batches:
            out = []
            for i, (n, own, least, dim, cell, p) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5, 6)))):
                boxes_of = index.get(dim)
                if boxes_of is None:
                    continue
                least = -math.inf if least is None else least
                s = sub(n, dim, cell)
                for at in np.flatnonzero(gaps(boxes_of["low"], boxes_of["high"], np.array(p)) <= stop * (2 - 2 * least)).tolist():
                    c = int(boxes_of["cell"][at])
                    out += [(dim, c, j, 1, n, own, least, i) for j in range(int(boxes_of["subs"][at])) if (c, j) != (cell, s)]
            yield dealt(out, batch.column(1))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, part = None, [], [], None
        for batch in batches:
            where = zip(*(batch.column(i).to_pylist() for i in range(7)))
            out: tuple[list, ...] = ([], [], [], [], [])
            for (dim, cell, s, kind_of, n, own, least), v in zip(where, _vectors(batch.column(7))):
                if (dim, cell, s) != key:
                    key, ids, vectors, part = (dim, cell, s), [], [], None
                if kind_of == 0:
                    ids.append(n)
                    vectors.append(v.copy())
                    continue
                if part is None and ids:
                    part = Part(np.array(ids, np.int64), np.array(vectors), options)
                best, verified = part.nearest(n, v, k, least) if part is not None else ([], 0)
                for x in [(None, None, verified), *((i, -score, 0) for score, i in best)]:
                    for c, y in zip(out, (n, own, *x)):
                        c.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["query_id", "own", "vec_id", "score", "verified"])

    def answered(asked: DataFrame) -> DataFrame:
        n = max(shuffle_partitions(spark), min(most, 10_000))
        at_part = asked.repartition(n, "dim", "cell", "sub").sortWithinPartitions("dim", "cell", "sub", "kind", "id")
        return at_part.mapInArrow(answer, "query_id long, own long, vec_id long, score double, verified long")

    homes = placed.mapInArrow(home, message)
    near = stored(answered(homes), "near")
    limits = near.groupBy("query_id", "own").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    limits = limits.select(F.col("query_id").alias("id"), "own", F.get("s", F.lit(k - 1)).alias("least"))
    routed = placed.where("q").join(limits, ["id", "own"]).select("id", "v", "own", "least", "dim", "cell", "p").mapInArrow(route, message)
    far = answered(homes.where("kind = 0").unionByName(routed))
    both = near.unionByName(far)
    w = Window.partitionBy("query_id", "own")
    rank = F.row_number().over(w.orderBy(F.col("score").desc_nulls_last(), "vec_id"))
    both = both.withColumn("verified", F.sum("verified").over(w)).withColumn("rank", rank)
    return both.where((F.col("rank") <= k) & F.col("vec_id").isNotNull()).select("query_id", "rank", "vec_id", "score", "verified")
