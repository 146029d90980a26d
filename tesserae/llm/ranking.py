"""A quality classifier by Bradley-Terry ranking: a score for each document, learnt from preference pairs.

Of a pair of labelled documents, one marked good and one marked bad, the good one is preferred with the probability
sigmoid(s(good) - s(bad)), where s is linear in measures of the text; the weights minimise the logistic loss on the
differences of measures. A document is taken as good if its score reaches a quantile of the labelled documents' scores,
the share of bad ones among them. The measures of all texts are taken once and stored. Every labelled row stands in pairs:
rows are dealt to groups by their ids, all pairs of a group count, and the loss is summed over the groups in tasks, once
for each step of Newton's method; the quantile is that of all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .shingles import mix, slices, text_bytes, word_hashes

_U = np.uint64
_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
_SPACE, _LINE, _UPPER, _LOWER, _DIGIT, _WIDE, _OTHER = range(len(_PUNCTUATION), len(_PUNCTUATION) + 7)
_KINDS = _OTHER + 1
_KIND = np.full(256, _OTHER, np.int64)
_KIND[_PUNCTUATION] = np.arange(len(_PUNCTUATION))
_KIND[[9, 11, 12, 13, 32]], _KIND[10] = _SPACE, _LINE
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = _UPPER, _LOWER, _DIGIT, _WIDE
#: Shares of each punctuation mark, of capitals, digits, other bytes and all punctuation among the bytes that are no
#: white space; words that repeat the word before, that occurred before, that lie in a repeated run of three, that end
#: in punctuation; words, bytes of a word, lines.
MEASURES = len(_PUNCTUATION) + 4 + 4 + 3


@dataclass(frozen=True)
class Ranking:
    """``group``: rows of the rarer class that a group has on average. ``pairs``: preference pairs that :func:`fit` draws.
    ``ridge``: weight of the squared weights. ``cut``: the score given to the threshold. ``sample`` bounds nothing any
    more: all labelled rows are used."""

    sample: int = 10_000
    pairs: int = 50_000
    ridge: float = 1e-3
    cut: float = 0.3
    seed: int = 11
    group: int = 64


def _share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Logarithms of shares, so that a few parts in a hundred already tell."""
    return np.log1p(100 * x / np.maximum(of, 1))


def _repeated(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n texts: how many of its hashes occurred before in it, and how many occur more than once."""
    order = np.lexsort((h, doc))
    d, s = doc[order], h[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = (s[1:] == s[:-1]) & (d[1:] == d[:-1])
    return np.bincount(d, same[:-1], n), np.bincount(d, same[:-1] | same[1:], n)


def measures(column: pa.Array) -> np.ndarray:
    """A row of ``MEASURES`` numbers for each text; null counts as empty, and an empty text has zeros only."""
    n = len(column)
    data, ends = text_bytes(column)
    of = np.repeat(np.arange(n), np.diff(ends))
    kind = _KIND[data]
    kind[:-1][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] = _UPPER  # capitals of Latin-1
    by = np.bincount(of * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
    solid = by.sum(1) - by[:, _SPACE] - by[:, _LINE]
    marks = by[:, : len(_PUNCTUATION)]
    blank = (kind == _SPACE) | (kind == _LINE)
    after = np.ones(len(data), bool)
    after[:-1] = blank[1:]
    after[ends[1:][ends[1:] > ends[:-1]] - 1] = True
    closing = np.bincount(of[(kind < len(_PUNCTUATION)) & after], minlength=n)
    h, count = word_hashes(column)
    doc = np.repeat(np.arange(n), count)
    again = np.bincount(doc[1:], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]), n) if len(h) else np.zeros(n)
    before, _ = _repeated(doc, h, n)
    whole = np.flatnonzero(doc[2:] == doc[:-2]) if len(h) > 2 else np.zeros(0, np.int64)
    runs = mix(mix(h[whole] * _U(3) + h[whole + 1]) + h[whole + 2])
    _, twice = _repeated(doc[whole], runs, n)
    return np.column_stack([
        _share(marks, solid[:, None]),
        *(_share(x, solid) for x in (by[:, _UPPER], by[:, _DIGIT], by[:, _WIDE], marks.sum(1))),
        *(_share(x, count) for x in (again, before, twice, closing)),
        np.log1p(count), np.log1p(solid / np.maximum(count, 1)), np.log1p(by[:, _LINE]),
    ])


def _measured(rows: DataFrame) -> DataFrame:
    """key, and the measures of text as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for piece in slices(batch.column(1)):
                x = measures(piece).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * MEASURES, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(piece)), lists], ["key", "x"])
                at += len(piece)

    return rows.mapInArrow(run, "key long, x array<float>")


def held_out(key: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass(frozen=True)
class Model:
    """Score of measures x: sigmoid((x - mean) . weights - threshold + logit(cut))."""

    mean: np.ndarray
    weights: np.ndarray
    threshold: float
    cut: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = (x.astype(float) - self.mean) @ self.weights
        return 1 / (1 + np.exp(-np.clip(raw - self.threshold + np.log(self.cut / (1 - self.cut)), -700, 700)))

    def good(self, x: np.ndarray) -> np.ndarray:
        return self.scores(x) >= self.cut


def bradley_terry(differences: np.ndarray, ridge: float, steps: int = 50) -> np.ndarray:
    """Weights w that minimise the mean of log(1 + exp(-d . w)) over the rows d, and ridge * |w|^2 / 2, by Newton's
    method with halved steps."""
    n, width = differences.shape
    loss = lambda w: np.logaddexp(0, -differences @ w).mean() + ridge * w @ w / 2
    w = np.zeros(width)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(differences @ w, -700, 700)))  # of the pair turning out the other way
        slope = ridge * w - differences.T @ p / n
        if np.abs(slope).max() < 1e-7:
            break
        step = np.linalg.solve((differences.T * (p * (1 - p))) @ differences / n + ridge * np.eye(width), slope)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
    return w


def fit(x: np.ndarray, label: np.ndarray, bad_share: float, options: Ranking = Ranking()) -> Model:
    """The model of labelled measures (1: good). Without rows of both labels every score is 0.5."""
    good, bad = x[label == 1].astype(float), x[label == 0].astype(float)
    if not len(good) or not len(bad):
        return Model(np.zeros(x.shape[1]), np.zeros(x.shape[1]), float(np.log(options.cut / (1 - options.cut))), options.cut)
    mean = (good.mean(0) + bad.mean(0)) / 2
    spread = np.sqrt((((good - mean) ** 2).mean(0) + ((bad - mean) ** 2).mean(0)) / 2)
    spread = np.where(spread > 1e-9, spread, np.inf)
    rng = np.random.default_rng(options.seed)
    a, b = rng.integers(0, len(good), options.pairs), rng.integers(0, len(bad), options.pairs)
    weights = bradley_terry((good[a] - bad[b]) / spread, options.ridge) / spread
    raw = np.concatenate([(good - mean) @ weights, (bad - mean) @ weights])
    weight = np.concatenate([np.full(len(good), (1 - bad_share) / len(good)), np.full(len(bad), bad_share / len(bad))])
    order = np.argsort(raw, kind="stable")
    below = np.cumsum(weight[order])
    at = int(np.searchsorted(below, bad_share * (1 + 1e-9), side="right"))  # the first that stands above the bad ones' share
    threshold = (raw[order[min(at, len(raw) - 1)]] + raw[order[max(at - 1, 0)]]) / 2
    return Model(mean, weights, float(threshold), options.cut)


def _summed(rows: DataFrame, columns: list[str], of) -> np.ndarray:
    """The sum of ``of`` (the batch's columns -> numbers) over all rows: one row leaves each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            own = of(*batch.columns)
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    found = sorted(tuple(r["sums"]) for r in rows.select(*columns).mapInArrow(run, "sums array<double>").collect())
    return np.sum(np.array(found), axis=0) if found else np.zeros(0)


def _moments(label: pa.Array, x: pa.Array) -> np.ndarray:
    """For each class its rows, and the sums and sums of squares of their measures."""
    own, y = np.asarray(x.flatten(), float).reshape(len(x), MEASURES), np.asarray(label)
    return np.concatenate([np.concatenate(([float((y == c).sum())], own[y == c].sum(0), (own[y == c] ** 2).sum(0))) for c in (0, 1)])


def _grouped(rows: DataFrame, n_bad: int, n_good: int, options: Ranking) -> DataFrame:
    """good, bad: measures of the rows of each group, one after another. A group's rows of the larger class are dealt to
    parts, and its rows of the rarer class are in each, so no row of this table is large."""
    rare, most = (0, n_bad) if n_bad <= n_good else (1, n_good)
    groups = max(1, most // options.group)
    parts = max(1, (n_bad + n_good - most) // (groups * 4 * options.group))
    own = F.when(F.col("label") == rare, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.pmod(F.xxhash64("key", "x", F.lit(1)), F.lit(parts)).cast("int")))
    x = rows.select("label", "key", "x", F.pmod(F.xxhash64("key", "x"), F.lit(groups)).alias("group"), F.explode(own).alias("part"))
    side = lambda y: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == y, F.struct("key", "x")))), lambda r: r["x"]))
    return x.groupBy("group", "part").agg(side(1).alias("good"), side(0).alias("bad")).sortWithinPartitions("group", "part")


def _losses(w: np.ndarray):
    """Of groups: their pairs, the sum of log(1 + exp(-d . w)) over them, its slope and its curvature in w."""

    def of(good: pa.Array, bad: pa.Array) -> np.ndarray:
        width = len(w)
        n, total, slope, bend = 0, 0.0, np.zeros(width), np.zeros((width, width))
        for i in range(len(good)):
            g, b = (np.asarray(c[i].values, float).reshape(-1, width) for c in (good, bad))
            margin = (g @ w)[:, None] - (b @ w)[None, :]
            p = 1 / (1 + np.exp(np.clip(margin, -700, 700)))
            v = p * (1 - p)
            cross = g.T @ v @ b
            n += margin.size
            total += np.logaddexp(0, -margin).sum()
            slope -= g.T @ p.sum(1) - b.T @ p.sum(0)
            bend += (g.T * v.sum(1)) @ g + (b.T * v.sum(0)) @ b - cross - cross.T
        return np.concatenate(([float(n), total], slope, bend.ravel()))

    return of


def _at(scores: DataFrame, ranks: list[int]) -> list[float]:
    """The values of column s at places (from 0) of its ascending order, by counts of ever smaller ranges."""
    out = []
    for k in ranks:
        lo, hi, n = scores.agg(F.min("s"), F.max("s"), F.count("*")).first()
        before = 0
        while n > 10_000 and hi > lo:
            step = (hi - lo) / 1000
            bins = scores.where(F.col("s").between(lo, hi)).groupBy(F.floor((F.col("s") - lo) / step).alias("b")).agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"))
            for r in sorted(bins.collect(), key=lambda r: r["b"]):
                if before + r["n"] > k:
                    lo, hi, n = r["lo"], r["hi"], r["n"]
                    break
                before += r["n"]
        out.append(lo if hi <= lo else sorted(r["s"] for r in scores.where(F.col("s").between(lo, hi)).collect())[k - before])
    return out


def _fitted(rows: DataFrame, options: Ranking) -> Model:
    """The model of all rows (label, key, x); of :func:`fit`, but for the pairs."""
    rows = stored(rows.select("label", "key", "x"), "ranking-labelled")
    sums = _summed(rows, ["label", "x"], _moments)
    width = 1 + 2 * MEASURES
    n_bad, n_good = (int(sums[0]), int(sums[width])) if len(sums) else (0, 0)
    if not n_bad or not n_good:
        discard(rows)
        return fit(np.zeros((0, MEASURES)), np.zeros(0, int), 0.0, options)
    means = [sums[a + 1 : a + 1 + MEASURES] / sums[a] for a in (0, width)]
    squares = [sums[a + 1 + MEASURES : a + width] / sums[a] for a in (0, width)]
    mean = (means[0] + means[1]) / 2
    spread = np.sqrt(np.maximum(0, sum(q - 2 * mean * m + mean**2 for q, m in zip(squares, means, strict=True)) / 2))
    spread = np.where(spread > 1e-6, spread, np.inf)  # sums of squares leave some rounding
    groups = stored(_grouped(rows, n_bad, n_good, options), "ranking-groups")

    def look(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        own = _summed(groups, ["good", "bad"], _losses(w / spread))
        n, slope, bend = max(1.0, own[0]), own[2 : 2 + MEASURES] / spread, own[2 + MEASURES :].reshape(MEASURES, MEASURES) / spread[:, None] / spread
        return own[1] / n + options.ridge * w @ w / 2, slope / n + options.ridge * w, bend / n + options.ridge * np.eye(MEASURES)

    w = np.zeros(MEASURES)
    loss, slope, bend = look(w)
    for _ in range(50):
        if np.abs(slope).max() < 1e-7:
            break
        step, size = np.linalg.solve(bend, slope), 1.0
        made = look(w - step)
        while size > 1e-6 and made[0] > loss:
            size /= 2
            made = look(w - size * step)
        w, (loss, slope, bend) = w - size * step, made
    weights = w / spread

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, MEASURES)
            yield pa.RecordBatch.from_arrays([pa.array((own - mean) @ weights)], ["s"])

    low, high = _at(rows.select("x").mapInArrow(score, "s double"), [n_bad - 1, n_bad])
    discard(rows, groups)
    return Model(mean, weights, (low + high) / 2, options.cut)


def classify(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", options: Ranking = Ranking()) -> DataFrame:
    """Score every whole text; learn from the labels of rows that are not held out.

    Returns doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= ``options.cut``). A
    null text is an empty one. Rows with one id are separate documents and each learns from that id's label; an id that
    is labelled both ways or null counts as not labelled, a repeated label once. Rows with a null id are held out.
    Without labels of both kinds every score is 0.5. An empty table gives an empty one; other columns play no part.
    """
    x = stored(_measured(df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))), "ranking-measures")
    known = labels.select(F.col(id_col).cast("long").alias("key"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)").where(~held_out(F.col("key")))
    known = known.groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other and key is not null")
    model = _fitted(x.join(known.select("key", "label"), "key"), options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, MEASURES)
            s = model.scores(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= model.cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    made = x.mapInArrow(run, "doc_id long, score double, predicted int")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
