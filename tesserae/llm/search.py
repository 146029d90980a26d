"""Ranked lexical search over a two-level quantised index.

The index holds, for each document, the asked terms that it has with their numbers of occurrences. From the corpus'
statistics an occurrence number gives an integer impact; its byte, rounded upwards, is what a search reads first. The
bytes give each document an upper and a lower bound of its score, and the largest byte of each term in a block of
documents bounds the whole block. A search keeps the k best lower bounds of each item; blocks and documents whose upper
bounds stay below the k-th are skipped, and every other document is scored again with exact integers.

A score sums over an item's terms, repeats included, w * ((1000000000 * tf) div (1000 * tf + 8 * m)). Items are searched
in rounds of a bounded number of terms. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored
from .shingles import slices, word_hashes

#: Bytes that end a term: all ASCII but digits and letters.
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass(frozen=True)
class Search:
    """``k``: documents kept for an item. ``terms``: terms of a round's items, repeats included, unless one item alone
    has more. ``block``: documents that are bounded together. ``cells``: numbers in a matrix of a task at most."""

    k: int = 10
    terms: int = 500_000
    block: int = 512
    cells: int = 4_000_000


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(column, _BETWEEN)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


#: No impact reaches it: 1,000,000,000 * tf < 1,000,000 * (1000 * tf + 8 * m).
_TOP = 1_000_000
#: What one step of a byte stands for.
STEP = -(-_TOP // 255)


def quantised(impact: np.ndarray) -> np.ndarray:
    """Bytes of impacts, rounded upwards: STEP * byte is no less than the impact, STEP * (byte - 1) is less than it, but
    for impact 0, which has byte 0."""
    return -(-impact // STEP)


def _items(items: DataFrame) -> DataFrame:
    """number (of the row), item, terms (hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for piece in slices(batch.column(2)):
                h, count = _terms(piece)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(piece)), batch.column(1).slice(at, len(piece)), lists], ["number", "item", "terms"])
                at += len(piece)

    return items.mapInArrow(run, "number long, item long, terms array<long>")


def _rounds(items: DataFrame, most: int) -> Iterator[list]:
    """The items (number, item, terms as an array) in lists of at most ``most`` terms; read one after another."""
    held, size = [], 0
    for r in items.toLocalIterator():
        terms = np.array(r["terms"], np.int64).view(np.uint64)
        if held and size + len(terms) > most:
            yield held
            held, size = [], 0
        if len(terms):
            held.append((r["number"], r["item"], terms))
            size += len(terms)
    if held:
        yield held


_INDEX = "doc long, n long, term array<int>, tf array<int>, df array<long>"


def _index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """For each document with a term: its id, its number of terms, and which terms of the vocabulary it has how often.
    Each task adds one row (n null) with the number of its documents for each term, bounded by the vocabulary."""

    def rows(doc: pa.Array, n: np.ndarray, at: np.ndarray, term: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(at, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (term, tf)]
        return pa.RecordBatch.from_arrays([doc, pa.array(n), *lists, pa.nulls(len(n), pa.list_(pa.int64()))], ["doc", "n", "term", "tf", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            at = 0
            for piece in slices(batch.column(1)):
                h, count = _terms(piece)
                place = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                hit = vocabulary[place] == h
                some = np.flatnonzero(count)  # documents without a term are none of the counted ones
                of = np.repeat(np.cumsum(count > 0) - 1, count)[hit]
                key, tf = np.unique(of * len(vocabulary) + place[hit], return_counts=True)
                of, term = np.divmod(key, len(vocabulary))
                df += np.bincount(term, minlength=len(vocabulary))
                doc = batch.column(0).slice(at, len(piece)).take(pa.array(some))
                if len(some):
                    yield rows(doc, count[some].astype(np.int64), np.searchsorted(of, np.arange(len(some) + 1)), term, tf)
                at += len(piece)
        held = np.flatnonzero(df)
        if len(held):
            whole = lambda x, kind: pa.array([x], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), whole(held, pa.int32()), pa.nulls(1, pa.list_(pa.int32())), whole(df[held], pa.int64())], ["doc", "n", "term", "tf", "df"])

    return docs.mapInArrow(run, _INDEX)


@dataclass(frozen=True)
class Asked:
    """A round: items, the sorted hashes of their terms, the terms' weights, and which items have which terms."""

    items: list[tuple[int, int | None]]
    vocabulary: np.ndarray
    weight: np.ndarray  # of each term
    term: np.ndarray  # of each pair of an item and one of its terms: places in the vocabulary,
    item: np.ndarray  # places in items, ascending,
    times: np.ndarray  # and how often the item has the term


def _asked(held: list) -> Asked:
    vocabulary, place = np.unique(np.concatenate([t for *_, t in held]), return_inverse=True)
    of = np.repeat(np.arange(len(held)), [len(t) for *_, t in held])
    key, times = np.unique(of * len(vocabulary) + place, return_counts=True)
    item, term = np.divmod(key, len(vocabulary))
    return Asked([(n, i) for n, i, _ in held], vocabulary, np.zeros(0), term, item, times)


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Searcher:
    """A task's search: the k best lower bounds of each item so far, and the documents that may still be among its best."""

    def __init__(self, asked: Asked, n_docs: int, n_terms: int, options: Search) -> None:
        self.asked, self.n_docs, self.n_terms, self.options = asked, n_docs, n_terms, options
        self.best = np.zeros((len(asked.items), options.k), np.int64)  # ascending lower bounds; 0: none yet
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # item, upper bound, document, exact score
        self.held = 0
        self.rescored = 0
        edges = np.searchsorted(asked.item, np.arange(len(asked.items) + 1))
        self.groups, a = [], 0
        while a < len(asked.items):  # items whose matrix of terms is small enough
            b = a + 1
            while b < len(asked.items) and (b + 1 - a) * (edges[b + 1] - edges[a]) <= options.cells:
                b += 1
            s = slice(edges[a], edges[b])
            self.groups.append((a, b, asked.term[s], asked.item[s] - a, asked.times[s] * asked.weight[asked.term[s]]))
            a = b

    def add(self, doc: np.ndarray, n: np.ndarray, at: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """A batch of documents: ids as places in some list, numbers of terms, and postings from at[i] to at[i + 1]."""
        m = 25 + (75 * n * self.n_docs) // self.n_terms
        impact = impacts(tf.astype(np.int64), np.repeat(m, np.diff(at)))
        byte = quantised(impact)
        for a in range(0, len(doc), self.options.block):
            b = min(a + self.options.block, len(doc))
            s = slice(at[a], at[b])
            if s.start < s.stop:
                self._block(doc[a:b], np.repeat(np.arange(b - a), np.diff(at[a : b + 1])), term[s], impact[s], byte[s])
        if self.held > 50_000:
            self._shrink()

    def _block(self, doc: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray, byte: np.ndarray) -> None:
        own, place = np.unique(term, return_inverse=True)
        top = np.zeros(len(own))
        np.maximum.at(top, place, byte)
        for a, b, asked, item, weight in self.groups:
            at = np.minimum(np.searchsorted(own, asked), len(own) - 1)
            use = own[at] == asked
            if not use.any():
                continue
            w = np.zeros((len(own), b - a))
            w[at[use], item[use]] = weight[use]
            # sums of integers below 2**53 are exact in doubles
            open_items = np.flatnonzero((STEP * (top @ w) > 0) & (STEP * (top @ w) >= self.best[a:b, 0]))
            w = w[:, open_items]
            rows = max(1, self.options.cells // max(1, len(own)))
            for x in range(0, len(doc) if len(open_items) else 0, rows):
                mine = slice(*np.searchsorted(row, [x, x + rows]))
                self._documents(doc[x : x + rows], row[mine] - x, place[mine], impact[mine], byte[mine], w, a + open_items)

    def _documents(self, doc: np.ndarray, row: np.ndarray, place: np.ndarray, impact: np.ndarray, byte: np.ndarray, w: np.ndarray, items: np.ndarray) -> None:
        level = np.zeros((len(doc), len(w)))
        level[row, place] = byte
        high = level @ w
        low = STEP * (high - (level > 0) @ w) + (level > 0) @ w  # each impact exceeds STEP * (byte - 1)
        low, high = np.where(high > 0, low, 0), STEP * high
        k = min(self.options.k, len(doc))
        own = np.partition(low, len(doc) - k, axis=0)[len(doc) - k :].T.astype(np.int64)
        self.best[items] = np.sort(np.concatenate([self.best[items], own], axis=1), axis=1)[:, -self.options.k :]
        bound = self.best[items, 0]
        i, d = np.nonzero(((high >= bound) & (high > 0)).T)
        if len(i):
            exact = np.zeros((len(doc), len(w)), np.int64)
            exact[row, place] = impact
            weight = w.astype(np.int64)
            score = np.concatenate([(exact[x] * weight[:, y].T).sum(1) for x, y in ((d[s : s + 4096], i[s : s + 4096]) for s in range(0, len(i), 4096))])
            self.rescored += len(i)
            keep = score > 0
            self.found.append((items[i[keep]], high[d, i][keep].astype(np.int64), doc[d[keep]], score[keep]))
            self.held += int(keep.sum())

    def _shrink(self) -> None:
        """Forget documents whose upper bound is below the k-th lower bound by now, and, of equally good ones, all but k."""
        if not self.found:
            return
        item, high, doc, score = (np.concatenate(x) for x in zip(*self.found, strict=True))
        keep = high >= self.best[item, 0]
        item, high, doc, score = item[keep], high[keep], doc[keep], score[keep]
        order = np.lexsort((doc, -score, item))
        item, high, doc, score = item[order], high[order], doc[order], score[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.options.k
        self.found, self.held = [(item[keep], high[keep], doc[keep], score[keep])], int(keep.sum())

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """item, document and exact score of each item's k best here."""
        self._shrink()
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        item, _, doc, score = self.found[0]
        return item, doc, score


_NONE = np.iinfo(np.int64).max  # stands for a null id, which comes last among equal scores


def _searched(index: DataFrame, asked: Asked, n_docs: int, n_terms: int, options: Search) -> DataFrame:
    """Each task's k best documents of each item."""
    number = np.array([n for n, _ in asked.items], np.int64)
    item_id = pa.array([i for _, i in asked.items], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(asked, n_docs, n_terms, options)
        for batch in batches:
            if not batch.num_rows:
                continue
            doc = np.asarray(batch.column(0).fill_null(_NONE))
            term, tf = batch.column(2), batch.column(3)
            at = np.asarray(term.offsets).astype(np.int64)
            search.add(doc, np.asarray(batch.column(1)), at - at[0], np.asarray(term.flatten()), np.asarray(tf.flatten()))
        item, doc, score = search.results()
        if len(item):
            yield pa.RecordBatch.from_arrays([pa.array(number[item]), item_id.take(pa.array(item)), pa.array(doc, mask=doc == _NONE), pa.array(score)], ["number", "item_id", "doc_id", "score"])

    return index.where("n is not null").select("doc", "n", "term", "tf").mapInArrow(run, "number long, item_id long, doc_id long, score long")


def search(df: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", options: Search = Search()) -> DataFrame:
    """The ``options.k`` best documents of each item with a score above 0, best first, equal ones by ascending id.

    Returns item_id, rank, doc_id, score. Whole texts count; a null text has no terms, and such documents and items are
    in no result. Rows with one id are separate documents, and each row of ``items`` is searched for itself, so a
    repeated item is answered as often; a null doc_id comes last among equal scores. Without documents or items the
    result is empty; other columns play no part.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    numbered = items.select(F.monotonically_increasing_id().alias("number"), F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    queries = stored(_items(numbered), "search-items")
    out = spark.createDataFrame([], "number long, item_id long, doc_id long, score long")
    parts = []
    for held in _rounds(queries, options.terms):
        asked = _asked(held)
        index = stored(_index(rows, asked.vocabulary), "search-index")
        n_docs, n_terms = index.where("n is not null").agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df_of = np.zeros(len(asked.vocabulary), np.int64)
        spread = index.where("n is null").select(F.explode(F.arrays_zip("term", "df")).alias("x"))
        for r in spread.groupBy("x.term").agg(F.sum("x.df").alias("n")).toLocalIterator():  # bounded by a round's terms
            df_of[r["term"]] = r["n"]
        asked = Asked(asked.items, asked.vocabulary, weights(n_docs, df_of), asked.term, asked.item, asked.times)
        if n_docs:
            parts.append(stored(_searched(index, asked, n_docs, n_terms, options), "search-found"))
        discard(index)
    discard(queries)
    for part in parts:
        out = out.unionByName(part)
    best = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= options.k).select("item_id", "rank", "doc_id", "score")
