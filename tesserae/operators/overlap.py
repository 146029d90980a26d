"""Which sentences of documents stand in a library: candidates by blocks, verification, fallback, roll-ups.

Tables: sentences (doc_id, idx, display, norm, start, end) of the query and of the library side; fingerprinted ones
have ``fp`` as well. Matches: q_doc, q_idx, doc_id, s_idx, s_display, d, m, sim, tier, cos, min_block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fingerprint as fp
from ..functions import similarity as sm
from ..functions import text as T

MIN_PENDING = 10
SPAN_GAP = 2
EVIDENCE = 3
#: Forms with one value of a block that a task compares with others at once.
HOT_BLOCK = 20_000
#: Frequencies of bigrams that are broadcast: some tens of megabytes.
GRAMS = 1_000_000
#: Numbers of a block of query vectors, and of a matrix product.
CELLS = 4_000_000
#: Forms and characters of a query side that is broadcast for containment: a few megabytes at most.
ASKED_FORMS, ASKED_CHARS = 4096, 1_000_000
DENSE = 4_000_000  # counters of one batch
WIDE = 2048  # bigrams of asked forms that are columns of a matrix
_SHIFTS, _BLOCK = np.arange(fp.BLOCKS, dtype=np.uint64) * np.uint64(fp.BLOCK_BITS), np.uint64((1 << fp.BLOCK_BITS) - 1)
#: Columns of a library row for containment, and what a task adds.
_ROW, _BEST = ("norm", "doc_id", "s_idx", "s_display"), "best array<struct<q:int,score:double>>"
_MATCH = ("q_doc", "q_idx", "doc_id", "s_idx", "s_display", "d", "m", "sim", "tier", "cos", "min_block")


def fingerprinted(sents: DataFrame) -> DataFrame:
    """Adds fp: a map over the sentences, as hashing one costs less than moving it."""
    return sents.withColumn("fp", fp.simhash("norm"))


def bigram_counts(sents: DataFrame) -> DataFrame:
    """bigram, n: how often each stands in the normal forms. A task counts its own by numbers, and hands on what it has when
    that grows beyond ``GRAMS``; only counts are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([fp.bigram_text(c) for c in codes.tolist()], pa.string()), pa.array(count)], ["bigram", "n"])

        for batch in batches:
            own, times = fp.counted_codes(fp.bigram_codes([x for x in batch.column(0).to_pylist() if x])[0])
            codes, count = fp.counted_codes(np.concatenate((codes, own)), np.concatenate((count, times)))
            if len(codes) > GRAMS:
                yield made()
                codes, count = codes[:0], count[:0]
        if len(codes):
            yield made()

    return sents.select("norm").mapInArrow(run, "bigram string, n long").groupBy("bigram").agg(F.sum("n").alias("n"))


def candidates(query: DataFrame, library: DataFrame) -> DataFrame:
    """Pairs of fingerprints that share a block and differ in four bits at most: q_norm, norm, distance, min_block.

    Fingerprints of 0 take no part. A query side of bounded size is broadcast: the library's distinct normal forms are
    moved once, for that, and each leaves its task once with all the pairs that it is in. A larger one is joined."""
    asked = _asked(query)
    if asked is None:
        return _joined(query, library)
    spark, names = library.sparkSession, [r["norm"] for r in asked]
    held = spark.sparkContext.broadcast(np.array([r["fp"] for r in asked], np.int64))
    kind = pa.list_(pa.struct([("q", pa.int32()), ("distance", pa.int32()), ("min_block", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = held.value
        step = max(1, DENSE // max(1, len(prints)))
        for batch in batches:
            for begin in range(0, batch.num_rows if len(prints) else 0, step):
                rows = batch.slice(begin, step)
                t, q, distance, first = _near(np.asarray(rows.column(1)), prints)
                own, count = np.unique(t, return_counts=True)
                if len(own):
                    found = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (q, distance, first)], fields=list(kind.value_type))
                    ends = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(own)), pa.ListArray.from_arrays(ends, found)], ["norm", "found"])

    forms = library.where("fp <> 0").select("norm", "fp").distinct()
    x = forms.mapInArrow(run, "norm string, found array<struct<q:int,distance:int,min_block:int>>").select("norm", F.inline("found"))
    named = F.broadcast(spark.createDataFrame(list(enumerate(names)), "q int, q_norm string"))
    return x.join(named, "q").select("q_norm", "norm", "distance", "min_block")


def _near(own: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of fingerprints and asked ones the pairs that share a block and differ in four bits at most, by the first's place:
    the places of both, how many bits differ, the first block shared. Fingerprints of 0 are in none."""
    differ = own[:, None] ^ prints[None, :]
    bits = np.bitwise_count(differ.view(np.uint64))
    t, q = np.nonzero((bits <= fp.MAX_DISTANCE) & (own != 0)[:, None])
    same = (differ[t, q].view(np.uint64)[:, None] >> _SHIFTS) & _BLOCK == 0
    some = same.any(axis=1)
    return t[some], q[some], bits[t, q][some], same[some].argmax(axis=1)


def _joined(query: DataFrame, library: DataFrame) -> DataFrame:
    """The candidates of a query side of any size.

    Both sides are first reduced to distinct normal forms, so repeated sentences do not multiply a hot block's
    pairs; an equi-join on the block then finds the pairs, and a pair that shares several blocks is kept at the
    first one only, so nothing has to be made distinct. A block value that many forms
    have is counted and split, see :func:`_split`.
    """

    def side(x: DataFrame, p: str) -> DataFrame:
        x = x.where("fp <> 0").select(F.col("norm").alias(p + "norm"), F.col("fp").alias(p + "fp")).distinct()
        return x.select("*", F.posexplode(fp.blocks(F.col(p + "fp"))).alias("block", "value"))

    q, lib = _split(side(query, "q_"), side(library, "l_").withColumnRenamed("l_norm", "norm"))
    return sharing(q, lib, "norm", ["block", "value", "q_part", "l_part"])


def _split(query: DataFrame, library: DataFrame, hot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with q_part and l_part. The rows of a (block, value) of which a side has more than ``hot`` are dealt to
    parts by their form, and the other side's rows are there once for each, so every pair meets in exactly one place and
    no task gets all pairs of a frequent value."""
    hot = hot or HOT_BLOCK
    size = lambda x, name: x.groupBy("block", "value").agg(F.count("*").alias(name))
    parts = size(query, "nq").join(size(library, "nl"), ["block", "value"]).where(F.greatest("nq", "nl") > hot)
    parts = parts.select("block", "value", *(F.ceil(F.col(n) / hot).cast("int").alias(to) for n, to in (("nq", "q_parts"), ("nl", "l_parts"))))
    parts = F.broadcast(parts)  # a row for each hot value: four blocks have 262,144 values at most

    def dealt(x: DataFrame, norm: str, own: str, other: str) -> DataFrame:
        x = x.join(parts, ["block", "value"], "left")
        mine = F.coalesce(F.pmod(F.xxhash64(norm), F.col(f"{own}s")).cast("int"), F.lit(0))
        every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"{other}s"), F.lit(1)) - 1))
        return x.withColumn(own, mine).withColumn(other, every).drop("q_parts", "l_parts")

    return dealt(query, "q_norm", "q_part", "l_part"), dealt(library, "norm", "l_part", "q_part")


def sharing(query: DataFrame, library: DataFrame, name: str, on: list[str]) -> DataFrame:
    """Pairs of rows (q_norm, q_fp, block, value) and (``name``, l_fp, block, value) that share a block, each at the first
    block that it shares."""
    x = query.join(library, on)
    same = F.transform(F.arrays_zip(fp.blocks(F.col("q_fp")).alias("a"), fp.blocks(F.col("l_fp")).alias("b")), lambda z: z["a"] == z["b"])
    distance = fp.hamming(F.col("q_fp"), F.col("l_fp"))
    x = x.where((distance <= fp.MAX_DISTANCE) & (F.array_position(same, F.lit(True)) == F.col("block") + 1))
    return x.select("q_norm", name, distance.alias("distance"), F.col("block").alias("min_block"))


def _measured(pairs: DataFrame) -> DataFrame:
    """Adds m (longer length) and d (edit distance, or m beyond the border). Pairs are few bytes but much work, so
    they are dealt to all partitions first."""
    x = pairs.withColumn("m", sm.longest(F.col("q_norm"), F.col("norm")))
    x = x.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "q_norm", "norm")
    return x.withColumn("d", sm.distance("q_norm", "norm"))


def _sim(d: Column, m: Column) -> Column:
    return F.bround(sm.similarity(d, m), 3)


def verified(pairs: DataFrame) -> DataFrame:
    """Candidate pairs whose edit similarity has a tier."""
    x = _measured(pairs.where(sm.fits(F.col("q_norm"), F.col("norm"))))
    return x.withColumn("tier", sm.tier(F.col("d"), F.col("m"))).where("tier is not null").withColumn("sim", _sim(F.col("d"), F.col("m")))


def _few(forms: DataFrame) -> list | None:
    """The rows of a query side (norm, ..) that fits in each task: they are counted first. None of a larger one."""
    n, chars = forms.agg(F.count("*"), F.coalesce(F.sum(F.char_length("norm")), F.lit(0))).first()
    return forms.collect() if n <= ASKED_FORMS and chars <= ASKED_CHARS else None


def _meets(asked: list, keep: list[str], *, stored: bool = False) -> tuple[Callable[[pa.RecordBatch, list, np.ndarray], Iterator[pa.RecordBatch]], tuple]:
    """What a task does with a batch of the library (norm, with ``stored`` fp, then the columns ``keep``): the batch's rows
    with what they match of the asked normal forms; and what is broadcast for it."""
    names, kept_from = [r["norm"] for r in asked], 2 if stored else 1

    def run(batch: pa.RecordBatch, asked: list, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = np.fromiter(map(len, asked), np.int64, len(asked))
        sizes = np.unique(size)
        step = max(1, DENSE // max(1, len(asked)))
        for begin in range(0, batch.num_rows if asked else 0, step):
            rows = batch.slice(begin, step)
            norm = rows.column(0).dictionary_encode()
            form = np.asarray(norm.indices.cast(pa.int32()).fill_null(-1))
            texts = norm.dictionary.to_pylist()
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            own = np.zeros(len(texts), np.int64)  # a form has one fingerprint
            if stored:
                own[form[form >= 0]] = np.asarray(rows.column(kept_from - 1).fill_null(0))[form >= 0]
            else:
                some = np.flatnonzero((20 * np.abs(lengths[:, None] - sizes) < 9 * np.maximum(lengths[:, None], sizes)).any(axis=1))
                own[some] = fp._simhashes([texts[i] for i in some])
            t, q, _, first = _near(own, prints)
            length = lengths[t]
            longest = np.maximum(length, size[q])
            fine = np.flatnonzero(20 * np.abs(length - size[q]) < 9 * longest)
            t, q, m, first = t[fine], q[fine], longest[fine], first[fine]
            d = sm.tier_distances_to(asked, texts, q, t)
            fine = np.flatnonzero((20 * d <= 9 * m) & (d < m))
            order = fine[np.argsort(t[fine], kind="stable")]
            # every row of a form that matches, once for each match
            lo, hi = np.searchsorted(t[order], form, side="left"), np.searchsorted(t[order], form, side="right")
            row = np.repeat(np.arange(len(form)), hi - lo)
            pair = order[np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo) + np.arange(len(row))]
            if len(row):
                kept = rows.take(pa.array(row)).columns[kept_from:]
                found = pa.array([asked[i] for i in q[pair]], pa.string()), *(pa.array(x[pair], pa.int32()) for x in (d, m, first))
                yield pa.RecordBatch.from_arrays([*kept, *found], [*keep, "q_norm", "d", "m", "min_block"])

    return run, (names, np.array([r["fp"] for r in asked], np.int64))


def _met_by(asked: list, library: DataFrame, keep: list[str], *, stored: bool = False) -> DataFrame:
    """The rows of the library (its columns ``keep``) with what they match of the asked normal forms (norm, fp): q_norm, d,
    m, min_block. The forms are broadcast; a task compares each normal form of a batch once, and only matches leave it. Where
    the fingerprints are not ``stored``, the task makes them, for forms whose length leaves a match possible."""
    meet, forms = _meets(asked, keep, stored=stored)
    held = library.sparkSession.sparkContext.broadcast(forms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from meet(batch, *held.value)

    kinds = "".join(f"`{c}` {library.schema[c].dataType.simpleString()}, " for c in keep)
    own = ["norm", "fp"] if stored else ["norm"]
    return library.select(*own, *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)]).mapInArrow(run, f"{kinds}q_norm string, d int, m int, min_block int")


def _tiered(x: DataFrame) -> DataFrame:
    return x.withColumn("tier", sm.tier(F.col("d"), F.col("m"))).withColumn("sim", _sim(F.col("d"), F.col("m")))


def _asked(query: DataFrame) -> list | None:
    return _few(query.where("fp <> 0").select("norm", "fp").distinct())


def few(query: DataFrame) -> bool:
    """Whether a query side is broadcast."""
    return _asked(query) is not None


def literal_pairs(query: DataFrame, library: DataFrame) -> DataFrame:
    """Pairs of normal forms that match by fingerprint and edit similarity: q_norm, norm, d, m, sim, tier, min_block.
    As ``verified(candidates(query, library))``; a query side of bounded size is broadcast, so no candidate is moved."""
    asked = _asked(query)
    if asked is None:
        x = verified(_joined(query, library))
    else:
        x = _tiered(_met_by(asked, library, ["norm"]).distinct())
    return x.select("q_norm", "norm", "d", "m", "sim", "tier", "min_block")


def literal_matches(query: DataFrame, library: DataFrame, *, stored: bool = False) -> DataFrame:
    """Matches by fingerprint and edit similarity. A query side of bounded size is broadcast, and the library is read once;
    beyond, verified pairs of normal forms meet the sentences again. The matches are held on disk, as what follows
    reads them several times. ``stored``: the library's fingerprints are read, not made."""
    asked = _asked(query)
    if asked is None:
        return placed(verified(_joined(query, library)), query, library)
    s = library.select("doc_id", F.col("idx").alias("s_idx"), F.col("display").alias("s_display"), "norm", "fp")
    return _with_sentences(_met_by(asked, s, ["doc_id", "s_idx", "s_display"], stored=stored), query).persist(StorageLevel.DISK_ONLY)


def _with_sentences(found: DataFrame, query: DataFrame) -> DataFrame:
    """Matches of asked forms as those of the query's sentences."""
    q = query.select(F.col("doc_id").alias("q_doc"), F.col("idx").alias("q_idx"), F.col("norm").alias("q_norm"))
    return _tiered(found).withColumn("cos", F.lit(0.0)).join(F.broadcast(q), "q_norm").select(*_MATCH)


def placed(pairs: DataFrame, query: DataFrame, library: DataFrame) -> DataFrame:
    """Verified pairs of normal forms at the sentences that have them."""
    pairs = pairs.select("q_norm", "norm", "d", "m", "sim", "tier", "min_block")
    q = query.select(F.col("doc_id").alias("q_doc"), F.col("idx").alias("q_idx"), F.col("norm").alias("q_norm"))
    s = library.select("doc_id", F.col("idx").alias("s_idx"), F.col("display").alias("s_display"), "norm")
    x = pairs.join(s, "norm").join(q, "q_norm").withColumn("cos", F.lit(0.0))
    return x.select("q_doc", "q_idx", "doc_id", "s_idx", "s_display", "d", "m", "sim", "tier", "cos", "min_block")


def pending(query: DataFrame, matches: DataFrame) -> DataFrame:
    """Query sentences of ten characters or more without a match."""
    hit = matches.select(F.col("q_doc").alias("doc_id"), F.col("q_idx").alias("idx"))
    return query.where(F.char_length("norm") >= MIN_PENDING).join(hit, ["doc_id", "idx"], "left_anti")


def _decided(x: DataFrame, score: Column, recall: float, strong: float) -> DataFrame:
    x = _measured(x.where(score >= recall)).where((F.col("d") < F.col("m")) | (score >= strong))
    # beyond the border a similarity shows for the strong scores only: exact or 0, by the row-wise cut-off
    beyond = F.col("d") == F.col("m")
    cut = sm.cut_distance(F.when(beyond, F.col("q_norm")), F.when(beyond, F.col("norm")))
    x = x.withColumn("d", F.coalesce(cut, "d"))
    tier = F.coalesce(sm.tier(F.col("d"), F.col("m")), F.when(score >= strong, F.lit("semantic")))
    x = x.withColumn("tier", tier).where("tier is not null").withColumn("sim", _sim(F.col("d"), F.col("m"))).withColumn("cos", F.bround(score, 3))
    return x.withColumn("min_block", F.lit(None).cast("int")).select("q_doc", "q_idx", "doc_id", "s_idx", "s_display", "d", "m", "sim", "tier", "cos", "min_block")


def _bigram_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct bigrams of each text: their numbers in ascending order, and the text of each."""
    codes, count = fp.bigram_codes(texts)
    row = np.repeat(np.arange(len(texts)), count)
    order = np.lexsort((row, codes))
    codes, row = codes[order], row[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
    return codes[new], row[new]


def _sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_bigram_rows`, text by text: text and bigram are one number, so that one plain sort does; 42 bits are the
    bigram's."""
    codes, count = fp.bigram_codes(texts)
    key = np.sort((np.repeat(np.arange(len(texts), dtype=np.uint64), count) << np.uint64(42)) | codes)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    return key & np.uint64((1 << 42) - 1), (key >> np.uint64(42)).astype(np.int64)


class _Asked:
    """The sets of the asked names: a matrix of those bigrams that most names have, inverted lists of the others."""

    def __init__(self, n: int, grams: np.ndarray, queries: np.ndarray) -> None:
        self.n, self.sizes = n, np.bincount(queries, minlength=n)
        self.grams, first, length = np.unique(grams, return_index=True, return_counts=True)
        wide = np.argsort(-length, kind="stable")[:WIDE]
        self.place = np.full(len(self.grams), -1)
        self.place[wide] = np.arange(len(wide))
        self.matrix = np.zeros((n, len(wide)), np.float32)
        column = np.repeat(self.place, length)
        self.matrix[queries[column >= 0], column[column >= 0]] = 1
        self.lo, self.hi, self.queries = first, first + length, queries

    def scores(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """For runs of texts the first one's number, and what share of the smaller set each name (row) and text have in
        common: matrix products, and counters of what the matrix lacks. A run's cells and list entries stay within
        ``DENSE``, but for one text."""
        codes, row = _sets(texts)
        size = np.bincount(row, minlength=len(texts))
        first = np.concatenate(([0], np.cumsum(size)))
        at = np.minimum(np.searchsorted(self.grams, codes), max(0, len(self.grams) - 1))
        asked = self.grams[at] == codes if len(self.grams) else np.zeros(len(codes), bool)
        place = np.where(asked, self.place[at], -2) if len(self.grams) else np.full(len(codes), -2)
        hits = np.where(place == -1, self.hi[at] - self.lo[at], 0) if len(self.grams) else np.zeros(len(codes), np.int64)
        entries = np.concatenate(([0], np.cumsum(hits)))[first]  # of the texts before each
        begin, step = 0, max(1, DENSE // max(1, self.n, self.matrix.shape[1]))
        while begin < len(texts):
            end = max(begin + 1, min(begin + step, len(texts), int(np.searchsorted(entries, entries[begin] + DENSE, side="right")) - 1))
            part = slice(first[begin], first[end])
            some = place[part] >= 0
            own = np.zeros((end - begin, self.matrix.shape[1]), np.float32)
            own[row[part][some] - begin, place[part][some]] = 1
            both = self.matrix @ own.T  # counts, exact
            if entries[end] > entries[begin]:
                few = part.start + np.flatnonzero(hits[part])
                n = hits[few]
                entry = np.repeat(self.lo[at[few]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                both += np.bincount(self.queries[entry] * (end - begin) + np.repeat(row[few] - begin, n), minlength=both.size).reshape(both.shape)
            yield begin, both / np.maximum(1, np.minimum(self.sizes[:, None], size[None, begin:end]))
            begin = end


def _shares(texts: list[str], asked: _Asked) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of texts and of names that share much, and how much."""
    for begin, score in asked.scores(texts):
        q, t = np.nonzero(score >= sm.CONTAIN_RECALL)
        yield t + begin, q, score[q, t]


def _shared_broadcast(forms: DataFrame, library: DataFrame) -> DataFrame:
    """Pairs by a query side that fits in each task: its inverted lists are broadcast, and each batch of library forms is
    counted against them. forms: q_norm, of bounded number and length."""
    asked = [r["q_norm"] for r in forms.collect()]
    held = forms.sparkSession.sparkContext.broadcast((asked, *_bigram_rows(asked)))

    def count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, *sets = held.value
        lists = _Asked(len(names), *sets)
        for b in batches:
            texts = b.column(0).to_pylist()
            for t, q, score in _shares(texts, lists):
                found = ([names[i] for i in q], pa.string()), ([texts[i] for i in t], pa.string()), (score, pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(*x) for x in found], ["q_norm", "norm", "score"])

    return library.select("norm").distinct().mapInArrow(count_shared, "q_norm string, norm string, score double")


class _Tops:
    """Of library rows (norm, doc_id, s_idx, display) that a task sees the k best of each asked form. Each row is held once,
    however many forms it is best for: rows may be long, and a long line contains the bigrams of many forms."""

    def __init__(self, k: int, names: list[str], *sets: np.ndarray) -> None:
        self.k, self.lists, self.kept = k, _Asked(len(names), *sets), None
        self.q, self.score, self.row = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)  # row: of what is kept
        self.floor = np.full(len(names), sm.CONTAIN_RECALL)

    def add(self, batch: pa.RecordBatch) -> None:
        k, q, score, row = self.k, self.q, self.score, self.row
        batch = _in_order(pa.Table.from_batches([batch])).combine_chunks()  # so a row's number decides between equal scores
        norm = batch.column(0).combine_chunks().dictionary_encode()
        form = np.asarray(norm.indices.cast(pa.int32()).fill_null(-1))
        rows = np.argsort(form, kind="stable")
        begin, end = (np.searchsorted(form[rows], np.arange(len(norm.dictionary)), side=x) for x in ("left", "right"))
        new_q, new_s, new_t = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        for at, share in self.lists.scores(norm.dictionary.to_pylist()):
            for _ in range(min(k, share.shape[1]) if len(self.floor) else 0):  # forms stand by their first rows, of equal ones the first is taken
                t = share.argmax(axis=1)
                most = share[np.arange(len(t)), t]
                some = np.flatnonzero(most >= self.floor)
                if not len(some):
                    break
                new_q.append(some)
                new_s.append(most[some])
                new_t.append(t[some] + at)
                share[np.arange(len(t)), t] = -1.0
        t, own_q, own_s = map(np.concatenate, (new_t, new_q, new_s))
        if not len(t):
            return
        first = _first(own_q, own_s, t, k)
        t, own_q, own_s = t[first], own_q[first], own_s[first]
        count = np.minimum(end[t] - begin[t], k)  # a form's first rows
        own_row = rows[np.repeat(begin[t] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        taken, own_row = np.unique(own_row, return_inverse=True)
        some = batch.take(pa.array(taken))
        q, score = np.concatenate((q, np.repeat(own_q, count))), np.concatenate((score, np.repeat(own_s, count)))
        row = np.concatenate((row, own_row + (0 if self.kept is None else self.kept.num_rows)))
        self.kept = some if self.kept is None else pa.concat_tables([self.kept, some])
        place = np.empty(self.kept.num_rows, np.int64)
        place[_order_of(self.kept)] = np.arange(self.kept.num_rows)
        first = _first(q, score, place[row], k)
        q, score = q[first], score[first]
        taken, row = np.unique(row[first], return_inverse=True)
        self.kept = self.kept.take(pa.array(taken))
        full = np.bincount(q, minlength=len(self.floor)) >= k
        least = np.full(len(self.floor), np.inf)
        np.minimum.at(least, q, score)
        self.floor = np.where(full, least, self.floor)
        self.q, self.score, self.row = q, score, row

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The rows held, each with ``best``: the forms it is best for, and scores."""
        kept, q, score, row = self.kept, self.q, self.score, self.row
        if kept is not None:
            order = np.argsort(row, kind="stable")
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=kept.num_rows)))).astype(np.int32)
            best = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(q[order].astype(np.int32)), pa.array(score[order])], ["q", "score"]))
            yield from kept.append_column("best", best).to_batches(max_chunksize=1024)


def _top_broadcast(asked: list[str], library: DataFrame, k: int) -> DataFrame:
    """Of library rows (norm, doc_id, s_idx, display) the k best of each asked form, with q_norm, score and rank. A task
    keeps k for each form and lets each row leave once, at its end."""
    held = library.sparkSession.sparkContext.broadcast((asked, *_bigram_rows(asked)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = _Tops(k, *held.value)
        for batch in batches:
            tops.add(batch)
        yield from tops.rows()

    kinds = ", ".join(f"{c} {library.schema[c].dataType.simpleString()}" for c in _ROW)
    return _top_of_tasks(asked, library.select(*_ROW).mapInArrow(run, f"{kinds}, {_BEST}").withColumn("hit", F.xxhash64(*_ROW)).persist(StorageLevel.DISK_ONLY), k)


def _top_of_tasks(asked: list[str], hits: DataFrame, k: int) -> DataFrame:
    """The k best of each asked form of what the tasks have kept (hits: held on disk). Ranks are found without the texts,
    which then come for the best only."""
    spark = hits.sparkSession
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), "doc_id", "s_idx")
    top = hits.select("hit", "doc_id", "s_idx", F.inline("best")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    # k rows for each form at most, without texts
    texts = hits.select("hit", "norm", "s_display").join(F.broadcast(top.select("hit").distinct()), "hit", "left_semi").dropDuplicates(["hit"])
    named = F.broadcast(spark.createDataFrame(list(enumerate(asked)), "q int, q_norm string"))
    return texts.join(F.broadcast(top), "hit").join(named, "q").select(*_ROW, "q_norm", "score", "rank")


def _order_of(rows: pa.Table) -> np.ndarray:
    """The order of library rows by (doc_id, s_idx), null first."""
    return np.asarray(pc.sort_indices(pa.table([rows.column(1), rows.column(2)], names=["a", "b"]), [("a", "ascending"), ("b", "ascending")], null_placement="at_start"))


def _in_order(rows: pa.Table) -> pa.Table:
    return rows.take(pa.array(_order_of(rows)))


def _first(q: np.ndarray, score: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Where the k best of each q stand, by q: the highest scores, of equal ones the first rows."""
    order = np.lexsort((row, -score, q))
    own = q[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own, side="left") < k]


def _ranked_sets(forms: DataFrame, norm: str, freq: DataFrame) -> DataFrame:
    """id, n, set: the bigrams of each form, the rarest first."""
    own = forms.select(F.xxhash64(norm).alias("id"), F.explode(F.array_distinct(T.bigrams(F.col(norm)))).alias("g")).join(freq, "g")
    sets = own.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("freq", "g"))).alias("s"))
    return sets.select("id", F.size("s").alias("n"), F.transform("s", lambda x: x["g"]).alias("set"))


def _met(small: DataFrame, large: DataFrame, least: float, strictly: bool) -> DataFrame:
    """Pairs (small, large) by id that may share ``least`` of the smaller set: small's prefix, the rarest bigrams of which
    one at least must be shared, meets large's inverted lists; then what was shared there and what can follow must do."""
    need = F.greatest(F.lit(1), F.ceil(F.col("n") * least - 1e-9)).cast("int")
    head = small.select(F.col("id").alias("small"), F.col("n").alias("n_small"), need.alias("need"), F.posexplode(F.slice("set", F.lit(1), F.col("n") - need + 1)).alias("pos", "g"))
    lists = large.select(F.col("id").alias("large"), F.col("n").alias("n_large"), F.explode("set").alias("g"))
    fits = F.col("n_small") < F.col("n_large") if strictly else F.col("n_small") <= F.col("n_large")
    met = head.join(lists, (head["g"] == lists["g"]) & fits).groupBy("small", "large").agg(F.count("*").alias("shared"), F.max("pos").alias("last"), F.first("n_small").alias("n_small"), F.first("need").alias("need"))
    return met.where(F.col("shared") + F.col("n_small") - F.col("last") - 1 >= F.col("need")).select("small", "large")


def _shared_lists(forms: DataFrame, library: DataFrame) -> DataFrame:
    """Pairs by prefixes of rare bigrams: of a pair's smaller set, whichever side it is on, only the prefix is looked up, and
    only pairs that pass the positional bound are counted in full."""
    names = library.select("norm").distinct()
    grams = lambda x, n: x.select(F.explode(F.array_distinct(T.bigrams(F.col(n)))).alias("g"))
    freq = grams(forms, "q_norm").unionByName(grams(names, "norm")).groupBy("g").agg(F.count("*").alias("freq"))
    if freq.count() <= GRAMS:
        freq = F.broadcast(freq)
    q, lib = _ranked_sets(forms, "q_norm", freq), _ranked_sets(names, "norm", freq)
    pairs = _met(q, lib, sm.CONTAIN_RECALL, False).select(F.col("small").alias("q_id"), F.col("large").alias("l_id"))
    pairs = pairs.unionByName(_met(lib, q, sm.CONTAIN_RECALL, True).select(F.col("large").alias("q_id"), F.col("small").alias("l_id")))
    sets = lambda x, p: x.select(F.col("id").alias(f"{p}_id"), F.col("n").alias(f"{p}_n"), F.col("set").alias(f"{p}_set"))
    both = pairs.join(sets(q, "q"), "q_id").join(sets(lib, "l"), "l_id")
    score = F.size(F.array_intersect("q_set", "l_set")) / F.least("q_n", "l_n")
    found = both.select("q_id", "l_id", score.alias("score")).where(F.col("score") >= sm.CONTAIN_RECALL)
    named = lambda x, n, p: x.select(n, F.xxhash64(n).alias(f"{p}_id")).distinct()
    return found.join(named(forms, "q_norm", "q"), "q_id").join(named(names, "norm", "l"), "l_id").select("q_norm", "norm", "score")


def containment_top(query: DataFrame, library: DataFrame, k: int = sm.TOP) -> DataFrame:
    """For each query sentence the k library sentences that contain most of its bigrams, by smaller set.

    Both sides are first reduced to distinct normal forms. The query side's number and length are counted: up to
    ``ASKED_FORMS`` and ``ASKED_CHARS`` it is broadcast and the library is scanned once, k for each form leaving a
    batch at most; beyond, prefixes of rare bigrams are joined. Both are exact. Sentences without a common bigram have score 0, below every threshold that follows, and
    are left out. Ties go to the smaller (doc_id, s_idx).
    """
    forms = query.select("norm").distinct()
    asked = _few(forms)
    lib = library.select("doc_id", F.col("idx").alias("s_idx"), F.col("display").alias("s_display"), "norm")
    # the k best of each form first: a sentence's k best are among its form's
    if asked is None:
        w = Window.partitionBy("q_norm").orderBy(F.col("score").desc(), "doc_id", "s_idx")
        best = _shared_lists(forms.withColumnRenamed("norm", "q_norm"), library).join(lib, "norm").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    else:
        best = _top_broadcast([r["norm"] for r in asked], lib, k)
    return _at_sentences(best, query)


def _at_sentences(best: DataFrame, query: DataFrame) -> DataFrame:
    qs = query.select(F.col("doc_id").alias("q_doc"), F.col("idx").alias("q_idx"), F.col("norm").alias("q_norm"))
    return best.join(qs, "q_norm").select("q_doc", "q_idx", "q_norm", "doc_id", "s_idx", "s_display", "norm", "score", "rank")


def literal_and_contained(query: DataFrame, library: DataFrame, k: int = sm.TOP) -> tuple[DataFrame, DataFrame]:
    """:func:`literal_matches`, and :func:`containment_top` of the sentences that these leave pending.

    Both in one scan of the library where the query side is broadcast: a form's k best do not depend on other forms, so a task
    keeps them for every form that may be left, and which are is known afterwards. What leaves the scan is held on disk."""
    forms = _few(query.select("norm", "fp").distinct())
    if forms is None:
        literal = literal_matches(query, library)
        return literal, containment_top(pending(query, literal), library, k)
    names = list(dict.fromkeys(r["norm"] for r in forms if len(r["norm"]) >= MIN_PENDING))
    meet, asked = _meets([r for r in forms if r["fp"]], [*_ROW[1:]])
    held = library.sparkSession.sparkContext.broadcast((asked, names, *_bigram_rows(names)))
    columns = [*_ROW, "q_norm", "d", "m", "min_block", "best"]
    kinds = dict.fromkeys(columns, pa.int32()) | {"norm": pa.string(), "q_norm": pa.string(), "best": pa.list_(pa.struct([("q", pa.int32()), ("score", pa.float64())]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, *sets = held.value
        tops = _Tops(k, *sets)

        def filled(x: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([x.column(c) if c in x.schema.names else pa.nulls(x.num_rows, kinds[c]) for c in columns], columns)

        for batch in batches:
            yield from map(filled, meet(batch, *asked))
            tops.add(batch)
        yield from map(filled, tops.rows())

    lib = library.select("norm", "doc_id", F.col("idx").alias("s_idx"), F.col("display").alias("s_display"))
    of_row = ", ".join(f"{c} {lib.schema[c].dataType.simpleString()}" for c in _ROW)
    x = lib.mapInArrow(run, f"{of_row}, q_norm string, d int, m int, min_block int, {_BEST}").withColumn("hit", F.xxhash64(*_ROW)).persist(StorageLevel.DISK_ONLY)
    literal = _with_sentences(x.where("best is null").select(*_ROW[1:], "q_norm", "d", "m", "min_block"), query)
    best = _top_of_tasks(names, x.where("best is not null").select(*_ROW, "best", "hit"), k)
    return literal, _at_sentences(best, pending(query, literal))


def vector_top(query: DataFrame, library: DataFrame, vectors: DataFrame, k: int = sm.TOP) -> DataFrame:
    """As ``containment_top``, by the cosine of the normal forms' vectors (norm, vec). Forms without one match none."""
    vec = vectors.select("norm", "vec").dropDuplicates(["norm"])
    qs = query.select(F.col("doc_id").alias("q_doc"), F.col("idx").alias("q_idx"), F.col("norm").alias("q_norm"))
    lib = library.select("doc_id", F.col("idx").alias("s_idx"), F.col("display").alias("s_display"), "norm")
    q = vec.join(query.select("norm").distinct(), "norm").select(F.col("norm").alias("q_id"), F.col("vec").alias("q_vec"))
    top = cosine_top(q, lib.join(vec, "norm").select(F.struct("doc_id", "s_idx").alias("id"), "vec"), k)
    best = top.select(F.col("q_id").alias("q_norm"), F.col("id.doc_id").alias("doc_id"), F.col("id.s_idx").alias("s_idx"), "score", "rank")
    return best.join(lib, ["doc_id", "s_idx"]).join(qs, "q_norm").select("q_doc", "q_idx", "q_norm", "doc_id", "s_idx", "s_display", "norm", "score", "rank")


def fallback_matches(query: DataFrame, library: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Matches of pending sentences, decided by edit similarity, else by a strong score: by containment, or where
    ``vectors`` (norm, vec; of both sides) are given, by their cosine."""
    if vectors is not None:
        return _decided(vector_top(query, library, vectors), F.col("score"), sm.COSINE_RECALL, sm.COSINE_STRONG)
    return decided(containment_top(query, library))


def decided(top: DataFrame) -> DataFrame:
    """The matches among what contains most of pending sentences (rows of :func:`containment_top`)."""
    return _decided(top, F.col("score"), sm.CONTAIN_RECALL, sm.CONTAIN_STRONG)


def _unit(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that count, as rows of length one in doubles, and where they stand. Null vectors, those that hold null
    or non-finite numbers, and zero do not count; all must have one length."""
    some = np.flatnonzero(np.asarray(vectors.is_valid()))
    own = vectors.take(pa.array(some))
    size = np.asarray(own.value_lengths())
    if not len(some) or not size.any():
        return np.zeros((0, 0)), some[:0]
    if size.min() != size.max():
        raise ValueError("vectors of several lengths")
    x = np.asarray(own.flatten().cast(pa.float64()).fill_null(np.nan)).reshape(len(some), -1)
    norm = np.sqrt((x * x).sum(axis=1))
    fine = np.isfinite(norm) & (norm > 0)
    return x[fine] / norm[fine, None], some[fine]


def _blocks_of(query: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and unit vectors of the queries in blocks of ``CELLS`` numbers at most, one block after another on the driver."""
    ids: list = []
    held: list = []
    for r in query.select("q_id", F.col("q_vec").cast("array<double>").alias("v")).toLocalIterator():
        unit, at = _unit(pa.array([r["v"]], pa.list_(pa.float64())))
        if len(at):
            ids.append(r["q_id"])
            held.append(unit[0])
            if len(held) * len(held[0]) >= CELLS:
                yield ids, np.stack(held)
                ids, held = [], []
    if held:
        yield ids, np.stack(held)


def _best_of(block: np.ndarray, k: int):
    """The task's function: one matrix product a batch, k vectors kept for each query. What may be among the k by the
    product is scored again row by row, so equal vectors have equal scores wherever they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = block.value
        best: list[list[tuple]] = [[] for _ in range(len(asked))]  # (-score, id), ascending
        floor = np.full(len(asked), -np.inf)
        for batch in batches:
            unit, at = _unit(batch.column(1))
            ids = batch.column(0).take(pa.array(at))
            step = max(1, CELLS // len(asked))
            for a in range(0, len(at), step):
                own = unit[a : a + step]
                score = asked @ own.T
                n = min(k, score.shape[1])
                low = np.maximum(floor, np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n] if n == k else -np.inf)
                q, v = np.nonzero(score >= low[:, None] - 1e-9)
                for s in range(0, len(q), 100_000):
                    qs, vs = q[s : s + 100_000], v[s : s + 100_000]
                    exact = (asked[qs] * own[vs]).sum(axis=1)
                    names = ids.take(pa.array(a + vs)).to_pylist()
                    for i in np.unique(qs).tolist():
                        lo, hi = np.searchsorted(qs, [i, i + 1])
                        best[i] = sorted([*best[i], *zip((-exact[lo:hi]).tolist(), map(_orderly, names[lo:hi]), names[lo:hi], strict=True)], key=lambda x: x[:2])[:k]
                        if len(best[i]) == k:
                            floor[i] = -best[i][-1][0]
        rows = [(i, x[2], -x[0]) for i, own in enumerate(best) for x in own]
        if rows:
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.float64())], ["q", "id", "score"])

    return run


def _orderly(x) -> tuple:
    """An id as something that sorts as Spark does: null first, structs by their fields."""
    return (0,) if x is None else (1, *map(_orderly, x.values())) if isinstance(x, dict) else (1, x)


def cosine_top(query: DataFrame, library: DataFrame, k: int = sm.TOP) -> DataFrame:
    """For each query vector (q_id, q_vec) the k nearest library vectors (id, vec): q_id, id, score, rank; ties go to the
    smaller id.

    Queries are a stated set, taken in blocks of a bounded size: a block is broadcast, each task keeps k for each of its
    queries by matrix products over its part of the library, and these meet once. Null vectors, zero and vectors that
    hold null or non-finite numbers take no part.
    """
    spark = query.sparkSession
    kinds = dict(library.dtypes) | dict(query.dtypes)
    out = spark.createDataFrame([], f"q_id {kinds['q_id']}, id {kinds['id']}, score double")
    lib = library.select("id", F.col("vec").cast("array<double>").alias("vec"))
    for ids, block in _blocks_of(query):
        held = spark.sparkContext.broadcast(block)
        names = spark.createDataFrame(list(enumerate(ids)), f"q int, q_id {kinds['q_id']}")
        out = out.unionByName(lib.mapInArrow(_best_of(held, k), f"q int, id {kinds['id']}, score double").join(F.broadcast(names), "q").select("q_id", "id", "score"))
    order = Window.partitionBy("q_id").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def all_matches(query: DataFrame, library: DataFrame, *, fallback: bool = True, vectors: DataFrame | None = None) -> DataFrame:
    """Literal matches and, for sentences without one, the fallback's."""
    if fallback and vectors is None:
        literal, top = literal_and_contained(query, library)
        return literal.unionByName(decided(top))
    literal = literal_matches(query, library)
    return literal.unionByName(fallback_matches(pending(query, literal), library, vectors)) if fallback else literal


def _order() -> tuple[Column, ...]:
    return F.col("sim").desc(), F.col("cos").desc(), F.col("min_block").asc_nulls_last(), F.col("doc_id"), F.col("s_idx")


def best_matches(matches: DataFrame) -> DataFrame:
    """One match for each query sentence: highest similarity, then cosine, then the order they were found in."""
    w = Window.partitionBy("q_doc", "q_idx").orderBy(*_order())
    return matches.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def evidence(matches: DataFrame, k: int = EVIDENCE) -> DataFrame:
    """The k best matches of each query sentence as an array, best first."""
    w = Window.partitionBy("q_doc", "q_idx").orderBy(*_order())
    top = matches.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    own = F.struct("rn", "doc_id", "s_idx", "s_display", "sim", "tier", "cos")
    return top.groupBy("q_doc", "q_idx").agg(F.array_sort(F.collect_list(own)).alias("evidence"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.bround(part / whole, 4)).otherwise(F.lit(0.0))


def source_stats(query: DataFrame, best: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """By query document and source: matched_chars, n_matches, ratio, rank (most characters first, then the source
    met first), name (the id where the library has none)."""
    q = query.select(F.col("doc_id").alias("q_doc"), F.col("idx").alias("q_idx"), F.char_length("norm").alias("chars"))
    body = q.groupBy("q_doc").agg(F.sum("chars").alias("body_chars"))
    x = best.join(q, ["q_doc", "q_idx"]).groupBy("q_doc", "doc_id").agg(F.sum("chars").alias("matched_chars"), F.count("*").alias("n_matches"), F.min("q_idx").alias("first"))
    x = x.join(body, "q_doc").withColumn("ratio", _ratio(F.col("matched_chars"), F.col("body_chars")))
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("q_doc").orderBy(F.col("matched_chars").desc(), "first")))
    if names is not None:
        x = x.join(names.select("doc_id", "name"), "doc_id", "left")
    else:
        x = x.withColumn("name", F.lit(None).cast("string"))
    return x.select("q_doc", "doc_id", F.coalesce("name", F.col("doc_id").cast("string")).alias("name"), "matched_chars", "n_matches", "ratio", "rank")


def summary(query: DataFrame, best: DataFrame) -> DataFrame:
    """By query document: body_chars, matched_chars, total_ratio, single_max_ratio, level."""
    q = query.select(F.col("doc_id").alias("q_doc"), F.col("idx").alias("q_idx"), F.char_length("norm").alias("chars"))
    x = q.join(best.select("q_doc", "q_idx", "doc_id"), ["q_doc", "q_idx"], "left")
    by = x.groupBy("q_doc", "doc_id").agg(F.sum("chars").alias("chars"))
    hit = F.when(F.col("doc_id").isNotNull(), F.col("chars")).otherwise(0)
    out = by.groupBy("q_doc").agg(F.sum("chars").alias("body_chars"), F.sum(hit).alias("matched_chars"), F.max(hit).alias("most"))
    out = out.withColumn("total_ratio", _ratio(F.col("matched_chars"), F.col("body_chars"))).withColumn("single_max_ratio", _ratio(F.col("most"), F.col("body_chars")))
    return out.select(F.col("q_doc").alias("doc_id"), "body_chars", "matched_chars", "total_ratio", "single_max_ratio", sm.level(F.col("total_ratio")).alias("level"))


def spans(matches: DataFrame) -> DataFrame:
    """Runs of matched sentences with gaps of two at most: q_doc, span, q_start, q_end, n_matches, matches, primary."""
    # rows of one sentence are peers: only the first of them may open a run, and all of them are in it
    w = Window.partitionBy("q_doc").orderBy("q_idx")
    new = F.coalesce((F.col("q_idx") - F.lag("q_idx").over(w) > SPAN_GAP).cast("int"), F.lit(0))
    runs = matches.withColumn("new", new).withColumn("span", F.sum("new").over(w)).drop("new")
    own = F.struct("q_idx", (-F.col("sim")).alias("less"), (-F.col("cos")).alias("far"), F.coalesce("min_block", F.lit(9)).alias("block"), "doc_id", "s_idx", "sim", "cos", "tier")
    best = F.struct((-F.col("sim")).alias("less"), (-F.col("cos")).alias("far"), "q_idx", "doc_id", "s_idx", "tier")
    x = runs.groupBy("q_doc", "span")
    return x.agg(F.min("q_idx").alias("q_start"), F.max("q_idx").alias("q_end"), F.count("*").alias("n_matches"), F.array_sort(F.collect_list(own)).alias("matches"), F.min(best).alias("primary"))


def chapter_heat(query: DataFrame, chaps: DataFrame, best: DataFrame) -> DataFrame:
    """By chapter: chars, hit_chars, ratio, color; chapters without a sentence stay, with zeros."""
    c = chaps.select(F.col("doc_id").alias("c_doc"), "ch_no", "title", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    hit = best.select(F.col("q_doc").alias("doc_id"), F.col("q_idx").alias("idx"), F.lit(1).alias("hit"))
    s = query.select("doc_id", "idx", "start", F.char_length("norm").alias("n")).join(hit, ["doc_id", "idx"], "left")
    inside = (F.col("doc_id") == F.col("c_doc")) & (F.col("start") >= F.col("c_start")) & (F.col("start") < F.col("c_end"))
    x = c.join(s, inside, "left").groupBy(F.col("c_doc").alias("doc_id"), "ch_no", "title", F.col("c_start").alias("start"))
    x = x.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("hit_chars"))
    return x.withColumn("ratio", _ratio(F.col("hit_chars"), F.col("chars"))).withColumn("color", sm.heat_color(F.col("ratio")))
