"""Spelling variants: near words of each word, found by pairless wildcard groups.

Leaving out one letter of a word gives a key: the place, what stands before it and what stands after it. Words of one key
differ by a replacement at that place, and a key's group keeps its size and its two foremost words only, as each member's
best other word is one of them. The same keys are the words with a letter deleted: where such a rest is a word itself, it
is near to the longer word. Sizes and best words of both kinds are combined word by word; no pair of words that differ by
a replacement is ever a row. Words go by their ranks, and keys by 128-bit hashes, so a long word costs no more than its
length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored
from .shingles import mix, slices

_U = np.uint64

#: Runs of these are words.
RUN = r"[A-Za-zÀ-ÿ]+"
#: Bytes of words whose keys are made at once.
_SLICE = 1 << 18
_NAMES = ["high", "low", "at", "first", "rank"]
_HIGH, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Spelling:
    """``letters``, ``times``: least code points and occurrences of a word. ``slips``: a run loses a letter where its
    crc32 with the document's id is divisible by this; 0: never. ``factor``: how much more frequent a word's form is."""

    letters: int = 7
    times: int = 2
    slips: int = 31
    factor: int = 10


def _without(word: Column, at: Column) -> Column:
    """The word without its code point at ``at`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def vocabulary(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", options: Spelling = Spelling()) -> DataFrame:
    """word, n: the words of all texts, slips made, that are long and frequent enough."""
    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.translate(F.col(text_col), _HIGH, _LOW).alias("text"))
    # a run that is one letter too short cannot become long enough by losing one
    runs = rows.select("key", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= options.letters)
    word = F.col("run")
    if options.slips:
        h = F.crc32(F.concat("key", F.lit(":"), "run").cast("binary"))
        word = F.when(h % options.slips == 0, _without(word, (h % F.length("run")).cast("int"))).otherwise(word)
    made = runs.select(word.alias("word")).where(F.length("word") >= options.letters)
    return made.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= options.times)


def _places(code: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    """Sums, from the first on, of a random number for each pair of code point and place."""
    return np.cumsum(mix(code.astype(np.uint64) + (place.astype(np.uint64) << _U(21)) + _U(seed)))


def hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of words: each word's hash (two columns of 64 bits), the hash of each word without each of its code
    points, one word after another, the places left out, and whether the code point before is another one.

    A hash is the sum of a random number for each code point and place, so all are had in one pass, however long a word.
    """
    size = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    code = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), "<u4")
    ends = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(len(code)) - np.repeat(ends[:-1], size)
    words, rests = [], []
    for seed in (1 << 60, 3 << 60):
        own, moved = (np.concatenate(([_U(0)], _places(code, x, seed))) for x in (at + 1, at))
        words.append(own[ends[1:]] - own[ends[:-1]])
        rests.append((own[:-1] - np.repeat(own[ends[:-1]], size)) + (np.repeat(moved[ends[1:]], size) - moved[1:]))
    first = np.ones(len(code), bool)
    first[1:] = (code[1:] != code[:-1]) | (at[1:] == 0)
    return np.stack(words), np.stack(rests), at, first


_KEYS = "high long, low long, at int, first boolean, rank long"


def _keys(words: DataFrame) -> DataFrame:
    """For each word (rank, word) a row with its hash (at null), and one for each place left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for piece in slices(batch.column(1), _SLICE):
                rank = np.asarray(batch.column(0).slice(done, len(piece)))
                done += len(piece)
                own, rest, at, first = hashes(piece)
                size = pc.utf8_length(piece).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in own), pa.nulls(len(piece), pa.int32()), pa.nulls(len(piece), pa.bool_()), pa.array(rank)], _NAMES)
                whole = pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in rest), pa.array(at, pa.int32()), pa.array(first), pa.array(np.repeat(rank, size))], _NAMES)
                for a in range(0, whole.num_rows, 100_000):
                    yield whole.slice(a, 100_000)

    return words.select("rank", "word").mapInArrow(run, _KEYS)


def _replaced(keys: DataFrame) -> DataFrame:
    """rank, near, best: of each word in each key's group of two or more, how many others and the foremost other."""
    group = Window.partitionBy("high", "low", "at")
    whole = group.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = [F.nth_value("rank", i).over(whole).alias(f"top{i}") for i in (1, 2)]
    own = keys.where("at is not null").select("rank", (F.count("*").over(group) - 1).alias("near"), *top).where("near > 0")
    return own.select("rank", "near", F.when(F.col("top1") == F.col("rank"), F.col("top2")).otherwise(F.col("top1")).alias("best"))


def _deleted(keys: DataFrame) -> DataFrame:
    """rank, near, best by insertions and deletions: for a word that is another's rest, all longer ones at once; for the
    longer word, the rest."""
    # letters of a run of equal ones leave the same rest; the first of them stands for all
    rests = keys.where("first").select("high", "low", F.col("rank").alias("longer"))
    pairs = rests.join(keys.where("at is null").select("high", "low", "rank"), ["high", "low"]).select("rank", "longer")
    up = pairs.groupBy("rank").agg(F.count("*").alias("near"), F.min("longer").alias("best"))
    down = pairs.select(F.col("longer").alias("rank"), F.lit(1).cast("long").alias("near"), F.col("rank").alias("best"))
    return up.unionByName(down)


def ranked(words: DataFrame) -> DataFrame:
    """rank, word, n: ranks, with gaps, put more frequent words first and equally frequent ones in code-point order."""
    ordered = words.select("word", "n").orderBy(F.desc("n"), "word")
    return stored(ordered.select(F.monotonically_increasing_id().alias("rank"), "word", "n"), "spelling-words")


def forms(words: DataFrame, options: Spelling = Spelling()) -> DataFrame:
    """rank, word, n, n_near, form_rank, form, form_n of ranked words."""
    keys = _keys(words)
    near = _replaced(keys).unionByName(_deleted(keys))
    near = near.groupBy("rank").agg(F.sum("near").alias("near"), F.min("best").alias("best"))
    best = words.select(F.col("rank").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    strong = F.col("best_n") >= options.factor * F.col("n")
    return words.join(near, "rank", "left").join(best, "best", "left").select(
        "rank", "word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), *(F.when(strong, F.col(c)).alias(to) for c, to in (("best", "form_rank"), ("best_word", "form"), ("best_n", "form_n")))
    )


def _roots(found: DataFrame) -> DataFrame:
    """rank, root (a rank) of the words that have a form. Ranks fall with each step, so chains end; each round halves
    their length."""
    roots = stored(found.where("form_rank is not null").select("rank", F.col("form_rank").alias("root")), "spelling-roots")
    while True:
        on = roots.select(F.col("rank").alias("root"), F.col("root").alias("next"))
        further = stored(roots.join(on, "root", "left").select("rank", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(roots)
        roots = further
        if roots.where("moved").isEmpty():
            return roots.select("rank", "root")


def variants(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", options: Spelling = Spelling()) -> DataFrame:
    """Words of all whole texts with their near words and forms.

    Words are runs of letters, A-Z lower-cased; where crc32 of ``<id>:<run>`` is divisible by ``options.slips``, the run
    loses the code point at crc32 modulo its length. A word is near another if one insertion, deletion or replacement of a
    code point turns one into the other. Its form is its near word of largest n (ties: the smallest), if that has
    ``options.factor`` times its n; its root is where the forms end, the word itself if it has none. Returns word, form,
    root, n, n_near, form_n, each word once. A null text has no words, a null id counts as empty text, rows with one id
    are separate texts, other columns play no part; without words the result is empty.
    """
    words = ranked(vocabulary(df, id_col=id_col, text_col=text_col, options=options))
    found = stored(forms(words, options), "spelling-forms")
    roots = _roots(found).join(words.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root").select("rank", "root_word")
    return found.join(roots, "rank", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
