"""Quality rules whose thresholds adapt to language and source, by mergeable quantile sketches. Native only.

A sketch is a relation: counts of values in buckets that grow by a fixed ratio, for each language, source and
feature. Sketches merge by adding counts, so those of a language and of everything come from those of the groups;
counts do not depend on the order of the rows, so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _SPACES, prefix, stored, word_array

SYMBOLS = "#*$%&|<>"
#: Up to so many groups, a few megabytes, their thresholds are broadcast; beyond, documents are salted over so many places.
GROUPS, SALT = 20_000, 64


@dataclass(frozen=True)
class Rules:
    """``min_words`` and ``repeat_percent`` are the base rule. A document fails on a feature above
    median + ``spread`` * (upper quartile - median) + the feature's slack; the quantiles are those of the
    document's language and source, or of the language, whichever is the first with ``min_group`` documents that pass
    the base rule, or else of everything; a source's threshold exceeds its language's by the slack at
    most. ``ratio`` is the sketch's growth of buckets (relative error (ratio - 1) / 2), ``least`` its smallest value
    that counts as more than 0."""

    min_words: int = 50
    repeat_percent: int = 50
    spread: float = 6.0
    min_group: int = 100
    ratio: float = 1.04
    least: float = 1e-4
    slack: tuple[tuple[str, float], ...] = (("symbols", 0.03), ("upper", 0.12), ("dup_lines", 0.35), ("repeats", 0.3))


def _measures(df: DataFrame, text_col: str, p: str) -> DataFrame:
    """The base measures, as columns that start with ``p``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    drop = lambda c, chars: F.translate(c, chars, "")
    c = lambda name: F.col(p + name)
    bare = drop(text, " " + _SPACES)
    lines = F.filter(F.split(text, "\n"), lambda x: drop(x, " " + _SPACES) != "")
    df = df.select(
        "*",
        word_array(F.col(text_col)).alias(p + "words"),
        F.char_length(bare).cast("long").alias(p + "word_chars"),
        (F.char_length(text) - F.char_length(drop(text, SYMBOLS))).cast("long").alias(p + "n_symbols"),
        (F.char_length(bare) - F.char_length(drop(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).cast("long").alias(p + "upper"),
        lines.alias(p + "lines"),
    )
    # a window's hash chains those of its words: 64 bits, compared within one text only
    window = F.when(F.size(c("words")) >= 3, F.transform(F.sequence(F.lit(0), F.size(c("words")) - 3), lambda i: F.xxhash64(F.get(c("words"), i), F.get(c("words"), i + 1), F.get(c("words"), i + 2))))
    df = df.select("*", window.alias(p + "h"), F.size(c("words")).cast("long").alias(p + "n_words"), F.size(c("lines")).cast("long").alias(p + "n_lines"), (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long").alias(p + "n_dup_lines")).drop(p + "words", p + "lines")
    # only texts with an equal pair sort their windows
    again = F.size(F.array_distinct(c("h"))) < F.size(c("h"))
    df = df.select("*", F.when(again, F.sort_array(F.transform(c("h"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias(p + "s")).drop(p + "h")
    at = lambda i: F.get(c("s"), i)["x"]
    twice = F.filter(c("s"), lambda e, i: F.coalesce(at(i - 1) == e["x"], F.lit(False)) | F.coalesce(at(i + 1) == e["x"], F.lit(False)))
    starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(starts, zero, lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"), (i + 3).alias("end")), lambda a: a["n"])
    # the row number keeps filters above from being merged into these expressions, which would repeat them
    return df.select("*", F.coalesce(covered, F.lit(0).cast("long")).alias(p + "n_repeat_words"), F.monotonically_increasing_id().alias(p + "row")).drop(p + "s")


def _features(p: str) -> dict[str, Column]:
    c = lambda name: F.col(p + name).cast("double")
    over = lambda a, b: a / F.greatest(b, F.lit(1.0))
    return {"symbols": over(c("n_symbols"), c("word_chars")), "upper": over(c("upper"), c("word_chars")), "dup_lines": over(c("n_dup_lines"), c("n_lines")), "repeats": over(c("n_repeat_words"), c("n_words"))}


def _base_failed(p: str, rules: Rules) -> Column:
    n = F.col(p + "n_words")
    return (n < rules.min_words) | (100 * F.col(p + "n_repeat_words") > rules.repeat_percent * n)


def _group(lang: Column, source: Column) -> tuple[Column, Column]:
    """Never null: a null is a value of its own."""
    key = lambda c: F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))
    return key(lang), key(source)


def sketch(measured: DataFrame, rules: Rules, *, p: str = "", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The sketches of all groups: lang, source, feature, bucket, n. One partial aggregation, then one shuffle of
    bucket counts, whose number does not depend on the number of documents."""
    lang, source = _group(F.col(lang_col), F.col(source_col))
    features = F.array(*(F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in _features(p).items()))
    rows = measured.where(~_base_failed(p, rules) & (F.col(p + "row") >= 0)).select(lang.alias("lang"), source.alias("source"), F.explode(features).alias("f"))
    bucket = F.when(F.col("f.value") < rules.least, F.lit(0)).otherwise(F.ceil(F.log(F.col("f.value") / rules.least) / F.log(F.lit(rules.ratio))).cast("int") + 1)
    return rows.groupBy("lang", "source", F.col("f.feature").alias("feature"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def thresholds(sketches: DataFrame, rules: Rules) -> DataFrame:
    """lang, source, and an upper bound for each feature, for each group that the sketches have."""
    slack = F.element_at(F.create_map(*(F.lit(x) for kv in rules.slack for x in kv)), F.col("feature"))

    def bounds(keys: list[str], suffix: str) -> DataFrame:
        merged = sketches.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys, "feature")
        merged = merged.withColumn("below", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
        value = F.when(F.col("bucket") == 0, F.lit(0.0)).otherwise(rules.least * F.pow(F.lit(rules.ratio), F.col("bucket") - 1.5))
        q = lambda share: F.min(F.when(F.col("below") >= share * F.col("total"), value))
        out = merged.groupBy(*keys, "feature").agg(q(0.5).alias("mid"), q(0.75).alias("high"), F.max("total").alias("total"))
        enough = F.col("total") >= (rules.min_group if keys else 1)
        bound = F.when(enough, F.col("mid") + rules.spread * (F.col("high") - F.col("mid")) + slack)
        return out.select(*keys, "feature", bound.alias("bound" + suffix))

    own, lang, every = bounds(["lang", "source"], ""), bounds(["lang"], "_lang"), bounds([], "_all")
    x = own.join(lang, ["lang", "feature"]).join(every, "feature")
    wide = F.coalesce(F.col("bound_lang"), F.col("bound_all"))
    bound = F.coalesce(F.least(F.col("bound"), wide + slack), wide)
    return x.groupBy("lang", "source").agg(*(F.max(F.when(F.col("feature") == k, bound)).alias(f"max_{k}") for k, _ in rules.slack))


def judged(measured: DataFrame, limits: DataFrame, rules: Rules, *, p: str = "", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Join the thresholds to the documents and add base_failed and kept, with the prefix ``p``. A group without a
    threshold has no document that passes the base rule."""
    lang, source = _group(F.col(lang_col), F.col(source_col))
    limits = limits.select(F.col("lang").alias(p + "key_lang"), F.col("source").alias(p + "key_source"), *(F.col(f"max_{k}").alias(f"{p}max_{k}") for k, _ in rules.slack))
    limits = stored(limits, "limits")
    if limits.count() <= GROUPS:
        limits = F.broadcast(limits)
    else:
        # a group's documents are spread over some places, to each of which its limits go
        place = lambda c: F.pmod(c, F.lit(SALT)).cast("int")
        measured = measured.withColumn(p + "salt", place(F.xxhash64(p + "row")))
        limits = limits.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias(p + "key_salt"))
    same = (lang == F.col(p + "key_lang")) & (source == F.col(p + "key_source"))
    if p + "key_salt" in limits.columns:
        same = same & (F.col(p + "salt") == F.col(p + "key_salt"))
    x = measured.join(limits, same, "left").withColumn(p + "base_failed", _base_failed(p, rules))
    ok = ~F.col(p + "base_failed")
    for k, v in _features(p).items():
        ok = ok & F.coalesce(v <= F.col(f"{p}max_{k}"), F.lit(True))
    return x.withColumn(p + "kept", ok).drop(p + "key_lang", p + "key_source", p + "salt", p + "key_salt")


def measure(df: DataFrame, *, text_col: str = "text", prefix: str = "") -> DataFrame:
    """The rows with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and two helpers, upper and n_lines.

    A null or empty text has none of anything. Repeated windows of three words are found by sorting their hashes,
    in texts that have an equal pair only, so a text of n words costs n log n at most.
    """
    return _measures(df, text_col, prefix)


def assess(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", rules: Rules = Rules()) -> DataFrame:
    """A row for each document: its measures, base_failed, kept and the thresholds of its group.

    The measures are written to the shared folder once, without the texts, and read for the sketches and for the
    verdicts. Null languages and sources are groups of their own; equal rows are judged alike; an empty table gives
    an empty one; columns that the rule does not name play no part.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    measured = stored(_measures(rows, "text", "").drop("text"), "quality")
    limits = thresholds(sketch(measured, rules), rules)
    return judged(measured, limits, rules).drop("upper", "n_lines", "row")


def keep(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``df``, all columns as they are, without the documents that the rules reject. Rows and measures are
    written to the shared folder once; sketches read the measures only."""
    p = prefix(df, "q")
    measured = stored(_measures(df, text_col, p), "quality")
    limits = thresholds(sketch(measured, rules, p=p, lang_col=lang_col, source_col=source_col), rules)
    x = judged(measured, limits, rules, p=p, lang_col=lang_col, source_col=source_col)
    return x.where(p + "kept").select(*df.columns)
