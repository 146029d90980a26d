"""Personal data by candidate gradient boosting. Native only.

Base rules find e-mail addresses, IP numbers, card and phone numbers. Beside them, generators of high recall propose
further spans, which may overlap: assignments of credentials, access keys, digit groups and spelled-out addresses.
Boosted trees over features of format and context score each proposal; those above a calibrated threshold are taken.
The trees are fitted on the driver, once in a session, on ``SAMPLE`` labelled strings that are made here from
templates; they are scored as CASE expressions.

Positions are code points. A pattern's matches come from regexp_extract_all, what lies between from split with the
same pattern, and their lengths add up to the positions.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.segment import starts
from .boosting import Model, fit
from .common import prefix

# The base patterns, written so that the engine neither recurses nor rescans: possessive repeats give what the plain
# ones give where nothing follows, and a start inside a run that has failed at its beginning is skipped.
_LOCAL = "A-Za-z0-9._%+-"
BASE = (
    ("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
#: What stands before a credential.
_NAME = r"[A-Za-z_][A-Za-z0-9_]++"
#: Kinds that the method adds, in the order of their generators.
ADDED = (
    ("credential", rf"(?<![A-Za-z0-9_]){_NAME}\x20?[=:]\x20?[^\x20\x09-\x0D\"',;|]{{4,}}+"),
    ("key", r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+"),
    ("number", r"(?<![0-9A-Za-z.,+])\(?[0-9]{2,5}\)?(?:[\x20./-]?[0-9]{2,6})++(?![0-9A-Za-z])"),
    ("address", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]{2,}+)++"),
)
KINDS = tuple(k for k, _ in BASE + ADDED)
#: Code points of context that a generator's features look at.
CONTEXT = 24
#: Rows of the labelled sample, whatever the corpus.
SAMPLE = 1600


def _found(text: Column, pattern: str, with_context: bool = False) -> Column:
    """All leftmost non-overlapping matches: array of (start, end, s), and the text before each if asked for."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    # the last gap has no match
    pairs = F.filter(F.arrays_zip(matches.alias("s"), gaps.alias("g")), lambda x: x["s"].isNotNull())

    def placed(x: Column, at: Column) -> Column:
        start = at + F.char_length(x["g"])
        own = [start.alias("start"), (start + F.char_length(x["s"])).alias("end"), x["s"].alias("s")]
        return F.struct(*own, *([F.right(x["g"], F.lit(CONTEXT)).alias("before")] if with_context else []))

    # in an array of one, so that the matches are found once
    return F.get(F.transform(F.array(pairs), lambda ps: F.zip_with(ps, starts(F.transform(ps, lambda x: F.char_length(x["g"]) + F.char_length(x["s"]))), placed)), F.lit(0))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right counts twice, less 9 if above 9."""
    n = F.char_length(digits)

    def add(a: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return a + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


_VALID = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: s.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)(?:\.|$)){4}$") & ~s.contains(".."),
    "card": lambda s: F.char_length(_digits(s)).between(12, 19) & _luhn(_digits(s)),
    "phone": lambda s: F.char_length(_digits(s)).between(9, 15),
}
_HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}


def _features(x: Column) -> list[Column]:
    """Format and context of one proposal (start, end, s, before)."""
    s, before = x["s"], F.lower(x["before"])
    n = F.char_length(s)
    count = lambda cls: F.char_length(F.regexp_replace(s, f"[^{cls}]", "")).cast("double")
    says = lambda c, pattern: F.when(c.rlike(pattern), 1.0).otherwise(0.0)
    value = F.regexp_replace(s, rf"^{_NAME}\x20?[=:]\x20?", "")
    mixed = F.char_length(F.regexp_replace(value, "[0-9]", "")).cast("long") * F.char_length(_digits(value))
    return [
        n.cast("double"),
        count("0-9"),
        count("A-Z"),
        count("a-z"),
        says(s, rf"^{_NAME}\x20?[=:]"),
        says(F.lower(s), r"^[a-z0-9_]*(passw|passwd|pwd|secret|token|api_?key|auth|credential)[a-z0-9_]*\x20?[=:]"),
        says(before, r"(passw|pwd|secret|token|key|credential)[a-z0-9_]*[\x20:=]*$"),
        says(before, r"(phone|tel|call|mobile|fax|ssn|social security|passport|account|iban|id)[a-z.]*[\x20:#=]*$"),
        says(s, r"[\[(](?:at|dot)[\])]"),
        says(s, r"^[A-Z0-9]{16,}$"),
        F.least(mixed, F.lit(400).cast("long")).cast("double"),
        says(s, r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
        says(s, r"^(?:19|20)[0-9]{2}[./-]|^[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}"),
    ]


def _proposals(text: Column) -> list[tuple[str, Column]]:
    """Each generator's spans, with context; only where a text can have any."""
    may = {"credential": text.rlike("[=:]"), "key": text.rlike(r"[A-Za-z0-9_/+-]{16}") & text.rlike("[0-9]"), "number": text.rlike("[0-9]{2}"), "address": text.rlike(r"[\[(]at[\])]")}
    none = F.array().cast("array<struct<start:int,end:int,s:string,before:string>>")
    return [(k, F.when(may[k], _found(text, p, True)).otherwise(none)) for k, p in ADDED]


def _sample() -> list[tuple[int, str]]:
    """Labelled strings; each has one proposal at least, and all its proposals share the label."""
    rnd = random.Random(17)
    pick = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    low, up, dig, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    word = lambda a=2, b=9: pick(low, rnd.randint(a, b))
    yes = [
        lambda: f"{rnd.choice(['password', 'passwd', 'pwd', 'secret', 'token', 'api_key', 'apikey', 'auth_token', 'db_password'])}{rnd.choice(['=', ': ', ' = ', ':'])}{pick(rnd.choice([hexa, low + dig, up + low + dig]), rnd.randint(8, 24))}",
        lambda: pick(up, 4) + pick(up + dig, 14) + pick(dig, 2),
        lambda: pick(low + up + dig, rnd.randint(28, 44)) + pick(dig, 3),
        lambda: f"{rnd.choice(['token', 'key', 'secret', 'api_key'])} = \"{pick(rnd.choice([hexa, low + up + dig]), rnd.randint(20, 44))}{pick(dig, 2)}\"",
        lambda: f"secret key {pick(low + up + dig, 24)}{pick(dig, 2)}",
        lambda: f"{pick(dig, 3)}-{pick(dig, 2)}-{pick(dig, 4)}",
        lambda: f"{rnd.choice(['call', 'phone', 'tel.', 'mobile', 'fax'])} {rnd.choice(['(' + pick(dig, 3) + ') ', pick(dig, 3) + '-', '0' + pick(dig, 3) + ' '])}{pick(dig, 3)}-{pick(dig, 4)}",
        lambda: f"{word()}{rnd.choice([' [at] ', '(at)', ' (at) '])}{word()}{rnd.choice([' [dot] ', '(dot)', '.'])}{rnd.choice(['com', 'org', 'net', 'example'])}",
    ]
    no = [
        lambda: f"{rnd.choice(['note', 'chapter', 'see', 'time', 'section', 'name', 'ratio', word()])}: {word(4, 12)}",
        lambda: f"{word()}={word(4, 12)}",
        lambda: f"{rnd.choice(['width', 'size', 'x', 'n', 'page', 'total'])}{rnd.choice(['=', ': '])}{pick(dig, rnd.randint(1, 4))}0000",
        lambda: pick(low, rnd.randint(16, 34)),
        lambda: pick(up, 1) + pick(low, rnd.randint(16, 34)),
        lambda: "-".join(word(3, 9) for _ in range(rnd.randint(3, 5))) + "-" + pick(low, 8),
        lambda: pick(up, rnd.randint(16, 26)),
        lambda: f"{word()}/{word(5, 9)}/{word(5, 9)}/{rnd.choice(['2019', '2021', '2024', '12', '7'])}",
        lambda: f"{rnd.choice(['19', '20'])}{pick(dig, 2)}{(sep := rnd.choice('-./'))}{rnd.choice(['01', '05', '11', '12'])}{sep}{pick('12', 1)}{pick(dig, 1)}",
        lambda: f"{pick('12', 1)}{pick(dig, 1)}.{rnd.choice(['01', '05', '11'])}.20{pick(dig, 2)}",
        lambda: f"{rnd.choice(['19', '20'])}{pick(dig, 2)}-{rnd.choice(['19', '20'])}{pick(dig, 2)}",
        lambda: f"{rnd.choice(['population', 'version', 'about', word()])} {pick(dig, rnd.randint(4, 7))}",
        lambda: f"{word()} {pick(dig, 2)} {pick(dig, 3)}",
        lambda: pick(dig, rnd.randint(10, 19)),
        lambda: f"{pick(dig, rnd.randint(10, 19))} {pick(dig, rnd.randint(10, 19))}",
    ]
    rows = []
    for i in range(SAMPLE):
        label = int(i % 2 == 0)
        made = rnd.choice(yes if label else no)()
        rows.append((label, f"{word()} {word()} {made} {word()} {word()}"))
    return rows


_MODEL: Model | None = None


def _fitted(spark: SparkSession) -> Model:
    rows = _sample()
    table = "\n".join(f"{label}{text}" for label, text in rows)
    lines = spark.range(1).select(F.explode(F.split(F.lit(table), "\n")).alias("line"))
    text = F.substr("line", F.lit(2))
    spans = F.flatten(F.array(*(x for _, x in _proposals(text))))
    x = lines.select(F.substr("line", F.lit(1), F.lit(1)).cast("int").alias("y"), F.explode(spans).alias("x"))
    made = x.select("y", F.array(*_features(F.col("x"))).alias("f")).collect()  # bounded by SAMPLE
    return fit(np.array([r["f"] for r in made]), np.array([r["y"] for r in made]))


def model(spark: SparkSession) -> Model:
    global _MODEL
    if _MODEL is None:
        _MODEL = _fitted(spark)
    return _MODEL


def find(df: DataFrame, *, text_col: str = "text", prefix: str = "") -> DataFrame:
    """The rows with ``base`` and ``spans``: arrays of (start, kind number, end), sorted; ``prefix`` stands before
    these names. ``spans`` holds the base spans and what the method adds.

    An added span that overlaps a base span is dropped; of overlapping added spans that pass the threshold, the
    more probable one stays (of equals the earlier, then the longer). A null text has no spans.
    """
    boosted = model(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = "array<struct<start:int,k:int,end:int>>"
    none = F.array().cast(kind)
    p = prefix
    base = []
    for k, (name, pattern) in enumerate(BASE):
        own = F.transform(_filtered(_found(text, pattern), _VALID[name]), _as_span(k))
        may = text.rlike("[0-9]") if name != "email" else text.contains("@")
        may = may & text.contains(_HINT[name]) if _HINT[name] and name != "email" else may
        base.append(F.when(may, own).otherwise(none))
    df = df.select("*", F.sort_array(F.flatten(F.array(*base))).alias(p + "base"))
    proposed = F.array().cast("array<struct<p:double,start:int,k:int,end:int>>")
    for k, (_, spans) in enumerate(_proposals(text), len(BASE)):
        proposed = F.concat(proposed, F.transform(spans, _scored(boosted, k)))
    df = df.select("*", F.filter(proposed, lambda x: x["p"] >= boosted.threshold).alias(p + "proposed"))
    overlap = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    clear = F.filter(p + "proposed", lambda x: ~F.exists(F.col(p + "base"), lambda b: overlap(x, b)))
    order = F.sort_array(F.transform(clear, lambda x: F.struct((-x["p"]).alias("p"), x["start"].alias("start"), (-x["end"]).alias("end"), x["k"].alias("k"))))
    span = lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), (-x["end"]).alias("end"))
    added = F.aggregate(order, none, lambda a, x: F.when(F.exists(a, lambda b: overlap(span(x), b)), a).otherwise(F.concat(a, F.array(span(x)))))
    added = F.when(F.size(p + "proposed") > 0, added).otherwise(none)
    return df.select("*", F.sort_array(F.concat(F.col(p + "base"), added)).alias(p + "spans")).drop(p + "proposed")


def _filtered(spans: Column, valid) -> Column:
    return F.filter(spans, lambda x: valid(x["s"]))


def _as_span(k: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"))


def _scored(boosted: Model, k: int):
    return lambda x: F.struct(boosted.column(_features(x)).alias("p"), x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["start"], x["end"])), ",")


def report(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added (spans of the
    other kinds) and n_spans. Null texts have none; equal rows and ids stay rows of their own; other columns play no part."""
    rows = find(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return rows.select("doc_id", *(count(k).alias(f"n_{name}") for k, (name, _) in enumerate(BASE)), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"), F.size("spans").cast("long").alias("n_spans"))


def redact(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with every span replaced by its kind in brackets; overlapping spans by one of the first's
    kind. Texts without spans, and null ones, stay as they are; so do all other columns."""
    p = prefix(df, "p")
    x = find(df, text_col=text_col, prefix=p)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text = F.col(text_col)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        kept = F.substr(text, a["at"] + 1, s["start"] - a["at"])
        fresh_span = F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(kept, F.get(names, s["k"]))).alias("out"))
        return F.when(s["start"] >= a["at"], fresh_span).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))

    clean = F.aggregate(F.col(p + "spans"), zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1)))
    return x.withColumn(text_col, F.when(F.size(p + "spans") > 0, clean).otherwise(text)).select(*df.columns)
