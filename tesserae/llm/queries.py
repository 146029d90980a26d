"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dedup, jaccard, katz, mixing, neighbours, pfor, pii, quality, ranking, search, sharding, spelling
from .common import read, shared_dir

#: Where the vocabulary files of public tokenizers lie; None: the installed package's own folder.
TOKENIZERS: str | None = None
SHARDS = 40


def tokenizer_path(name: str) -> str:
    import os

    import public_tokenizers

    return os.path.join(TOKENIZERS, name) if TOKENIZERS else public_tokenizers.path(name)


def op1_pfor_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write their ids in patched frame-of-reference blocks, read the files back."""
    out = shared_dir(spark, "pfor")
    files = pfor.write_ids(read(spark, sf_dir, "documents"), out, tokenizer_path("word_bpe_49k.json"))
    return pfor.read_ids(spark, out, files, with_ids=False)


def op2_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that occurred before, in an earlier document or earlier in the same one."""
    return dedup.find_repeats(read(spark, sf_dir, "documents"))


def op3_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole, in 40 shards of equal row counts; digests are taken from the sharded rows."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.shard(docs, SHARDS)
    text = F.coalesce(F.col("text"), F.lit(""))
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    import public_tokenizers

    return bpe.encode_bpe(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op5_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.report(read(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 3-word shingles at a similarity of 0.9."""
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op7_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a model of four fifths of them."""
    return katz.score(read(spark, sf_dir, "documents"))


def op8_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    made = quality.assess(read(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of the size of all documents takes of each."""
    return mixing.assign(read(spark, sf_dir, "documents"))


def op10_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of all other vectors for every vector whose id is divisible by 50."""
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from the preference pairs of labelled ones."""
    return ranking.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all documents for each benchmark item."""
    return search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return spelling.variants(read(spark, sf_dir, "documents"))


def katz_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op7's result what whole numbers say: tokens and known tokens of each document."""
    return op7_katz_scores(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")


def mixture_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op9's result what each source has, should give and gives: whole words, the target rounded."""
    made = op9_mixture(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "source").distinct(), "doc_id")
    near = F.abs(F.sum("taken") - F.max("target")) <= F.greatest(F.lit(2000.0), 0.05 * F.max("target"))
    return made.groupBy("source").agg(F.max("source_size").alias("source_size"), F.bround(F.max("target"), 3).alias("target"), near.alias("near"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pfor_blocks": op1_pfor_blocks,
    "op2_gear_chunks": op2_gear_chunks,
    "op3_hypergeometric_shards": op3_hypergeometric_shards,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_boosted_pii": op5_boosted_pii,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_katz_scores": op7_katz_scores,
    "op8_adaptive_quality": op8_adaptive_quality,
    "op9_mixture": op9_mixture,
    "op10_projected_neighbours": op10_projected_neighbours,
    "op11_bradley_terry": op11_bradley_terry,
    "op12_lexical_search": op12_lexical_search,
    "op13_spelling_variants": op13_spelling_variants,
    "katz_counts": katz_counts,
    "mixture_targets": mixture_targets,
}

_WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"
_BLANK = "regexp_replace({0}, '[\\x20\\x09-\\x0D]+', '', 'g')"
_OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM x a JOIN x b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 90 * (na + nb - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS o FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.o = e.a)
SELECT r.doc_id, any_value(len(s.s))::BIGINT AS n_shingles, min(o) AS component_id FROM r JOIN s ON s.doc_id = r.doc_id GROUP BY r.doc_id"""


def _op8() -> str:
    rules = quality.Rules()
    slack = " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.slack)
    bounds = lambda keys, s: f"""bd{s} AS (SELECT {keys} f, min(CASE WHEN below >= 0.5 * total THEN v END) AS mid, min(CASE WHEN below >= 0.75 * total THEN v END) AS high, max(total) AS total FROM (
  SELECT {keys} f, bucket, CASE WHEN bucket = 0 THEN 0.0 ELSE {rules.least} * pow({rules.ratio}, bucket - 1.5) END AS v,
  sum(n) OVER (PARTITION BY {keys} f ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY {keys} f) AS total FROM (SELECT {keys} f, bucket, sum(n) AS n FROM sk GROUP BY ALL)) GROUP BY ALL),
th{s} AS (SELECT {keys} f, mid, CASE WHEN total >= {rules.min_group if keys else 1} THEN mid + {rules.spread} * (high - mid) + CASE f {slack} END END AS bound FROM bd{s})"""  # noqa: E731
    return f"""
WITH d AS (SELECT doc_id, coalesce('v' || lang, 'n') AS lang, coalesce('v' || source, 'n') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS.format("text")} AS w, {_BLANK.format("text")} AS bare, list_filter(string_split(text, chr(10)), lambda x: {_BLANK.format("x")} <> '') AS lines FROM d),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w)),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM t, range(0, 3) AS z(o) WHERE c > 1 GROUP BY 1),
m AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(bare)::BIGINT AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
  length(bare) - length(regexp_replace(bare, '[A-Z]', '', 'g')) AS upper FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.repeat_percent} * n_words) AS base_failed,
  n_symbols / greatest(word_chars, 1) AS symbols, upper / greatest(word_chars, 1) AS upper_share, n_dup_lines / greatest(n_lines, 1) AS dup_lines, n_repeat_words / greatest(n_words, 1) AS repeats FROM m),
f AS (SELECT doc_id, lang, source, base_failed, unnest(['symbols', 'upper', 'dup_lines', 'repeats']) AS f, unnest([symbols, upper_share, dup_lines, repeats]) AS v FROM b),
sk AS (SELECT lang, source, f, CASE WHEN v < {rules.least} THEN 0 ELSE ceil(ln(v / {rules.least}) / ln({rules.ratio}))::INT + 1 END AS bucket, count(*) AS n FROM f WHERE NOT base_failed GROUP BY ALL),
{bounds("lang, source,", "")},
{bounds("lang,", "_lang")},
{bounds("", "_all")},
q AS (SELECT t.lang, t.source, t.f, coalesce(CASE WHEN t.bound IS NOT NULL THEN least(t.bound, coalesce(l.bound, a.bound) + CASE t.f {slack} END) END, l.bound, a.bound) AS hi
  FROM th t JOIN th_lang l ON l.lang = t.lang AND l.f = t.f JOIN th_all a ON a.f = t.f),
v AS (SELECT f.doc_id, bool_and(coalesce(f.v <= q.hi, true)) AS fine FROM f LEFT JOIN q ON q.lang = f.lang AND q.source = f.source AND q.f = f.f GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fine AS kept FROM b JOIN v USING (doc_id)"""


_LOWERED = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWERED.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_OP12 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS t FROM documents),
k AS (SELECT doc_id, r, len(t) AS n FROM d WHERE len(t) > 0),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM k),
p AS (SELECT r, g, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS g FROM d) GROUP BY ALL),
f AS (SELECT g, count(*) AS df FROM p GROUP BY g),
i AS (SELECT item_id, r, g, count(*) AS times FROM (SELECT item_id, row_number() OVER () AS r, unnest({_TERMS}) AS g FROM benchmark) GROUP BY ALL),
w AS (SELECT i.*, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM i JOIN f USING (g), c),
s AS (SELECT w.item_id, w.r AS item, k.doc_id, k.r, sum(w.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 75 + ((75 * k.n * docs) // terms)))))::BIGINT AS score
  FROM w JOIN p USING (g) JOIN k ON k.r = p.r, c GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""

#: crc32 of a text of one-byte characters and those of Latin-1, which UTF-8 writes in two bytes: {0}.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}, ''), lambda c: CASE WHEN c = '' THEN [] WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
  ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64]::BIGINT[] END))),
  lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
_OP13 = f"""
WITH RECURSIVE r AS (SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWERED.format("text")}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, times, {_CRC.format("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM r),
v AS (SELECT word, sum(times)::BIGINT AS n FROM (SELECT times, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
k AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
d AS (SELECT DISTINCT word, n, rest FROM k),
e AS (SELECT a.word, b.word AS near, b.n AS near_n FROM k a JOIN k b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.rest UNION ALL SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.rest),
b AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS best, max(near_n) AS best_n FROM e GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * v.n THEN best END AS form, CASE WHEN best_n >= 10 * v.n THEN best_n END AS form_n FROM v LEFT JOIN b USING (word)),
c AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word AND c.next IS NULL"""

_COUNTS = f"""
WITH d AS (SELECT doc_id, {_CRC.format("coalesce(doc_id::VARCHAR, '')")} % 5 = 1 AS held_out, {_WORDS.format(_LOWERED.format("text"))} AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(list_concat(w, ['\n'])) AS g FROM d),
k AS (SELECT DISTINCT g FROM t WHERE NOT held_out), n AS (SELECT count(*) AS n FROM t WHERE NOT held_out)
SELECT doc_id, held_out, count(*) AS n_tokens, count(k.g) AS n_known, any_value(n.n) AS train_tokens FROM t LEFT JOIN k USING (g), n GROUP BY doc_id, held_out"""
_TARGETS = f"""
WITH s AS (SELECT source, sum(len({_WORDS.format("coalesce(text, '')")}))::BIGINT AS size FROM documents GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1)::INT % 3 + 1] AS w FROM s),
r AS (SELECT *, 3 * size / w AS full_at, sum(size) OVER () AS total FROM w),
c AS (SELECT *, (total - coalesce(sum(3 * size) OVER (ORDER BY full_at, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY full_at, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
l AS (SELECT arg_min(level, full_at) FILTER (full_at >= level) AS level FROM c)
SELECT source, size AS source_size, round_even(least(3.0 * size, c.w * l.level), 3) AS target, true AS near FROM c, l"""


ORACLE_SQL: dict[str, str] = {"katz_counts": _COUNTS, "mixture_targets": _TARGETS, "op6_jaccard_join": _OP6, "op8_adaptive_quality": _op8(), "op12_lexical_search": _OP12, "op13_spelling_variants": _OP13}
