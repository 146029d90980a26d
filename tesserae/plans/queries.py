"""The library's own operators as queries over whole tables: the benchmark's items are checked against documents."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embedding
from ..functions import fingerprint as fp
from ..functions import grading as G
from ..functions import text as T
from ..operators import grading, library, overlap, segment, store
from ..sources import folders, tables
from ..streaming import tasks

RUBRIC = {
    "course": {
        "name": "course paper",
        "dimensions": [
            {"name": "topic", "weight": 20, "criteria": "clear topic"},
            {"name": "content", "weight": 25, "criteria": "sound content"},
            {"name": "argument", "weight": 25, "criteria": "sound argument"},
            {"name": "structure", "weight": 15, "criteria": "clear structure"},
            {"name": "writing", "weight": 15, "criteria": "clear writing"},
        ],
    }
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


def lib(spark: SparkSession, d: str) -> DataFrame:
    return overlap.fingerprinted(segment.sentences(docs(spark, d)))


def asked(spark: SparkSession, d: str) -> DataFrame:
    return overlap.fingerprinted(segment.sentences(items(spark, d)))


def papers(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")


def rubric(spark: SparkSession) -> DataFrame:
    return grading.rubric(spark, RUBRIC)


# ---- sentences and fingerprints ----


def doc_sentences(spark, d):
    return segment.sentences(docs(spark, d)).select("doc_id", "idx", "norm", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


def normalize_text(spark, d):
    n = T.normalize(F.col("text"))
    return docs(spark, d).select("doc_id", F.md5(n).alias("norm_md5"), F.char_length(n).alias("norm_chars"))


def body_chars(spark, d):
    return segment.body_chars(segment.sentences(docs(spark, d))).select("doc_id", "body_chars", "n_sentences")


def ref_cut(spark, d):
    with_refs = F.concat("text", F.lit("\n  References \n[1] "), "source", F.lit("\n"))
    return table(spark, d, "documents").select("doc_id", segment.excluded_chars(with_refs).alias("excluded_ref_chars"))


def char_bigrams(spark, d):
    return overlap.bigram_counts(segment.sentences(docs(spark, d)))


def fnv1a64_bigrams(spark, d):
    return char_bigrams(spark, d).select("bigram", fp.fnv1a_hex("bigram").alias("fnv"))


def sentence_simhash(spark, d):
    return lib(spark, d).select("norm", "fp").distinct()


def lsh_blocks(spark, d):
    own = sentence_simhash(spark, d).where("fp <> 0")
    return own.select("norm", F.posexplode(fp.blocks(F.col("fp"))).alias("block_idx", "block_key"))


def bucket_histogram(spark, d):
    # normal forms are told apart by fingerprint and hash, so their texts are not moved
    own = lib(spark, d).where("fp <> 0").select(F.xxhash64("norm").alias("form"), "fp").distinct()
    return own.select(F.posexplode(fp.blocks(F.col("fp"))).alias("block_idx", "block_key")).groupBy("block_idx", "block_key").agg(F.count("*").alias("n"))


def lsh_candidates(spark, d):
    return overlap.candidates(asked(spark, d), lib(spark, d)).select("q_norm", "norm", "distance", "min_block")


# ---- matches and roll-ups ----


def edit_matches(spark, d):
    return overlap.literal_pairs(asked(spark, d), lib(spark, d)).select("q_norm", "norm", "d", "m", "sim", "tier")


def tier_histogram(spark, d):
    return overlap.literal_matches(asked(spark, d), lib(spark, d)).groupBy("tier").agg(F.count("*").alias("n"), F.countDistinct("q_doc", "q_idx").alias("sentences"))


def containment_top3(spark, d):
    _, x = overlap.literal_and_contained(asked(spark, d), lib(spark, d))
    return x.select("q_doc", "q_idx", "doc_id", "s_idx", F.bround("score", 6).alias("score"), "rank")


def _matches(spark, d):
    q, s = asked(spark, d), lib(spark, d)
    return q, overlap.all_matches(q, s)


def fallback_matches(spark, d):
    _, top = overlap.literal_and_contained(asked(spark, d), lib(spark, d))
    x = overlap.decided(top)
    return x.select("q_doc", "q_idx", "doc_id", "s_idx", "tier", F.col("cos").alias("contain"))


def best_match(spark, d):
    _, m = _matches(spark, d)
    return overlap.best_matches(m).select("q_doc", "q_idx", "doc_id", "s_idx", "sim", "tier")


def check_summary(spark, d):
    q, m = _matches(spark, d)
    return overlap.summary(q, overlap.best_matches(m))


def source_stats(spark, d):
    q, m = _matches(spark, d)
    return overlap.source_stats(q, overlap.best_matches(m)).select("q_doc", "doc_id", "name", "matched_chars", "n_matches", "ratio", "rank")


def match_spans(spark, d):
    _, m = _matches(spark, d)
    return overlap.spans(m).select("q_doc", "span", "q_start", "q_end", "n_matches")


def evidence_top3(spark, d):
    _, m = _matches(spark, d)
    return overlap.evidence(m).select("q_doc", "q_idx", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["doc_id"].cast("string"), e["s_idx"].cast("string"), e["tier"])), ",").alias("evidence"))


def chapter_heat(spark, d):
    """Items stand in a part of their own, before a part without a source; chapters reach to the next heading."""
    closing = F.concat(F.lit("\n## part two\nThis closing line of number "), F.col("doc_id").cast("string"), F.lit(" has no source anywhere."))
    own = items(spark, d).withColumn("text", F.concat(F.lit("## part one\n"), "text", closing))
    q, s = overlap.fingerprinted(segment.sentences(own)), lib(spark, d)
    heat = overlap.chapter_heat(q, segment.chapters(own, scope="section"), overlap.best_matches(overlap.all_matches(q, s)))
    return heat.select("doc_id", "ch_no", "title", "chars", "hit_chars", "ratio", "color")


def cosine_top3(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
    return overlap.cosine_top(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))).select("q_id", "id", F.bround("score", 6).alias("score"), "rank")


class _Letters:
    """A stand-in for a sentence encoder: how often each letter occurs."""

    def encode(self, texts):
        return np.array([[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], float)


def vector_matches(spark, d):
    """The fallback by vectors, of sentences that no fingerprint has matched."""
    q, s = asked(spark, d), lib(spark, d)
    rest = overlap.pending(q, overlap.literal_matches(q, s))
    vectors = embedding.vectors(lambda: embedding.from_encoder(_Letters()), rest, s)
    x = overlap.fallback_matches(rest, s, vectors)
    return x.select("q_doc", "q_idx", "doc_id", "s_idx", "tier", "cos")


# ---- library ----


def _files(spark, d):
    return library.with_sha(docs(spark, d))


def library_dedup(spark, d):
    known = library.with_sha(items(spark, d))
    return library.new_documents(_files(spark, d), known, order_col="doc_id").select("doc_id", "sha256")


def known_doc_skip(spark, d):
    first = _files(spark, d)
    known = library.with_sha(table(spark, d, "documents").where("lang = 'de'").select("text"))
    return first.join(known.select("sha256").distinct(), "sha256", "left_anti").select("doc_id", "sha256")


def library_stats(spark, d):
    return library.stats(table(spark, d, "documents").select("n_chars"), segment.sentences(docs(spark, d)))


def library_text(spark, d):
    x = library.source_text(segment.sentences(docs(spark, d)))
    return x.select("doc_id", F.md5("text").alias("text_md5"))


def params_key(spark, d):
    s = library_stats(spark, d)
    return s.select(library.params_key(F.lit(True), F.col("documents"), F.col("n_chars"), F.col("sentences")).alias("params_key"))


def _reports(spark, d):
    """Events as reports: the user is the query, the type the parameters."""
    return table(spark, d, "events").select(F.concat(F.lit("R"), F.pmod("event_id", F.lit(500)).cast("string")).alias("report_no"), F.sha2(F.col("user_id").cast("string"), 256).alias("query_sha256"), F.col("event_type").alias("params_key"), F.struct(F.col("ts"), F.col("event_id")).alias("created_at"), "event_id", "value")


def report_cache_latest(spark, d):
    r = _reports(spark, d)
    wanted = r.select("query_sha256", "params_key").distinct()
    return library.cached_reports(wanted, r).select("query_sha256", "params_key", "event_id", "value")


def report_latest_wins(spark, d):
    return library.latest_reports(_reports(spark, d)).select("report_no", "event_id")


def task_retention(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts")).first()[0]
    return library.live_tasks(e, F.lit(now)).select("event_id", "ts")


def stored_matches(spark, d):
    """The library is stored in two batches, documents in English first, and the items are checked against the store."""
    kept = store.temporary(spark)
    files = table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("name"), "text", F.coalesce(F.col("lang") == "en", F.lit(False)).alias("first"))
    for own in (files.where("first"), files.where("not first")):
        kept.append(own.select("name", "text"))
    found = kept.literal_matches(asked(spark, d))
    return found.groupBy("q_doc", "q_idx").agg(F.max("sim").alias("sim"), F.count("*").alias("n_matches"), F.countDistinct("doc_id").alias("n_sources"))


def report_upserts(spark, d):
    """Events as reports that arrive in three batches; each replaces the stored ones of its numbers."""
    path, r = folders.work_dir(spark, "reports"), _reports(spark, d).select("report_no", "query_sha256", "event_id", "value")
    for day in (F.col("event_id") % 3 == 0, F.col("event_id") % 3 == 1, F.col("event_id") % 3 == 2):
        tables.upsert(r.where(day), path, "report_no", order="event_id")
    return tables.read(spark, path).select("report_no", "query_sha256", "event_id", "value")


def task_states(spark, d):
    """Events as the life of tasks: a desk for each type, a task for each of its users, kept a day."""
    kind = F.element_at(F.array(*map(F.lit, ("submit", "running", "done", "error"))), (F.col("event_id") % 4 + 1).cast("int"))
    e = table(spark, d, "events").select(F.col("event_type").alias("desk"), F.col("user_id").alias("task_id"), kind.alias("kind"), F.col("value").alias("message"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    now = tasks.current(tasks.changes(e, tasks.Desk(ttl=86_400)))
    return now.select("desk", "task_id", "status", "stage", "pct", "seq", F.unix_micros("created").alias("created_us"))


# ---- grading ----


def pii_redaction(spark, d):
    n = G.redact(F.col("text"))
    return docs(spark, d).select("doc_id", F.md5(n).alias("redacted_md5"), F.char_length(n).alias("redacted_chars"))


def paper_meta(spark, d):
    """Documents with an abstract and keywords before them, under names of three types."""
    n = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("毕业论文-"), n)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("journal-"), n)).otherwise(n)
    said = F.concat(F.lit("摘要：本文第 "), n, F.lit(" 号材料研究河流沉积物的来源与搬运过程，比较三种取样方法，讨论潮汐对河口盐度分布的影响及其多年变化，并给出误差的估计。\n关键词：河流；沉积；编号"), n, F.lit("\n"))
    own = docs(spark, d).select(F.concat(name, F.lit(".txt")).alias("path"), F.concat(said, "text").alias("text"))
    return grading.paper_meta(own).select("path", "title", "abstract", "keywords", F.size("headings").alias("n_headings"), "n_chars", "ptype")


def text_chunks(spark, d):
    paragraphs = papers(spark, d).withColumn("text", F.regexp_replace("text", "\n", "\n\n"))
    return grading.text_chunks(paragraphs, 1000).select("path", "chunk_no", F.char_length("chunk").alias("chars"), F.md5("chunk").alias("chunk_md5"))


def sample_excerpt(spark, d):
    return papers(spark, d).select("path", F.md5(G.excerpt(F.col("text"))).alias("excerpt_md5"))


def mock_scores(spark, d):
    x = grading.mock_scores(papers(spark, d), rubric(spark))
    return x.select("path", "name", "score", "confidence", F.array_join("evidence", "|").alias("evidence"), "comment", "suspicions")


def _scores(spark, d):
    return grading.mock_scores(papers(spark, d), rubric(spark))


def weighted_totals(spark, d):
    return grading.totals(_scores(spark, d)).select("path", "total", "band", "confidence", F.array_join("flags", "|").alias("flags"))


def band_distribution(spark, d):
    return grading.band_distribution(grading.totals(_scores(spark, d)))


def batch_stats(spark, d):
    return grading.batch_stats(grading.totals(_scores(spark, d)))


def grade_pivot(spark, d):
    names = [x["name"] for x in RUBRIC["course"]["dimensions"]]
    return grading.detail(_scores(spark, d), "course", names)


def grade_ranking(spark, d):
    return grading.ranking(grading.totals(_scores(spark, d))).select("path", "total", "rank")


def low_confidence_flags(spark, d):
    x = grading.totals(_scores(spark, d).withColumn("confidence", F.col("confidence") - 0.2))
    return x.where(F.size("flags") > 0).select("path", "confidence")


def loose_json_scores(spark, d):
    """Events' JSON, plain and inside prose, read as replies."""
    e = table(spark, d, "events")
    said = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("Here it is: "), "props", F.lit(" - done")))
    return e.select("event_id", G.loose_json(said).alias("json")).where("json is not null").select("event_id", F.md5("json").alias("json_md5"))


def cache_validity(spark, d):
    """Documents as papers' signatures: the cached grades of some are of another size or have failed."""
    o = table(spark, d, "documents")
    sig = lambda x: x.select(F.col("doc_id").cast("string").alias("key"), F.col("lang").alias("model"), F.lit(True).alias("mock"), F.lit("course").alias("ptype"), F.lit("r").alias("rubric_sig"), F.lit(False).alias("redact_pii"), F.col("n_chars").alias("size"), F.lit(1).alias("mtime"))
    old = sig(o).withColumn("error", F.when(F.col("size") % 5 == 0, "failed")).withColumn("size", F.when(F.col("size") % 3 == 0, -1).otherwise(F.col("size")))
    return grading.cached(sig(o), old).groupBy("hit").agg(F.count("*").alias("n"))


def _replies():
    """A client that answers by what a prompt asks for: dimensions score by their place, ten more where notes stand for the
    text."""
    names = [x["name"] for x in RUBRIC["course"]["dimensions"]]

    def answer(prompt: str) -> str:
        if '"summary"' in prompt:
            return json.dumps({"summary": "part", "strengths": ["s"], "weaknesses": ["w"], "quotes": ["q"]})
        if '"overall_comment"' in prompt:
            return "Here: " + json.dumps({"overall_comment": " read ", "strengths": ["s"], "improvements": ["i", " "], "flags": []})
        by_notes = "【分段记录】" in prompt
        return json.dumps({"score": 60 + 5 * names.index(prompt.split("\n")[0]) + 10 * by_notes, "confidence": 0.5 if by_notes else 0.9, "evidence": ["e"], "comment": "c", "suspicions": ""})

    return answer


def grade_replies(spark, d):
    """All documents graded by scripted replies; those of more than 3,000 characters by notes on their parts."""
    x = grading.grade(papers(spark, d), rubric(spark), lambda: _replies(), limit=3000)
    return x.select("path", "n_chars", "total", "band", "confidence", F.size("dimensions").alias("n_dims"), "overall_comment", F.array_join("improvements", "|").alias("improvements"), F.array_join("flags", "|").alias("flags"), "error")


QUERIES = {
    f.__name__: f
    for f in (
        doc_sentences, normalize_text, body_chars, ref_cut, char_bigrams, fnv1a64_bigrams, sentence_simhash, lsh_blocks, bucket_histogram, lsh_candidates,
        edit_matches, tier_histogram, containment_top3, fallback_matches, best_match, check_summary, source_stats, match_spans, evidence_top3, chapter_heat, cosine_top3, vector_matches,
        library_dedup, known_doc_skip, library_stats, library_text, params_key, report_cache_latest, report_latest_wins, task_retention, stored_matches, report_upserts, task_states,
        pii_redaction, paper_meta, text_chunks, sample_excerpt, mock_scores, weighted_totals, band_distribution, batch_stats, grade_pivot, grade_ranking, low_confidence_flags, loose_json_scores, cache_validity, grade_replies,
    )
}
