"""Batch grading: papers by rubric, with a scorer that can be replaced; totals, bands, batch statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import grading as G
from ..functions import text as T
from ..sources.model import Pace, answers

RUBRIC = "ptype string, rubric_name string, dim_no int, name string, weight int, criteria string"
Scorer = Callable[[str], str]


def rubric(spark: SparkSession, config: dict) -> DataFrame:
    """{ptype: {"name": .., "dimensions": [{"name", "weight", "criteria"}]}} -> a row for each dimension. Weights of
    a type must add up to 100; white space in criteria is collapsed."""
    rows = []
    for ptype, r in config.items():
        dims = r["dimensions"]
        if sum(int(d["weight"]) for d in dims) != 100:
            raise ValueError(f"weights of {ptype} do not add up to 100")
        rows += [(ptype, r["name"], i, d["name"], int(d["weight"]), " ".join(str(d.get("criteria", "")).split())) for i, d in enumerate(dims)]
    return spark.createDataFrame(rows, RUBRIC)


def rubric_overview(dims: DataFrame) -> DataFrame:
    """A text for each type: its dimensions with weights and criteria."""
    line = F.concat(F.lit("- "), "name", F.lit("（"), F.col("weight").cast("string"), F.lit("）："), "criteria")
    x = dims.groupBy("ptype").agg(F.array_sort(F.collect_list(F.struct("dim_no", line.alias("line")))).alias("d"), F.sum("weight").alias("total_weight"))
    return x.select("ptype", F.array_join(F.transform("d", lambda x: x["line"]), "\n").alias("overview"), "total_weight")


def rubric_signature(dims: DataFrame) -> DataFrame:
    own = F.array_sort(F.collect_list(F.struct("dim_no", "name", "weight", "criteria")))
    return dims.groupBy("ptype").agg(F.substring(F.sha2(F.to_json(F.struct(F.first("rubric_name").alias("name"), own.alias("dims"))), 256), 1, 16).alias("rubric_sig"))


def paper_meta(papers: DataFrame) -> DataFrame:
    t = F.col("text")
    return papers.select("path", G.title(t).alias("title"), G.abstract(t).alias("abstract"), G.keywords(t).alias("keywords"), G.headings(t).alias("headings"), F.char_length(t).alias("n_chars"), G.paper_type(G.file_name(F.col("path"))).alias("ptype"))


def text_chunks(papers: DataFrame, size: int = G.CHUNK_CHARS) -> DataFrame:
    return papers.select("path", F.posexplode(G.chunks(F.col("text"), size)).alias("chunk_no", "chunk"))


def dimensions_of(papers: DataFrame, dims: DataFrame) -> DataFrame:
    """Each paper with the dimensions of its type."""
    return papers.withColumn("ptype", G.paper_type(G.file_name(F.col("path")))).join(F.broadcast(dims), "ptype")  # a few dozen rows


def mock_scores(papers: DataFrame, dims: DataFrame) -> DataFrame:
    """Deterministic scores by structure, without a model; the mock's evidence is quoted from the text. What depends on
    the text alone is worked out once for each paper, before it meets the dimensions."""
    text, path, dim = F.col("text"), F.col("path"), F.col("name")
    doubt = F.when(text.rlike(r"参考\s*文献"), "").otherwise("未识别到参考文献列表")
    own = papers.select("path", G.mock_bonus(text).alias("bonus"), G.quotable(text).alias("quotes"), doubt.alias("suspicions"))
    base = F.col("base")
    quoted = F.transform(G.mock_places(path, dim, F.size("quotes")), lambda i: F.get("quotes", i))
    x = dimensions_of(own, dims).withColumn("base", G.mock_base(path, dim))
    score = G.mock_score(base, F.col("bonus"))
    comment = G.mock_comment(dim, F.col("bonus"), score)
    return x.select("path", "ptype", "dim_no", "name", "weight", score.alias("score"), G.mock_confidence(base).alias("confidence"), quoted.alias("evidence"), comment.alias("comment"), "suspicions")


#: Asks of a model; each reply is the JSON that the prompt describes.
SYSTEM = "你是严谨的论文评阅人，只依据所给材料评分，只输出 JSON。"
_CHUNK_ASK = '请提炼这一部分，输出 JSON：{"summary": "要点", "strengths": ["亮点"], "weaknesses": ["问题"], "quotes": ["原文片段"]}'
_SCORE_ASK = '只评这一个维度，输出 JSON：{"score": 0, "confidence": 0.0, "evidence": ["原文摘录"], "comment": "评语", "suspicions": "学术规范问题，无则留空"}，score 为 0-100，confidence 为 0-1。'
_WHOLE_ASK = '请写综合意见，输出 JSON：{"overall_comment": "总评", "strengths": ["优点"], "improvements": ["建议"], "flags": ["风险"]}'


#: Papers that are worked on at a time, with a model and with the mock.
OPEN_CALLS, OPEN_MOCK_CALLS = 2, 4


def asked(df: DataFrame, prompt: Column, client: Callable[[], Scorer], *, redact_pii: bool = False, open_calls: int = OPEN_CALLS, gap: float = 0.0) -> DataFrame:
    """The rows with ``reply``, ``error`` and ``usage`` of one call for each. A task has up to ``open_calls`` calls open,
    each by a client of its own, and starts one every ``gap`` seconds at most; rows keep their order. A call that fails is
    a row with an error of 300 characters at most; nothing is raised. A null prompt is not asked."""
    keep = df.columns
    x = df.withColumn("prompt", G.redact(prompt) if redact_pii else prompt)
    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(gap) if gap else None
        for b in batches:
            made = list(answers(b["prompt"], client, open_calls=open_calls, pace=pace))
            yield b[keep].assign(reply=[a.reply for a in made], error=[a.error for a in made], usage=[a.usage for a in made])

    return x.mapInPandas(ask, f"{fields}, reply string, error string, usage struct<prompt_tokens: long, completion_tokens: long, requests: long>")


def observed(calls: DataFrame, name: str = "usage") -> tuple[DataFrame, Observation]:
    """The calls, and what they use as it is counted while they run: after the first action over the returned table,
    ``observation.get`` has prompt_tokens, completion_tokens, requests, calls and failed, without another pass."""
    seen = Observation(name)
    of = lambda field: F.coalesce(F.sum(F.col("usage")[field]), F.lit(0))
    fields = [of(f).alias(f) for f in ("prompt_tokens", "completion_tokens", "requests")]
    return calls.observe(seen, *fields, F.count("*").alias("calls"), F.count("error").alias("failed")), seen


def _read(x: DataFrame) -> DataFrame:
    """Adds ``json``; a reply without JSON is an error, unless there is one already or nothing was asked."""
    json = G.loose_json(F.col("reply"))
    unread = F.concat(F.lit("no JSON in reply: "), F.substring("reply", 1, 200))
    return x.withColumn("json", json).withColumn("error", F.coalesce("error", F.when(F.col("reply").isNotNull() & F.col("json").isNull(), unread)))


def model_scores(papers: DataFrame, dims: DataFrame, scorer: Callable[[], Scorer], *, redact_pii: bool = False, limit: int = G.FULLTEXT_CHARS + 6000) -> DataFrame:
    """Scores from a model, a row for each paper and dimension. An answer that fails or cannot be read becomes a row with
    ``error``. Where ``papers`` has ``notes`` (of :func:`map_chunks`), these and an excerpt stand for the text."""
    text = F.col("text")
    notes = F.col("notes") if "notes" in papers.columns else F.lit(None).cast("string")
    said = lambda c, none: F.when(F.coalesce(c, F.lit("")) == "", none).otherwise(c)
    frame = F.concat(F.lit("【提纲】"), said(F.array_join(G.headings(text), "、"), "无标题"), F.lit("\n【摘要】"), said(G.abstract(text), "无摘要"))
    whole = F.concat(frame, F.lit("\n【全文】\n"), F.substring(text, 1, limit))
    brief = F.concat(frame, F.lit("\n【分段记录】\n"), notes, F.lit("\n【原文节选】\n"), G.excerpt(text))
    own = papers.select("path", G.title(text).alias("title"), F.when(notes.isNotNull() & (notes != ""), brief).otherwise(whole).alias("content"))
    overview = F.broadcast(rubric_overview(dims).select("ptype", "overview"))  # a row for each type
    x = dimensions_of(own, dims).join(overview, "ptype")
    prompt = F.concat_ws("\n\n", "name", "criteria", F.concat(F.lit("论文《"), "title", F.lit("》")), "overview", "content", F.lit(_SCORE_ASK))
    keep = ["path", "ptype", "dim_no", "name", "weight"]
    made = _read(asked(x.select(*keep, prompt.alias("ask")), F.col("ask"), scorer, redact_pii=redact_pii))
    return made.withColumn("d", G.dimension(F.col("json"))).select(*keep, "d.*", "error", "usage")


def map_chunks(papers: DataFrame, client: Callable[[], Scorer], *, size: int = G.CHUNK_CHARS, limit: int = G.FULLTEXT_CHARS, redact_pii: bool = False) -> DataFrame:
    """Notes on long papers: path, notes (a line for each chunk, in order), n_chunks, error (the first chunk's that failed).
    Short papers have none."""
    long = text_chunks(papers.where(F.char_length("text") > limit), size)
    prompt = F.concat_ws("\n", F.format_string("第 %d 部分", F.col("chunk_no") + 1), "chunk", F.lit(_CHUNK_ASK))
    made = _read(asked(long.select("path", "chunk_no", prompt.alias("ask")), F.col("ask"), client, redact_pii=redact_pii))
    r = F.from_json("json", "summary string, strengths array<string>, weaknesses array<string>, quotes array<string>")
    some = lambda c, n: F.array_join(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n), "；")
    note = F.concat(F.format_string("[第%d部分] ", F.col("chunk_no") + 1), F.coalesce(r["summary"], F.lit("")), F.lit(" 亮点："), some(r["strengths"], 3), F.lit(" 问题："), some(r["weaknesses"], 3), F.lit(" 片段："), some(r["quotes"], 2))
    x = made.select("path", F.struct("chunk_no", F.coalesce(note, F.lit("")).alias("note")).alias("n"), F.when(F.col("error").isNotNull(), F.struct("chunk_no", "error")).alias("e"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("n")), lambda n: n["note"]), "\n")
    return x.groupBy("path").agg(joined.alias("notes"), F.count("*").alias("n_chunks"), F.min("e")["error"].alias("error"))


DIMENSION = "array<struct<dim_no:int,name:string,weight:int,score:double,confidence:double,evidence:array<string>,comment:string,suspicions:string>>"


def grade(papers: DataFrame, dims: DataFrame, client: Callable[[], Scorer], *, redact_pii: bool = False, size: int = G.CHUNK_CHARS, limit: int = G.FULLTEXT_CHARS, bands: tuple = G.BANDS) -> DataFrame:
    """Grade papers (path, text): notes on the chunks of long ones, a score for each dimension, the weighted total and a
    synthesis. One row for each paper: path, ptype, rubric_name, title, n_chars, total, band, confidence, dimensions,
    overall_comment, strengths, improvements, flags, error.

    A failed chunk or dimension makes the paper a row with ``error`` and no total, as does a type without a rubric; a
    failed synthesis costs the comment only. Paths should tell papers apart. Calls are made once in a plan without
    failures; store the result where it is used more than once.
    """
    text = F.col("text")
    notes = map_chunks(papers, client, size=size, limit=limit, redact_pii=redact_pii)
    x = papers.select("path", "text").join(notes.select("path", "notes", F.col("error").alias("note_error")), "path", "left")
    scores = model_scores(x.where("note_error is null"), dims, client, redact_pii=redact_pii, limit=limit + 6000)
    own = F.struct("dim_no", "name", F.col("weight").cast("int").alias("weight"), "score", "confidence", "evidence", "comment", "suspicions")
    failed = F.when(F.col("error").isNotNull(), F.struct("dim_no", "error"))
    by = scores.groupBy("path").agg(F.array_sort(F.collect_list(own)).alias("dimensions"), F.min(failed)["error"].alias("score_error"))
    names = F.broadcast(dims.groupBy("ptype").agg(F.first("rubric_name").alias("rubric_name")))
    x = x.select("path", G.title(text).alias("title"), F.char_length("text").alias("n_chars"), G.paper_type(G.file_name(F.col("path"))).alias("ptype"), F.substring("notes", 1, 3000).alias("notes"), "note_error")
    x = x.join(by, "path", "left").join(names, "ptype", "left")
    unread = F.when(F.col("rubric_name").isNull(), F.concat(F.lit("no rubric for type "), "ptype"))
    x = x.withColumn("error", F.coalesce("note_error", "score_error", unread))
    d, n = F.col("dimensions"), F.size("dimensions")
    weighted = F.aggregate(d, F.lit(0.0), lambda a, r: a + r["score"] * r["weight"])
    mean = F.aggregate(d, F.lit(0.0), lambda a, r: a + r["confidence"]) / n
    fine = F.col("error").isNull()
    x = x.withColumn("total", F.when(fine, F.bround(weighted / 100, 1))).withColumn("confidence", F.when(fine, F.bround(F.least(F.lit(1.0), mean), 2)))
    x = x.withColumn("band", F.when(fine, G.band(F.col("total"), bands)))
    lines = F.array_join(F.transform(d, lambda r: F.concat(r["name"], F.lit("："), r["score"].cast("string"), F.lit("（权重 "), r["weight"].cast("string"), F.lit("）"), F.substring(r["comment"], 1, 200))), "\n")
    prompt = F.when(fine, F.concat_ws("\n", F.concat(F.lit("论文《"), "title", F.lit("》"), "rubric_name"), lines, F.concat(F.lit("总分 "), F.col("total").cast("string"), F.lit(" "), "band"), "notes", F.lit(_WHOLE_ASK)))
    columns = ["path", "ptype", "rubric_name", "title", "n_chars", "total", "band", "confidence", "dimensions", F.col("error").alias("paper_error")]
    made = _read(asked(x.select(*columns, prompt.alias("ask")), F.col("ask"), client, redact_pii=redact_pii))
    r = F.from_json("json", "overall_comment string, strengths array<string>, improvements array<string>, flags array<string>")
    said = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda s: T.strip(s) != "")
    comment = F.when(F.col("error").isNotNull(), F.concat(F.lit("（综合评语生成失败，各维度评语仍有效）："), "error")).otherwise(T.strip(F.coalesce(r["overall_comment"], F.lit(""))))
    flags = G.review_flags(said(r["flags"]), F.col("confidence"))
    return made.select(*columns[:9], comment.alias("overall_comment"), F.slice(said(r["strengths"]), 1, 5).alias("strengths"), F.slice(said(r["improvements"]), 1, 5).alias("improvements"), F.coalesce(flags, F.array().cast("array<string>")).alias("flags"), F.col("paper_error").alias("error"))


def totals(scores: DataFrame) -> DataFrame:
    """By paper: total (weighted, one decimal), band, confidence (mean, two decimals), flags."""
    x = scores.groupBy("path", "ptype").agg(F.sum(F.col("score") * F.col("weight")).alias("s"), F.avg("confidence").alias("c"), F.count("*").alias("n_dims"))
    x = x.select("path", "ptype", F.bround(F.col("s") / 100, 1).alias("total"), F.bround(F.least(F.lit(1.0), F.col("c")), 2).alias("confidence"), "n_dims")
    return x.withColumn("band", G.band(F.col("total"))).withColumn("flags", G.review_flags(F.array().cast("array<string>"), F.col("confidence")))


def ranking(grades: DataFrame) -> DataFrame:
    """Papers with a total, highest first; failed ones follow. A total order: ties by path.

    Totals have one decimal, so there are about a thousand: how many papers stand above each is counted first, and
    papers are ordered among those of their total only."""
    # null totals come last; counts of totals are a thousand rows
    above = Window.orderBy(F.col("total").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    counts = grades.groupBy("total").agg(F.count("*").alias("n")).withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0)))
    counts = counts.select(F.col("total").alias("of_total"), "above")
    x = grades.join(F.broadcast(counts), F.col("total").eqNullSafe(F.col("of_total")))
    rank = F.row_number().over(Window.partitionBy("total").orderBy("path"))
    return x.withColumn("rank", (rank + F.col("above")).cast("int")).select(*grades.columns, "rank")


def batch_stats(grades: DataFrame) -> DataFrame:
    return grades.where("total is not null").agg(F.count("*").alias("n"), F.bround(F.avg("total"), 1).alias("average"), F.max("total").alias("highest"), F.min("total").alias("lowest"))


def band_distribution(grades: DataFrame) -> DataFrame:
    return grades.where("total is not null").groupBy("band").agg(F.count("*").alias("n"))


def detail(scores: DataFrame, ptype: str, names: list[str]) -> DataFrame:
    """A type's papers with its dimensions as columns."""
    return scores.where(F.col("ptype") == ptype).groupBy("path").pivot("name", names).agg(F.first("score"))


def failures(grades: DataFrame) -> DataFrame:
    return grades.where("error is not null").select(F.col("path").alias("文件名"), F.substring("error", 1, 300).alias("失败原因"))


def cached(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """The wanted papers with ``hit``: a cached grade without error whose signature agrees in every field; null
    agrees with null, a missing redaction flag is false."""
    fields = ["model", "mock", "ptype", "rubric_sig", "redact_pii", "size", "mtime"]
    own = lambda x: x.withColumn("redact_pii", F.coalesce("redact_pii", F.lit(False))).withColumn("mtime", F.col("mtime").cast("long"))
    c = own(cache.where("error is null")).select(F.col("key").alias("c_key"), *(F.col(f).alias("c_" + f) for f in fields), F.lit(True).alias("found")).distinct()
    same = F.col("key") == F.col("c_key")
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col("c_" + f))
    return own(wanted).join(c, same, "left").select(*wanted.columns, F.coalesce("found", F.lit(False)).alias("hit"))


def token_usage(calls: DataFrame) -> DataFrame:
    """What calls used: rows with ``usage``, as :func:`asked` gives them, or with its fields."""
    own = calls.select("usage.*") if "usage" in calls.columns else calls
    requests = F.coalesce(F.sum("requests"), F.lit(0)) if "requests" in own.columns else F.count("*")
    return own.agg(F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"), requests.alias("requests"))


def report_markdown(grades: DataFrame) -> DataFrame:
    """path, name and a Markdown report for each graded paper (rows of :func:`grade`, or any with its columns)."""
    text = lambda c: F.coalesce(c, F.lit(""))
    weak = F.when(F.col("confidence") < G.LOW_CONFIDENCE, "　⚠️ 建议人工复核").otherwise("")
    head = F.concat(
        F.lit("# 《"), F.when(text(F.col("title")) == "", F.col("path")).otherwise(F.col("title")), F.lit("》批改报告\n\n- **文件**："), "path",
        F.lit("\n- **论文类型**："), text(F.col("rubric_name")), F.format_string("\n- **总分**：**%.1f**（%s）", "total", "band"),
        F.format_string("\n- **评分置信度**：%.2f", "confidence"), weak, F.lit("\n- **篇幅**：约 "), F.col("n_chars").cast("string"), F.lit(" 字\n- **标记**："),
        F.when(F.size("flags") > 0, F.array_join("flags", "；")).otherwise("无"), F.lit("\n\n## 分维度评分\n\n| 维度 | 权重 | 得分 | 加权得分 | 置信度 |\n|---|---|---|---|---|\n"),
    )
    line = lambda d: F.format_string("| %s | %d | %.0f | %.1f | %.2f |\n", d["name"], d["weight"], d["score"], F.bround(d["score"] * d["weight"] / 100, 1), d["confidence"])
    rows = F.array_join(F.transform("dimensions", line), "")
    total = F.format_string("| **合计** | 100 | — | **%.1f** | — |\n\n", "total")

    def part(d: Column) -> Column:
        quoted = F.concat(F.lit("**原文证据**：\n"), F.array_join(F.transform(d["evidence"], lambda e: F.concat(F.lit("> "), e)), "\n"), F.lit("\n\n"))
        doubt = F.concat(F.lit("**⚠️ 学术规范提示**："), d["suspicions"], F.lit("\n\n"))
        said = F.when(text(d["comment"]) == "", "（无评语）").otherwise(d["comment"])
        return F.concat(F.format_string("### %s：%.0f 分\n\n", d["name"], d["score"]), said, F.lit("\n\n"), F.when(F.size(d["evidence"]) > 0, quoted).otherwise(""), F.when(text(d["suspicions"]) != "", doubt).otherwise(""))

    parts = F.array_join(F.transform("dimensions", part), "")
    listed = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"## {title}\n"), F.array_join(F.transform(c, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n"), F.lit("\n\n"))).otherwise("")
    whole = F.when(text(F.col("overall_comment")) != "", F.concat(F.lit("## 总评\n\n"), "overall_comment", F.lit("\n\n"))).otherwise("")
    page = F.concat(head, rows, total, parts, whole, listed("主要优点", F.col("strengths")), listed("修改建议", F.col("improvements")), F.date_format(F.current_timestamp(), "'---\n*生成时间：'yyyy-MM-dd HH:mm'*'"))
    name = F.concat(F.lit("批改报告__"), G.paper_key(F.col("path")), F.lit(".md"))
    return grades.where("error is null").select("path", name.alias("name"), page.alias("markdown"))


def graded(scores: DataFrame, papers: DataFrame, dims: DataFrame, *, bands: tuple = G.BANDS) -> DataFrame:
    """The columns of :func:`grade` from scores without a model, such as :func:`mock_scores`."""
    has = lambda c, none: F.col(c) if c in scores.columns else F.lit(none)
    own = F.struct("dim_no", "name", F.col("weight").cast("int").alias("weight"), "score", "confidence", "evidence", has("comment", "").alias("comment"), "suspicions")
    by = scores.groupBy("path").agg(F.array_sort(F.collect_list(own)).alias("dimensions"))
    t = totals(scores)
    names = F.broadcast(dims.groupBy("ptype").agg(F.first("rubric_name").alias("rubric_name")))
    text = papers.select("path", G.title(F.col("text")).alias("title"), F.char_length("text").alias("n_chars"))
    none = F.array().cast("array<string>")
    x = t.join(by, "path").join(names, "ptype", "left").join(text, "path")
    return x.select("path", "ptype", "rubric_name", "title", "n_chars", "total", G.band(F.col("total"), bands).alias("band"), "confidence", "dimensions", F.lit("").alias("overall_comment"), none.alias("strengths"), none.alias("improvements"), "flags", F.lit(None).cast("string").alias("error"))
