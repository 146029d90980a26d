"""An inbox of papers: text, Word and PDF files that arrive are checked against a stored library, each content once.

Files come as a stream of whole binary files and are decoded in the micro-batch. What was checked before with the same
parameters, and whose report is still there, is answered from the stored reports. Reports, their table and the tasks'
events are all written in ways that a repeated micro-batch repeats without doubling.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import overlap, segment, store
from ..sources import files, named, sinks, tables
from .tasks import MOST

_BINARY = "path string, modificationTime timestamp, length long, content binary"
REPORTS = "query_sha256 string, params_key string, report_no string, name string, created_at timestamp, total_ratio double, single_max_ratio double, html_path string, summary_json string, n_sentences long"


def arrivals(spark: SparkSession, inbox: str, *, most: int = MOST) -> DataFrame:
    """A stream of whole files below ``inbox``, at most ``most`` in a batch: path, modificationTime, length, content."""
    return spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most).load(inbox)


def existing(rows: DataFrame, path_col: str) -> DataFrame:
    """The rows whose file is there, asked row by row in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            here = []
            for p in b.column(path_col).to_pylist():
                system, at = named.open_path(p) if p else (None, None)
                here.append(bool(system) and system.get_file_info(at).type == fs.FileType.File)
            yield b.filter(pa.array(here, pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


@dataclass(frozen=True)
class Inbox:
    """``kept``: the stored library. ``root``: below it are ``files`` (reports), ``reports`` (their table), ``answers`` and
    ``events`` (one folder for each batch). ``fallback``: whether sentences without a literal match are looked up by
    containment; part of the parameters that a report is reused for."""

    kept: store.SentenceStore
    root: str
    fallback: bool = True

    @property
    def spark(self) -> SparkSession:
        return self.kept.spark

    def reports(self) -> DataFrame:
        return tables.read(self.spark, f"{self.root}/reports", REPORTS)

    def answers(self) -> DataFrame:
        """A row for each file that arrived: path, query_sha256, params_key, report_no, total_ratio, cached, error."""
        return self.spark.read.parquet(f"{self.root}/answers")

    def events(self) -> DataFrame:
        """The files as tasks, for :func:`tesserae.streaming.tasks.changes`."""
        return self.spark.read.parquet(f"{self.root}/events")

    def _known(self, wanted: DataFrame) -> DataFrame:
        """Stored reports of (query_sha256, params_key) whose page still exists."""
        if not self.kept.folders.exists(f"{self.root}/reports"):
            return self.spark.createDataFrame([], REPORTS)
        return existing(tables.lookup(wanted, f"{self.root}/reports", "query_sha256", "params_key"), "html_path")

    def _held(self, df: DataFrame, work: str, label: str) -> DataFrame:
        """``df``, written below the batch's work folder and read again: plans stay small, lost executors cost little."""
        df.write.mode("overwrite").parquet(f"{work}/{label}")
        return self.spark.read.schema(df.schema).parquet(f"{work}/{label}")

    def _check(self, docs: DataFrame, params_key: str, work: str) -> DataFrame:
        """Reports (the table's columns, html) of documents: doc_id, query_sha256, name, text."""
        docs = self._held(docs, work, "docs")
        sents = self._held(overlap.fingerprinted(segment.sentences(docs)), work, "sentences")
        matches = self._held(self.kept.all_matches(sents, fallback=self.fallback), work, "matches")
        best, names = self._held(overlap.best_matches(matches), work, "best"), self.kept.names()
        chapters = self._held(overlap.chapter_heat(sents, segment.chapters(docs), best), work, "chapters")
        sources = overlap.source_stats(sents, best, names)
        found = overlap.summary(sents, best)
        no_words = docs.select("doc_id").join(found, "doc_id", "left_anti").select("doc_id", *(F.lit(v).cast(t).alias(c) for c, t, v in ((f.name, f.dataType, 0) for f in found.schema if f.name not in ("doc_id", "level"))), F.lit("低").alias("level"))
        found = found.unionByName(no_words)
        numbered = docs.select("doc_id", F.sha2("name", 256).alias("sha256"))
        found = self._held(found, work, "found")
        json = sinks.summary_json(found, sources, chapters, sha=numbered, params_key=params_key)
        json = self._held(json, work, "json")
        html = sinks.report_html(sents, sinks.hit_rows(best, overlap.evidence(matches), names), json, sources, chapters)
        x = docs.select("doc_id", "query_sha256", "name").join(found, "doc_id").join(json, "doc_id").join(html, "doc_id", "left")
        x = x.join(sents.groupBy("doc_id").agg(F.count("*").alias("n_sentences")), "doc_id", "left")
        page = F.concat(F.lit(f"{self.root}/files/查重报告__"), named.stem(F.col("name")), F.lit(".html"))
        return x.select(
            "query_sha256", F.lit(params_key).alias("params_key"), F.get_json_object("json", "$.report_no").alias("report_no"), "name", F.current_timestamp().alias("created_at"),
            "total_ratio", "single_max_ratio", page.alias("html_path"), F.col("json").alias("summary_json"), F.coalesce("n_sentences", F.lit(0)).cast("long").alias("n_sentences"), F.coalesce("html", F.lit("")).alias("html"),
        )

    def handle(self, batch: DataFrame, number: int) -> None:
        """Check one micro-batch of files and write what comes of it."""
        work = f"{self.root}/work/batch={number}"
        params_key = self.kept.params_key(self.fallback)
        name = F.regexp_extract("path", r"([^/]*)$", 1)
        own = batch.withColumn("relative", name).withColumn("suffix", F.lower(F.regexp_extract("relative", r"\.([^./]*)$", 1)))
        own = own.where(F.col("suffix").isin(*files.INDEX_SUFFIXES) & ~F.col("relative").rlike("^[~.]"))
        read = files.papers(files.admitted(own)).select("path", "text", "error")
        too_large = own.where(F.col("length") > files.MAX_BYTES).select("path", F.lit(None).cast("string").alias("text"), F.lit("the file is too large").alias("error"))
        papers = own.select("path", F.col("relative").alias("name"), F.sha2("content", 256).alias("query_sha256")).join(read.unionByName(too_large), "path")
        papers = self._held(papers.withColumn("params_key", F.lit(params_key)), work, "papers")
        fine = papers.where("error is null")
        wanted = fine.select("query_sha256", "params_key").distinct()
        known = self._held(self._known(wanted), work, "known")
        first = fine.groupBy("query_sha256").agg(F.min_by(F.struct("name", "text"), "path").alias("x")).join(known, "query_sha256", "left_anti")
        docs = first.select(F.xxhash64("query_sha256").alias("doc_id"), "query_sha256", "x.name", "x.text")
        made = self._held(self._check(docs, params_key, work), work, "made")
        named.write_check_reports(made.select("name", "html", F.col("summary_json").alias("json")), f"{self.root}/files")
        fresh = made.drop("html")
        tables.upsert(fresh, f"{self.root}/reports", "query_sha256", "params_key", order="created_at")
        columns = ("query_sha256", "report_no", "total_ratio", "single_max_ratio", "html_path")
        reports = known.select(*columns, F.lit(True).alias("cached")).unionByName(fresh.select(*columns, F.lit(False).alias("cached")))
        answers = papers.drop("text", "name").join(reports, "query_sha256", "left")
        answers.write.mode("overwrite").parquet(f"{self.root}/answers/batch={number}")
        self._log(self.spark.read.parquet(f"{self.root}/answers/batch={number}"), number)
        self.kept.folders.delete(work)

    def _log(self, answers: DataFrame, number: int) -> None:
        """The batch as events of tasks: each file is submitted, runs, and is done or failed."""
        step = lambda kind, said: F.struct(F.lit(kind).alias("kind"), said.alias("message"))
        end = F.when(F.col("error").isNull(), step("done", F.col("report_no"))).otherwise(step("error", F.col("error")))
        steps = F.array(step("submit", F.col("path")), step("running", F.lit("解析文档")), end)
        x = answers.select(F.lit("inbox").alias("desk"), F.substring(F.sha2("path", 256), 1, 12).alias("task_id"), F.posexplode(steps).alias("step", "e"))
        x = x.select("desk", "task_id", "e.kind", "e.message", F.current_timestamp().alias("at"), (F.lit(number).cast("long") * 3 + F.col("step")).alias("seq"))
        x.write.mode("overwrite").parquet(f"{self.root}/events/batch={number}")

    def watch(self, inbox: str, checkpoint: str, *, most: int = MOST, available_now: bool = True) -> StreamingQuery:
        """Check what arrives; with ``available_now`` what is there, then end."""
        w = arrivals(self.spark, inbox, most=most).writeStream.foreachBatch(lambda batch, number: self.handle(batch, number)).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if available_now else w).start()
