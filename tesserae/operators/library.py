"""The library of known documents, and the store of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import overlap, segment

HEADER_TTL = 7200
MAX_TASKS = 20


def with_sha(files: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds sha256 of the content; null content counts as empty."""
    return files.withColumn("sha256", F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def new_documents(files: DataFrame, known: DataFrame, *, order_col: str) -> DataFrame:
    """Files whose content the library lacks: the first of each content in ``order_col``. Digests are aggregated before
    they move, so a content that occurs very often gathers nowhere."""
    first = files.groupBy("sha256").agg(F.min(order_col).alias("first_of_content")).join(known.select("sha256"), "sha256", "left_anti")
    x = files.join(first.withColumnRenamed("sha256", "sha_of_content"), (F.col("sha256") == F.col("sha_of_content")) & (F.col(order_col) == F.col("first_of_content")))
    return x.dropDuplicates(["sha256", order_col]).select(*files.columns)


def numbered(new: DataFrame, known: DataFrame, *, order_col: str) -> DataFrame:
    """New documents with ids after the library's. Counts of id ranges come first, so no task numbers all rows."""
    top = known.agg(F.max("doc_id")).first()[0] or 0
    parts = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = new.withColumn("bucket", F.pmod(F.xxhash64("sha256"), F.lit(parts)))
    x = x.withColumn("rn", F.row_number().over(Window.partitionBy("bucket").orderBy(order_col)))
    sizes = x.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.join(F.broadcast(sizes.select("bucket", "before")), "bucket")  # a row for each partition
    return x.withColumn("doc_id", F.col("before") + F.col("rn") + F.lit(top)).drop("bucket", "rn", "before")


def library_sentences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return overlap.fingerprinted(segment.sentences(docs, id_col=id_col, text_col=text_col))


def stats(docs: DataFrame, sents: DataFrame) -> DataFrame:
    """One row: documents, n_chars, sentences."""
    zero = F.lit(0).cast("long")
    a = docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_chars"), zero).cast("long").alias("n_chars"), zero.alias("sentences"))
    b = sents.agg(zero.alias("documents"), zero.alias("n_chars"), F.count("*").alias("sentences"))
    return a.unionByName(b).agg(*(F.sum(c).alias(c) for c in ("documents", "n_chars", "sentences")))


def source_text(sents: DataFrame) -> DataFrame:
    """A document's sentences joined in order."""
    own = F.array_sort(F.collect_list(F.struct("idx", "display")))
    return sents.groupBy("doc_id").agg(F.array_join(F.transform(own, lambda x: x["display"]), "").alias("text"))


def params_key(use_fallback: Column, documents: Column, n_chars: Column, sentences: Column) -> Column:
    """Changes with the flag and with the library's size."""
    return F.substring(F.sha2(F.concat_ws("|", use_fallback.cast("string"), documents.cast("string"), n_chars.cast("string"), sentences.cast("string")), 256), 1, 16)


def report_no(sha: Column, at: Column) -> Column:
    return F.concat(F.lit("PC-"), F.upper(F.substring(sha, 1, 8)), F.lit("-"), F.date_format(at, "yyyyMMddHHmmss"))


def latest_reports(reports: DataFrame) -> DataFrame:
    """The last row of each report number."""
    return reports.groupBy("report_no").agg(F.max_by(F.struct(*reports.columns), "created_at").alias("r")).select("r.*")


def cached_reports(wanted: DataFrame, reports: DataFrame) -> DataFrame:
    """wanted (query_sha256, params_key) with the newest report of the same key, if any."""
    columns = [c for c in reports.columns if c not in ("query_sha256", "params_key")]
    newest = reports.groupBy("query_sha256", "params_key").agg(F.max_by(F.struct(*columns), "created_at").alias("r"))
    return wanted.join(newest, ["query_sha256", "params_key"], "left").select(*wanted.columns, "r.*")


def live_tasks(tasks: DataFrame, now: Column, *, id_col: str = "event_id", ts_col: str = "ts", ttl: int = HEADER_TTL, most: int = MAX_TASKS) -> DataFrame:
    """Tasks not older than ``ttl`` seconds; of these the newest ``most``."""
    fresh = tasks.where(now.cast("timestamp").cast("long") - F.col(ts_col).cast("timestamp").cast("long") <= ttl)
    return fresh.orderBy(F.col(ts_col).desc(), F.col(id_col).desc()).limit(most)
