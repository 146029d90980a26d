"""Texts as files of their own names, one file for each row, written by a data source with a two-phase commit.

A task writes its rows below a folder of the job and of its attempt; when all tasks have ended well, the driver moves the
files to their names, and otherwise removes the job's folder. So a failed or repeated task leaves nothing under a final
name. A file of the same name is replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

_STAGE = "_temporary"


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and path of a file or folder as Spark names it. Only the store's name is read as a URI, so that
    paths may hold any characters."""
    store, rest = re.match(r"(?:([A-Za-z0-9+.-]+://[^/]*)|file:)?(.*)", path, re.DOTALL).groups()
    if not store or store == "file://":
        return fs.LocalFileSystem(), re.sub("^/+", "/", rest).rstrip("/")
    system, base = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", store))
    return system, f"{base.rstrip('/')}{rest}".rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its folder and the names in it."""

    folder: str
    names: list[str]


class NamedWriter(DataSourceWriter):
    def __init__(self, path: str, encoding: str) -> None:
        self.path, self.encoding, self.job = path, encoding, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        system, base = open_path(self.path)
        folder, names = f"{base}/{_STAGE}/{self.job}/{uuid.uuid4().hex}", []
        for r in iterator:
            name, text = r["name"], r["text"]
            if not name or "/" in name or name in (".", "..") or name.startswith(_STAGE):
                raise ValueError(f"{name!r} is no file name")
            if not names:
                system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{folder}/{len(names)}") as out:
                out.write((text or "").encode(self.encoding))
            names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = open_path(self.path)
        for m in messages:
            for i, name in enumerate(m.names if m else ()):
                to = f"{base}/{name}"
                if system.get_file_info(to).type != fs.FileType.NotFound:
                    system.delete_file(to)
                system.move(f"{m.folder}/{i}", to)
        self._clean(system, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*open_path(self.path))

    def _clean(self, system: fs.FileSystem, base: str) -> None:
        for at in (f"{base}/{_STAGE}/{self.job}", f"{base}/{_STAGE}"):
            found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
            if at.endswith(self.job) or not found:
                if system.get_file_info(at).type == fs.FileType.Directory:
                    system.delete_dir(at)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> NamedWriter:
        return NamedWriter(self.options["path"], self.options.get("encoding", "utf-8"))


def stem(name: Column) -> Column:
    """The last part of a path without its last suffix; a name that only begins with a dot has none."""
    return F.regexp_replace(F.regexp_extract(name, r"([^/]*)/*$", 1), r"(?<=.)\.[^.]+$", "")


def write_files(df: DataFrame, path: str, *, name_col: str, text_col: str, order_col: str | None = None, encoding: str = "utf-8") -> None:
    """Each row's text in the file of its name below ``path``. Of rows with one name that with the largest ``order_col``,
    then the largest text, is written. A null text is an empty file; a name that is null, empty or holds a slash fails
    the whole write, which then leaves nothing. The driver moves the files: some hundred bytes for each pass through it."""
    order = F.struct(*([F.col(order_col)] if order_col else []), F.coalesce(F.col(text_col), F.lit("")))
    own = df.groupBy(F.col(name_col).alias("name")).agg(F.max_by(F.col(text_col), order).alias("text"))
    # in a micro-batch the plan's session, the thread's and the one that the stream was made in are three
    for session in (df.sparkSession, SparkSession.getActiveSession(), SparkSession(df.sparkSession.sparkContext, own._jdf.sparkSession())):
        if session is not None:
            session.dataSource.register(NamedFiles)
    own.write.format("named_files").option("path", path).option("encoding", encoding).mode("append").save()


def write_check_reports(reports: DataFrame, path: str) -> None:
    """Checked documents (name, html, json) as a page and a summary for each, by the stem of the name."""
    named = lambda head, tail, c: reports.select(F.concat(F.lit(head), stem(F.col("name")), F.lit(tail)).alias("file"), F.col(c).alias("text"))
    write_files(named("查重报告__", ".html", "html").unionByName(named("查重摘要__", ".json", "json")), path, name_col="file", text_col="text")


def write_grade_reports(reports: DataFrame, path: str) -> None:
    """Rows (name, markdown) of :func:`grading.report_markdown` as files."""
    write_files(reports, path, name_col="name", text_col="markdown")
