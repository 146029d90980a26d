"""Folders that the driver and all executors see, through Hadoop's file systems."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder (not yet made) in the one that ``spark.checkpoint.dir`` names. Where that is unset, a session in one
    process, as in tests, gets a local one; any other must name one."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tesserae-work-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/work/{label}-{uuid.uuid4().hex}"


class Folders:
    """Names, small texts and removal below any path that Spark can read."""

    def __init__(self, spark: SparkSession) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._path(path)
        return p.getFileSystem(self._conf), p

    def names(self, path: str) -> list[str]:
        """What lies in a folder; nothing if it is not there."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def create(self, path: str, text: str) -> bool:
        """Write a new small file; false if there is one already."""
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        out = fs.create(p, False)  # fails where another one was faster
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
