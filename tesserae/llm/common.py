"""What the operators of this subpackage share: the shared folder, word rules and small caches."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"
_SPACES = "\t\n\x0b\f\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder (not yet made) that the driver and all executors see.

    It lies in the folder named by ``spark.checkpoint.dir``. Where that is unset, a session in one process, as in tests,
    gets a local folder; any other must name one.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tesserae-shared-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/tesserae/{label}-{uuid.uuid4().hex}"


def arrow_path(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and path of a folder as Spark names it."""
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it again."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.stored_at = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`stored` wrote, once nothing that will still run reads it."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_array(text: Column) -> Column:
    """The words of a text as an array; null counts as an empty text."""
    flat = F.translate(F.coalesce(text, F.lit("")), _SPACES, " " * len(_SPACES))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def prefix(df: DataFrame, name: str) -> str:
    """``name`` and an underline, lengthened until no column of ``df`` begins with it (without case)."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(f"{name.lower()}_") for c in taken):
        name = f"_{name}"
    return f"{name}_"


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that hands freed memory back to the system when the task ends, so that a reused worker does not
    keep what its largest task had."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
            if trim:
                trim(0)

    return tidied


class Memo(dict):
    """A bounded cache of two generations: when the young one is full, it becomes the old one.

    Entries in use move up again, so frequent keys stay; nothing but speed depends on what is held.
    """

    def __init__(self, size: int) -> None:
        super().__init__()
        self.size, self.old = size, {}

    def __missing__(self, key):
        value = self.old[key]  # KeyError: unknown
        self[key] = value
        return value

    def room(self) -> None:
        """Call between slices of the input."""
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()

    def forget(self) -> None:
        """Call at the end of a task, so that a reused worker holds nothing for the next one."""
        self.clear()
        self.old = {}


def distinct_words(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Each text split at single spaces: codes of all texts' words, the distinct words, and where each text's codes
    begin, with the end."""
    own = pc.split_pattern(column, " ")
    words = own.flatten().dictionary_encode()
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(own).to_numpy(zero_copy_only=False)))).astype(np.int64)
    return words.indices.to_numpy(zero_copy_only=False), words.dictionary.to_pylist(), ends


def spread(values: list[bytes] | pa.Array, codes: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The codes' values, joined, and where those of each text begin in that, with the end."""
    taken = (values if isinstance(values, pa.Array) else pa.array(values, pa.large_binary())).take(pa.array(codes))
    at = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset + ends]
    return memoryview(taken.buffers()[2] or b""), at
