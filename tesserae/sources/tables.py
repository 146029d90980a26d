"""Stored tables whose rows are replaced by key.

A table lies in folders by bucket, the key's hash modulo a number that its first write fixes. An upsert reads and rewrites
only the buckets that its keys fall into: the merged buckets are staged first, a note names the stage, and then they
replace the old ones (dynamic partition overwrite). Whoever finds the note later finishes the move, so an upsert that was
cut off is neither lost nor half done, and one that is repeated changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import Folders

BUCKETS = 64
_NOTE = "_pending"


def _bucket(keys: tuple[str, ...], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _layout(folders: Folders, path: str) -> int | None:
    """The number of buckets, if the table is there."""
    found = [x for x in folders.names(path) if x.startswith("_buckets-")]
    return int(found[0].removeprefix("_buckets-")) if found else None


def recover(spark: SparkSession, path: str) -> None:
    """Finish what an upsert left staged."""
    folders, note = Folders(spark), f"{path}/{_NOTE}"
    if not folders.exists(note):
        return
    stage = folders.read(note)
    if stage and "_SUCCESS" in (made := folders.names(stage)) and any(x.startswith("bucket=") for x in made):
        staged = spark.read.parquet(stage)
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    folders.delete(note)
    if stage:
        folders.delete(stage)


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The table's rows. A table that is not there is empty if a ``schema`` is given."""
    recover(spark, path)
    if schema is not None and not any(x.startswith("bucket=") for x in Folders(spark).names(path)):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path).drop("bucket")


def lookup(wanted: DataFrame, path: str, *keys: str) -> DataFrame:
    """The stored rows of the keys in ``wanted``; only their buckets are read."""
    spark = wanted.sparkSession
    recover(spark, path)
    n = _layout(Folders(spark), path)
    own = wanted.select(*keys).distinct().withColumn("bucket", _bucket(keys, n))
    touched = [r["bucket"] for r in own.select("bucket").distinct().collect()]  # n at most
    return spark.read.parquet(path).where(F.col("bucket").isin(touched)).join(own, [*keys, "bucket"], "left_semi").drop("bucket")


def upsert(df: DataFrame, path: str, *keys: str, order: str, buckets: int = BUCKETS) -> None:
    """Put rows into the table, replacing those of the same key.

    Of several new rows with one key that with the largest ``order`` (a column; then the largest row) counts. Rows with a
    null key are an error of the caller's and raise one. The columns must be those of the table. One writer at a time.
    """
    spark = df.sparkSession
    folders = Folders(spark)
    recover(spark, path)
    n = _layout(folders, path)
    new = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(order, *df.columns)).alias("x")).select("x.*")
    new = new.withColumn("bucket", F.when(F.expr(" or ".join(f"`{k}` is null" for k in keys)), F.raise_error(F.lit("a key is null"))).otherwise(_bucket(keys, n or buckets)))
    stage = f"{path.rstrip('/')}/_stage-{uuid.uuid4().hex}"
    if n is None:
        merged = new
    else:
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # n at most
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
        merged = old.join(new.select(*keys), [*keys], "left_anti").unionByName(new)
    merged.repartition("bucket").write.partitionBy("bucket").parquet(stage)
    if not folders.create(f"{path}/{_NOTE}", stage):
        raise RuntimeError(f"another upsert into {path} is under way")
    if n is None:
        folders.create(f"{path}/_buckets-{buckets}", "")
    recover(spark, path)
