"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, shuffle_partitions
from .hypergeometric import matrix


def shard(df: DataFrame, shards: int, *, key_cols: tuple[str, ...] = ("doc_id", "text"), seed: int = 7, partitions: int | None = None) -> DataFrame:
    """Put every row into one of ``shards`` shards whose row counts differ by one at most.

    Adds ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard) to the rows; columns of these names in
    any case are replaced, all others stay. How it works: rows lie in source partitions by a hash of their key; the driver draws how
    many rows of each go to each shard (``partitions`` times ``shards`` counts, whatever the rows); each partition
    permutes its rows and deals them out by those counts; each shard permutes what it got, in sub-ranges of its
    slots whose sizes are counted first, so no task holds a whole shard.

    The key should tell rows apart; rows with one key are interchangeable and lie in one partition. Null keys count
    as a value. Groups of equal texts are spread like other rows. An empty table gives an empty table. Reruns on
    the same rows agree, as all randomness comes from ``seed`` and the keys.
    """
    spark = df.sparkSession
    n = partitions or shuffle_partitions(spark)
    subs = max(1, -(-n // shards))
    df = df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")))
    part, one, two, sub, ends_of = (fresh(df, c) for c in ("part", "order_1", "order_2", "sub", "ends"))

    def keyed(hash_of: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(seed), hash_of), F.lit(n)).cast("int").alias(part), F.xxhash64(F.lit(seed + 1), hash_of).alias(one), F.xxhash64(F.lit(seed + 2), hash_of).alias(two)]

    own = F.concat_ws("\x1f", *(F.coalesce(F.hex(F.xxhash64(F.lit(i), F.col(c))), F.lit("-")) for i, c in enumerate(key_cols)))
    own = F.concat(own, *(F.when(F.col(c).isNull(), "n").otherwise("v") for c in key_cols))
    narrow = df.select(*keyed(own))
    counts = {r[0]: r[1] for r in narrow.groupBy(part).count().collect()}  # at most n rows
    rows, total = [counts.get(i, 0) for i in range(n)], sum(counts.values())
    columns = [total // shards + (j < total % shards) for j in range(shards)]
    dealt = matrix(np.random.default_rng(seed), rows, columns)
    ends = [[int(x) for x in np.cumsum(r)] for r in dealt]
    schema = T.StructType([T.StructField(part, T.IntegerType()), T.StructField(ends_of, T.ArrayType(T.LongType()))])
    table = F.broadcast(spark.createDataFrame(list(enumerate(ends)), schema))  # n * shards numbers

    def exchanged(x: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(part).orderBy(one, two)).cast("long") - 1
        x = x.withColumn("shard", rank).join(table, part)
        return x.withColumn("shard", F.size(F.filter(ends_of, lambda e: e <= F.col("shard")))).drop(ends_of, part, one).withColumn(sub, F.pmod(F.col(two), F.lit(subs)).cast("int"))

    # shards * subs rows; the keys alone are shuffled for this
    sizes = {(r[0], r[1]): r[2] for r in exchanged(narrow).groupBy("shard", sub).count().collect()}
    base = []
    for s in range(shards):
        at = 0
        for b in range(subs):
            base.append((s, b, at))
            at += sizes.get((s, b), 0)
    start = fresh(df, "start_of")
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField(sub, T.IntegerType()), T.StructField(start, T.LongType())])
    starts = F.broadcast(spark.createDataFrame(base, schema))
    wide = exchanged(df.select("*", *keyed(own)))
    local = F.row_number().over(Window.partitionBy("shard", sub).orderBy(two)).cast("long") - 1
    return wide.withColumn("slot", local).join(starts, ["shard", sub]).withColumn("slot", F.col("slot") + F.col(start)).select(*df.columns, "shard", "slot")
