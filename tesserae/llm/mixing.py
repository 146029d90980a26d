"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. Native only.

A source's documents, in an order of hashes, make a stream: whole passes, then a part of one. The stream is cut into
blocks; how many blocks each source gives is its quota. The tree splits the vector of quotas among the output
shards: at each node the left half's share of every source is drawn from the multivariate hypergeometric law, so
leaves hold exact numbers of blocks. Each source's blocks, permuted, fill those numbers; each shard is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _SPACES, discard, prefix, shuffle_partitions, stored
from .hypergeometric import draw_column


@dataclass(frozen=True)
class Mix:
    """Weights repeat over the sources in code-point order, null last. ``share``: of all sizes, what the mix takes.
    ``most``: no target above this multiple of its source, no document more often. ``shards``: output shards.
    ``blocks``: of each shard on average, so that their number does not grow with the corpus. ``rounds``: in which a
    source's part is filled with documents that still fit. ``seed``: of all draws."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.0
    most: int = 3
    shards: int = 64
    blocks: int = 256
    rounds: int = 3
    seed: int = 11


def word_count(text: Column) -> Column:
    """The number of words of a text; null: 0."""
    flat = F.translate(F.coalesce(text, F.lit("")), _SPACES, " " * len(_SPACES))
    return F.size(F.filter(F.split(flat, " "), lambda w: w != "")).cast("long")


def targets(sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """sources: skey, source, s (its size). Adds target: proportional to weight, at most ``most`` times the size,
    the excess dealt again by weight until none is above; a source without size gets 0."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in mix.weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(mix.weights))) + 1).cast("int"))
    x = sources.withColumn("w", weight).withColumn("cap", F.col("s").cast("double") * mix.most)
    every = Window.partitionBy()
    by = Window.orderBy(F.col("cap") / F.col("w"), "skey")
    x = x.withColumn("all", F.sum("s").over(every).cast("double") * mix.share).withColumn("k", F.row_number().over(by))
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    x = x.withColumn("rate", (F.col("all") - before) / after)
    x = x.withColumn("first", F.min(F.when(F.col("rate") <= F.col("cap") / F.col("w"), F.struct("k", "rate"))).over(every))
    free = F.coalesce(F.col("k") >= F.col("first.k"), F.lit(False))
    return x.withColumn("target", F.when(free, F.col("first.rate") * F.col("w")).otherwise(F.col("cap"))).select("skey", "source", "s", "target")


def key_of(id_col: str, text_col: str) -> Column:
    """What places a row in its source's order; rows of one id, or without one, differ by their texts."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _placed(df: DataFrame, size: Column, source: Column, key: Column, mix: Mix, buckets: int, p: str) -> DataFrame:
    """Adds each row's place in its source's order: bucket, rank in it and the size before it there. A source is
    spread over ``buckets`` windows, so a hot one is no task's alone."""
    h = F.xxhash64(F.lit(mix.seed), key)
    skey = F.coalesce(F.concat(F.lit("v"), source.cast("string")), F.lit("n"))
    df = df.select("*", skey.alias(p + "skey"), F.pmod(h, F.lit(buckets)).cast("int").alias(p + "bucket"), h.alias(p + "h"), size.alias(p + "size"))
    w = Window.partitionBy(p + "skey", p + "bucket").orderBy(p + "h", p + "size")
    return df.select("*", F.row_number().over(w).alias(p + "rn"), (F.sum(p + "size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(p + "size")).alias(p + "before"))


@dataclass
class Plan:
    """``rows``: each document's place with source_size, target, passes (how often it is taken) and blocks (of each
    taken copy). ``shard_of``: the output shard of each source's blocks. Both are small beside the texts."""

    rows: DataFrame
    shard_of: DataFrame
    buckets: int


def plan(df: DataFrame, *, mix: Mix = Mix(), keep: tuple[str, ...] = ()) -> Plan:
    """Decide what the mix takes of each row. df: key_ (of :func:`key_of`), source_, size_ and the columns to keep.

    A source's target is met by whole passes and a part. The part is filled in rounds: in order of the hashes, those not
    larger than what is missing are taken while they fit; so documents that are too large do not end it. Then the one of
    the rest whose size comes nearest to what is missing is taken, if that is nearer than leaving it. Null sources are
    one source; rows with equal keys and sizes are interchangeable; rows without size are never taken.
    """
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    placed = _placed(df, F.col("size_"), F.col("source_"), F.col("key_"), mix, n, "m_")
    names = {f"m_{c}": c for c in ("skey", "bucket", "rn", "before", "size")}
    placed = stored(placed.select(*keep, F.col("source_").alias("source"), *(F.col(a).alias(b) for a, b in names.items())), "mix-rows")
    buckets = placed.groupBy("skey", "bucket").agg(F.max("source").alias("source"), F.sum("size").alias("b"))
    to = targets(buckets.groupBy("skey").agg(F.max("source").alias("source"), F.sum("b").alias("s")), mix).drop("source")
    in_order = Window.partitionBy("skey").orderBy("bucket")
    full = F.when(F.col("s") > 0, F.least(F.floor(F.col("target") / F.col("s")), F.lit(mix.most))).otherwise(F.lit(0)).cast("long")
    cut = buckets.withColumn("offset", F.sum("b").over(in_order) - F.col("b")).drop("b", "source").join(to, "skey").withColumn("full", full)
    cut = cut.withColumn("part", F.col("target") - F.col("full") * F.col("s")).withColumn("got", F.lit(0).cast("long"))
    cut = stored(cut, "mix-cut")  # a row for each bucket; documents meet it by bucket, not by source
    total = cut.groupBy("skey").agg(F.first("target").alias("target")).agg(F.sum("target")).first()[0] or 0.0
    block = max(1, math.ceil(total / (mix.shards * mix.blocks)))
    rows, at = placed.withColumn("place", F.lit(None).cast("long")), ["skey", "bucket"]
    for _ in range(mix.rounds):
        x = rows.join(cut.select(*at, "part", "got"), at)
        fits = F.col("place").isNull() & (F.col("size") > 0) & (F.col("size") <= F.col("part") - F.col("got"))
        up_to = Window.partitionBy(*at).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
        x = x.withColumn("run", F.sum(F.when(fits, F.col("size")).otherwise(0)).over(up_to)).withColumn("fits", fits)
        tried = stored(x.drop("part", "got"), "mix-round")
        sums = tried.groupBy(*at).agg(F.max("run").alias("b"))
        sums = sums.withColumn("ahead", F.sum("b").over(in_order) - F.col("b")).drop("b")
        cut = cut.join(sums, at)
        x = tried.join(cut.select(*at, "part", "got", "ahead"), at)
        end = F.col("got") + F.col("ahead") + F.col("run")
        placed_now = F.when(F.col("fits") & (end <= F.col("part")), end - F.col("size"))
        rows = x.withColumn("place", F.coalesce("place", placed_now)).drop("run", "fits", "part", "got", "ahead")
        rows = stored(rows, "mix-filled")
        got = rows.groupBy("skey").agg(F.coalesce(F.max(F.col("place") + F.col("size")), F.lit(0).cast("long")).alias("got"))
        cut = stored(cut.drop("got", "ahead").join(got, "skey"), "mix-got")
        discard(tried)
    gap = F.col("part") - F.col("got")
    missed = F.abs(F.col("size") - gap)
    x = rows.join(cut.select(*at, "part", "got", "full"), at)
    nearer = F.col("place").isNull() & (F.col("size") > 0) & (missed < gap) & (F.col("full") < mix.most)
    tried = x.groupBy(*at).agg(F.min(F.when(nearer, F.struct(missed.alias("missed"), "bucket", "rn"))).alias("best"))
    best = tried.groupBy("skey").agg(F.min("best").alias("best"))
    cut = stored(cut.join(best, "skey"), "mix-best")
    made = _taken(rows.join(cut, at), mix, block)
    quota = made.select("skey", F.explode("blocks").alias("block")).groupBy("skey").agg((F.max("block") + 1).alias("q"))
    return Plan(made, stored(_shard_of(quota, mix), "mix-blocks"), n)


def _taken(x: DataFrame, mix: Mix, size: int) -> DataFrame:
    """x: placed rows joined with ``cut``. Adds passes and the block of each copy."""
    best = (F.col("bucket") == F.col("best.bucket")) & (F.col("rn") == F.col("best.rn"))
    block = lambda at: F.floor(at / F.lit(size)).cast("long")
    start = F.col("offset") + F.col("before")
    whole = F.when(F.col("full") > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.col("full")), lambda e: block((e - 1) * F.col("s") + start))).otherwise(F.array().cast("array<long>"))
    last = F.coalesce(F.col("place"), F.when(F.coalesce(best, F.lit(False)), F.col("got")))
    taken = F.when(last.isNotNull(), F.concat(whole, F.array(block(F.col("full") * F.col("s") + last)))).otherwise(whole)
    blocks = F.when(F.col("size") == 0, F.array().cast("array<long>")).otherwise(taken)
    return x.withColumn("blocks", blocks).withColumn("passes", F.size("blocks").cast("long"))


def _shard_of(quota: DataFrame, mix: Mix) -> DataFrame:
    """The splitting tree: skey, q (quota of blocks) -> skey, block, shard. All quotas add up to shards times blocks and one
    for each source, about, whatever the corpus."""
    root = quota.agg(F.sort_array(F.collect_list(F.struct("skey", "q"))).alias("own")).withColumn("lo", F.lit(0)).withColumn("hi", F.lit(mix.shards))
    total = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["q"])
    nodes = root.withColumn("all", total)  # one row for each node, an entry for each source

    def capacity(lo: Column, hi: Column) -> Column:
        """Blocks of shards lo .. hi - 1: equal but for one."""
        less, more = F.floor(F.col("all") / mix.shards).cast("long"), F.pmod(F.col("all"), F.lit(mix.shards))
        return less * (hi - lo) + F.least(hi.cast("long"), more) - F.least(lo.cast("long"), more)

    depth = max(0, (mix.shards - 1).bit_length())
    for level in range(depth):
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        nodes = nodes.withColumn("mid", middle)
        n = capacity(F.col("lo"), F.col("mid"))
        rest = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["q"])
        zero = F.struct(n.alias("n"), rest.alias("rest"), F.array().cast("array<bigint>").alias("left"))

        salt = F.lit(level)

        def step(a: Column, x: Column) -> Column:
            u = (F.xxhash64(F.lit(mix.seed + 1), salt, F.col("lo"), x["skey"]).bitwiseAND(F.lit((1 << 52) - 1))).cast("double") / float(1 << 52)
            took = F.when(F.col("hi") - F.col("lo") < 2, x["q"]).otherwise(draw_column(x["q"], a["rest"] - x["q"], a["n"], u))
            # the draw stands in a one-element array so that it is made once
            return F.element_at(F.transform(F.array(took), lambda t: F.struct((a["n"] - t).alias("n"), (a["rest"] - x["q"]).alias("rest"), F.concat(a["left"], F.array(t)).alias("left"))), 1)

        nodes = nodes.withColumn("left", F.aggregate("own", zero, step, lambda a: a["left"]))
        half = lambda left: F.transform("own", lambda x, i: F.struct(x["skey"].alias("skey"), (F.get("left", i) if left else x["q"] - F.get("left", i)).alias("q")))
        children = F.array(F.struct(F.col("lo").alias("lo"), F.when(F.col("hi") - F.col("lo") < 2, F.col("hi")).otherwise(F.col("mid")).alias("hi"), half(True).alias("own")), F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), half(False).alias("own")))
        nodes = nodes.select("all", F.explode(children).alias("c")).select("all", "c.*").where(F.col("lo") < F.col("hi"))
        nodes = nodes.where(F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["q"]) > 0)
    leaves = nodes.select(F.col("lo").alias("shard"), F.explode("own").alias("o")).select("shard", "o.skey", "o.q").where(F.col("q") > 0)
    end = F.sum("q").over(Window.partitionBy("skey").orderBy("shard"))
    dealt = leaves.withColumn("end", end).select("skey", "shard", F.explode(F.sequence(F.col("end") - F.col("q") + 1, F.col("end"))).alias("rank"))
    blocks = quota.select("skey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)).alias("block"))
    perm = F.row_number().over(Window.partitionBy("skey").orderBy(F.xxhash64(F.lit(mix.seed + 2), "skey", "block"), "block")).cast("long")
    return blocks.withColumn("rank", perm).join(dealt, ["skey", "rank"]).select("skey", "block", "shard")


def assign(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mix: Mix = Mix()) -> DataFrame:
    """A row for each document: doc_id, size (words), source_size, target, taken (words, repeats counted) and
    shards (that of each copy). An empty table gives an empty one."""
    made = plan(df.select(F.col(id_col).alias("doc_id"), key_of(id_col, text_col).alias("key_"), F.col(source_col).alias("source_"), word_count(F.col(text_col)).alias("size_")), mix=mix, keep=("doc_id",))
    own = ["skey", "bucket", "rn"]
    copies = made.rows.select(*own, F.explode("blocks").alias("block")).join(made.shard_of, ["skey", "block"])
    shards = copies.groupBy(*own).agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    out = made.rows.join(shards, own, "left")
    return out.select("doc_id", "size", F.col("s").alias("source_size"), "target", (F.col("passes") * F.col("size")).alias("taken"), F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))


def apply(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mix: Mix = Mix()) -> DataFrame:
    """The mix itself: the rows of ``df`` as often as they are taken, all columns as they are, dealt to the output
    shards and shuffled in each. Texts move once for their places and once to their shards."""
    p = prefix(df, "m")
    size = word_count(F.col(text_col))
    key = key_of(id_col, text_col)
    made = plan(df.select(key.alias("key_"), F.col(source_col).alias("source_"), size.alias("size_")), mix=mix)
    at = ["skey", "bucket", "rn"]
    texts = _placed(df, size, F.col(source_col), key, mix, made.buckets, p)
    copies = made.rows.select(*at, F.posexplode("blocks").alias("pass", "block")).join(made.shard_of, ["skey", "block"])
    copies = copies.groupBy(*at).agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    copies = copies.select(*(F.col(c).alias(f"{p}c_{c}") for c in (*at, "shards")))
    same = (F.col(p + "skey") == F.col(f"{p}c_skey")) & (F.col(p + "bucket") == F.col(f"{p}c_bucket")) & (F.col(p + "rn") == F.col(f"{p}c_rn"))
    x = texts.join(copies, same).select(*df.columns, F.col(p + "h"), F.posexplode(f"{p}c_shards").alias(p + "copy", p + "shard"))
    order = F.xxhash64(F.lit(mix.seed + 3), F.col(p + "h"), F.col(p + "copy"))
    x = x.repartition(shuffle_partitions(df.sparkSession), F.col(p + "shard"), F.pmod(order, F.lit(16)))
    return x.sortWithinPartitions(F.col(p + "shard"), order).select(*df.columns)
