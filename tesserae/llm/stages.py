"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of
documents.

Each keeps all columns of its input, whatever their names, works on repeated rows and ids and on null texts, and gives an
empty table for an empty one. Where ``lang`` or ``source`` is absent, it counts as null; ``n_chars`` is set where it is
there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, mixing, pii, quality
from .common import read, stored
from .queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with(docs: DataFrame, *names: str) -> DataFrame:
    """The documents with these columns, null where they are absent."""
    have = {c.lower() for c in docs.columns}
    return docs.select("*", *(F.lit(None).cast("string").alias(n) for n in names if n not in have))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep(_with(docs, "lang", "source")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at a similarity of 0.8, the document of the smallest id stays. Documents
    without words stay; of rows that share the kept id, one of each text."""
    return jaccard.keep_one(docs, words=5, num=80, den=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets; n_chars follows the text."""
    own = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return own
    return own.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: rows are there as often as the mix takes them."""
    return mixing.apply(_with(docs, "source")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and ids; the ids are decoded again for the second digest."""
    import public_tokenizers

    return bpe.encode_bpe(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True).drop("decoded")


def run(stages: list[tuple[str, Stage]], spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result but the last is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(stages):
        docs = stage(spark, docs, sf_dir)
        if i < len(stages) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
