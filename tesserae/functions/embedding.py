"""Vectors of sentences by a model that the caller gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: A list of texts -> a matrix of as many rows.
Model = Callable[[list[str]], np.ndarray]


def from_encoder(encoder) -> Model:
    """Of any object with ``encode(list of texts)``, as sentence encoders have it."""
    return lambda texts: np.asarray(encoder.encode(texts), float)


def embed(text: Column, make: Callable[[], Model], *, batch: int = 256) -> Column:
    """Vectors of length one; a null text and a vector of zeros give null. ``make()`` is called once in each task."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            out: list = [None] * len(s)
            some = [i for i, t in enumerate(s) if t is not None]
            for a in range(0, len(some), batch):
                own = some[a : a + batch]
                made = np.asarray(model([s.iloc[i] for i in own]), float)
                norm = np.sqrt((made * made).sum(axis=1))
                for i, v, n in zip(own, made, norm):
                    out[i] = v / n if n > 0 else None
            yield pd.Series(out)

    return run(text)


def vectors(make: Callable[[], Model], *sides: DataFrame) -> DataFrame:
    """norm, vec: each distinct normal form of the sides' sentences, embedded once."""
    norms = sides[0].select("norm")
    for x in sides[1:]:
        norms = norms.unionByName(x.select("norm"))
    return norms.distinct().withColumn("vec", embed(F.col("norm"), make)).where("vec is not null")
