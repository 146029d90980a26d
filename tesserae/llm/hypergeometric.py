"""Exact hypergeometric draws: on the driver for communication matrices, and as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement from ``good`` + ``bad`` items are good.

    Inverts the distribution, built outwards by the ratio of neighbouring probabilities, over all values or 12
    standard deviations beside the mean (what lies beyond has less mass than a double resolves). Any population.
    """
    lo, hi = max(0, n - bad), min(n, good)
    if lo >= hi:
        return lo
    total = good + bad
    mean = n * good / total
    sd = math.sqrt(max(0.0, mean * (bad / total) * ((total - n) / max(1, total - 1))))
    a, b = max(lo, math.floor(mean - 12 * sd - 12)), min(hi, math.ceil(mean + 12 * sd + 12))
    k = np.arange(a, b, dtype=np.float64)
    ratio = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(ratio)))
    mass = np.cumsum(np.exp(logs - logs.max()))
    return a + min(b - a, int(np.searchsorted(mass, rng.random() * mass[-1], side="right")))


def matrix(rng: np.random.Generator, rows: list[int], columns: list[int]) -> list[list[int]]:
    """A random communication matrix: entry (i, j) is how many items of source i go to target j, as a uniform
    shuffle of all items would have it; row and column sums are exactly ``rows`` and ``columns``."""
    left, out = list(columns), []
    for n in rows:
        rest, taken = sum(left), []
        for j, c in enumerate(left):
            x = draw(rng, c, rest - c, n)
            taken.append(x)
            rest -= c
            n -= x
            left[j] = c - x
        out.append(taken)
    return out


def draw_column(good: Column, bad: Column, n: Column, u: Column) -> Column:
    """:func:`draw` as an expression; ``u`` is a uniform double in [0, 1)."""
    d = lambda c: c.cast("double")
    lo, hi = F.greatest(F.lit(0).cast("long"), n - bad), F.least(n, good)
    total = good + bad
    mean = d(n) * d(good) / F.greatest(d(total), F.lit(1.0))
    sd = F.sqrt(F.greatest(F.lit(0.0), mean * d(bad) / F.greatest(d(total), F.lit(1.0)) * d(total - n) / F.greatest(d(total) - 1, F.lit(1.0))))
    a = F.greatest(lo, F.floor(mean - 12 * sd - 12))
    b = F.least(hi, F.ceil(mean + 12 * sd + 12))

    def up(w: Column, k: Column) -> Column:
        """The weight of k + 1 from that of k; 0 after the last."""
        return w * (d(good) - k) * (d(n) - k) / ((d(k) + 1) * F.greatest(d(bad) - d(n) + k + 1, F.lit(1.0)))

    ks = F.sequence(a, F.greatest(a, b))
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
    total_mass = F.aggregate(ks, start, lambda x, k: F.struct(up(x["w"], k).alias("w"), (x["s"] + x["w"]).alias("s")), lambda x: x["s"])
    find = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), a.alias("k"), total_mass.alias("t"))
    found = F.aggregate(
        ks,
        find,
        lambda x, k: F.struct(up(x["w"], k).alias("w"), (x["s"] + x["w"]).alias("s"), F.when(x["s"] + x["w"] <= u * x["t"], F.least(k + 1, b)).otherwise(x["k"]).alias("k"), x["t"].alias("t")),
        lambda x: x["k"],
    )
    return F.when(lo >= hi, lo).otherwise(found)
