"""Ranked search against a plain scorer, the bounds of its bytes, and odd rows."""

import collections
import math
import random
import re

import numpy as np
import pytest

from tesserae.llm import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, item_id long, rank int, score long, number long"
ITEMS = "item_id long, text string, doc_id long"


def plain(docs, items, k):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    own = [(i, collections.Counter(terms(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n, total = len(own), sum(x for *_, x in own)
    df = collections.Counter(g for _, c, _ in own for g in c)
    out = []
    for item, text in items:
        asked, found = terms(text), []
        for i, c, size in own:
            m = 100 - 75 + (75 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[g] + 1))) * ((1_000_000_000 * c[g]) // (1000 * c[g] + 8 * m)) for g in asked if c[g])
            if s > 0:
                found.append((-s, i is None, i if i is not None else 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def made():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcÀé7") for _ in range(rnd.randint(1, 3))) for _ in range(150)]
    docs = [(i, rnd.choice([" ", "-", ", "]).join(rnd.choice(words) for _ in range(rnd.choice([1, 5, 60, 300])))) for i in range(400)]
    docs += [(1000 + i, "the same text of a large group Abc") for i in range(300)]
    docs += [(2000, None), (2001, ""), (2002, " !?\n"), (2003, "Word " * 20_000), (None, "the same"), (2004, "a\x1cb 漢字 ß"), (3, docs[3][1]), (2005, "z" * 50_000)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 4, 40])))) for i in range(30)]
    items += [(100, "the same text of a large group"), (101, None), (102, ""), (103, "unknownterm"), (104, "word WORD word"), (None, "the"), (104, "word"), (105, "漢字 ß!")]
    return docs, items


@pytest.mark.parametrize("options", [search.Search(), search.Search(k=3, terms=60, block=16, cells=40)])
def test_search(spark, options):
    docs, items = made()
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(i, t, 5) for i, t in items], ITEMS)
    got = sorted(map(tuple, search.search(df, asked, options=options).collect()), key=str)
    assert got == plain(docs, items, options.k)


def test_empty_tables(spark):
    docs, items = made()
    df, asked = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in docs[:5]], DOCS), spark.createDataFrame([(i, t, 5) for i, t in items[:5]], ITEMS)
    assert search.search(df.limit(0), asked).count() == 0
    assert search.search(df, asked.limit(0)).count() == 0
    assert search.search(df.where("text is null"), asked).count() == 0


def test_bytes_bound_impacts():
    tf, m = np.meshgrid(np.arange(1, 3000, dtype=np.int64), np.array([25, 30, 100, 10**6, 10**12]))
    x = search.impacts(tf, m)
    b = search.quantised(x)
    assert b.min() >= 0 and b.max() <= 255 and (search.STEP * b >= x).all() and ((search.STEP * (b - 1) < x) | (x == 0)).all()


def test_most_documents_are_not_rescored():
    """One long, rare match beats the rest: blocks and documents below its bound are skipped."""
    rng = np.random.default_rng(1)
    asked = search._asked([(0, 0, np.array([5, 9], np.uint64))])
    asked = search.Asked(asked.items, asked.vocabulary, np.array([10, 4000]), asked.term, asked.item, asked.times)
    s = search.Searcher(asked, 20_000, 2_000_000, search.Search(k=10))
    for a in range(0, 20_000, 5000):
        doc = np.arange(a, a + 5000)
        term = np.where(doc % 500 == 0, 1, 0)
        s.add(doc, np.full(5000, 100), np.arange(5001), term, rng.integers(1, 4, 5000))
    assert s.rescored < 2000
    assert set(s.results()[1] % 500) == {0}
