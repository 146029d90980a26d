"""Spelling variants against all pairs of words, with slips, ties, chains and odd rows."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, word string, n long, root string, best long"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counts(docs, o):
    out = collections.Counter()
    for i, text in docs:
        for run in RUN.findall((text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if o.slips and h % o.slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += len(run) >= o.letters
    return {w: n for w, n in out.items() if n >= o.times}


def plain(docs, o):
    words = counts(docs, o)
    rows = {}
    for w, n in words.items():
        own = [x for x in words if near(w, x)]
        best = min(own, key=lambda x: (-words[x], x), default=None)
        rows[w] = (best if best and words[best] >= o.factor * n else None, n, len(own))
    out = []
    for w, (form, n, some) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out.append((w, form, root, n, some, words[form] if form else None))
    return sorted(out, key=str)


def made():
    rnd = random.Random(6)
    docs = [(i, " ".join("".join(rnd.choice("abÀ") for _ in range(rnd.randint(5, 9))) for _ in range(rnd.choice([1, 30, 200])))) for i in range(60)]
    chain = [("abcdefg", 500), ("abcdefh", 50), ("abcdeih", 5), ("abcdefgh", 500), ("bbcdefg", 500), ("aaaaaaaa", 40), ("aaaaaaa", 4), ("aaaaaaab", 4), ("ÿéßàøþÀ", 30), ("ÿéßàøþá", 3)]
    docs += [(100 + j, f"{w} " * n) for j, (w, n) in enumerate(chain)]
    docs += [(200, None), (201, ""), (202, "1 2 !"), (None, "Abcdefg ABCDEFG abcdefgŁabcdefg"), (203, "x" * 30_000 + " longish " * 2), (100, "abcdefg×abcdefg"), (100, "abcdefg×abcdefg"), (204, "Straßen, straßen-STRASSEN \U0001d400abcdefg")]
    return docs


@pytest.mark.parametrize("options", [spelling.Spelling(), spelling.Spelling(letters=3, times=1, slips=3, factor=2), spelling.Spelling(letters=1, slips=0)])
def test_variants(spark, options):
    docs = made()
    df = spark.createDataFrame([(i, t, "w", 1, "r", 2) for i, t in docs], SCHEMA).repartition(3)
    got = spelling.variants(df, options=options)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == plain(docs, options)
    assert any(r[1] and r[2] != r[1] for r in rows) or options.letters == 7


def test_chain_ends_in_its_root(spark):
    base = "abcdefghij"
    words = spelling.ranked(spark.createDataFrame([("z" * i + base[i:], 4**i) for i in range(11)], "word string, n long"))
    found = spelling.forms(words, spelling.Spelling(factor=4))
    name = {r["rank"]: r["word"] for r in found.collect()}
    roots = {name[r["rank"]]: name[r["root"]] for r in spelling._roots(found).collect()}
    assert set(roots.values()) == {"z" * 10} and len(roots) == 10


def test_no_words(spark):
    df = spark.createDataFrame([(1, None, "", 1, "", 1), (2, "a b", "", 1, "", 1)], SCHEMA)
    assert spelling.variants(df).count() == 0
    assert spelling.variants(df.limit(0)).count() == 0


def test_groups_make_no_pairs(spark):
    """Words that differ at one place stay as many rows as they are, however large their group."""
    words = spelling.ranked(spark.createDataFrame([(f"abcdef{c}", i + 1) for i, c in enumerate("abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ")], "word string, n long"))
    assert spelling._replaced(spelling._keys(words)).count() == words.count()


def test_hashes_of_rests_are_those_of_words():
    words = ["a", "", "ab", "aab", "ÿé\U0001d400x", "x" * 5000]
    own, rest, at, first = spelling.hashes(pa.array(words))
    k = 0
    for w in words:
        for i in range(len(w)):
            other = spelling.hashes(pa.array([w[:i] + w[i + 1 :]]))[0][:, 0] if len(w) < 100 or i in (0, 4999) else None
            assert other is None or (rest[:, k] == other).all()
            assert at[k] == i and first[k] == (i == 0 or w[i] != w[i - 1])
            k += 1
    assert len(at) == k and len(np.unique(own[0])) == len(words)


def test_a_very_long_word(spark):
    rows = [(1, "q" * 1_000_000 + " " + "q" * 1_000_000), (2, "q" * 999_999 + " " + "q" * 999_999)]
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), options=spelling.Spelling(slips=0)).select(F.length("word"), "n", "n_near").collect()
    assert sorted(map(tuple, got)) == [(999_999, 2, 1), (1_000_000, 2, 1)]
