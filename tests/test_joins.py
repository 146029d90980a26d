"""Similarity joins at their limits: distances in batches, prefixes, blocks of vectors, hot block values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import similarity as sm
from tesserae.functions import text as T
from tesserae.operators import library, overlap


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def pairs(n):
    rnd = random.Random(n)
    for _ in range(n):
        a = [rnd.choice("abcdé漢🙂") for _ in range(rnd.choice([0, 1, 5, 30, 63, 64, 65, 128, 129, 200]))]
        b = list(a)
        for _ in range(rnd.randint(0, len(a) // 3 + 2)):
            at = rnd.randint(0, len(b))
            b[at : at + rnd.randint(0, 1)] = rnd.choice(["", "x", "a"])
        yield "".join(a), "".join(b) if rnd.random() < 0.8 else "".join(rnd.choice("abcdé") for _ in range(rnd.randint(0, 150)))


@pytest.mark.parametrize("n", [3, 700])
def test_distances_of_many_pairs(spark, n):
    a, b = map(list, zip(*pairs(n)))
    d = np.array([plain_distance(x, y) for x, y in zip(a, b)])
    m = np.array([max(len(x), len(y)) for x, y in zip(a, b)])
    assert (sm.bit_distances(a, b, np.full(n, 10**6)) == d).all()
    limit = 9 * m // 20
    some = sm.bit_distances(a, b, limit)
    assert ((some == d) | ((some > limit) & (d > limit))).all()
    expected = [0 if x == y else z if 20 * abs(len(x) - len(y)) >= 9 * z else e if 20 * e < 9 * z else sm._cut_off(x, y) if 20 * e == 9 * z else z for x, y, e, z in zip(a, b, d.tolist(), m.tolist())]
    assert sm.tier_distances(a, b).tolist() == expected
    rows = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(a, b))], "i int, a string, b string").withColumn("d", sm.distance("a", "b")).orderBy("i").collect()
    assert [r["d"] for r in rows] == expected
    assert len(sm.tier_distances([], [])) == 0


def test_long_texts():
    rnd = random.Random(5)
    a = "".join(rnd.choice("abcdefghij ") for _ in range(3000))
    b = a[:1000] + "zz" + a[1001:2500] + a[2510:]
    assert sm.tier_distances([a, a[:70]], [b, a[:69]]).tolist() == [12, 1]


def test_unlike_pairs_leave_early(monkeypatch):
    """Distances of few patterns and many texts, shifted ones too, are those of the plain table; of unlike pairs a part of
    the characters is not looked at."""
    rnd = random.Random(7)
    said = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    patterns = [said(n) for n in (1, 20, 63, 64, 65, 129, 150)]
    texts = [said(rnd.randint(1, 220)) for _ in range(60)] + [x for a in patterns for x in (said(30) + a, a + said(30), a[len(a) // 3 :] + a[: len(a) // 3], a[: len(a) // 2] + said(len(a) // 3) + a[len(a) // 2 :])]
    p, t = np.repeat(np.arange(len(patterns)), len(texts)), np.tile(np.arange(len(texts)), len(patterns))
    expected = sm.tier_distances([patterns[i] for i in p], [texts[i] for i in t])
    m = np.array([max(len(patterns[i]), len(texts[j])) for i, j in zip(p, t)])
    plain = np.array([plain_distance(patterns[i], texts[j]) for i, j in zip(p, t)])
    fits = np.array([20 * abs(len(patterns[i]) - len(texts[j])) < 9 * x for i, j, x in zip(p, t, m)])
    inner = 20 * plain != 9 * m  # on the border the cut-off decides
    assert (sm.tier_distances_to(patterns, texts, p, t)[inner] == np.where(fits & (20 * plain < 9 * m), plain, m)[inner]).all()
    assert (sm.tier_distances_to(patterns, texts, p, t) == expected).all()
    looked, columns = [], sm._columns
    monkeypatch.setattr(sm, "_columns", lambda masks, place, *x: columns(masks, lambda j, own: looked.append(len(own)) or place(j, own), *x))
    long = [said(150) for _ in range(400)]
    assert (sm.tier_distances_to(patterns[-1:], long, np.zeros(400, int), np.arange(400)) == 150).all()
    assert 0 < sum(looked) < 0.95 * 400 * 150


def lines(seed, n, least=12):
    rnd = random.Random(seed)
    common = ["the ", "of and ", "in this "]
    return [(i, "".join(rnd.choice(common) if rnd.random() < 0.5 else rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randint(1, 2) for _ in range(rnd.randint(least, 40)))) for i in range(n)]


def test_prefixes_meet_fewer_rows(spark):
    schema = "doc_id long, text string"
    lib = library.library_sentences(spark.createDataFrame(lines(1, 150) + [(999, "ab"), (998, "the of and in this")], schema)).persist()
    query = library.library_sentences(spark.createDataFrame(lines(2, 40, 3) + lines(1, 5), schema))
    forms = query.select(F.col("norm").alias("q_norm")).distinct()
    key = lambda df: sorted((r["q_norm"], r["norm"], round(r["score"], 9)) for r in df.collect())
    found = key(overlap._shared_lists(forms, lib))
    assert found == key(overlap._shared_broadcast(forms, lib)) and len(found) > 5
    grams = lambda x, n: x.select(n, F.explode(F.array_distinct(T.bigrams(F.col(n)))).alias("g")).distinct()
    raw = grams(forms, "q_norm").join(grams(lib.select("norm").distinct(), "norm"), "g").count()
    names = lib.select("norm").distinct()
    freq = grams(forms, "q_norm").select("g").unionByName(grams(names, "norm").select("g")).groupBy("g").agg(F.count("*").alias("freq"))
    q, s = overlap._ranked_sets(forms, "q_norm", freq), overlap._ranked_sets(names, "norm", freq)
    need = F.greatest(F.lit(1), F.ceil(F.col("n") * sm.CONTAIN_RECALL - 1e-9)).cast("int")
    met = 0
    for small, large, strictly in ((q, s, False), (s, q, True)):
        head = small.select("n", F.explode(F.slice("set", F.lit(1), F.col("n") - need + 1)).alias("g"))
        other = large.select(F.col("n").alias("m"), F.explode("set").alias("g"))
        met += head.join(other, "g").where("n < m" if strictly else "n <= m").count()
    assert met < raw / 2
    lib.unpersist()


def test_cosine_in_blocks(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(300, 8)).round(1).tolist()
    x[10], x[200], x[201] = x[11], x[11], x[11]
    rows = [(i, v) for i, v in enumerate(x)] + [(400, None), (401, [0.0] * 8), (402, [None] * 8), (403, [math.nan] * 8), (404, [math.inf] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, v array<float>").repartition(5)
    e = np.array(x, np.float32).astype(float)
    e /= np.sqrt((e * e).sum(axis=1))[:, None]
    query = table.where("vec_id % 3 = 0 or vec_id in (11, 200, 400, 401)").select(F.col("vec_id").alias("q_id"), F.col("v").alias("q_vec"))
    asked = [i for i in range(300) if i % 3 == 0 or i in (11, 200)]
    expected = {i: sorted(((-round(float((e[i] * e[j]).sum()), 9), j) for j in range(300)))[:4] for i in asked}
    plan = overlap.cosine_top(query, table.select(F.col("vec_id").alias("id"), F.col("v").alias("vec")), 4)
    assert "zip_with" not in plan._jdf.queryExecution().executedPlan().toString()
    for cells in (4_000_000, 64):
        monkeypatch.setattr(overlap, "CELLS", cells)
        got: dict = {}
        for r in overlap.cosine_top(query, table.select(F.col("vec_id").alias("id"), F.col("v").alias("vec")), 4).orderBy("q_id", "rank").collect():
            got.setdefault(r["q_id"], []).append((-round(r["score"], 9), r["id"]))
        assert got == expected
    assert overlap.cosine_top(query.limit(0), table.select(F.col("vec_id").alias("id"), F.col("v").alias("vec"))).count() == 0
    named = table.select(F.struct(F.col("vec_id").alias("doc_id"), F.lit(0).alias("s_idx")).alias("id"), F.col("v").alias("vec"))
    assert [r["id"]["doc_id"] for r in overlap.cosine_top(query.where("q_id = 11"), named, 4).orderBy("rank").collect()] == [j for _, j in expected[11]]


def test_a_hot_block_value_is_split(spark):
    """Three hundred forms share a block value with forty of the query's: their pairs meet in many places, each once."""
    lib = spark.createDataFrame([(i, f"library form {i}", (i << 16) | 7) for i in range(1, 301)] + [(900, "other", 5 << 40)], "doc_id long, norm string, fp long")
    query = spark.createDataFrame([(i, f"query form {i}", (i << 16) | 7) for i in range(1, 41)], "doc_id long, norm string, fp long")

    def side(x, p):
        return x.select(F.col("norm").alias("q_norm" if p == "q_" else "norm"), F.col("fp").alias(p + "fp"), F.posexplode(overlap.fp.blocks(F.col("fp"))).alias("block", "value"))

    q, s = overlap._split(side(query, "q_"), side(lib, "l_"), hot=16)
    on = ["block", "value", "q_part", "l_part"]
    assert s.where("block = 0 and value = 7").select("q_part", "l_part").distinct().count() == 3 * 19
    most = s.where("block = 0 and value = 7").groupBy("q_part", "l_part").count().agg(F.max("count")).first()[0]
    assert most < 45  # of 300
    key = lambda df: sorted(map(tuple, df.collect()))
    found = key(overlap.sharing(q, s, "norm", on))
    assert found == key(overlap.candidates(query, lib)) and len(found) == len(set(found))
    expected = [(f"query form {i}", f"library form {j}", bin(i ^ j).count("1")) for i in range(1, 41) for j in range(1, 301) if bin(i ^ j).count("1") <= 4]
    assert [x[:3] for x in found] == sorted(expected)


def test_few_patterns_meet_many_texts():
    a, b = map(list, zip(*pairs(400)))
    patterns = [*a[:25], "", "x" * 900]
    p, t = np.repeat(np.arange(len(patterns)), len(b)), np.tile(np.arange(len(b)), len(patterns))
    expected = sm.tier_distances([patterns[i] for i in p], [b[i] for i in t])
    assert (sm.tier_distances_to(patterns, b, p, t) == expected).all()
    assert len(sm.tier_distances_to(patterns, [], p[:0], p[:0])) == 0


def test_a_bounded_query_side_moves_no_candidates(spark, monkeypatch):
    """What leaves the scan of the library are matches, and k rows for each form of a batch at most; results are those of
    the joins for larger query sides."""
    schema = "doc_id long, text string"
    lib = overlap.fingerprinted(library.library_sentences(spark.createDataFrame(lines(1, 300) + [(i, "the same line for all of these") for i in range(900, 960)] + [(None, "a line of no document at all")], schema).coalesce(1))).persist()
    query = overlap.fingerprinted(library.library_sentences(spark.createDataFrame(lines(2, 30) + lines(1, 9) + [(70, "the same line for all of those"), (71, "a line of no document at all")], schema))).persist()
    some = query.where("fp <> 0").select("norm", "fp").distinct().collect()
    plan = overlap._met_by(some, lib, ["norm"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    unheld = overlap.fingerprinted(library.library_sentences(spark.createDataFrame(lines(1, 30), schema)))  # prints are made where they are compared
    assert "ArrowEvalPython" not in overlap._met_by(some, unheld, ["norm"])._jdf.queryExecution().executedPlan().toString()
    forms = sorted({r["norm"] for r in query.collect()})
    s = lib.select("doc_id", F.col("idx").alias("s_idx"), F.col("display").alias("s_display"), "norm")
    assert overlap._shared_broadcast(query.select(F.col("norm").alias("q_norm")).distinct(), lib).join(lib, "norm").count() > 3 * len(forms)
    assert overlap._top_broadcast(forms, s, 3).count() <= 3 * len(forms)
    key = lambda df: sorted(map(tuple, df.collect()), key=str)

    def found():
        return key(overlap.literal_pairs(query, lib)), key(overlap.literal_matches(query, lib)), key(overlap.containment_top(query, lib))

    small = found()
    monkeypatch.setattr(overlap, "DENSE", 500)
    assert found() == small
    monkeypatch.setattr(overlap, "ASKED_FORMS", 0)
    assert found() == small and all(len(x) > 10 for x in small)
    lib.unpersist(), query.unpersist()


def test_a_long_line_leaves_once_for_all_forms(spark):
    """A line that contains the bigrams of every form is handed on once by a task, not once for each form; a fallback and
    runs of matches read the library's scan once."""
    long = " ".join(t for _, t in lines(2, 200))
    rows = [(5, long), (7, long + " again"), (6, long), (3, long), *[(i + 10, t) for i, t in lines(3, 40)]]
    lib = overlap.fingerprinted(library.library_sentences(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)))
    query = overlap.fingerprinted(library.library_sentences(spark.createDataFrame(lines(2, 60), "doc_id long, text string")))
    top = overlap.containment_top(query, lib).orderBy("q_doc", "q_idx", "rank").collect()
    assert [(r["doc_id"], r["rank"], r["score"]) for r in top] == [(d, k, 1.0) for _ in range(60) for d, k in ((3, 1), (5, 2), (6, 3))]
    plan = overlap.containment_top(query, lib)._jdf.queryExecution().optimizedPlan().toString()
    assert "best#" in plan and "hit#" in plan  # a row with all the forms that it is best for
    found = overlap.fallback_matches(query, lib)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0
    matches = spark.createDataFrame([(1, i, d, 0, "x", 0, 9, 1.0, "copy", 0.0, 0) for i in (0, 2, 5, 9, 11) for d in (4, 5)], "q_doc long, q_idx int, doc_id long, s_idx int, s_display string, d int, m int, sim double, tier string, cos double, min_block int")
    spans = overlap.spans(matches)
    assert "Join" not in spans._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["span"], r["q_start"], r["q_end"], r["n_matches"]) for r in spans.collect()) == [(0, 0, 2, 4), (1, 5, 5, 2), (2, 9, 11, 4)]


def test_bigrams_are_counted_in_tasks(spark, monkeypatch):
    texts = ["", "a", "ab", "aab🙂é", "漢字漢字", None, "x" * 3000, "aa" * 50 + "b"]
    rows = spark.createDataFrame([(t,) for t in texts * 3], "norm string").coalesce(1)
    expected: dict = {}
    for t in texts * 3:
        for g in [t[i : i + 2] for i in range(len(t) - 1)] or [t] if t else []:
            expected[g] = expected.get(g, 0) + 1
    for most in (overlap.GRAMS, 2):
        monkeypatch.setattr(overlap, "GRAMS", most)
        found = overlap.bigram_counts(rows)
        assert {r["bigram"]: r["n"] for r in found.collect()} == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan  # no row for each place


def test_fingerprints_are_made_once(spark):
    """A filter on fingerprints does not make them again; block values are counted without moving texts."""
    from tesserae.plans import queries

    texts = spark.createDataFrame(lines(5, 50), "doc_id long, norm string")
    own = overlap.fingerprinted(texts).where("fp <> 0").select("norm", "fp").distinct()
    assert own._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    plan = queries.bucket_histogram(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any("norm" in x for x in plan.splitlines() if "Exchange" in x) and plan.count("ArrowEvalPython") == 1


def test_candidates_of_few_forms_are_not_joined_by_blocks(spark, monkeypatch):
    schema = "doc_id long, text string"
    lib = overlap.fingerprinted(library.library_sentences(spark.createDataFrame(lines(1, 300) + lines(1, 20), schema)))
    query = overlap.fingerprinted(library.library_sentences(spark.createDataFrame(lines(2, 30) + lines(1, 40), schema)))
    key = lambda df: sorted(map(tuple, df.collect()))
    few = overlap.candidates(query, lib)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and "posexplode" not in plan  # the library's distinct forms only
    assert few.dtypes == overlap._joined(query, lib).dtypes
    found = key(few)
    assert found == key(overlap._joined(query, lib)) and len(found) >= 40
    monkeypatch.setattr(overlap, "DENSE", 500)
    assert key(overlap.candidates(query, lib)) == found


def test_pairs_far_beyond_their_limit_are_dropped_early(monkeypatch):
    """Most pairs of texts of one language differ by far more than their limit: they leave in narrow windows, so few are
    measured. Distances are as before, also with few pairs at once, patterns in parts, and texts in other letters."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["th", "e", "ing", "on", "a", "s", "re"]) for _ in range(rnd.randint(20, 160))) for _ in range(120)]
    patterns = [*texts[:12], "漢" * 80, texts[3][:50] + "q" * 9 + texts[3][50:]]
    p, t = np.repeat(np.arange(len(patterns)), len(texts)), np.tile(np.arange(len(texts)), len(patterns))
    expected = sm.tier_distances([patterns[i] for i in p], [texts[i] for i in t])
    measured, columns = [], sm._columns
    monkeypatch.setattr(sm, "_FEW", 1)
    monkeypatch.setattr(sm, "_columns", lambda masks, place, m, *rest: measured.append(len(m)) or columns(masks, place, m, *rest))
    assert (sm.tier_distances_to(patterns, texts, p, t) == expected).all()
    m = np.array([max(len(patterns[i]), len(texts[j])) for i, j in zip(p, t)])
    near = sum(20 * abs(len(patterns[i]) - len(texts[j])) < 9 * k for i, j, k in zip(p, t, m))
    assert (expected < m).sum() <= sum(measured) < near / 4
    for lanes, table in ((5, sm._TABLE), (sm._LANES, 1 << 12)):
        monkeypatch.setattr(sm, "_LANES", lanes)
        monkeypatch.setattr(sm, "_TABLE", table)
        assert (sm.tier_distances_to(patterns, texts, p, t) == expected).all()


def test_one_scan_finds_literal_and_contained_matches(spark, monkeypatch):
    """The library's sentences are read once for both, and the results are those of two scans and of the joins."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    schema = "doc_id long, text string"
    held = library.library_sentences(spark.createDataFrame([*lines(1, 200), (None, "a line of no document at all")], schema)).persist()
    lib = overlap.fingerprinted(held.mapInArrow(counted, held.schema))
    query = overlap.fingerprinted(library.library_sentences(spark.createDataFrame([*lines(2, 30), *lines(1, 9), (71, "a line of no document at all"), (72, "short")], schema)))
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    literal, top = overlap.literal_and_contained(query, lib)
    found = key(literal), key(top)
    assert read.value == held.count() and all(len(x) > 9 for x in found)
    matches = key(overlap.all_matches(query, lib))
    assert read.value == 2 * held.count()
    apart = overlap.literal_matches(query, held.transform(overlap.fingerprinted))
    rest = overlap.pending(query, apart)
    assert found == (key(apart), key(overlap.containment_top(rest, lib)))
    assert matches == key(apart.unionByName(overlap.fallback_matches(rest, lib)))
    monkeypatch.setattr(overlap, "ASKED_FORMS", 0)
    assert found == tuple(map(key, overlap.literal_and_contained(query, lib)))
    held.unpersist()


def test_normal_forms_by_whole_words():
    """Spaces of every kind go, wide punctuation becomes plain, and parts without any are not translated."""
    from tesserae.operators import segment

    assert set(T.SPACES) == {chr(i) for i in range(0x110000) if not chr(i).split()}
    rnd = random.Random(3)
    for _ in range(3000):
        part = "".join(rnd.choice(T.SPACES + T.PUNCTUATION_FROM + "aBÄß漢İ🙂.,\x00") for _ in range(rnd.randint(0, 12)))
        assert segment._normal(part) == part.translate(segment._NORMAL).lower()
