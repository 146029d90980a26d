"""The quality classifier: measures and weights against plain computations, held-out accuracy, odd rows."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tesserae.llm import ranking

SCHEMA = "doc_id long, text string, lang string, quality int, x string, key long, label int"
MARKS = [chr(b) for b in range(33, 127) if not chr(b).isalnum()]
WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [None, "", " \n\t ", "a", "A B", "a a", "É È ß 漢字 🙂", "x" * 50_000, "der " * 9000, "a | b | c\n\n", "Wort. wort. Wort!", "\n", "é\n", "the end."]


def plain(text):
    text = text or ""
    body = [c for c in text.encode() if c not in b"\x20\x09\x0a\x0b\x0c\x0d"]
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(text)]
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    share = lambda x, of: np.log1p(100 * x / max(of, 1))
    high = sum("A" <= c <= "Z" or "À" <= c <= "Þ" for c in text)
    wide = sum(c >= 0x80 for c in body) - sum("À" <= c <= "Þ" for c in text)
    marks = [text.count(m) for m in MARKS]
    return [
        *(share(m, len(body)) for m in marks),
        *(share(x, len(body)) for x in (high, sum(48 <= c < 58 for c in body), wide, sum(marks))),
        *(share(x, len(w)) for x in (sum(a == b for a, b in zip(w, w[1:])), len(w) - len(set(w)), sum(runs.count(r) > 1 for r in runs) if len(runs) < 500 else len(runs), sum(x[-1] in MARKS for x in w))),
        np.log1p(len(w)), np.log1p(len(body) / max(len(w), 1)), np.log1p(text.count("\n")),
    ]


def test_measures():
    rnd = random.Random(3)
    texts = ODD + [" ".join(rnd.choice(["a", "B!", "cé", "d.\n", "Öl", "|", "7"]) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    found = ranking.measures(pa.array(texts))
    assert found.shape == (len(texts), ranking.MEASURES)
    for text, x in zip(texts, found, strict=True):
        assert x == pytest.approx(plain(text)), text
    assert not ranking.measures(pa.array([None, ""])).any()
    assert len(ranking.measures(pa.array(["x", "y z"]).slice(1))) == 1


def test_weights_minimise_the_loss():
    rng = np.random.default_rng(5)
    d = rng.normal(size=(4000, 3)) + [1.0, 0, -0.5]
    w = ranking.bradley_terry(d, 0.01)
    loss = lambda v: np.logaddexp(0, -d @ v).mean() + 0.005 * v @ v
    assert all(loss(w) < loss(w + step) for step in np.vstack([np.eye(3), -np.eye(3)]) * 1e-3)
    assert w[0] > 0.3 and w[2] < 0


def test_threshold_is_the_bad_ones_quantile():
    x = np.arange(100, dtype=float)[:, None]
    label = (np.arange(100) >= 30).astype(int)
    model = ranking.fit(x, label, 0.3)
    assert (model.good(x) == (label == 1)).all()
    assert (ranking.fit(x[:30], label[:30], 1.0).scores(x) == 0.5).all()


def documents(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(600):
        w = [rnd.choice(words) for _ in range(rnd.randint(20, 80))]
        bad = i % 4 == 0
        if bad:
            w = [x + "$$$" for x in w] if i % 8 else [w[0]] * 40
        rows.append((i, " ".join(w), "en", int(not bad) if i % 5 else None, "x", 1, 2))
    odd = [(1000 + i, t, None, None, None, None, None) for i, t in enumerate(ODD)] + [(None, "text", "en", 1, "x", 1, 1)]
    return spark.createDataFrame(rows + odd + rows[:1], SCHEMA), rows


def test_held_out_accuracy(spark):
    docs, rows = documents(spark)
    labels = docs.select("doc_id", "quality", "x").union(spark.createDataFrame([(7, 0, ""), (1, None, "")], "doc_id long, quality int, x string"))
    made = ranking.classify(docs, labels, options=ranking.Ranking(sample=100, pairs=5000)).collect()
    assert len(made) == docs.count()
    by = {r["doc_id"]: r for r in made}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 0) for i, r in by.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in made)
    held = [(by[i]["predicted"], int(i % 4 != 0)) for i, *_ in rows if by[i]["held_out"]]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.97
    again = ranking.classify(docs.repartition(3), labels, options=ranking.Ranking(sample=100, pairs=5000)).collect()
    assert {r["doc_id"]: r["score"] for r in again} == pytest.approx({i: r["score"] for i, r in by.items()})


def test_held_out_labels_do_not_matter(spark):
    docs, _ = documents(spark)
    labels = docs.select("doc_id", "quality").distinct()
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality")
    options = ranking.Ranking(sample=50, pairs=2000)
    a, b = (ranking.classify(docs, y, options=options).select("doc_id", "score").collect() for y in (labels, turned))
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_without_labels_or_rows(spark):
    docs, _ = documents(spark)
    labels = docs.select("doc_id", "quality")
    assert {(r["score"], r["predicted"]) for r in ranking.classify(docs, labels.where("quality = 1")).collect()} == {(0.5, 1)}
    assert ranking.classify(docs.limit(0), labels).count() == 0
    assert ranking.classify(docs, labels.limit(0)).where("score <> 0.5").count() == 0


def test_every_labelled_row_counts(spark):
    """With ``sample=1`` the model is still that of all labelled rows; the quantile is exact beyond what is collected."""
    docs, _ = documents(spark)
    labels = docs.select("doc_id", "quality").distinct()
    a, b = (ranking.classify(docs, labels, options=o).select("doc_id", "score").collect() for o in (ranking.Ranking(), ranking.Ranking(sample=1)))
    assert sorted(map(str, a)) == sorted(map(str, b))
    rng = np.random.default_rng(2)
    x = np.zeros((60, ranking.MEASURES), np.float32)
    x[:, :3] = rng.normal(size=(60, 3)) + (np.arange(60) % 3 > 0)[:, None]
    label = (np.arange(60) % 3 > 0).astype(int)
    rows = spark.createDataFrame([(int(y), i, v.tolist()) for i, (y, v) in enumerate(zip(label, x))], "label int, key long, x array<float>")
    model = ranking._fitted(rows, ranking.Ranking(group=1000))
    good, bad = x[label == 1].astype(float), x[label == 0].astype(float)
    used = [0, 1, 2]
    mean = (good.mean(0) + bad.mean(0)) / 2
    spread = np.sqrt((((good - mean) ** 2).mean(0) + ((bad - mean) ** 2).mean(0)) / 2)[used]
    w = ranking.bradley_terry(((good[:, None] - bad[None]).reshape(-1, ranking.MEASURES)[:, used]) / spread, 1e-3)
    assert model.weights[used] == pytest.approx(w / spread, rel=1e-5) and not model.weights[3:].any()
    grouped = ranking._grouped(rows, 20, 40, ranking.Ranking(group=5)).collect()
    assert sum(len(r["good"]) for r in grouped) >= 40 * ranking.MEASURES and len(grouped) > 1
    s = spark.range(30_000).selectExpr("cast(id * 7919 % 30011 as double) as s")
    assert ranking._at(s, [0, 12_345, 29_999]) == [sorted(i * 7919 % 30011 for i in range(30_000))[k] for k in (0, 12_345, 29_999)]
