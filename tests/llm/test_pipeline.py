"""The pipeline's stages, one by one, each held against a plain computation over its own input; and run() against them."""

import collections
import hashlib
import random
import re

import duckdb
import public_tokenizers as P
import pytest

import corpus_pipeline
from tesserae.llm import queries

from .test_operators import BASE, WORD, made, plain_components, plain_spans, plain_targets


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(21)
    texts = [t for t in made(160, 5) if len(t.split(" ")) > 50]
    clean = [" ".join(rnd.choice(["Alpha", "beta", "gamma", "delta"]) + str(rnd.randrange(10**6)) for _ in range(80)) for _ in range(90)]
    near = [" ".join(w if rnd.random() > 0.01 else "changed" for w in t.split(" ")) for t in clean[:20]]
    private = [f"{t} write to ann.b{i}@mail.org or 10.0.0.{i} password=Ab{i}9xk2Qm77z end" for i, t in enumerate(clean[80:])]
    clean = clean[:80]
    junk = ["short", "", None, "same words again " * 60, *(" ".join(f"w{rnd.randrange(10**6)}&&&" for _ in range(80)) for _ in range(6))]
    rows = [(i, t, ["en", "de"][i % 2], ["a", "b", "a", None][i % 4], len(t or "")) for i, t in enumerate(texts + clean + near + private + junk)]
    d = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def test_stages(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}.parquet")
        seen[name] = (docs.collect(), spark.read.parquet(f"{folder}/{name}.parquet").collect())
        docs = spark.read.parquet(f"{folder}/{name}.parquet")
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns

    before, after = seen["quality_rules"]
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    wanted = {r[0] for r in db.sql(f"SELECT doc_id FROM ({queries.ORACLE_SQL['op8_adaptive_quality']}) WHERE kept").fetchall()}
    assert {r["doc_id"] for r in after} == wanted and 0 < len(after) < len(before)
    assert {tuple(r) for r in after} == {tuple(r) for r in before if r["doc_id"] in wanted}

    before, after = seen["near_duplicates"]
    before = sorted(before)
    roots, _ = plain_components([r["text"] for r in before], 5, 80, 100)
    assert sorted(after) == [r for i, r in enumerate(before) if roots[i] == i] and len(after) < len(before)

    before, after = seen["personal_data"]
    after = {r["doc_id"]: r for r in after}
    for r in before:
        text, new = r["text"], after[r["doc_id"]]
        assert new["n_chars"] == len(new["text"]) and (new["lang"], new["source"]) == (r["lang"], r["source"])
        for span in filter(None, plain_spans(text).split(",")):
            kind, a, b = span.split(":")
            assert text[int(a) : int(b)] not in new["text"] and f"[{kind.upper()}]" in new["text"]
        if not re.search("[0-9@=]", text):
            assert new["text"] == text
        assert "password=Ab" not in new["text"]
    assert sum("[EMAIL]" in r["text"] for r in after.values()) >= 8

    before, after = seen["mixture"]
    size = lambda r: len(WORD.findall(r["text"]))
    sizes, taken = collections.Counter(), collections.Counter()
    for r in before:
        sizes[r["source"]] += size(r)
    for r in after:
        taken[r["source"]] += size(r)
    goal, longest = plain_targets(sizes), max(map(size, before))
    assert set(after) <= set(before) and max(collections.Counter(after).values()) <= 3
    assert all(abs(taken[s] - goal[s]) <= longest / 2 for s in sizes)

    import tiktoken

    from tesserae.llm import bpe

    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    before, after = seen["tokens"]
    made_ = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in after)
    plain = collections.Counter()
    for r in before:
        ids = ref.encode_ordinary(r["text"])
        plain[(r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest(), tuple(ids))] += 1
    assert made_ == plain

    whole = collections.Counter(map(str, corpus_pipeline.run(spark, folder).collect()))
    assert whole == collections.Counter(map(str, seen["tokens"][1]))
    assert len(BASE) == 4
