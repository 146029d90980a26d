"""Null and repeated ids, repeated rows and clashing column names, for every operator and stage: defined rows, no crash."""

import collections
import hashlib
import zlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tesserae.llm import bpe, dedup, jaccard, katz, mixing, pfor, pii, quality, sharding, stages

#: Names that the operators use inside.
CLASH = ("ends", "Shard", "SLOT", "part", "row", "key", "size", "n", "cid", "base", "spans", "kept", "q_row", "m_skey", "r_row", "p_base", "j_id", "salt", "blocks")
LONG = " ".join(f"word{i} of{i} the{i} long{i} text{i}" for i in range(40))


def odd(spark):
    """Two rows of id 1 with different texts, two equal rows of id 2, two null ids, a null text."""
    texts = [(1, LONG), (1, LONG.upper() + " and more words here"), (2, "same row"), (2, "same row"), (None, "no id, mail a.b@c.de"), (None, None), (3, ""), (4, LONG), (5, "one two three " * 30)]
    rows = [(i, t, "en" if i else None, "a" if i != 2 else None, len(t or ""), *range(len(CLASH))) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASH))


def ids(rows, column="doc_id"):
    return collections.Counter(r[column] for r in rows)


EXPECTED = collections.Counter([1, 1, 2, 2, None, None, 3, 4, 5])


def test_token_files(spark, tmp_path):
    files = pfor.write_ids(odd(spark), str(tmp_path / "x"), P.path("word_bpe_49k.json"), partitions=3)
    rows = pfor.read_ids(spark, str(tmp_path / "x"), files).orderBy("start").collect()
    assert ids(rows) == EXPECTED and [r["doc_id"] for r in rows] == [None, None, 1, 1, 2, 2, 3, 4, 5]
    assert all(r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"])) for r in rows)


def test_other_tokenizer_takes_whole_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    files = pfor.write_ids(odd(spark), str(tmp_path / "x"), path, partitions=2)
    t = Tokenizer.from_file(path)
    got = sorted(tuple(r["ids"][:-1]) for r in pfor.read_ids(spark, str(tmp_path / "x"), files).collect())
    assert got == sorted(tuple(t.encode(r["text"] or "", add_special_tokens=False).ids) for r in odd(spark).collect())


def test_repeats(spark):
    rows = dedup.find_repeats(odd(spark)).collect()
    assert ids(rows) == EXPECTED
    cut = dedup.remove_repeats(odd(spark))
    assert cut.columns == odd(spark).columns and ids(cut.collect()) == EXPECTED
    assert sorted(r["text"] for r in cut.where("doc_id = 1 or doc_id = 4").collect())[0] == ""  # 4 repeats a row of 1


def test_shards(spark):
    x = sharding.shard(odd(spark), 4)
    assert [c for c in x.columns if c.lower() in ("shard", "slot")] == ["shard", "slot"] and "ends" in x.columns
    rows = x.collect()
    assert ids(rows) == EXPECTED and {r["ends"] for r in rows} == {0} and {r["part"] for r in rows} == {3}
    assert sorted(collections.Counter(r["shard"] for r in rows).values()) == [2, 2, 2, 3]


def test_bytes(spark):
    rows = bpe.encode_bpe(odd(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert ids(rows) == EXPECTED
    assert sorted(bytes(r["decoded"]) for r in rows) == sorted((r["text"] or "").encode() for r in odd(spark).collect())
    assert all(r["decoded_sha256"] == hashlib.sha256(bytes(r["decoded"])).hexdigest() for r in rows)


def test_personal_data(spark):
    rows = pii.report(odd(spark)).collect()
    assert ids(rows) == EXPECTED and sum(r["n_email"] for r in rows) == 1
    x = pii.redact(odd(spark))
    assert x.columns == odd(spark).columns and [r["text"] for r in x.where("doc_id is null and text is not null").collect()] == ["no id, mail [EMAIL]"]


def test_near_duplicates(spark):
    rows = jaccard.jaccard_components(odd(spark)).collect()
    assert ids(rows) == EXPECTED
    of = collections.defaultdict(set)
    for r in rows:
        of[r["doc_id"]].add(r["component_id"])
    assert of[4] == {1} and of[1] == {1} and of[2] == {2} and of[3] == {3} and of[None] == {None}
    kept = jaccard.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns and ids(kept.where("doc_id = 2").collect()) == {2: 1}


def test_scores(spark):
    rows = katz.score(odd(spark), model=katz.Katz(order=3)).collect()
    assert ids(rows) == EXPECTED and all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 1) for r in rows)


def test_quality(spark):
    assert ids(quality.assess(odd(spark)).collect()) == EXPECTED
    kept = quality.keep(odd(spark))
    assert kept.columns == odd(spark).columns and ids(kept.collect()) == {1: 2, 4: 1}


def test_mixing(spark):
    rows = mixing.assign(odd(spark)).collect()
    assert ids(rows) == EXPECTED and all(r["taken"] <= 3 * r["size"] for r in rows)
    x = mixing.apply(odd(spark))
    assert x.columns == odd(spark).columns
    words = collections.Counter()
    for r in x.collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert words == collections.Counter({k: v for k in set(ids(rows)) if (v := sum(r["taken"] for r in rows if r["doc_id"] == k))})


@pytest.mark.parametrize("name", ["quality_rules", "near_duplicates", "personal_data", "mixture"])
def test_stages_keep_columns(spark, name):
    stage, none = getattr(stages, name), odd(spark).limit(0)
    assert stage(spark, odd(spark), "").columns == odd(spark).columns
    assert stage(spark, none, "").collect() == []
    narrow = odd(spark).select("doc_id", "text")
    assert stage(spark, narrow, "").columns == narrow.columns
    assert stages.tokens(spark, none, "").count() == 0


def test_thresholds_of_many_groups_are_salted(spark, monkeypatch):
    df = odd(spark)
    whole = sorted(map(str, quality.assess(df).collect()))
    monkeypatch.setattr(quality, "GROUPS", 0)
    assert sorted(map(str, quality.assess(df).collect())) == whole


def test_hot_tokens_are_split(spark, monkeypatch):
    """Lists of tokens that are in many sets lie in pieces; links between the pieces are found all the same."""
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(w if j != 3 * i % 80 else f"x{i}" for j, w in enumerate(base)) for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    whole = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df, words=3, num=80).collect()}
    monkeypatch.setattr(jaccard, "HOT", 8)
    monkeypatch.setattr(jaccard, "PART", 200)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df, words=3, num=80).collect()} == whole
    assert len(set(whole.values())) == 1


def test_shared_folder(spark):
    from tesserae.llm import common

    assert common.arrow_path("file:/tmp/x")[1] == "/tmp/x" and common.arrow_path("/tmp/x")[1] == "/tmp/x" and common.arrow_path("file:///tmp/x")[1] == "/tmp/x"
    kept = common.stored(spark.range(3), "test")
    assert kept.count() == 3
    common.discard(kept)
    with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST|PATH_NOT_FOUND"):
        spark.read.parquet(kept.stored_at).select(F.sum("id")).collect()
