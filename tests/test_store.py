"""The stored library and stored tables: batches, pruned reads, replacement by key, and what failures leave behind."""

import random

import pytest

from tesserae.operators import library, overlap, segment, store
from tesserae.sources import tables
from tesserae.sources.folders import Folders

LIBRARY = [
    ("a.txt", "The survey covers nine villages in the northern valley!\nEach household answered the same list of questions twice.\n"),
    ("b.txt", "本文讨论河流沉积物的来源与搬运过程，并比较三种取样方法。\n潮汐会改变河口的盐度分布；这是常见现象。\n"),
    ("c.txt", "The survey covers nine villages in the northern valley!\nA second sentence that only this one has.\n"),
    ("d.txt", None),
]
QUERY = [(10, "The survey covers nine villages in the northern valley!\nEach household answered this same list of question twice.\n三种取样方法并比较，本文讨论河流沉积物的来源与搬运过程。\nNothing else here was printed before.")]
FIELDS = ("q_doc", "q_idx", "name", "s_idx", "d", "m", "sim", "tier", "cos", "min_block")


def files(spark, rows):
    return spark.createDataFrame([(n, t, 0) for n, t in rows], "name string, text string, doc_id int")


def asked(spark):
    return library.library_sentences(spark.createDataFrame(QUERY, "doc_id long, text string"))


def rows(matches, names):
    return sorted(map(tuple, matches.join(names, "doc_id").select(*FIELDS).collect()), key=str)


def unstored(spark, some):
    """The same matches without a store."""
    docs = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(some)], "doc_id long, name string, text string")
    return rows(overlap.all_matches(asked(spark), library.library_sentences(docs)), docs.select("doc_id", "name"))


def test_index_check_append_check_again(spark, tmp_path):
    kept = store.SentenceStore(spark, str(tmp_path / "lib"))
    assert kept.batches() == [] and kept.stats().first()["documents"] == 0
    assert kept.literal_matches(asked(spark)).count() == 0
    assert kept.append(files(spark, LIBRARY[:2])) == 2
    first = kept.params_key()
    assert {m[2] for m in rows(kept.literal_matches(asked(spark)), kept.names())} == {"a.txt"}
    again = [("z.txt", LIBRARY[0][1]), *LIBRARY[2:], ("e.txt", LIBRARY[2][1])]
    assert kept.append(files(spark, again)) == 2  # one content is known, one comes twice
    assert kept.append(files(spark, again)) == 0 and kept.batches() == [0, 1]
    assert kept.params_key() != first and kept.params_key(False) != kept.params_key()
    assert {r["name"] for r in kept.names().collect()} == {n for n, _ in LIBRARY}
    assert sorted(r["doc_id"] for r in kept.docs().collect()) == [1, 2, 3, 4]
    stats = kept.stats().first()
    assert (stats["documents"], stats["sentences"]) == (4, kept.sentences().count())
    matches = rows(kept.all_matches(asked(spark)), kept.names())
    assert matches == unstored(spark, LIBRARY) and {m[2] for m in matches} == {"a.txt", "b.txt", "c.txt"}
    ids = {r["name"]: r["doc_id"] for r in kept.names().collect()}
    assert kept.source_text([ids["c.txt"]]).first()["text"] == LIBRARY[2][1].replace("\n", "")
    kept.compact()
    assert len(kept.batches()) == 1
    kept.vacuum()
    assert rows(kept.literal_matches(asked(spark)), kept.names()) == [m for m in matches if m[-1] is not None]
    assert Folders(spark).names(f"{kept.root}/docs") == ["batch=2"]


def test_only_needed_folders_are_read(spark, tmp_path):
    kept = store.SentenceStore(spark, str(tmp_path / "lib"))
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40)) for _ in range(300)]
    kept.append(files(spark, [(f"{i:03}", t) for i, t in enumerate(texts)]))
    one = library.library_sentences(spark.createDataFrame([(1, texts[7])], "doc_id long, text string"))
    found = kept.candidates(one)
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]
    assert "block#" in filters and "range#" in filters
    read = int(plan[plan.index("PartitionCount: ") :].split()[1].rstrip(",")) if "PartitionCount: " in plan else None
    there = kept._table("blocks", store._BLOCKS, ", block int, range int").select("block", "range").distinct().count()
    assert there > 50 and (read is None or read <= 4)
    assert found.where("distance = 0").count() == 1


def test_what_a_failed_addition_left_is_not_read(spark, tmp_path, monkeypatch):
    kept = store.SentenceStore(spark, str(tmp_path / "lib"))
    kept.append(files(spark, LIBRARY[:1]))
    before = rows(kept.literal_matches(asked(spark)), kept.names())

    def fail(*_):
        raise OSError("the disk is gone")

    with monkeypatch.context() as m:
        m.setattr(store.SentenceStore, "_write_blocks", fail)
        with pytest.raises(OSError):
            kept.append(files(spark, LIBRARY))
    assert rows(kept.literal_matches(asked(spark)), kept.names()) == before and kept.sentences().count() == 2
    assert kept.append(files(spark, LIBRARY)) == 3
    assert {m[2] for m in rows(kept.literal_matches(asked(spark)), kept.names())} == {"a.txt", "c.txt"}
    Folders(spark).create(f"{kept.root}/commits/99", "0")  # cut off while it was written
    assert kept.docs().count() == 4


# ---- tables ----

SCHEMA = "key string, at long, value string, bucket2 int"


def put(spark, path, *some):
    tables.upsert(spark.createDataFrame([(*r, 1) for r in some], SCHEMA), path, "key", order="at", buckets=8)


def stored(spark, path):
    return sorted((r["key"], r["at"], r["value"]) for r in tables.read(spark, path, SCHEMA).collect())


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    assert stored(spark, path) == []
    put(spark, path, ("a", 1, "x"), ("b", 1, "y"), ("a", 2, "z"), ("c", 0, None))
    assert stored(spark, path) == [("a", 2, "z"), ("b", 1, "y"), ("c", 0, None)]
    for _ in range(2):  # a repeated batch leaves one row
        put(spark, path, ("b", 0, "older but later"), ("d", 5, "new"))
        assert stored(spark, path) == [("a", 2, "z"), ("b", 0, "older but later"), ("c", 0, None), ("d", 5, "new")]
    wanted = spark.createDataFrame([("d",), ("none",), ("d",)], "key string")
    assert [r["at"] for r in tables.lookup(wanted, path, "key").collect()] == [5]
    assert "PartitionFilters: [bucket" in tables.lookup(wanted, path, "key")._jdf.queryExecution().executedPlan().toString().replace("isnotnull(", "")
    put(spark, path)
    assert len(stored(spark, path)) == 4
    with pytest.raises(Exception, match="a key is null"):
        put(spark, path, (None, 1, "x"))
    assert len(stored(spark, path)) == 4


def test_upsert_that_was_cut_off(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    put(spark, path, *((str(i), i, "old") for i in range(40)))
    real = tables.recover
    calls = []

    def once(session, at):
        calls.append(at)
        if len(calls) == 2:
            raise KeyboardInterrupt
        real(session, at)

    with monkeypatch.context() as m:
        m.setattr(tables, "recover", once)
        with pytest.raises(KeyboardInterrupt):
            put(spark, path, ("3", 99, "new"), ("x", 1, "new"))
    got = stored(spark, path)  # a reader finishes the move
    assert len(got) == 41 and ("3", 99, "new") in got and ("x", 1, "new") in got
    assert not [x for x in Folders(spark).names(path) if x.startswith(("_pending", "_stage"))]


def test_a_small_check_holds_no_pairs(spark, tmp_path, monkeypatch):
    """Matches are those of held pairs, and of a small query side no pair is dealt out by its distances."""
    kept = store.SentenceStore(spark, str(tmp_path / "s"))
    text = "The river carries sand to the sea and the tide brings it back. " * 3
    for name in ("a", "b"):
        kept.append(spark.createDataFrame([(name, f"{text}Number {name} of two that differ.")], "name string, text string"))
    query = overlap.fingerprinted(segment.sentences(spark.createDataFrame([(1, f"{text}A closing line.")], "doc_id long, text string")))
    small = kept.literal_matches(query)
    assert "distance(" not in small._jdf.queryExecution().optimizedPlan().toString()
    found = sorted(map(str, small.collect()))
    monkeypatch.setattr(overlap, "ASKED_FORMS", 0)
    assert found and found == sorted(map(str, kept.literal_matches(query).select(*small.columns).collect()))
