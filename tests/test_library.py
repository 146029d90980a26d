"""The library's own operators on small tables with literal rows."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tesserae.functions import fingerprint as fp
from tesserae.functions import grading as G
from tesserae.functions import similarity as sm
from tesserae.functions import text as T
from tesserae.operators import grading, library, overlap, segment
from tesserae.sources import files, sinks

LIBRARY = [
    (1, "第一章 绪论\n本文讨论河流沉积物的来源与搬运过程，并比较三种取样方法。\n潮汐会改变河口的盐度分布；这是常见现象。\n"),
    (2, "## method\nThe survey covers nine villages in the northern valley!\nEach household answered the same list of questions twice.\n参考文献\n[1] Someone."),
]
QUERY = [(10, "1) Intro\nThe survey covers nine villages in the northern valley!\nEach household answered this same list of question twice.\nNothing else here was ever printed before in any known book.\nReferences\n[1] x")]


@pytest.fixture(scope="module")
def tables(spark):
    schema = "doc_id long, text string"
    lib = library.library_sentences(spark.createDataFrame(LIBRARY, schema)).persist()
    query = library.library_sentences(spark.createDataFrame(QUERY, schema)).persist()
    return query, lib


def test_normal_form_and_sentences(spark):
    x = spark.createDataFrame([("Ａ，Ｂ：“x” Ｙ　é\x1cZ",), ("",), (None,)], "t string").select(T.normalize(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in x] == ['ａ,ｂ:"x"ｙéz', "", None]
    rows = segment.sentences(spark.createDataFrame([(1, "  Short!  A longer one here? tail of the line\r\n\r\n# Head\nok"), (2, None), (3, "")], "doc_id long, text string")).orderBy("idx").collect()
    assert [(r["idx"], r["display"], r["norm"], r["start"], r["end"]) for r in rows] == [
        (0, "Short!", "short!", 0, 6), (1, "A longer one here?", "alongeronehere?", 6, 26), (2, "tail of the line", "tailoftheline", 26, 43), (3, "# Head", "#head", 47, 53),
    ]


def test_references_and_chapters(spark):
    docs = spark.createDataFrame(LIBRARY, "doc_id long, text string")
    cut = {r["doc_id"]: r["n"] for r in docs.select("doc_id", segment.excluded_chars(F.col("text")).alias("n")).collect()}
    assert cut == {1: 0, 2: len("参考文献\n[1] Someone.")}
    ch = {(r["doc_id"], r["title"]) for r in segment.chapters(docs).collect()}
    assert ch == {(1, "第一章 绪论"), (2, "method")}
    of = {(r["doc_id"], r["idx"]): r["chapter"] for r in segment.chapter_of(segment.sentences(docs), segment.chapters(docs)).collect()}
    assert of[(2, 0)] == "method" and of[(2, 1)] == "（前置部分）"


def test_fingerprints(spark):
    assert fp.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    texts = ["the same sentence about rivers", "河流沉积物的来源与搬运过程", "x", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select(fp.simhash("s").alias("f")).collect()
    for t, r in zip(texts, rows):
        grams = [t[i : i + 2] for i in range(len(t) - 1)] or [t] if t else []
        votes = [sum(1 if fp.fnv1a(g.encode()) >> b & 1 else -1 for g in grams) for b in range(64)]
        expected = sum(1 << b for b in range(64) if votes[b] > 0)
        assert r["f"] is None if t is None else r["f"] & (2**64 - 1) == expected
    b = spark.createDataFrame([(-1,), (0x1234,)], "f long").select(fp.blocks(F.col("f")).alias("b")).collect()
    assert b[0]["b"] == [65535] * 4 and b[1]["b"] == [0x1234, 0, 0, 0]


def test_tiers_at_their_borders(spark):
    pairs = [("a" * 20, "a" * 16 + "b" * 4), ("a" * 20, "a" * 13 + "b" * 7), ("a" * 20, "a" * 12 + "b" * 8), ("a" * 20, "b" * 20), ("a" * 20, "a" * 11 + "b" * 9), ("a" * 20, "b" * 9 + "a" * 11), ("a" * 20, "a" * 9), ("b" * 7 + "a" * 11, "a" * 18 + "cc"), ("", "")]
    x = spark.createDataFrame(pairs, "a string, b string").withColumn("d", sm.distance("a", "b")).withColumn("m", sm.longest(F.col("a"), F.col("b"))).withColumn("t", sm.tier(F.col("d"), F.col("m"))).collect()
    # at 9 of 20 a pair counts only if each row of the table has a value below 9: as the last two do where 2 of the 9 are
    # insertions at the end
    assert [r["t"] for r in x] == ["copy", "near", "suspect", None, None, None, None, "suspect", None]


def test_check(tables):
    query, lib = tables
    m = overlap.all_matches(query, lib)
    best = {r["q_idx"]: (r["doc_id"], r["tier"]) for r in overlap.best_matches(m).collect()}
    assert best == {1: (2, "copy"), 2: (2, "copy")}
    s = overlap.summary(query, overlap.best_matches(m)).collect()[0]
    assert 0.4 < s["total_ratio"] < 0.7 and s["single_max_ratio"] == s["total_ratio"] and s["level"] == "高"
    span = overlap.spans(m).collect()
    assert [(r["q_start"], r["q_end"]) for r in span] == [(1, 2)]
    src = overlap.source_stats(query, overlap.best_matches(m)).collect()
    assert [(r["doc_id"], r["name"], r["n_matches"]) for r in src] == [(2, "2", 2)]
    j = sinks.summary_json(overlap.summary(query, overlap.best_matches(m)), overlap.source_stats(query, overlap.best_matches(m)))
    assert json.loads(j.first()["json"])["sources"][0]["n_matches"] == 2
    html = sinks.report_html(query, sinks.hit_rows(overlap.best_matches(m), overlap.evidence(m)), j).first()["html"]
    assert html.count("<mark ") == 2
    assert overlap.all_matches(query.limit(0), lib).count() == 0


def test_escapes(spark):
    r = spark.createDataFrame([("</script><img src='x'>& ",)], "s string").select(T.escape_html(F.col("s")).alias("h"), T.script_safe(F.to_json(F.struct("s"))).alias("j")).first()
    assert "<" not in r["h"] and "&#x27;" in r["h"] and "<" not in r["j"] and " " not in r["j"]
    assert json.loads(r["j"])["s"] == "</script><img src='x'>& "


def test_library_tables(spark):
    docs = library.with_sha(spark.createDataFrame([(5, "a", 1), (6, "a", 1), (7, "b", 1), (8, None, 0)], "doc_id long, text string, n_chars long"))
    known = docs.where("doc_id = 7").select("sha256", F.lit(40).cast("long").alias("doc_id"))
    new = library.new_documents(docs, known, order_col="doc_id")
    assert sorted(r["doc_id"] for r in new.collect()) == [5, 8]
    assert sorted(r["doc_id"] for r in library.numbered(new.drop("doc_id"), known, order_col="sha256").collect()) == [41, 42]


def test_grading_expressions(spark):
    one = lambda c, *v: spark.createDataFrame([v], ", ".join(f"c{i} string" for i in range(len(v)))).select(c.alias("x")).first()["x"]
    c0 = F.col("c0")
    assert one(G.redact(c0), "id 110101199003071234, mail a.b@c.org, 13812345678, 010-1234-5678, 学号：AB123456, 123456789012") == "id [已脱敏], mail [已脱敏], [已脱敏], [已脱敏], [已脱敏], 123456789012"
    assert one(G.paper_type(c0), "张三-毕业论文.docx") == "thesis" and one(G.paper_type(c0), "x.txt") == "course"
    assert [one(G.band(c0.cast("double")), v) for v in ("95", "80", "59.9")] == ["优秀", "良好", "不及格"]
    assert [one(G.number(c0, 0.0), v) for v in ("78分", "约85.5/100", "无")] == [78.0, 85.5, 0.0]
    assert one(G.chunks(c0, 10), "aaaa\n\nbbbb\n \ncccccccccccc\n\nd") == ["aaaa\n\nbbbb", "cccccccccccc", "d"]
    assert json.loads(one(G.loose_json(c0), 'x ```json\n{"a": 1}\n``` y')) == {"a": 1} and one(G.loose_json(c0), "nothing") is None
    d = one(G.dimension(c0), '{"score": "150", "evidence": ["a", " ", "b"], "comment": " ok "}')
    assert (d["score"], d["confidence"], d["evidence"], d["comment"]) == (100.0, 0.7, ["a", "b"], "ok")
    assert [one(G.is_local_endpoint(c0), u) for u in ("http://localhost:1/v1", "http://[::1]/", "http://localhost.evil.org/", "nonsense")] == [True, True, False, False]
    assert one(G.paper_key(c0), "1班/张三 论文.docx") != one(G.paper_key(c0), "2班/张三 论文.docx")
    assert one(G.title(c0), "#\n## ab\n# A title\n") == "A title"
    assert len(one(G.excerpt(c0), "x" * 5000)) == 1800 + 1000 + 800 + 2 * len("\n\n……（中略）……\n\n")


def test_grading(spark):
    dims = grading.rubric(spark, {"course": {"name": "r", "dimensions": [{"name": "a", "weight": 60, "criteria": " x  y "}, {"name": "b", "weight": 40}]}})
    with pytest.raises(ValueError):
        grading.rubric(spark, {"course": {"name": "r", "dimensions": [{"name": "a", "weight": 60}]}})
    papers = spark.createDataFrame([("p1", "text one"), ("p2", "fails here")], "path string, text string")

    def scorer():
        def client(prompt):
            if "fails" in prompt:
                raise RuntimeError("no answer")
            return '{"score": 80, "confidence": 0.5}' if prompt.startswith("a") else "```{\"score\": \"90\", \"confidence\": 0.5}```"

        return client

    scores = grading.model_scores(papers, dims, scorer)
    assert sorted(r["error"] or "" for r in scores.where("path = 'p2'").collect())[0].startswith("no answer")
    t = grading.totals(scores.where("error is null")).first()
    assert (t["total"], t["band"], t["confidence"]) == (84.0, "良好", 0.5) and "人工复评" in t["flags"][0]
    mock = grading.mock_scores(papers, dims).collect()
    assert all(35 <= r["score"] <= 96 and r["evidence"] == [] for r in mock)


def test_cache_signature(spark):
    fields = "key string, model string, mock boolean, ptype string, rubric_sig string, redact_pii boolean, size long, mtime long"
    row = ("k", "m", False, "course", "s", None, 1, 2)
    cache = spark.createDataFrame([(*row, None)], fields + ", error string")
    hit = lambda r: grading.cached(spark.createDataFrame([r], fields), cache).first()["hit"]
    assert hit(row) and not hit((*row[:6], 5, 2)) and not hit((*row[:5], True, 1, 2))
    failed = spark.createDataFrame([(*row, "x")], fields + ", error string")
    assert not grading.cached(spark.createDataFrame([row], fields), failed).first()["hit"]


def test_files(spark, tmp_path):
    root = tmp_path / "in"
    (root / "a" / "output").mkdir(parents=True)
    (root / "a" / "one.txt").write_bytes("第一行标题\n正文".encode("gb18030"))
    (root / "a" / "~tmp.txt").write_text("x")
    (root / "a" / "output" / "r.txt").write_text("x")
    (root / "b.doc").write_bytes(b"old")
    with zipfile.ZipFile(root / "c.DOCX", "w") as z:
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        p = lambda t, s="": f'<w:p>{s and f"""<w:pPr><w:pStyle w:val="{s}"/></w:pPr>"""}<w:r><w:t>{t}</w:t></w:r></w:p>'
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{p('Top', 'Heading1')}{p('Body text')}<w:tbl><w:tr><w:tc>{p('x')}</w:tc><w:tc>{p('y')}</w:tc></w:tr></w:tbl></w:body></w:document>")
    got = {os.path.basename(r["path"]): r for r in files.papers(files.collect(spark, str(root))).collect()}
    assert sorted(got) == ["b.doc", "c.DOCX", "one.txt"]
    assert got["one.txt"]["text"] == "第一行标题\n正文" and got["one.txt"]["title"] == "第一行标题" and got["b.doc"]["error"]
    assert got["c.DOCX"]["text"] == "## Top\nBody text\nx | y"


def test_vector_fallback(spark):
    """Rewritten sentences match by their vectors alone: strong ones only, none without a vector."""
    lib = library.library_sentences(spark.createDataFrame([("l", "Completely original wording about rivers flowing north.")], "doc_id string, text string"))
    asked = library.library_sentences(spark.createDataFrame([(c, t) for c, t in zip("abc", ["Zyx quick jumps vex bad guy who ponders much.", "Five wizards hatch plump quail eggs by dusk.", "My jukebox played odd hits until midnight came."])], "doc_id string, text string"))
    norm = lambda df: [r["norm"] for r in df.orderBy("doc_id").collect()]
    a, b, _ = norm(asked)
    vectors = spark.createDataFrame([(norm(lib)[0], [1.0, 0.0]), (a, [0.8, 0.6]), (b, [0.6, 0.8])], "norm string, vec array<double>")
    rows = overlap.all_matches(asked, lib, vectors=vectors).collect()
    assert [(r["q_doc"], r["doc_id"], r["tier"], r["cos"]) for r in rows] == [("a", "l", "semantic", 0.8)]
    assert overlap.all_matches(asked, lib).count() == 0


def test_one_search_finds_what_all_lines_give(spark):
    """Title, headings and the cut at the references by one search of a text, against line by line; lines that do not count
    do not become values."""
    import random

    from tesserae.functions import text as T

    bare = lambda x: T.strip(F.regexp_replace(x, "^#+", ""))
    own = F.transform(T.lines(F.col("t")), T.strip)
    title = F.coalesce(F.get(F.filter(F.transform(own, bare), lambda x: F.char_length(x) >= 4), F.lit(0)), F.lit(""))
    headings = F.slice(F.transform(F.filter(own, lambda x: x.rlike(T.PAPER_HEADING) & F.char_length(bare(x)).between(3, 40)), bare), 1, 30)
    raw = T.raw_lines(F.col("t"))
    kept = F.aggregate(segment.body_lines(raw), F.lit(0), lambda a, x: a + F.char_length(x))
    rnd, pieces = random.Random(8), ["\n", "\r\n", "\r", "\x0b", " ", "\x1f", " ", "　", "\t", "# ", "##", "#", "第一章", "第", "(1)", "（二）、", "12)", "References", "REFERENCES", "参 考文　献", "参考文献", "abc", "🙂🙂", "ab", "1. x", "title here", "x" * 30]
    rows = [("",), (None,), ("#\n##ab\n# 　 # abc  \r\n",), ("a\nReferences\r",), ("\r\nReferences",), (" References x\n参\n考文献\n",)]
    rows += [("".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 14))),) for _ in range(1500)]
    df = spark.createDataFrame(rows, "t string").coalesce(1)
    x = df.select("t", title.alias("t0"), G.title(F.col("t")).alias("t1"), headings.alias("h0"), G.headings(F.col("t")).alias("h1"), F.coalesce(F.char_length("t") - kept, F.lit(0)).alias("c0"), segment.excluded_chars(F.col("t")).alias("c1"))
    for r in x.collect():
        assert (r["t0"], r["h0"], r["c0"]) == (r["t1"], r["h1"], r["c1"]), ascii(r["t"])
    plan = df.select(G.title(F.col("t")), segment.excluded_chars(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "lambda" not in plan


def test_beginning_looks_for_line_ends(spark):
    """The lines that begin with a mark, at all line ends and the text's beginning; the search does not look back from each
    character."""
    ends = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "\n\n"]
    texts = ["# a" + e + " \t# b x" + e + "no # c" + e + "　#d" + e for e in ends] + ["", "#", "x#", " #\n#", None]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.beginning(F.col("t"), "#").alias("b"))
    assert "(?<" not in found._jdf.queryExecution().optimizedPlan().toString()
    expected = [None if t is None else [x for x in t.splitlines() if x.strip(T.SPACES)[:1] == "#"] for t in texts]
    assert [r["b"] for r in found.orderBy("i").collect()] == expected
