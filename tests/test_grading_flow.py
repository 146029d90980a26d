"""The grading flow with scripted clients, the client's retries with an injected clock, and reports of both engines."""

import json
import re
import zipfile
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import embedding
from tesserae.functions import grading as G
from tesserae.operators import grading, library, overlap, segment
from tesserae.sources import model, settings, sinks

RUBRIC = {"course": {"name": "课程论文（测试）", "dimensions": [{"name": "topic", "weight": 60, "criteria": "clear  topic"}, {"name": "style", "weight": 40, "criteria": "plain"}]}}
LONG = "\n\n".join(f"Paragraph {i} tells of one more river and its banks." for i in range(40))
PAPERS = [("short.txt", "# A short paper\nIt is about rivers."), ("long.txt", "# A long paper\n" + LONG), ("bad.txt", "# Broken\nNO DIMENSION for this."), ("毕业论文.txt", "# A thesis\nno rubric here")]


def scripted(calls=None, fail_whole=False, fail_chunk=False, flags=()):
    """A client that answers by what the prompt asks for."""

    def make():
        def answer(prompt):
            if '"summary"' in prompt:
                if fail_chunk:
                    raise RuntimeError("chunk lost")
                part = re.match(r"第 (\d+) 部分", prompt).group(1)
                return json.dumps({"summary": f"S{part}", "strengths": ["a", "b", "c", "d"], "weaknesses": [], "quotes": ["x", "y", "z"]})
            if '"overall_comment"' in prompt:
                if fail_whole:
                    raise RuntimeError("model is away")
                return json.dumps({"overall_comment": " fine work ", "strengths": ["s1", " ", "s2"], "improvements": [str(i) for i in range(9)], "flags": list(flags)})
            if "NO DIMENSION" in prompt and prompt.startswith("style"):
                return "I cannot say."
            score = "90 points" if prompt.startswith("topic") else 70
            return "```json\n" + json.dumps({"score": score, "confidence": 0.5 if prompt.startswith("topic") else 0.9, "evidence": ["e" * 100, ""], "comment": "ok" if "【分段记录】" not in prompt else "by notes"}) + "\n```"

        return answer

    return make


@pytest.fixture(scope="module")
def papers(spark):
    return spark.createDataFrame(PAPERS, "path string, text string")


@pytest.fixture(scope="module")
def dims(spark):
    return grading.rubric(spark, RUBRIC)


def test_grade(spark, papers, dims):
    rows = {r["path"]: r for r in grading.grade(papers, dims, scripted(), size=300, limit=400).collect()}
    assert set(rows) == {p for p, _ in PAPERS}
    r = rows["short.txt"]
    assert (r["total"], r["band"], r["confidence"], r["title"], r["error"]) == (82.0, "良好", 0.7, "A short paper", None)
    assert r["overall_comment"] == "fine work" and r["strengths"] == ["s1", "s2"] and len(r["improvements"]) == 5 and r["flags"] == []
    assert [d["name"] for d in r["dimensions"]] == ["topic", "style"] and r["dimensions"][0]["evidence"] == ["e" * 80]
    assert {d["comment"] for d in rows["long.txt"]["dimensions"]} == {"by notes"} and {d["comment"] for d in r["dimensions"]} == {"ok"}
    assert rows["bad.txt"]["error"].startswith("no JSON in reply") and rows["bad.txt"]["total"] is None
    assert "no rubric" in rows["毕业论文.txt"]["error"]


def test_failures_of_parts(spark, papers, dims):
    away = {r["path"]: r for r in grading.grade(papers, dims, scripted(fail_whole=True), size=300, limit=400).collect()}
    assert away["short.txt"]["total"] == 82.0 and "model is away" in away["short.txt"]["overall_comment"] and away["short.txt"]["error"] is None
    lost = {r["path"]: r for r in grading.grade(papers, dims, scripted(fail_chunk=True), size=300, limit=400).collect()}
    assert lost["long.txt"]["error"] == "chunk lost" and lost["short.txt"]["error"] is None
    notes = grading.map_chunks(papers, scripted(), size=300, limit=400).first()
    assert notes["notes"].startswith("[第1部分] S1 亮点：a；b；c 问题： 片段：x；y\n[第2部分] S2") and notes["n_chunks"] > 5


def test_low_confidence_is_flagged_once(spark, dims):
    one = spark.createDataFrame([PAPERS[0]], "path string, text string")

    def unsure(said):
        def make():
            own = scripted(flags=said)()
            return lambda p: own(p).replace("0.9", "0.1") if '"overall_comment"' not in p else own(p)

        return make

    assert grading.grade(one, dims, unsure(())).first()["flags"] == ["置信度偏低，建议人工复评"]
    assert grading.grade(one, dims, unsure(("请人工复评",))).first()["flags"] == ["请人工复评"]


def test_prompts_are_redacted(spark, dims):
    own = spark.createDataFrame([("a.txt", "# Title of it\nmail a.b@c.org now")], "path string, text string")

    def make():
        def answer(prompt):
            if "a.b@c.org" in prompt:
                raise RuntimeError("seen")
            return scripted()()(prompt)

        return answer

    assert grading.grade(own, dims, make).first()["error"] == "seen"
    assert grading.grade(own, dims, make, redact_pii=True).first()["error"] is None


GOOD = json.dumps({"choices": [{"message": {"content": "hello"}}], "usage": {"prompt_tokens": 7, "completion_tokens": 2}}).encode()


def client(script, **fields):
    waits, sent = [], []

    def send(url, body, headers, timeout):
        sent.append((url, json.loads(body), headers))
        step = script[len(sent) - 1]
        if isinstance(step, Exception):
            raise step
        return step

    e = model.Endpoint.of({"base_url": "http://host/v1/", "model": "m", "api_key": "k", **fields}, {})
    return model.Client(e, "sys", send=send, sleep=waits.append, jitter=lambda: 0.5), waits, sent


def test_client_retries():
    c, waits, sent = client([(503, {}, b"busy"), (429, {"Retry-After": "600"}, b""), (200, {}, GOOD)])
    assert c("hi") == "hello" and waits == [2.5, 120] and c.usage == {"prompt_tokens": 7, "completion_tokens": 2, "requests": 1}
    assert sent[0][0] == "http://host/v1/chat/completions" and sent[0][2]["Authorization"] == "Bearer k"
    c, waits, _ = client([TimeoutError("slow"), (200, {}, GOOD)])
    assert c("hi") == "hello" and waits == [2.5]
    c, waits, _ = client([(400, {}, b"bad request")])
    with pytest.raises(model.ModelError, match="HTTP 400: bad request"):
        c("hi")
    c, waits, _ = client([(500, {}, b"x")] * 2, max_retries="2")
    with pytest.raises(model.ModelError, match="after 2 tries"):
        c("hi")
    assert waits == [2.5]
    c, _, _ = client([(200, {}, b"{}")])
    with pytest.raises(model.ModelError, match="not understood"):
        c("hi")


def test_keys_and_settings(tmp_path):
    with pytest.raises(model.ModelError, match="no key"):
        client([], api_key="")[0]("hi")
    c, _, sent = client([(200, {}, GOOD)], api_key="", base_url="http://127.0.0.1:11434/v1")
    assert c("hi") == "hello" and "Authorization" not in sent[0][2]
    assert model.Endpoint.of({"base_url": "u", "model": "m", "api_key": "file"}, {model.KEY_VARIABLE: "env"}).api_key == "env"
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"llm": {"base_url": "u", "model": "m", "timeout": "9"}, "grading": {"chunk_chars": "12", "grade_bands": [{"min": 50, "label": "in"}, {"min": 0, "label": "out"}]}, "type_keywords": {"journal": ["kw"]}}))
    s = settings.Settings.load(str(path), {})
    assert s.chunk_chars == 12 and s.fulltext_chars == G.FULLTEXT_CHARS and s.endpoint.timeout == 9.0 and s.bands == ((50.0, "in"), (0.0, "out"))
    assert settings.Settings.load(str(tmp_path / "none.json"), {}) == settings.Settings()


def test_usage_is_added_up(spark):
    class Counting:
        usage = {"prompt_tokens": 3, "completion_tokens": 1, "requests": 1}

        def __call__(self, prompt):
            return "{}"

    calls = grading.asked(spark.createDataFrame([("a",), ("b",), (None,)], "p string"), F.col("p"), Counting)
    assert tuple(grading.token_usage(calls).first()) == (6, 2, 2)


def test_markdown_and_workbook(spark, papers, dims, tmp_path):
    grades = grading.grade(papers, dims, scripted(flags=["<b>&"]), size=300, limit=400).persist()
    text = {r["path"]: r for r in grading.report_markdown(grades).collect()}
    assert set(text) == {"short.txt", "long.txt"}
    page = text["short.txt"]["markdown"]
    for part in ("# 《A short paper》批改报告", "**82.0**（良好）", "| topic | 60 | 90 | 54.0 | 0.50 |", "### style：70 分", "> " + "e" * 80, "## 总评\n\nfine work", "2. s2", "5. 4", "<b>&"):
        assert part in page, part
    assert re.fullmatch(r"批改报告__short__[0-9a-f]{8}\.md", text["short.txt"]["name"])
    path = str(tmp_path / "book.xlsx")
    sinks.write_workbook(sinks.workbook_tables(grades, {"course": ["topic", "style"]}), path)
    with zipfile.ZipFile(path) as z:
        ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", ns)]
        sheet = lambda i: [["".join(c.itertext()) for c in r] for r in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter("{%s}row" % ns["m"])]
        rows, stats, detail = sheet(1), sheet(2), sheet(3)
    assert names == ["成绩总表", "统计", "course明细"] and rows[0][0] == "文件名" and len(rows) == 5
    assert [r[3] for r in rows[1:3]] == ["82.0", "82.0"] and rows[3][6] == rows[4][6] == "批改失败" and rows[1][6] == "<b>&"
    assert stats[1][:2] == ["2", "82.0"] and stats[1][-1] == "良好 2" and detail[0][4:] == ["topic", "topic评语", "style", "style评语"]
    mock = grading.graded(grading.mock_scores(papers.limit(2), dims), papers, dims)
    assert grading.report_markdown(mock).count() == 2
    grades.unpersist()


def test_mock_places(spark):
    import hashlib

    for n in (0, 1, 2, 3, 7, 1000):
        rows = spark.range(40).select(F.concat(F.lit("p"), "id").alias("p"), F.lit("dim").alias("d")).select("p", G.mock_places(F.col("p"), F.col("d"), F.lit(n)).alias("x"), G.mock_base(F.col("p"), F.col("d")).alias("b")).collect()
        for r in rows:
            h = int(hashlib.md5(f"{r['p']}:dim".encode()).hexdigest(), 16)
            pair = [h % n, h // n % n] if n else []
            if n > 1 and pair[0] == pair[1]:
                pair[1] = (pair[0] + 1) % n
            assert r["x"] == (sorted(set(pair))) and r["b"] == h % 30


def test_hostile_text_in_reports(spark):
    evil = "</script><img src=x onerror=alert(1)> and the survey covers nine villages in the valley   <!-- x"
    lib = library.library_sentences(spark.createDataFrame([(1, evil)], "doc_id long, text string"))
    docs = spark.createDataFrame([(9, "## Part\n" + evil + "\nAnother line that nobody has written before this one.")], "doc_id long, text string")
    query = library.library_sentences(docs)
    m = overlap.all_matches(query, lib)
    best = overlap.best_matches(m)
    names = spark.createDataFrame([(1, "<i>name</i>")], "doc_id long, name string")
    sources = overlap.source_stats(query, best, names)
    heat = overlap.chapter_heat(query, segment.chapters(docs, scope="section"), best)
    j = sinks.summary_json(overlap.summary(query, best), sources, heat, sha=library.with_sha(docs).select("doc_id", "sha256"), params_key="abc")
    said = json.loads(j.first()["json"])
    assert said["report_no"].startswith("PC-") and said["params_key"] == "abc" and said["chapters"][0]["title"] == "Part"
    hits = sinks.hit_rows(best, overlap.evidence(m), names)
    html = sinks.report_html(query, hits, j, sources, heat).first()["html"]
    assert "<img" not in html and "<i>name" not in html and "<!-- x" not in html and " " not in html and html.count("</script>") == 1
    assert html.count("<mark ") == 1 and "&lt;i&gt;name&lt;/i&gt;" in html and "Part</b>" in html and "高度疑似" in html
    data = re.search(r"const hits=(.*?);\n", html).group(1)
    assert next(iter(json.loads(data).values()))[0]["doc"] == "<i>name</i>"


def test_vectors_by_an_injected_model(spark):
    class Letters:
        def encode(self, texts):
            return np.array([[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], float)

    make = lambda: embedding.from_encoder(Letters())
    lib = library.library_sentences(spark.createDataFrame([(1, "rivers carry sand and gravel far"), (2, "zzz qqq xxx zzz qqq xxx")], "doc_id long, text string"))
    query = library.library_sentences(spark.createDataFrame([(7, "far sand, gravel and carry rivers"), (8, "0123456789 0123456789")], "doc_id long, text string"))
    vec = embedding.vectors(make, query, lib)
    assert all(abs(sum(x * x for x in r["vec"]) - 1) < 1e-9 for r in vec.collect())
    rows = overlap.all_matches(query, lib, vectors=vec).collect()
    assert [(r["q_doc"], r["doc_id"], r["tier"]) for r in rows] == [(7, 1, "semantic")] and rows[0]["cos"] > 0.99
    assert overlap.all_matches(query, lib).where("tier = 'semantic'").count() <= 1


def test_containment_both_ways(spark):
    import random

    rnd = random.Random(3)
    line = lambda: "".join(rnd.choice("abcde ") for _ in range(rnd.randint(12, 40)))
    lib = library.library_sentences(spark.createDataFrame([(i, line()) for i in range(60)], "doc_id long, text string"))
    query = library.library_sentences(spark.createDataFrame([(i, line()) for i in range(15)] + [(20, "xy zq xy zq xy")], "doc_id long, text string"))
    forms = query.select(F.col("norm").alias("q_norm")).distinct()
    key = lambda df: sorted((r["q_norm"], r["norm"], round(r["score"], 9)) for r in df.collect())
    a = key(overlap._shared_broadcast(forms, lib))
    assert a == key(overlap._shared_lists(forms, lib)) and len(a) > 20
    assert overlap.containment_top(query.limit(0), lib).count() == 0


def test_rows_of_one_id_stay_apart(spark):
    docs = spark.createDataFrame([(1, "alpha one line here\nbeta two lines here"), (1, "gamma one line here\ndelta two lines here"), (None, "omega one line here"), (None, None)], "doc_id long, text string")
    rows = segment.sentences(docs).collect()
    assert sorted((r["doc_id"] or 0, r["idx"], r["start"], r["norm"][:5]) for r in rows) == [(0, 0, 0, "omega"), (1, 0, 0, "alpha"), (1, 0, 0, "gamma"), (1, 1, 20, "betat"), (1, 1, 20, "delta")]
    many = spark.createDataFrame([(1, "\n".join(f"line number {i:05d} of many" for i in range(3000)))], "doc_id long, text string")
    got = segment.sentences(many).orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(3000)) and all(r["start"] == 26 * i and r["end"] == 26 * i + 25 for i, r in enumerate(got))


def test_ranking_of_ties_and_failures(spark):
    grades = spark.createDataFrame([("c", 80.0), ("a", 80.0), ("d", None), ("b", 91.5), ("e", None)], "path string, total double")
    assert [(r["path"], r["rank"]) for r in grading.ranking(grades).orderBy("rank").collect()] == [("b", 1), ("a", 2), ("c", 3), ("d", 4), ("e", 5)]
