"""One file for each row: names, replaced files, and what failed writes leave."""

import os

import pytest
from pyspark.sql import functions as F

from tesserae.functions import grading as G
from tesserae.operators import grading
from tesserae.sources import named


def listed(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def test_files_by_stem(spark, tmp_path):
    out = str(tmp_path / "reports")
    rows = [("sub/甲.docx", "<p>甲</p>", "{}"), ("b.tar.gz", "<p>b</p>", '{"a": 1}'), (".hidden", "h", "j"), ("other/甲.txt", "<p>乙</p>", "{}")]
    named.write_check_reports(spark.createDataFrame(rows, "name string, html string, json string").repartition(3), out)
    assert listed(out) == sorted(f"{h}__{s}.{t}" for s in ("甲", "b.tar", ".hidden") for h, t in (("查重报告", "html"), ("查重摘要", "json")))
    assert (tmp_path / "reports/查重报告__甲.html").read_text() == "<p>甲</p>"  # the larger text of one name
    assert (tmp_path / "reports/查重摘要__b.tar.json").read_text() == '{"a": 1}'
    named.write_files(spark.createDataFrame([("查重报告__甲.html", "new", 1), ("查重报告__甲.html", "z old", 0), ("empty", None, 0)], "n string, t string, at int"), out, name_col="n", text_col="t", order_col="at")
    assert (tmp_path / "reports/查重报告__甲.html").read_text() == "new" and (tmp_path / "reports/empty").read_text() == ""
    named.write_files(spark.createDataFrame([], "n string, t string"), out, name_col="n", text_col="t")
    assert len(listed(out)) == 7


@pytest.mark.parametrize("bad", ["a/b", "", None, ".."])
def test_a_failed_task_leaves_no_file(spark, tmp_path, bad):
    out = str(tmp_path / "reports")
    rows = [(f"f{i}", "text") for i in range(40)] + [(bad, "text")]
    with pytest.raises(Exception, match="no file name"):
        named.write_files(spark.createDataFrame(rows, "n string, t string").repartition(8), out, name_col="n", text_col="t")
    assert listed(out) == []


def test_grade_reports(spark, tmp_path):
    dims = grading.rubric(spark, {"course": {"name": "course paper", "dimensions": [{"name": "topic", "weight": 60, "criteria": "x"}, {"name": "style", "weight": 40, "criteria": "y"}]}})
    papers = spark.createDataFrame([("毕业论文/essay.txt", "# A title of some length\ntext"), ("x/essay.txt", "# Another title here\ntext")], "path string, text string")
    made = grading.graded(grading.mock_scores(papers, dims), papers, dims)
    named.write_grade_reports(grading.report_markdown(made), str(tmp_path / "out"))
    keys = [r["k"] for r in papers.select(G.paper_key(F.col("path")).alias("k")).collect()]
    assert listed(tmp_path / "out") == sorted(f"批改报告__{k}.md" for k in keys)
    text = (tmp_path / "out" / f"批改报告__{keys[0]}.md").read_text()
    assert "【mock 试运行，非真实评分】topic维度：结构要素有明显缺失，按启发式规则给出参考分 " in text


def test_type_by_file_name(spark):
    rows = spark.createDataFrame([("毕业论文/essay.txt", "t"), ("a/毕业论文.txt", "t"), ("期刊/x", "t")], "path string, text string")
    assert [r["ptype"] for r in grading.paper_meta(rows).collect()] == ["course", "thesis", "course"]
