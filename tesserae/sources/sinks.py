"""Where results go: reports as HTML and JSON, grades as Markdown, CSV and workbooks, and the library's tables."""

from __future__ import annotations

import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sm
from ..functions import text as T
from ..operators import library


def summary_json(summary: DataFrame, sources: DataFrame, chapters: DataFrame | None = None, *, sha: DataFrame | None = None, params_key: str | None = None) -> DataFrame:
    """doc_id, json: each checked document's ratios, sources in order and chapters; with ``sha`` (doc_id, sha256) its report
    number and the time as well, with ``params_key`` the parameters' key."""
    own = F.array_sort(F.collect_list(F.struct("rank", "name", "ratio", "matched_chars", "n_matches")))
    s = sources.groupBy(F.col("q_doc").alias("doc_id")).agg(F.transform(own, lambda x: F.struct(x["name"].alias("name"), x["ratio"].alias("ratio"), x["matched_chars"].alias("matched_chars"), x["n_matches"].alias("n_matches"))).alias("sources"))
    x = summary.join(s, "doc_id", "left")
    if chapters is not None:
        c = chapters.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "title", "chars", "hit_chars", "ratio"))).alias("chapters"))
        x = x.join(c, "doc_id", "left")
    if sha is not None:
        now = F.current_timestamp()
        x = x.join(sha.select("doc_id", library.report_no(F.col("sha256"), now).alias("report_no"), F.date_format(now, "yyyy-MM-dd HH:mm:ss").alias("created_at")), "doc_id", "left")
    if params_key is not None:
        x = x.withColumn("params_key", F.lit(params_key))
    fields = [c for c in x.columns if c != "doc_id"]
    return x.select("doc_id", F.to_json(F.struct("doc_id", *fields)).alias("json"))


def hit_rows(best: DataFrame, evidence: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """What a report shows of each matched sentence: tier, label, colour and its three best sources, with the library's
    names of them."""
    t = F.col("tier")
    named = F.lit(None).cast("map<string,string>")
    x = best.join(evidence, ["q_doc", "q_idx"])
    if names is not None:
        # names of the few documents that are evidence of one query document
        own = evidence.select("q_doc", F.explode("evidence").alias("e")).select("q_doc", F.col("e.doc_id").alias("doc_id")).distinct().join(names, "doc_id")
        own = own.groupBy("q_doc").agg(F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), "name"))).alias("named"))
        x, named = x.join(own, "q_doc", "left"), F.col("named")
    shown = F.transform("evidence", lambda e: F.struct(F.coalesce(F.try_element_at(named, e["doc_id"].cast("string")), e["doc_id"].cast("string")).alias("doc"), e["s_display"].alias("text"), e["sim"].alias("sim"), e["tier"].alias("tier"), e["cos"].alias("cos")))
    return x.select("q_doc", "q_idx", "tier", sm.label(t).alias("label"), sm.color(t).alias("color"), "sim", "cos", shown.alias("evidence"))


def _percent(ratio: Column) -> Column:
    return F.format_string("%.1f%%", ratio * 100)


_PAGE = """<!doctype html><html><head><meta charset="utf-8"><style>
mark{cursor:pointer}.ch{padding:4px;margin:2px}.bar{background:#eee;width:160px}.bar i{display:block;height:8px;background:#c0392b}aside{border-top:1px solid #ccc}
</style></head><body>
"""
# text from the data goes into the page by textContent only
_SHOW = """
document.querySelectorAll("mark").forEach(m=>m.addEventListener("click",()=>{
const box=document.getElementById("evidence");box.textContent="";
for(const e of (hits[m.dataset.q]||[])){const p=document.createElement("p");p.textContent=e.doc+" · "+e.tier+" · "+e.sim+" · "+e.text;box.append(p);}
}));"""


def report_html(sentences: DataFrame, hits: DataFrame, summaries: DataFrame, sources: DataFrame | None = None, chapters: DataFrame | None = None) -> DataFrame:
    """doc_id, html: a page with every sentence, matched ones marked, and the summary and each hit's evidence as data in a
    script; the sources with their shares, the chapters with their heat, and a legend of the tiers. All text is
    escaped."""
    h = hits.select(F.col("q_doc").alias("doc_id"), F.col("q_idx").alias("idx"), "color", "label", "evidence")
    body = T.escape_html(F.col("display"))
    marked = F.concat(F.lit('<mark data-q="'), F.col("idx").cast("string"), F.lit('" style="background:'), "color", F.lit('" title="'), "label", F.lit('">'), body, F.lit("</mark>"))
    shown = F.when(F.col("evidence").isNotNull(), F.struct(F.col("idx").cast("string").alias("key"), F.col("evidence").alias("value")))
    x = sentences.join(h, ["doc_id", "idx"], "left").select("doc_id", F.struct("idx", F.coalesce(marked, body).alias("html")).alias("s"), shown.alias("h"))
    pages = x.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["html"]), "\n").alias("body"), F.to_json(F.map_from_entries(F.collect_list("h"))).alias("hits"))
    x = pages.join(summaries, "doc_id")
    legend = F.lit("<p>" + " ".join(f'<span style="background:{sm.COLORS[k]}">{v}</span>' for k, v in sm.LABELS.items()) + "</p>\n")
    table, heat = F.lit("<p>未发现相似来源</p>"), F.lit("<p>未识别到章节结构</p>")
    if sources is not None:
        line = F.concat(F.lit("<tr><td>"), T.escape_html(F.col("name")), F.lit("</td><td>"), F.col("matched_chars").cast("string"), F.lit("</td><td>"), _percent(F.col("ratio")), F.lit('</td><td><div class="bar"><i style="width:'), F.format_string("%.0f", F.col("ratio") * 100), F.lit('%"></i></div></td><td>'), F.col("n_matches").cast("string"), F.lit("</td></tr>"))
        own = sources.groupBy(F.col("q_doc").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("src"))
        x = x.join(own, "doc_id", "left")
        table = F.coalesce(F.concat(F.lit("<table>"), F.array_join(F.transform("src", lambda s: s["line"]), ""), F.lit("</table>")), table)
    if chapters is not None:
        line = F.concat(F.lit('<div class="ch" style="border-left:4px solid '), "color", F.lit('"><b>'), T.escape_html(F.col("title")), F.lit("</b> "), _percent(F.col("ratio")), F.lit("（"), F.col("chars").cast("string"), F.lit(" 字）</div>"))
        own = chapters.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "ch_no", line.alias("line")))).alias("ch"))
        x = x.join(own, "doc_id", "left")
        heat = F.coalesce(F.array_join(F.transform("ch", lambda s: s["line"]), ""), heat)
    script = F.concat(F.lit("<script>const summary="), T.script_safe(F.col("json")), F.lit(";const hits="), T.script_safe(F.coalesce("hits", F.lit("{}"))), F.lit(";" + _SHOW + "</script>"))
    page = F.concat(F.lit(_PAGE), legend, table, F.lit("\n"), heat, F.lit("\n<main>\n"), "body", F.lit('\n</main>\n<aside id="evidence"></aside>\n'), script, F.lit("</body></html>"))
    return x.select("doc_id", page.alias("html"))


def write_failures(failures: DataFrame, path: str) -> None:
    """CSV with a header and, for spreadsheets, a byte order mark before it."""
    first, *rest = failures.columns
    marked = failures.withColumnRenamed(first, "﻿" + first)
    marked.select("﻿" + first, *rest).write.mode("overwrite").option("header", "true").option("encoding", "UTF-8").csv(path)


def top_sources(sources: DataFrame, k: int = 5) -> DataFrame:
    """The first sources of each document, for a console."""
    return sources.where(F.col("rank") <= k)


def append(df: DataFrame, path: str, *partition: str) -> None:
    """Add rows to a table of the library, of reports or of cached grades."""
    w = df.write.mode("append")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def workbook_tables(grades: DataFrame, scores_of: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The sheets of a grading workbook: graded papers by total with failed ones after them, one row of statistics with the
    bands' counts, and each type's papers with score and comment of its dimensions (``scores_of``: type -> names)."""
    first = F.struct(F.col("error").isNotNull(), -F.col("total"), "path")
    flags = F.when(F.col("error").isNull(), F.array_join("flags", "；")).otherwise("批改失败")
    summary = grades.orderBy(first).select(F.col("path").alias("文件名"), F.col("title").alias("论文题目"), F.col("rubric_name").alias("论文类型"), F.col("total").alias("总分"), F.col("band").alias("等级"), F.col("confidence").alias("置信度"), flags.alias("标记"), F.coalesce("error", F.lit("")).alias("备注"))
    fine = grades.where("error is null")
    bands = fine.groupBy("band").agg(F.count("*").alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "band", F.col("n").cast("string")))), "，").alias("等级分布"))
    stats = fine.agg(F.count("*").alias("篇数"), F.bround(F.avg("total"), 1).alias("平均"), F.max("total").alias("最高"), F.min("total").alias("最低")).crossJoin(bands)  # one row each
    out = {"成绩总表": summary, "统计": stats}
    for kind, names in scores_of.items():
        of = lambda name, f: F.get(F.filter("dimensions", lambda d: d["name"] == name), F.lit(0))[f]
        columns = [c for name in names for c in (of(name, "score").alias(name), of(name, "comment").alias(f"{name}评语"))]
        out[f"{kind}明细"] = fine.where(F.col("ptype") == kind).orderBy(F.col("total").desc(), "path").select(F.col("path").alias("文件名"), F.col("title").alias("论文题目"), F.col("total").alias("总分"), F.col("band").alias("等级"), *columns)
    return out


_SHEET_ROWS = 1_000_000
_SPREAD = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write_workbook(tables: dict[str, DataFrame], path: str) -> None:
    """An XLSX file on the driver's disk with a sheet for each table, headers frozen. Rows stream through a partition at a
    time; a table of more rows than a sheet may have goes on in another. Control characters are left out."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names: list[str] = []
        for title, df in tables.items():
            rows, more = df.toLocalIterator(), True
            held = next(rows, None)
            while more:
                bare = re.sub(r"[\[\]:*?/\\]", " ", title)
                name = f"{bare[:27]} {sum(n.startswith(bare[:27]) for n in names) + 1}" if bare[:31] in names else bare[:31]
                names.append(name)
                with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w") as f:
                    f.write(f'<worksheet xmlns="{_SPREAD}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>'.encode())
                    f.write(_row(df.columns))
                    n = 0
                    while held is not None and n < _SHEET_ROWS:
                        f.write(_row(held))
                        held, n = next(rows, None), n + 1
                    f.write(b"</sheetData></worksheet>")
                more = held is not None
        sheets = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_SPREAD}" xmlns:r="{_REL}"><sheets>{sheets}</sheets></workbook>')
        package = "http://schemas.openxmlformats.org/package/2006"
        link = lambda i, kind, to: f'<Relationship Id="rId{i}" Type="{_REL}/{kind}" Target="{to}"/>'
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{"".join(link(i, "worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(names) + 1))}</Relationships>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships">{link(1, "officeDocument", "xl/workbook.xml")}</Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')


def _row(values) -> bytes:
    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", str(v))
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    return f"<row>{''.join(map(cell, values))}</row>".encode()
