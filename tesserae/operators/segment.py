"""Documents to sentences and chapters. All is worked out within a row, so nothing is shuffled and rows that share an
id, or have none, stay apart."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_BLOCK = 64


def body_lines(raw: Column) -> Column:
    """Of a text's lines with their ends, those before the first that opens the references."""
    cut = F.array_position(F.transform(raw, T.is_references), F.lit(True))
    return F.when(cut > 0, F.slice(raw, F.lit(1), (cut - 1).cast("int"))).otherwise(raw)


def excluded_chars(text: Column) -> Column:
    """Characters from the references line to the end, by one search of the text."""
    return F.char_length(F.regexp_extract(F.coalesce(text, F.lit("")), T.FROM_REFERENCES, 0))


def starts(sizes: Column) -> Column:
    """The sum of the sizes before each. Blocks of sums are built by themselves and then joined, as adding to one long
    array would copy it again and again."""
    none = F.array().cast("array<int>")

    def within(a: Column, x: Column) -> Column:
        return F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))

    def block(a: Column, i: Column) -> Column:
        own = F.aggregate(F.slice(sizes, i * _BLOCK + 1, F.lit(_BLOCK)), F.struct(a["at"].alias("at"), none.alias("out")), within)
        return F.get(F.transform(F.array(own), lambda o: F.struct(o["at"].alias("at"), F.concat(a["out"], F.array(o["out"])).alias("out"))), F.lit(0))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    blocks = F.sequence(F.lit(0), F.ceil(F.size(sizes) / _BLOCK).cast("int") - 1)
    return F.when(F.size(sizes) > 0, F.aggregate(blocks, zero, block, lambda a: F.flatten(a["out"]))).otherwise(none)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, and arrays: ended (lines with their ends), raw (without), line (stripped)."""
    x = docs.select(F.col(id_col).alias("doc_id"), T.raw_lines(F.coalesce(F.col(text_col), F.lit(""))).alias("all"))
    x = x.select("doc_id", body_lines(F.col("all")).alias("ended")).select("*", F.transform("ended", T.without_end).alias("raw"))
    return x.select("*", F.transform("raw", T.strip).alias("line"))


_HEADING, _REFERENCES, _END = re.compile(T.HEADING), re.compile(T.REFERENCES), re.compile(f"(?<=[{T.SENTENCE_END}])")
_NORMAL = str.maketrans(T.PUNCTUATION_FROM, T.PUNCTUATION_TO, T.SPACES)
_PUNCTUATION = re.compile(f"[{re.escape(T.PUNCTUATION_FROM)}]")
#: Characters of text whose sentences leave a task together.
_RUN = 1 << 20


def _normal(part: str) -> str:
    """A part's normal form. ``str.split`` drops the very characters of ``T.SPACES``; looking each character up, as translate
    does, is left to parts with punctuation that changes."""
    bare = "".join(part.split())
    return (bare if bare.isascii() or not _PUNCTUATION.search(bare) else bare.translate(_NORMAL)).lower()


def _sentences_of(text: str) -> Iterator[tuple[str, str, int, int]]:
    """display, norm, start, end of a text's sentences, by the rules of :mod:`..functions.text`; offsets count one for each
    line end."""
    pos = 0
    for ended in text.splitlines(keepends=True):
        bare = ended[:-2] if ended.endswith("\r\n") else ended[:-1] if ended.splitlines()[0] != ended else ended
        line, start = bare.strip(T.SPACES), pos
        if _REFERENCES.match(line):
            return
        pos += len(bare) + 1
        if not line:
            continue
        heading = _HEADING.match(line) is not None
        for part in (line,) if heading else _END.split(line):
            norm = _normal(part)
            if heading or len(norm) >= T.MIN_SENTENCE:
                yield part.strip(T.SPACES), norm, start, start + len(part)
            start += len(part)


def sentences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, idx, display, norm, start, end. Headings are sentences of their own; other lines are cut after
    sentence ends and parts whose normal form is shorter than six are left out. Offsets count one for each line end.
    A null or empty text has no sentence. A map over Arrow batches: nothing is shuffled, rows that share an id stay apart."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "idx", "display", "norm", "start", "end"]

    def batch_of(ids: pa.Array, row: list[int], idx: list[int], made: list[tuple]) -> pa.RecordBatch:
        display, norm, start, end = zip(*made, strict=True)
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), *(pa.array(x, t) for x, t in zip((idx, display, norm, start, end), kinds, strict=True))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, idx, made, size = [], [], [], 0
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                for n, sentence in enumerate(_sentences_of(text or "")):
                    row.append(i)
                    idx.append(n)
                    made.append(sentence)
                    size += len(sentence[0])
                    if size >= _RUN:
                        yield batch_of(batch.column(0), row, idx, made)
                        row, idx, made, size = [], [], [], 0
            if made:
                yield batch_of(batch.column(0), row, idx, made)

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, idx int, display string, norm string, start int, end int")


def chapters(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: str = "heading") -> DataFrame:
    """doc_id, ch_no, title, start, end of each heading. ``scope="section"`` lets a chapter reach to the next one."""
    x = _lines(docs, id_col, text_col).withColumn("cursor", starts(F.transform("ended", F.char_length)))
    found = F.filter(F.arrays_zip("line", "ended", "cursor"), lambda z: (z["line"] != "") & T.is_heading(z["line"]))
    x = x.select("doc_id", found.alias("found"))
    x = x.select("doc_id", "found", F.posexplode("found").alias("ch_no", "h"))
    end = F.col("h.cursor") + F.char_length("h.ended")
    if scope == "section":
        end = F.coalesce(F.get("found", F.col("ch_no") + 1)["cursor"], F.lit(2**31 - 1))
    return x.select("doc_id", "ch_no", T.heading_title(F.col("h.line")).alias("title"), F.col("h.cursor").alias("start"), end.alias("end"))


def body_chars(sents: DataFrame) -> DataFrame:
    return sents.groupBy("doc_id").agg(F.sum(F.char_length("norm")).alias("body_chars"), F.count("*").alias("n_sentences"))


def chapter_of(sents: DataFrame, chaps: DataFrame) -> DataFrame:
    """Each sentence with the title of the first chapter it starts in, or the front part's."""
    c = chaps.select(F.col("doc_id").alias("c_doc"), "ch_no", "title", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    inside = (F.col("doc_id") == F.col("c_doc")) & (F.col("start") >= F.col("c_start")) & (F.col("start") < F.col("c_end"))
    x = sents.join(c, inside, "left").groupBy("doc_id", "idx").agg(F.min(F.when(F.col("ch_no").isNotNull(), F.struct("ch_no", "title"))).alias("c"))
    return x.select("doc_id", "idx", F.coalesce("c.title", F.lit("（前置部分）")).alias("chapter"))
