"""Text expressions: lines, stripping, normal form, headings and sentence parts. All are plain columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation that the normal form maps, white space, line ends, headings, the references line and the
# characters that end a sentence.
PUNCTUATION_FROM = "，。！？；：（）“”‘’【】《》—％"
PUNCTUATION_TO = ",.!?;:()\"\"''[]<>-%"
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same, one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
#: White space that ends no line, and where a line begins and ends within a text.
BLANK = r"[\t\x1f\x20\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]"
LINE_BEGIN, LINE_STOP = rf"(?<![^{LINE_END}])", rf"(?=[{LINE_END}]|\z)"
NOT_SPACE = r"[^\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
HEADING = rf"^(?:#{{1,3}}{SPACE}|第[一二三四五六七八九十百]+[章节部分]|[(（]?(?:[一二三四五六七八九十]|[0-9]{{1,2}})[)）]、?{SPACE}*{NOT_SPACE})"
#: Headings of graded papers do not count hundreds.
PAPER_HEADING = rf"^(?:#{{1,3}}{SPACE}|第[一二三四五六七八九十]+[章节部分]|[(（]?(?:[一二三四五六七八九十]|[0-9]{{1,2}})[)）]、?{SPACE}*{NOT_SPACE})"
REFERENCES = rf"^(?:参{SPACE}*考{SPACE}*文{SPACE}*献|References|REFERENCES)$"
#: The references line within a text, and all that follows.
FROM_REFERENCES = rf"(?s){LINE_BEGIN}{BLANK}*+(?:参{BLANK}*考{BLANK}*文{BLANK}*献|References|REFERENCES){BLANK}*+{LINE_STOP}.*"
SENTENCE_END = "。！？!?；;"
MIN_SENTENCE = 6


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def raw_lines(text: Column) -> Column:
    """Lines with their ends, as they are in the text; no empty line after the last end."""
    return F.regexp_extract_all(text, F.lit(rf"[^{LINE_END}]*(?:\r\n|[{LINE_END}])|[^{LINE_END}]+$"), F.lit(0))


def without_end(line: Column) -> Column:
    return F.regexp_replace(line, rf"(?:\r\n|[{LINE_END}])$", "")


def beginning(text: Column, first: str) -> Column:
    """The lines, without their ends, that begin after white space with one of the characters ``first``. One search of the
    text: other lines do not become values. It looks for line ends, one before the text included, as to look back from each
    character takes many times as long."""
    return F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(rf"[{LINE_END}]({BLANK}*+[{first}][^{LINE_END}]*+)"), F.lit(1))


def lines(text: Column) -> Column:
    return F.transform(raw_lines(text), without_end)


def normalize(text: Column) -> Column:
    """Punctuation mapped, white space dropped, lower case."""
    return F.lower(F.regexp_replace(F.translate(text, PUNCTUATION_FROM, PUNCTUATION_TO), SPACE, ""))


def is_heading(line: Column) -> Column:
    return line.rlike(HEADING)


def is_references(line: Column) -> Column:
    return strip(line).rlike(REFERENCES)


def sentence_parts(line: Column) -> Column:
    """Parts of a line after each sentence end, blank ones included."""
    return F.split(line, f"(?<=[{SENTENCE_END}])", -1)


def heading_title(line: Column) -> Column:
    return F.substring(strip(F.regexp_replace(line, r"^[#\x20]+", "")), 1, 30)


def bigrams(s: Column) -> Column:
    """Pairs of neighbouring characters; a single character stands for itself; nothing for an empty text."""
    n = F.char_length(s)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(s, i, F.lit(2)))
    return F.when(n >= 2, pairs).when(n == 1, F.array(s)).otherwise(F.array().cast("array<string>"))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def script_safe(json: Column) -> Column:
    """JSON that may stand inside a script element."""
    for ch in ("<", ">", "&", "\u2028", "\u2029"):
        json = F.replace(json, F.lit(ch), F.lit(f"\\u{ord(ch):04x}"))
    return json
