"""Tables and links of web pages as rows, cut out by built-in expressions inside each page's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What named character references stand for; the ampersand comes last, as it may begin another.
NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def _character(reference: Column) -> Column:
    """The character of a numeric reference (&#38; or &#x26;); one past the last code point stays as it is."""
    hexed = F.regexp_extract(reference, "^&#[xX]([0-9a-fA-F]{1,6});$", 1)
    number = F.when(hexed != "", F.conv(hexed, 16, 10)).otherwise(F.regexp_extract(reference, "^&#([0-9]{1,7});$", 1)).try_cast("int")
    known = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    return F.when(known, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(reference)


def plain(markup: Column) -> Column:
    """The text of a piece of markup: no tags, references resolved, white space as single blanks, trimmed."""
    text = F.regexp_replace(markup, r"<[^>]*>", "")
    pieces = F.regexp_extract_all(text, F.lit(r"&#[xX]?[0-9a-fA-F]+;|&|[^&]+"), F.lit(0))
    text = F.when(text.contains("&#"), F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("&#"), _character(p)).otherwise(p)), "")).otherwise(text)
    for name, stands_for in NAMED.items():
        text = F.replace(text, F.lit(name), F.lit(stands_for))
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def _cell(markup: Column) -> Column:
    """A cell's lines, which line breaks and paragraphs tell apart, joined by ' | '; empty ones count for nothing."""
    lines = F.split(F.regexp_replace(markup, r"(?i)<(br|p)\b[^>]*>", "|"), r"\|")
    return F.array_join(F.filter(F.transform(lines, plain), lambda line: line != ""), " | ")


def _rows(body: Column) -> Column:
    """Cells of each row of a table's markup."""
    rows = F.regexp_extract_all(body, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</tr\s*>|<tr\b|$)"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=</t[dh]\s*>|<t[dh]\b|$)"), F.lit(1)), _cell))


def page_rows(html: Column) -> Column:
    """An array of (table, row, heading, cells) of a page; null and pages without a table give none.

    The page is split at the beginnings of tables. What follows a table's end up to the next one, without tags, is
    that one's heading. A table inside another is a table of its own, after which the outer one goes on as text.
    """
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    sections = F.split(shown, r"(?i)<table\b[^>]*>")

    def told(parts: Column) -> Column:
        def table(k: Column) -> Column:
            before, own = F.get(parts, k), F.get(parts, k + 1)
            outside = F.when((k == 0) | before.rlike(r"(?i)</table\s*>"), F.regexp_replace(before, r"(?is)^.*</table\s*>", "")).otherwise("")
            body = F.regexp_replace(own, r"(?is)</table\s*>.*$", "")
            return F.transform(_rows(body), lambda cells, i: F.struct(k.cast("int").alias("table"), i.cast("int").alias("row"), plain(F.regexp_replace(outside, r"<[^>]*>", " ")).alias("heading"), cells.alias("cells")))

        numbers = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: k < F.size(parts) - 1)
        return F.flatten(F.transform(numbers, table))

    # a transform over one element: the page is split once, not once for each table
    return F.transform(F.array(sections), told)[0]


def tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, table, row, heading, cells of every table row of every page."""
    return pages.select(key, F.explode(page_rows(F.col(html))).alias("r")).select(key, "r.*")


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("(?i)<a\\s[^>]*?href=[\"']([^\"']+)[\"']"), F.lit(1))
