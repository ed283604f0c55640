"""Text normalisation as column expressions (operators H02-H04, H06, H09-H22, H24, H27-H33).

Each function takes and returns a Column; null in, null out unless said otherwise.  Only built-ins are used, so the
expressions stay inside whole-stage code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

re = F.regexp_replace


def nullif_empty(c: Column) -> Column:
    """Null for ''; c is evaluated once, and in generated code, so that nested calls stay linear."""
    return F.get(F.array_remove(F.array(c), ""), F.lit(0))


def strip(c: Column) -> Column:
    """Trim white space of any kind on both sides."""
    return F.trim(c, F.lit(" \t\n\x0b\f\r"))


def pick(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, null without a match or if it is empty."""
    return nullif_empty(F.regexp_extract(c, pattern, group))


def before(c: Column, pattern: str) -> Column:
    """The text before the first match, all of it without one; unlike a split, this compiles the pattern once."""
    return re(c, rf"(?:{pattern})(?s:.*)\z", "")


def clean_text(c: Column) -> Column:
    """Join hyphenated line ends, drop page-number lines, collapse blanks and blank lines, strip; null is ''."""
    c = F.translate(F.coalesce(c, F.lit("")), " –—‘’“”•​﻿", " --''\"\"-")
    c = re(c, r"(\w)-\n(\w)", "$1$2")
    c = re(c, r"(?im)^\s*page\s+\d+(?:\s+of\s+\d+)?\s*$|^\s*\d+\s*/\s*\d+\s*$", "")
    c = re(re(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return strip(c)


def collapse(c: Column) -> Column:
    """One line, single blanks, stripped; null if nothing is left."""
    return nullif_empty(strip(re(c, r"[\t\n][ \t\n]*| [ \t\n]+", " ")))


def truncate(c: Column, n: int = 2000) -> Column:
    """At most n characters, the last three of a cut text being dots."""
    c = strip(c)
    return F.when(F.length(c) > n, F.concat(re(F.substring(c, 1, n - 3), r"\s+$", ""), F.lit("..."))).otherwise(c)


def lines_of(c: Column) -> Column:
    """The non-empty lines, stripped."""
    return F.filter(F.transform(F.split(c, r"\r\n|[\n\r\x0B\x0C\x85]"), strip), lambda x: x != "")


CHROME = r"(?i)tender\s+no\s*:|closing\s+date\s*/?\s*time\s*:|\bitem\s+breakup\b|schedule\s*schedule|page\s+\d+\s+of\s+\d+|run\s+date\s*/?\s*time|s\.?\s*no\.?\s+item\s+(?:no|code|qty|item)|\[\[PAGE:\d+\]\]"


def before_chrome(c: Column) -> Column:
    """H06, first half: the text before the first page header or footer mark."""
    return strip(before(c, CHROME))


def consecutive(chunk: Column) -> Column:
    """Whether white-space separated integers each follow the one before."""
    a = F.transform(F.split(strip(chunk), r"\s+"), lambda x: x.cast("int"))
    return (F.size(a) > 1) & F.forall(F.zip_with(F.slice(a, 1, F.size(a) - 1), F.slice(a, 2, F.size(a)), lambda x, y: x + 1 == y), lambda ok: ok)


def schedule_title(c: Column) -> Column:
    """A schedule's title without its total, empty brackets and repeated word."""
    t = bind(c, lambda x: F.coalesce(collapse(x), strip(x)))
    t = strip(re(t, r"(?i)\s+[\d,]+\.\d{2}(?:\s+above\s*/\s*below[\s/Par]*)?\s*$", ""))
    t = re(re(t, r"\(\s*\)", " "), r"\[\s*\]", " ")
    t = re(t, r"(?i)\b(schedule)\b(?:\s+\1\b)+", "$1")
    t = bind(t, lambda x: F.coalesce(collapse(x), x))
    return strip(re(t, r"(?i)^schedule\b", "Schedule"))


def norm_num(c: Column) -> Column:
    """A number without separators and trailing zeros (two decimals at most); other text in lower case; '' for null."""
    return bind(re(F.coalesce(c, F.lit("")), r"[,\s]", ""), _number)


def _number(v: Column) -> Column:
    d = F.when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), v.try_cast("decimal(30,8)")).cast("decimal(30,2)").cast("string")
    return bind(d, lambda d: F.when(d.isNotNull(), re(re(d, r"(\.\d*?)0+$", "$1"), r"\.$", "")).otherwise(F.lower(v)))


def norm_desc(c: Column) -> Column:
    """Lower case, single blanks, without the label, 50 characters; '' for null."""
    t = re(F.lower(strip(F.coalesce(c, F.lit("")))), r"\s+", " ")
    t = re(t, r"^description\s*[:\-–]\s*", "")
    return F.substring(strip(re(t, r"^[-–— ]+", "")), 1, 50)


def item_code(c: Column) -> Column:
    """Digits lose leading zeros, other codes are upper case; null if empty."""
    t = strip(c)
    return nullif_empty(F.when(t.rlike(r"^\d+$"), F.coalesce(nullif_empty(re(t, r"^0+", "")), F.lit("0"))).when(t.rlike(r"^[A-Z0-9]*$"), t).otherwise(F.upper(t)))


def clean_numeric(c: Column) -> Column:
    """``12. 50`` is 12.50; numbers lose inner blanks; other values stay."""
    t = re(re(strip(c), r"(\d)\.\s+(\d)", "$1.$2"), r"\s+", "")
    return F.when(t.rlike(r"^[\d,]+(\.\d+)?$"), t).otherwise(c)


def clean_description(c: Column) -> Column:
    """Single blanks, label prefixes and leading dashes off; null if nothing is left."""
    t = strip(re(re(c, r"[\r\n\t]+", " "), r"\s+", " "))
    t = strip(re(t, r"(?i)^description\s*[:\-–]\s*", ""))
    t = strip(re(t, r"(?i)^item\s*(?:details?|description|title)\s*[:\-–]\s*", ""))
    return nullif_empty(strip(re(t, r"^[-–— ]+", "")))


def cell(c: Column) -> Column:
    """One clean cell, null if empty."""
    return nullif_empty(strip(re(c, r"[\r\n\t][\r\n\t ]*| [\r\n\t ]+", " ")))


def guard_formula(c: Column) -> Column:
    """Values that a spreadsheet would run get a leading apostrophe."""
    return F.when(F.substring(c, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), c)).otherwise(c)


def yes_no(c: Column) -> Column:
    """Yes, No, or the cell itself."""
    return bind(c, _yes_no)


def _yes_no(c: Column) -> Column:
    t = F.lower(strip(c))
    no = t.rlike(r"\bno\b")
    return (
        F.when(t == "", None)
        .when(t.isin("y", "yes", "true", "required", "1"), "Yes")
        .when(t.isin("n", "no", "false", "not required", "0", "nil", "na", "n/a", "not applicable"), "No")
        .when(t.rlike(r"not\s+applicable"), "No")
        .when(t.rlike(r"\byes\b") & ~no, "Yes")
        .when(no, "No")
        .otherwise(cell(c))
    )


_CLOCK = r"(?:{gap}(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?)?"
DMY = r"(?i)^\s*(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})" + _CLOCK.format(gap=r"\s+") + r"(?:\s*(?:hrs?|hours?))?\s*$"
ISO = r"(?i)^\s*(\d{4})-(\d{2})-(\d{2})" + _CLOCK.format(gap=r"[T\s]") + r"(?:Z|[+-]\d{2}:\d{2})?\s*$"


def bind(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once."""
    return F.transform(F.array(c), f)[0]


def portal_datetime(c: Column) -> Column:
    """dd/mm/yyyy or ISO as yyyy-MM-dd[THH:mm:ss].

    Ranges are checked field by field (31 February passes); a bad time leaves the date; other text is null.
    """
    parts = lambda raw: F.split(F.when(raw.rlike(ISO), re(raw, ISO, "$1,$2,$3,$4,$5,$6")).when(raw.rlike(DMY), re(raw, DMY, "$3,$2,$1,$4,$5,$6")), ",")

    def written(p: Column) -> Column:
        n = lambda k: nullif_empty(p[k]).cast("int")
        two = lambda k: F.lpad(p[k], 2, "0")
        date = F.when(n(0).between(1900, 2100) & n(1).between(1, 12) & n(2).between(1, 31), F.concat_ws("-", p[0], two(1), two(2)))
        good = n(3).between(0, 23) & n(4).between(0, 59) & F.coalesce(n(5), F.lit(0)).between(0, 59)
        return F.when(good, F.concat(date, F.lit("T"), two(3), F.lit(":"), p[4], F.lit(":"), two(5))).otherwise(date)

    return bind(bind(cell(c), parts), written)


def schedule_letter(c: Column) -> Column:
    """The letter of a schedule title, '' if there is none."""
    s = F.lower(strip(F.coalesce(c, F.lit(""))))
    first = F.regexp_extract(s, r"schedule\s*(?:\(\)\s*)?([a-z])\b", 1)
    return F.when(first != "", first).otherwise(F.regexp_extract(s, r"\b([a-z])\s*[-–]", 1))


def breakup_parent(c: Column) -> Column:
    """The parent serial in ``Item 33 Breakup``, without leading zeros."""
    return pick(c, r"(?i)^\s*item\s*[-–]?\s*0*(\d{1,4})\s+break\s*up\b")


def breakup_title(parent: Column) -> Column:
    return F.concat(F.lit("Item "), parent, F.lit(" Breakup"))


def tokens(c: Column) -> Column:
    """Estimated tokens of a text (a fourth of its length, at least 1)."""
    return F.greatest(F.floor(F.length(F.coalesce(c, F.lit(""))) / 4), F.lit(1)).cast("int")


def clip(c: Column, n: int) -> Column:
    """At most n characters, the last one an ellipsis if cut."""
    c = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(c) > n, F.concat(re(F.substring(c, 1, n - 1), r"\s+$", ""), F.lit("…"))).otherwise(c)


def loose_json(c: Column, schema: str) -> Column:
    """The outermost braces of a reply that may stand in a code fence; null if it does not parse."""
    body = re(strip(c), r"(?is)^```(?:json)?\s*|\s*```$", "")
    return F.from_json(nullif_empty(F.regexp_extract(body, r"(?s)(\{.*\})", 1)), schema, {"mode": "PERMISSIVE"})


def instruction(c: Column) -> Column:
    """Single blanks, 400 characters; null under 12."""
    t = strip(re(c, r"\s+", " "))
    return F.when(F.length(t) >= 12, F.substring(t, 1, 400))


def code_number(c: Column) -> Column:
    """The number of a prefixed code (NS04 is 4)."""
    return nullif_empty(re(F.regexp_extract(strip(c), r"^[A-Za-z]{1,6}(\d{1,5})$", 1), r"^0+(?=\d)", ""))


def desc_key(c: Column) -> Column:
    """Lower case, stripped, single blanks."""
    return re(F.lower(strip(c)), r"\s+", " ")


def table_digest(headers: Column, rows: Column, n_rows: int = 12, n_cells: int = 10) -> Column:
    """Headers and the first rows of a grid as text."""
    line = lambda r: F.array_join(F.slice(r, 1, n_cells), " | ", "")
    return F.array_join(F.concat(F.array(line(headers)), F.transform(F.slice(rows, 1, n_rows), line)), "\n")


def compact_row(index: Column, s_no: Column, name: Column, desc: Column, qty: Column, amount: Column) -> Column:
    """A short struct of an item for a prompt."""
    return F.struct(index.alias("index"), s_no.alias("s_no"), clip(name, 80).alias("product_name"), clip(desc, 140).alias("description"), qty.alias("qty"), amount.alias("amount"))


def chat_title(c: Column) -> Column:
    """The first words of a chat, 48 characters."""
    t = F.coalesce(collapse(c), F.lit("New chat"))
    return F.when(F.length(t) > 48, F.concat(re(F.substring(t, 1, 47), r"\s+$", ""), F.lit("…"))).otherwise(t)


def file_label(names: Column) -> Column:
    """The first name and how many more."""
    return F.when(F.size(names) <= 1, F.try_element_at(names, F.lit(1))).otherwise(F.concat(names[0], F.lit(" +"), (F.size(names) - 1).cast("string")))


def strip_xml(c: Column) -> Column:
    """Without characters that XML 1.0 does not allow; null is ''."""
    return re(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
