"""Line items from free text.

A document's lines are exploded and classified once.  Every layout is one regular expression over a line (or the line and
the two after it); a row opens an item, and the lines that follow attach to it until an end class.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import JUNK_FIRST, list_serial, portal, text_or_empty
from ..functions.text import clean_description, code_number, collapse, item_code, nullif_empty, strip, truncate
from ..schemas import ITEM_FIELDS
from .lines import BY, annotate, explode_lines, in_doc, nearest_above, running

# Units, bidding units, escalation and money of schedule rows.
UNIT = r"[A-Za-z][A-Za-z./\-]{0,20}|Running\s*Mtr"
STRICT = (
    r"Months?|Numbers?|Nos?\.?|Sets?|Each|Kgs?|Kg|Mtrs?|Metres?|Meters?|Units?|Lumpsum|Job|Hour|Hrs?|Days?|Pairs?|Lots?|Cum|Cmt|Sqm|Rmt|Ton(?:ne)?s?|Litres?|Ltr|Packet|Pkts?|"
    r"Stations?|Locations?|Sites?|Blocks?|Spans?|Trips?|Shifts?|Km|Kilometres?|Kilometers?|Rm|Running\s*Mtr|Per\s+Track\s+Circuit|Per\s+Conductor|Man-?Days?"
)
MONEY, ESCL = r"([\d,]+\.\d{2})", r"(AT\s*Par|[\d,]+\.?\d*\s*%?)"
BID = r"(Rs\.?|INR|Above\s*/\s*Below\s*/\s*Par|Above\s*/|Below\s*/?\s*P(?:ar)?|ar|Par)?"
#: An item code: letters and a number, or a number of any length that a key has.
CODE = r"[A-Za-z]{1,6}\d{1,5}|\d{1,18}"
TAIL = rf"\s+{MONEY}\s+{MONEY}\s+{ESCL}\s+{MONEY}\s*{BID}\s*$"

#: Layout: expression and the fields of its groups.  The order is the order of precedence.
LAYOUTS: dict[str, tuple[str, list[str]]] = {
    "letter": (rf"(?i)^([A-Z])\s+{MONEY}\s+({STRICT}){TAIL}", ["item_code", "item_qty", "qty_unit", "unit_rate", "basic_value", "escalation", "amount", "bidding_unit"]),
    "pointer": (rf"(?i)^please\s+see.{{0,120}}?\s+{MONEY}\s+{ESCL}\s+[\d,]+\.\d{{2}}$", ["amount", "escalation"]),
    "plain": (rf"(?i)^(\d{{1,4}})\s+{MONEY}\s+({UNIT}){TAIL}", ["s_no", "item_qty", "qty_unit", "unit_rate", "basic_value", "escalation", "amount", "bidding_unit"]),
    "amounts": (rf"(?i)^{MONEY}\s+({UNIT}){TAIL}", ["item_qty", "qty_unit", "unit_rate", "basic_value", "escalation", "amount", "bidding_unit"]),
    "inline": (rf"(?i)^(\d{{1,4}})\s+({CODE})\s+{MONEY}\s+({UNIT}){TAIL}", ["s_no", "item_code", "item_qty", "qty_unit", "unit_rate", "basic_value", "escalation", "amount", "bidding_unit"]),
    "prefixed": (
        rf"(?i)^([A-Za-z]{{1,6}}\d{{1,5}})\s+{MONEY}\s+({UNIT})\s+{MONEY}(?:\s+{MONEY})?(?:\s+{ESCL})?(?:\s+{MONEY})?(?:\s+{BID})?\s*$",
        ["item_code", "item_qty", "qty_unit", "unit_rate", "basic_value", "escalation", "amount", "bidding_unit"],
    ),
}
#: A unit's letters are looked at only where an amount follows them.
BREAKUP_ROW = rf"(?i)^(\d{{1,3}})\s+(\d{{1,3}})\s+(.+?)(?=[A-Z][A-Z.\s\-]*+[\d,]++\.\d{{2}}\s)({STRICT})\s+{MONEY}\s+{MONEY}\s+{MONEY}\s*$"
#: The groups of a breakup row as they are kept, free text last.
BREAKUP_GROUPS = [1, 2, 4, 5, 6, 7, 3]
#: A coded row anywhere in a region: it may wrap, share its line with others, or have whole numbers.
SWEEP = (
    rf"(?i)(?<![0-9A-Za-z.])(\d{{1,4}})\s+({CODE})\s+([\d,]+\.\d{{2}}|\d+)\s+({UNIT})\s+([\d,]+\.\d{{2}}|\d+)\s+([\d,]+\.\d{{2}}|\d+)\s+(AT\s*Par|[\d,]+\.?\d*\s*%?)\s+"
    rf"([\d,]+\.\d{{2}}|\d+)(?![\d.,])(?:[ \t]+{BID[:-1]}(?![A-Za-z]))?"
)
SWEEP_FIELDS = LAYOUTS["inline"][1]
DESCRIPTION = r"(?i)^(?:([A-Za-z]{0,6}\d{1,5})\s+)?description\s*[:\-–]-?\s*(.*)$"
CODE_LINE = r"(?i)^([A-Za-z]{1,6}\d{1,5}|\d{5,18}|[A-Z])$"
MAX_DESC = 8000


#: The fields that a layout's row gives, in the order in which :func:`read_rows` keeps them.
ROW_FIELDS = LAYOUTS["inline"][1]


def read_rows(found: DataFrame) -> DataFrame:
    """Found (kind, matched) with ``row_text``, the groups of the matched line's layout by :data:`ROW_FIELDS`: one pass of
    one expression for each item, and no wide row before the lines are folded."""

    def texts(name: str) -> Column:
        pattern, fields = LAYOUTS[name]
        return F.regexp_replace("matched", pattern, "\u0001".join(f"${fields.index(f) + 1}" if f in fields else "" for f in ROW_FIELDS))

    kinds = list(LAYOUTS)
    groups = reduce(lambda acc, n: acc.when(F.col("kind") == n, texts(n)), kinds[1:], F.when(F.col("kind") == kinds[0], texts(kinds[0])))
    return found.withColumn("row_text", F.split(groups, "\u0001"))


def row_fields() -> dict[str, Column]:
    """The item fields of rows that :func:`read_rows` gives."""
    out = {f: nullif_empty(strip(F.col("row_text")[ROW_FIELDS.index(f)])) if f in ROW_FIELDS else F.lit(None).cast("string") for f in ITEM_FIELDS}
    zeros = r"^0+(?=\d)"
    s_no = F.when(F.col("kind") == "prefixed", code_number(item_code(out["item_code"]))).when(F.col("kind") == "amounts", F.regexp_replace("serial_above", zeros, "")).otherwise(F.regexp_replace(out["s_no"], zeros, ""))
    return out | {"s_no": s_no, "item_code": item_code(out["item_code"]), "escalation": F.regexp_replace(collapse(out["escalation"]), r"(?i)at\s*par", "AT Par")}


#: How far :func:`match_rows` looks above and below a line.
ABOVE, BELOW = 3, 2


def match_rows(lines: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Lines with ``kind``, the first layout that fits, null for other lines; ``matched``, the text it fits; and
    ``serial_above``, the serial of a row without one.  :func:`read_rows` reads the fields.

    The inline layout may wrap, so it is also tried on the line joined with one or two that follow.
    """
    line, c = F.col("line"), F.col("class")
    # only a line of these classes is digits alone
    serial_above = nearest_above(F.when(c.isin("serial", "text") & list_serial(line), line), c.isin("priced", "schedule", "total"), ABOVE, by)
    follow = [F.lead("line", k).over(in_doc(by)) for k in (1, BELOW)]
    plain_next = [~F.coalesce(F.lead("class", k).over(in_doc(by)).isin("description", "schedule", "total", "breakup"), F.lit(True)) for k in (1, BELOW)]
    lines = lines.select("*", serial_above.alias("serial_above"), *[f.alias(f"_follow{k}") for k, f in enumerate(follow)], *[f.alias(f"_plain{k}") for k, f in enumerate(plain_next)])
    flowing = ~c.isin("schedule", "total", "breakup", "blank") & ~F.col("skip")
    wrap1 = F.when(flowing & F.col("_plain0") & line.rlike(rf"^\d{{1,4}}\s+(?:{CODE})\b"), F.concat_ws(" ", line, F.col("_follow0")))
    lines = lines.withColumn("wrap1", wrap1)
    lines = lines.withColumn("wrap2", F.when(F.col("wrap1").isNotNull() & F.col("_plain1"), F.concat_ws(" ", F.col("wrap1"), F.col("_follow1"))))
    # every layout has an amount in it, on the line or on the two that may belong to it
    own = flowing & line.contains(".")
    fits = {n: own & line.rlike(LAYOUTS[n][0]) for n in LAYOUTS}
    fits["amounts"] = own & F.col("serial_above").isNotNull() & line.rlike(LAYOUTS["amounts"][0])
    cases: list[tuple[Column, str | None]] = [(fits[n], n) for n in LAYOUTS]
    cases[5:5] = [(F.col(w).contains(".") & F.col(w).rlike(LAYOUTS["inline"][0]), w) for w in ("wrap1", "wrap2")]
    kind = reduce(lambda acc, k: acc.when(k[0], k[1]), cases[1:], F.when(*cases[0]))
    lines = lines.withColumn("kind", kind)
    wrapped = F.col("kind").isin("wrap1", "wrap2")
    matched = F.when(F.col("kind") == "wrap1", F.col("wrap1")).when(F.col("kind") == "wrap2", F.col("wrap2")).when(F.col("kind").isNotNull(), line)
    lines = lines.withColumn("matched", matched).withColumn("kind", F.when(wrapped, "inline").otherwise(F.col("kind")))
    return lines.drop("wrap1", "wrap2", "_follow0", "_follow1", "_plain0", "_plain1")


def parse_items(docs: DataFrame, pass_no: int = 2) -> DataFrame:
    """Items of schedule texts.  docs: doc_id, text."""
    lines = match_rows(annotate(explode_lines(docs))).where("class <> 'blank'")
    w = in_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("item_no", F.sum(F.col("kind").isNotNull().cast("int")).over(w)).where("item_no > 0")
    # an item's lines are folded once: its row, first label, code and serial, what may end it, and its texts
    c, n, opens = F.col("class"), F.col("line_no"), F.col("kind").isNotNull()
    first = lambda ok, *v: F.min(F.when(ok, F.struct("line_no", *v)))
    label, code = c == "description", F.when(F.col("kind").isNull() & (c != "description"), own_code())
    g = lines.groupBy("doc_id", "item_no").agg(
        *[F.max(F.when(opens, F.col(v))).alias(v) for v in ROW_AT],
        first(label, *[v.alias(k) for k, v in zip(("v", "t"), label_parts(), strict=True)]).alias("label"),
        first(code.isNotNull(), code.alias("v")).alias("code"), first(own_serial().isNotNull(), own_serial().alias("v")).alias("serial"),
        F.min(F.when(closing(), n)).alias("end_bare"), F.collect_list(F.when(closing() | label | (c == "bid"), n)).alias("ends"),
        F.array_sort(F.collect_list(F.when(is_text(), F.struct("line_no", F.col("line").alias("t"))))).alias("texts"),
    )
    g = g.withColumn("label_no", F.coalesce("label.line_no", F.lit(LAST)))
    g = g.withColumn("end_no", F.coalesce(F.when(F.col("label").isNull(), F.col("end_bare")).otherwise(F.array_min(F.filter("ends", lambda e: e > F.col("label_no")))), F.lit(LAST)))
    code = F.when(F.col("code.line_no") < F.least("label_no", "end_no"), F.col("code.v"))
    body = F.transform(F.filter("texts", lambda t: (t["line_no"] > F.col("label_no")) & (t["line_no"] < F.col("end_no"))), lambda t: t["t"])
    parts = F.concat(F.array_compact(F.array("label.t")), body)
    return assemble(g.select("doc_id", *ROW_AT, F.coalesce(code, F.col("label.v")).alias("code"), F.when(F.col("serial.line_no") < F.col("end_no"), F.col("serial.v")).alias("serial"), parts.alias("parts")), pass_no)


#: What is kept of the line that opens an item.
ROW_AT = ["kind", "matched", "serial_above", "line_no", "offset", "page", "schedule"]
#: Above every line number.
LAST = 2**31 - 1


def closing() -> Column:
    """Whether a line ends an item's description by its class or because rows are switched off."""
    return F.col("kind").isNull() & (F.col("class").isin("schedule", "total", "breakup", "priced") | F.col("skip"))


def is_text() -> Column:
    """Whether a line may belong to a description; up to four digits alone are of another class."""
    return (F.col("class") == "text") & F.col("kind").isNull()


def label_parts() -> tuple[Column, Column]:
    """The code before a description's label and the text behind it."""
    return nullif_empty(F.regexp_extract("line", DESCRIPTION, 1)), nullif_empty(F.regexp_extract("line", DESCRIPTION, 2))


def own_code() -> Column:
    return nullif_empty(F.regexp_extract("line", CODE_LINE, 1))


def own_serial() -> Column:
    return F.when((F.col("class") == "serial") & list_serial(F.col("line")), F.regexp_replace("line", r"^0+(?=\d)", ""))


def assemble(g: DataFrame, pass_no: int) -> DataFrame:
    """Items of one row per item: what its line gave (:data:`ROW_AT`), first code and serial, description pieces."""
    g = read_rows(g).withColumn("code", item_code(F.col("code"))).withColumn("description", clean_description(F.array_join("parts", " ")))
    row, found = row_fields(), F.col("code")
    g = g.select("*", *[row.pop(f).alias(f"_{f}") for f in ("s_no", "item_code", "item_qty")], F.coalesce(found.rlike(r"^\d{1,4}$"), F.lit(False)).alias("_digits"))
    s_no = F.coalesce("_s_no", F.when(F.col("_digits"), found), F.col("serial"))
    out = dict.fromkeys(ITEM_FIELDS) | row
    out |= {
        "s_no": s_no,
        "item_code": F.coalesce("_item_code", F.when(~F.col("_digits"), found), F.when(F.col("_item_qty").isNotNull(), item_code(s_no))),
        "item_qty": F.col("_item_qty"),
        "description": truncate(F.col("description"), MAX_DESC),
        "schedule": F.col("schedule"),
    }
    pages = F.when(F.col("page").isNotNull(), F.array(F.col("page").cast("int"))).otherwise(F.array().cast("array<int>"))
    return g.select("doc_id", F.lit(pass_no).alias("pass_no"), F.col("line_no").cast("bigint").alias("seq"), *[v.alias(f) for f, v in out.items()], pages.alias("page_numbers"), F.col("offset").alias("source_pos"))


def regions(docs: DataFrame) -> DataFrame:
    """doc_id, region_no, offset, page, schedule, text of each schedule up to its total, a new section or the next one.

    Heads inside an item breakup open none.  Region 0, the whole text, is left to the passes over lines.
    """
    c, line = F.col("class"), F.col("line")
    section = line.rlike(r"(?i)^(?:\d+\.\s*)?(?:general\s+conditions|special\s+conditions|eligibility|payment\s+terms|instructions\s+to\s+bidders|standard\s+general|annexure|corrigendum)\b")
    lines = annotate(explode_lines(docs))
    lines = lines.withColumn("inside", F.coalesce(running((c == "breakup") | section, c == "breakup"), F.lit(False)))
    head = (c == "schedule") & ~F.col("inside")
    lines = lines.withColumn("region_no", F.coalesce(running(head, F.col("line_no")), F.lit(-1))).withColumn("done", F.coalesce(running(head | section | c.isin("total", "breakup"), ~head), F.lit(True)))
    g = lines.where("region_no >= 0 and not done").groupBy("doc_id", "region_no")
    g = g.agg(F.min("offset").alias("offset"), F.min("page").alias("page"), F.min_by("schedule", "line_no").alias("schedule"), F.array_sort(F.collect_list(F.struct("line_no", "raw"))).alias("parts"))
    return g.select("doc_id", "region_no", "offset", "page", "schedule", F.array_join(F.transform("parts", lambda p: p["raw"]), "\n").alias("text"))


def description_block(after: Column) -> Column:
    """The description at the start of a text: the lines from its label, after blanks and codes, up to the end of the block."""
    body = F.regexp_extract(after, rf"(?is)\A\s*(?:(?:{CODE}|[A-Z])\s*\n\s*)?(?:[A-Za-z]{{0,6}}\d{{1,5}}\s+)?description\s*[:\-–]-?\s*(.*)", 1)
    ended = F.regexp_replace(body, r"(?is)\n\s*(?:schedule\b|(?:grand\s+)?total\b|(?:[A-Za-z]{0,6}\d{1,5}\s+)?description\s*[:\-–]|above\s*/|below\s*/|item\s+breakup\b|\d{1,4}\s*$).*\z", "")
    chrome = F.regexp_replace(ended, r"(?im)^\s*(?:\[\[PAGE:\d+\]\]|tender\s+no\s*:.*|page\s+\d+.*|\d{1,4})\s*$", "")
    return truncate(clean_description(collapse(chrome)), MAX_DESC)


def sweep_regions(docs: DataFrame, pass_no: int = 6) -> DataFrame:
    """Coded rows found anywhere in the text of a schedule's region, each with the description that follows it."""
    marked = F.regexp_replace("text", SWEEP, "\u0001$0\u0002" + "\u0002".join(f"${k + 1}" for k in range(len(SWEEP_FIELDS))) + "\u0003")
    found = regions(docs).where(F.col("text").rlike(SWEEP)).select("doc_id", "region_no", "offset", "page", "schedule", F.posexplode(F.split(marked, "\u0001")).alias("k", "piece"))
    found = found.withColumn("after", F.substring_index("piece", "\u0003", -1)).withColumn("g", F.split(F.substring_index("piece", "\u0003", 1), "\u0002"))
    size = F.when(F.col("k") == 0, F.length("piece")).otherwise(F.length(F.col("g")[0]) + F.length("after"))
    here = Window.partitionBy("doc_id", "region_no").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    page = F.when(F.col("k") >= 0, F.regexp_extract("piece", r"(?s).*\[\[PAGE:(\d+)\]\]", 1)).try_cast("int")
    found = found.withColumn("at", F.col("offset") + F.coalesce(F.sum(size).over(here), F.lit(0))).withColumn("page", F.coalesce(F.last(page, True).over(here), F.col("page"))).where("k > 0")
    get = lambda f: nullif_empty(strip(F.col("g")[SWEEP_FIELDS.index(f) + 1]))
    out = {f: get(f) if f in SWEEP_FIELDS else F.lit(None).cast("string") for f in ITEM_FIELDS}
    out |= {"s_no": F.regexp_replace(get("s_no"), r"^0+(?=\d)", ""), "item_code": item_code(get("item_code")), "escalation": F.regexp_replace(collapse(get("escalation")), r"(?i)at\s*par", "AT Par")}
    out |= {"description": nullif_empty(description_block(F.col("after"))), "schedule": F.col("schedule")}
    pages = F.when(F.col("page").isNotNull(), F.array("page")).otherwise(F.array().cast("array<int>"))
    return found.select("doc_id", F.lit(pass_no).alias("pass_no"), F.col("at").alias("seq"), *[v.alias(f) for f, v in out.items()], pages.alias("page_numbers"), F.col("at").alias("source_pos"))


def parse_anchors(docs: DataFrame, pass_no: int = 7, reach: int = 29) -> DataFrame:
    """Each description with the nearest row in the ``reach`` lines above it; several may share a row.

    A description with a prefixed code of its own and no row above is an item without money; others are left out.
    """
    lines = match_rows(annotate(explode_lines(docs)))
    line, c = F.col("line"), F.col("class")
    label = line.rlike(DESCRIPTION) & ~F.col("skip")
    above = F.last(F.when(F.col("kind").isNotNull(), F.struct("kind", "matched", "serial_above", "line_no", "schedule")), True).over(in_doc().rowsBetween(-reach, -1))
    # serials and codes alone on a line, each with its place, count if they stand between the row and the description
    serial = F.last(F.when(list_serial(line), F.struct("line_no", line.alias("v"))), True).over(in_doc().rowsBetween(-reach, -1))
    code = F.last(F.when(line.rlike(CODE_LINE) & ~line.rlike(r"^\d{1,4}$"), F.struct("line_no", line.alias("v"))), True).over(in_doc().rowsBetween(-reach, -1))
    lines = lines.withColumn("above", F.when(label, above)).withColumn("serial", F.when(label, serial)).withColumn("code", F.when(label, code)).withColumn("label", label)
    so_far = in_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("block", F.sum(F.col("label").cast("int")).over(so_far)).where("block > 0")
    ends = ~F.col("label") & (c.isin("schedule", "total", "breakup", "priced", "description", "bid") | F.col("kind").isNotNull() | F.col("skip"))
    in_block = Window.partitionBy("doc_id", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("ended", F.max(ends).over(in_block)).where("not ended")
    text = F.when(F.col("label"), nullif_empty(F.regexp_extract(line, DESCRIPTION, 2))).when((c == "text") & ~line.rlike(r"^\d{1,4}$"), line)
    own = F.when(F.col("label"), F.struct("line_no", "offset", "page", "schedule", "above", "serial", "code", nullif_empty(F.regexp_extract(line, DESCRIPTION, 1)).alias("lead")))
    g = lines.groupBy("doc_id", "block").agg(F.max_by(own, F.col("label").cast("int")).alias("a"), F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("line_no", text.alias("t"))))).alias("parts"))
    g = g.withColumn("description", clean_description(F.array_join(F.transform("parts", lambda p: p["t"]), " "))).withColumn("description", nullif_empty(truncate(F.col("description"), MAX_DESC)))
    g = read_rows(g.select("*", "a.above.kind", "a.above.matched", "a.above.serial_above"))
    row, at, desc = row_fields(), F.col("a.above.line_no"), F.col("description")
    between = lambda f: F.when(F.col(f"a.{f}.line_no") > at, F.col(f"a.{f}.v"))
    lead = F.col("a.lead")
    numeric = F.coalesce(lead.rlike(r"^\d{1,4}$"), F.lit(False))
    g = g.where(desc.isNotNull() & (at.isNotNull() | lead.isNotNull() & ~numeric))
    g, row["s_no"] = g.withColumn("_s_no", row["s_no"]), F.col("_s_no")
    s_no = F.regexp_replace(F.coalesce(row["s_no"], between("serial"), F.when(numeric, lead)), r"^0+(?=\d)", "")
    out = row | {"s_no": s_no, "item_code": item_code(F.coalesce(row["item_code"], F.when(~numeric, lead), between("code"), s_no)), "description": desc, "schedule": F.coalesce(F.col("a.above.schedule"), F.col("a.schedule"))}
    pages = F.when(F.col("a.page").isNotNull(), F.array(F.col("a.page").cast("int"))).otherwise(F.array().cast("array<int>"))
    return g.select("doc_id", F.lit(pass_no).alias("pass_no"), F.col("a.line_no").cast("bigint").alias("seq"), *[v.alias(f) for f, v in out.items()], pages.alias("page_numbers"), F.col("a.offset").alias("source_pos"))


def parse_breakups(docs: DataFrame, pass_no: int = 5) -> DataFrame:
    """Rows of item breakup annexures; the parent comes from the ``Item - n`` line above."""
    lines = annotate(explode_lines(docs)).where("in_breakup and class <> 'blank'")
    w = in_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = F.col("line")
    parent = F.regexp_extract(line, r"(?i)^item\s*[-–]?\s*0*(\d{1,4})\b", 1)
    # a total or a new section ends the annexure, a new heading opens one
    state = F.when(F.col("class") == "breakup", F.lit(True)).when((F.col("class") == "total") | line.rlike(r"(?i)^(?:\d+\.\s*)?(?:eligibility|standard\s+(?:financial|technical)|general\s+conditions|special\s+conditions|instructions\s+to\s+bidders|payment\s+terms|annexure|corrigendum)\b"), F.lit(False))
    lines = lines.withColumn("parent", F.last(nullif_empty(parent), True).over(w)).withColumn("open", F.coalesce(F.last(state, True).over(w), F.lit(False))).where("open")
    # the expression runs once for each line, and only where a line can be a row
    row = F.when(line.rlike(r"^\d{1,3}\s+\d") & line.contains("."), F.regexp_replace(line, BREAKUP_ROW, "\u0002" + "\u0001".join(f"${k}" for k in BREAKUP_GROUPS)))
    lines = lines.withColumn("row", row).withColumn("row", F.when(F.col("row").startswith("\u0002"), F.substring("row", 2, 2**31 - 1)))
    lines = lines.withColumn("item_no", F.sum(F.col("row").isNotNull().cast("int")).over(w)).where("item_no > 0")
    is_row = F.col("row").isNotNull()
    follows = ~is_row & (F.col("class") == "text") & (parent == "") & ~line.rlike(r"(?i)^s\s*no\.?\b|^(?:no|item)$")
    kept = lambda v: F.max(F.when(is_row, F.col(v))).alias(v)
    g = lines.groupBy("doc_id", "item_no").agg(*[kept(v) for v in ("line_no", "offset", "page", "parent", "row")], F.array_sort(F.collect_list(F.when(follows, F.struct("line_no", F.col("line").alias("t"))))).alias("parts"))
    g = g.withColumn("row", F.split("row", "\u0001", len(BREAKUP_GROUPS)))
    get = lambda k: nullif_empty(strip(F.col("row")[BREAKUP_GROUPS.index(k)]))
    number_ = lambda k: F.regexp_replace(get(k), r"^0+(?=\d)", "")
    parts = F.concat(F.array(strip(F.col("row")[BREAKUP_GROUPS.index(3)])), F.transform("parts", lambda p: p["t"]))
    out = {f: F.lit(None).cast("string") for f in ITEM_FIELDS}
    out |= {"s_no": number_(1), "item_code": number_(2), "description": clean_description(F.array_join(parts, " ")), "qty_unit": get(4), "item_qty": get(5), "unit_rate": get(6), "amount": get(7)}
    out |= {"schedule": F.when(F.col("parent").isNotNull(), F.concat(F.lit("Item "), F.col("parent"), F.lit(" Breakup"))).otherwise("Item Breakup"), "parent_s_no": F.col("parent")}
    pages = F.when(F.col("page").isNotNull(), F.array(F.col("page").cast("int"))).otherwise(F.array().cast("array<int>"))
    return g.select("doc_id", F.lit(pass_no).alias("pass_no"), F.col("line_no").cast("bigint").alias("seq"), *[v.alias(f) for f, v in out.items()], pages.alias("page_numbers"), F.col("offset").alias("source_pos"))


def parse_categories(docs: DataFrame, pass_no: int = 3) -> DataFrame:
    """The comma list of a bid's item categories, at most as many as the total quantity says."""
    body = F.regexp_extract("text", r"(?is)item\s*category\s*[:\-/]?\s*(.+?)(?:\n\s*\n|\n\s*(?:gemarpts|bid\s|total\s+quantity|minimum|boq)|\z)", 1)
    total = F.regexp_extract("text", r"(?i)total\s*quantity\s*[:\-]?\s*(\d{1,6})", 1).try_cast("int")
    parts = docs.select("doc_id", total.alias("total"), F.posexplode(F.split(F.regexp_replace(body, r"\s+", " "), r"\s*,\s*")).alias("k", "part"))
    parts = parts.withColumn("part", strip(F.col("part"))).where((F.length("part") >= 8) & ~F.col("part").rlike(r"(?i)^(?:bid|ministry|department|organi[sz]ation|office|contract|estimated|years?)\b"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("k"))
    rows = parts.withColumn("n", n).where("total is null or n <= total")
    out = {f: F.lit(None).cast("string") for f in ITEM_FIELDS} | {"s_no": F.col("n").cast("string"), "description": F.col("part"), "product_name": F.col("part"), "schedule": F.lit("GeM Item Category")}
    return rows.select("doc_id", F.lit(pass_no).alias("pass_no"), F.col("k").cast("bigint").alias("seq"), *[v.alias(f) for f, v in out.items()], F.array().cast("array<int>").alias("page_numbers"), F.lit(None).cast("bigint").alias("source_pos"))


# Labels of a bid's price blocks, their first letters, and the labels without blanks.
BLOCK_LABELS = {
    "title": r"item\s*(?:title|name)",
    "description": r"item\s*(?:description|details?)",
    "unit_rate": r"unit\s*(?:rate|price)|rate|price",
    "amount": r"total\s*(?:amount|price)|amount",
    "item_qty": r"quantity|qty",
    "qty_unit": r"unit|uom",
}
BLOCK_STARTS = "aipqrtu"
BLOCK_NAMES = {
    "title": ["itemtitle", "itemname"],
    "description": ["itemdescription", "itemdetail", "itemdetails"],
    "unit_rate": ["unitrate", "unitprice", "rate", "price"],
    "amount": ["totalamount", "totalprice", "amount"],
    "item_qty": ["quantity", "qty"],
    "qty_unit": ["unit", "uom"],
}


def parse_price_blocks(docs: DataFrame, pass_no: int = 3) -> DataFrame:
    """Labelled title, description, quantity, unit, rate and amount of a bid's items.

    A text is cut at its labels; the parts run on until a title, or a description or quantity after the block's quantity,
    opens the next block.  A block counts if it has a quantity and its words are no page furniture.
    """
    cut = F.split(F.regexp_replace("text", rf"(?i)(?=[{BLOCK_STARTS}])\b({'|'.join(BLOCK_LABELS.values())})\s*(?:[:\-–]|(?<=quantity|qty)(?=\s*\d))\s*", "\u0001$1\u0002"), "\u0001")
    parts = docs.select("doc_id", F.posexplode(cut).alias("k", "part")).where("k > 0")
    label, value = F.translate(F.lower(F.substring_index("part", "\u0002", 1)), " \t\n\x0b\f\r", ""), F.expr("substring(part, instr(part, '\u0002') + 1)")
    kind = reduce(lambda acc, f: acc.when(label.isin(BLOCK_NAMES[f]), f), list(BLOCK_NAMES)[1:], F.when(label.isin(BLOCK_NAMES["title"]), "title"))
    parts = parts.select("doc_id", "k", kind.alias("kind"), collapse(value).alias("value"))
    w = Window.partitionBy("doc_id").orderBy("k")
    before = F.lag("kind").over(w)
    words = F.col("kind").isin("title", "description", "item_qty")
    opens = (F.col("kind") == "title") | words & (before.isNull() | ~before.isin("title", "description"))
    parts = parts.withColumn("block", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("block > 0")
    first = lambda f: F.min_by(F.when(F.col("kind") == f, F.col("value")), F.when(F.col("kind") == f, F.col("k")))
    g = parts.groupBy("doc_id", "block").agg(F.min("k").cast("bigint").alias("seq"), *[first(f).alias(f) for f in BLOCK_LABELS])
    number = lambda f: nullif_empty(F.regexp_extract(f, r"^(?:Rs\.?|INR|₹)?\s*([\d,]+\.?\d*)", 1))
    text = nullif_empty(F.concat_ws(" ", "title", "description"))
    out = {f: F.lit(None).cast("string") for f in ITEM_FIELDS} | {f: number(f) for f in ("item_qty", "unit_rate", "amount")}
    out |= {"qty_unit": nullif_empty(F.regexp_extract("qty_unit", r"^([A-Za-z][A-Za-z./\-]{0,20})", 1)), "description": truncate(text, MAX_DESC), "product_name": truncate(F.col("title"), 200)}
    rows = g.select("doc_id", F.lit(pass_no).alias("pass_no"), (F.col("seq") + 1_000_000).alias("seq"), *[v.alias(f) for f, v in out.items()], F.array().cast("array<int>").alias("page_numbers"), F.lit(None).cast("bigint").alias("source_pos"))
    return rows.where(F.col("item_qty").isNotNull() & ~F.coalesce(F.col("description").rlike(JUNK_FIRST), F.lit(False)))


def parse_paragraphs(docs: DataFrame, pass_no: int = 9) -> DataFrame:
    """Numbered lines of the first section that names a bill of quantities (40,000 characters)."""
    # Headings of a bill of quantities.
    head = r"(?i)bill\s+of\s+quantit(?:y|ies)|\bboq\b|schedule\s+of\s+(?:items?|rates?|quantit)|list\s+of\s+(?:items?|materials?|products?|goods)|items?\s+(?:to\s+be\s+)?(?:procured|supplied|purchased)|scope\s+of\s+supply|item\s*details?|product\s*details?"
    section = F.substring(F.element_at(F.split("text", head, 2), -1), 1, 40_000)
    some = docs.where(F.col("text").rlike(head)).select("doc_id", F.posexplode(F.split(section, "\n")).alias("k", "line"))
    row = r"^\s*(\d{1,3})[.)]\s+(.{4,})$"
    some = some.where(F.col("line").rlike(row)).withColumn("desc", strip(F.regexp_extract("line", row, 2)))
    labelled = r"(?i)(?:qty|quantity|nos?\.?)\s*[:\-]?\s*([\d,]+(?:\.\d+)?)\s*([A-Za-z%]+)?"
    bare = r"(?i)\b([\d,]+(?:\.\d+)?)\s*(nos?\.?|units?|kg|kgs|mt|tonnes?|litres?|ltr|meters?|mtr|sets?|pcs?|pieces?|months?)\b"
    qty = lambda k: F.coalesce(nullif_empty(F.regexp_extract("desc", labelled, k)), nullif_empty(F.regexp_extract("desc", bare, k)))
    out = {f: F.lit(None).cast("string") for f in ITEM_FIELDS} | {"s_no": F.regexp_replace(F.regexp_extract("line", row, 1), r"^0+(?=\d)", ""), "description": F.col("desc"), "item_qty": qty(1), "qty_unit": qty(2)}
    return some.select("doc_id", F.lit(pass_no).alias("pass_no"), F.col("k").cast("bigint").alias("seq"), *[v.alias(f) for f, v in out.items()], F.array().cast("array<int>").alias("page_numbers"), F.lit(None).cast("bigint").alias("source_pos"))


def all_passes(docs: DataFrame, from_tables: DataFrame | None = None) -> DataFrame:
    """The bag of all passes.  GeM documents use the category list first and schedule layouts only if nothing was
    found; paragraphs are read only in documents without any item."""
    from ..plans.stages import Stages

    stages = Stages(docs.sparkSession, "passes")
    kind = stages.write(docs.select("doc_id", "text", portal(F.col("text")).alias("portal")))
    gem, rest = kind.where("portal = 'gem'"), kind.where("portal <> 'gem'")
    first = parse_categories(gem).unionByName(parse_price_blocks(gem))
    first = stages.write(from_tables.unionByName(first) if from_tables is not None else first)
    again = gem.join(first.select("doc_id").distinct(), "doc_id", "left_anti")
    schedules = rest.select("doc_id", "text", F.lit(2).alias("pass_no")).union(again.select("doc_id", "text", F.lit(4).alias("pass_no")))
    found = first.unionByName(parse_items(schedules)).unionByName(parse_breakups(rest))
    found = stages.write(found.unionByName(sweep_regions(rest)).unionByName(parse_anchors(rest)))
    none = kind.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    return found.unionByName(parse_paragraphs(none))


def defaults(items: DataFrame) -> DataFrame:
    """Default code, casing of AT Par, bidding units that exist, serials without zeros."""
    code = F.coalesce(nullif_empty(strip(F.col("item_code"))), F.when(F.col("s_no").rlike(r"^\d+$"), F.col("s_no")))
    bid = F.when(strip(F.col("bidding_unit")).rlike(r"(?i)^(?:at\s*par|above\s*/\s*below\s*/\s*par|rs\.?|inr)$"), F.col("bidding_unit"))
    serial = F.when(list_serial(F.col("s_no")), F.regexp_replace(strip(F.col("s_no")), r"^0+(?=\d)", "")).otherwise(F.coalesce(code_number(F.col("item_code")), F.when((text_or_empty(F.col("s_no")) == "") & list_serial(F.col("item_code")), F.regexp_replace("item_code", r"^0+(?=\d)", ""))))
    return items.withColumn("s_no", serial).withColumn("item_code", code).withColumn("bidding_unit", bid).withColumn("escalation", collapse(F.regexp_replace("escalation", r"(?i)at\s*par", "AT Par")))
