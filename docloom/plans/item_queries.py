"""Registered queries of single operators over rendered rows, each with the DuckDB text it must equal.

Texts are rendered from the star-schema tables, so every row has a value of its own and the expected one follows in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrow
from ..functions import describe as D
from ..functions import predicates as P
from ..functions import text as T
from ..operators import blocks, export, fields, header, items, lines, memory, merge, names, tables
from ..operators.rules import match_rules
from ..schemas import ITEM_FIELDS
from ..sources import pages as page_source
from . import flow, render
from .deploy import ship
from .queries import _NUMBERED, _scalar, query, table
from .stages import spread



def part_key() -> Column:
    return F.col("p_partkey").cast("string")


def none() -> Column:
    return F.lit(None).cast("string")


def sno() -> Column:
    return F.col("sno").cast("string")


def key() -> Column:
    return F.col("o_orderkey").cast("string")


def price() -> Column:
    return F.col("o_totalprice").cast("decimal(18,2)").cast("string")


def text(template: str) -> Column:
    """A text of the part row: ``{}`` is its key."""
    out: list[Column] = []
    for k, piece in enumerate(template.split("{}")):
        out += ([part_key()] if k else []) + [F.lit(piece)]
    return F.concat(*out)


def on_part(name: str, f: Callable[[Column], Column], given: str, want: str) -> None:
    """f of a text with the part's key in it, against a text with the key in it."""
    sql = " || ".join(["'" + want.replace("'", "''").replace("{}", "' || p_partkey || '") + "'"])
    _scalar(name, "part", "p_partkey", lambda: f(text(given)), sql)


def choice(name: str, f: Callable[[Column], Column], cases: dict[str | None, str | bool | None]) -> None:
    """f over a row of cases dealt by order key."""
    lit = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    sql = f"[{', '.join(lit(v) for v in cases.values())}][o_orderkey % {len(cases)} + 1]"
    _scalar(name, "orders", "o_orderkey", lambda: f(F.element_at(F.array(*[F.lit(c) if c is not None else none() for c in cases]), (F.col("o_orderkey") % len(cases) + 1).cast("int"))), sql)


# ---- H, I: texts and names ----
@query("h01_nfkc", "select p_partkey, 'fi-\"part\" ' || p_partkey || ' x2' as v from part")
def h01(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return table(spark, d, "part").select("p_partkey", arrow.nfkc(text("ﬁ–“part” {}​ x²")).alias("v"))


on_part("h02_clean_text", T.clean_text, "word-\nwrap   {}\n\n\n\nPage 3 of 9\nx – {} \n", "wordwrap {}\n\nx - {}")
on_part("h05_repair_spaced", D.repair_spaced, "S u p p l y of H D P E pipe P{} and fix ing", "Supply of HDPE pipe P{} and fixing")
on_part("h06_drop_chrome", D.drop_chrome, "drum P{} 60 61 62 on Page 1 of 2 x", "drum P{} on")
_scalar("h07_stray_number", "part", "p_partkey", lambda: D.drop_stray_number(F.concat(F.lit("tinned "), (F.col("p_partkey") % 50 + 1).cast("string"), F.lit(" copper P"), part_key(), F.lit(" of 900 x")), (F.col("p_partkey") % 50 + 1).cast("string"), none()), "'tinned copper P' || p_partkey || ' of 900 x'")
on_part("h08_clean_item", lambda c: D.clean_item(c, none(), none()), "Specifi cation as per as per drawing SK.9/1 1 relayPanel P{}", "Specification as per drawing SK.9/11 relay Panel P{}")
on_part("h09_schedule_title", T.schedule_title, "schedule () [ ] B-Cables P{} 1,200.00", "Schedule B-Cables P{}")
on_part("h11_normal_description", D.normal_description, 'Description:- "[[PAGE:2]] cable o f type P{} 12 3.00 Nos 4.00 5.00 AT Par', "cable of type P{}")
on_part("h16_clean_description", T.clean_description, "Description: \n Item details: - part  {}", "part {}")
on_part("h17_cell", T.cell, " part\t{}\r\n x ", "part {} x")
on_part("h27_instruction", T.instruction, " always  name part {} in full ", "always name part {} in full")
on_part("h30_desc_key", T.desc_key, " Part  {} \n X", "part {} x")
_scalar("h32_compact_row", "part", "p_partkey", lambda: F.to_json(T.compact_row(F.col("p_size"), part_key(), F.col("p_name"), F.repeat(F.col("p_name"), 30), none(), F.col("p_type"))), """'{"index":' || p_size || ',"s_no":"' || p_partkey || '","product_name":"' || p_name || '","description":"' || case when length(repeat(p_name, 30)) > 140 then regexp_replace(substr(repeat(p_name, 30), 1, 139), '\\s+$', '') || '…' else repeat(p_name, 30) end || '","amount":"' || p_type || '"}'""")
_scalar("h33_chat_title", "documents", "doc_id", lambda: T.chat_title(F.col("text")), "coalesce(case when length(trim(regexp_replace(replace(text, chr(10), ' '), '[ \\t]+', ' ', 'g'))) > 48 then regexp_replace(substr(trim(regexp_replace(replace(text, chr(10), ' '), '[ \\t]+', ' ', 'g')), 1, 47), '\\s+$', '') || '…' else nullif(trim(regexp_replace(replace(text, chr(10), ' '), '[ \\t]+', ' ', 'g')), '') end, 'New chat')")
_scalar("h28_table_digest", "part", "p_partkey", lambda: T.table_digest(F.array(F.lit("a"), F.lit("b")), F.array(F.array("p_name", "p_brand"), F.array("p_type", none()))), "'a | b' || chr(10) || p_name || ' | ' || p_brand || chr(10) || p_type || ' | '")
on_part("a13_xml_text", T.strip_xml, "a\u0001{}\u0008b", "a{}b")
_scalar("e07_consecutive", "part", "p_partkey", lambda: T.consecutive(F.concat_ws(" ", part_key(), (F.col("p_partkey") + 1).cast("string"), (F.col("p_partkey") + 1 + F.col("p_size") % 2).cast("string"))), "p_size % 2 = 1")
on_part("i22_product_name", lambda c: D.product_name(D.normal_description(c)), "Supply, installation and testing of signal unit P{} as per RDSO spec", "signal unit P{}")
on_part("i23_finish_name", D.finish_name, "unit P{} with back-box for site with back box (2 nos)", "unit P{} with back-box for site")
on_part("i24_checked_name", lambda c: D.checked_name(c, c), "supply of signal lamp P{}", "signal lamp P{}")
_scalar("i26_spec_numbers", "part", "p_partkey", lambda: names.spec_numbers(F.concat(F.lit("as per IRS : S-63/2014 and RDSO / SPN / "), (F.col("p_partkey") % 900 + 100).cast("string"), F.lit("/2006, again IRS:S-63/2014"))), "'IRS:S-63/2014; RDSO/SPN/' || (p_partkey % 900 + 100) || '/2006'")
_scalar("i27_drawing", "part", "p_partkey", lambda: names.drawing_number(F.concat(F.lit("relay to drawing no. RDSO / S- "), (F.col("p_partkey") % 9000 + 1000).cast("string"), F.lit(" x"))), "'RDSO/S-' || (p_partkey % 9000 + 1000)")
on_part("i27_make", names.make_brand, "relay M/s Acme{} make, with box", "Acme{}")
_scalar("i27_warranty", "part", "p_partkey", lambda: names.warranty(F.concat(F.lit("Warranty period: "), F.col("p_size").cast("string"), F.lit(" months from date"))), "p_size || ' months'")
choice("i27_agency", names.inspection_agency, {"(Inspection: RDSO)": "RDSO", "inspection by RITES / Consignee": "RITES / Consignee", "none": None})
on_part("i03_clip_label", fields.clip_label, "to bid part {} Tender Type Open", "part {}")
on_part("i08_tender_token", fields.tender_token, " : BCT-{}/01 Closing Date x", "BCT-{}/01")
_scalar("i09_closing", "orders", "o_orderkey", lambda: fields.closing(F.concat(F.lit("x\nBid End Date/Time "), F.date_format("o_orderdate", "dd-MM-yyyy HH:mm"), F.lit("\ny"))), "strftime(o_orderdate, '%d-%m-%Y %H:%M')")
on_part("i13_name_of_work", fields.name_of_work, "Name of Work: supply of\npart {} and\nmore\nTender Type: Open", "supply of part {} and more")
_scalar("i14_period", "part", "p_partkey", lambda: fields.clean_period(F.concat(F.lit("within "), F.col("p_size").cast("string"), F.lit(" Months from award"))), "p_size || ' Months'")
on_part("i14_zone", fields.clean_zone, "W{} RLY  zone office", "W{} RLY zone")
choice("i15_currency", fields.currency, {"Rs. 5": "INR", "USD 5": "USD", "5 €": "EUR", "5": None})
on_part("i20_signing", lambda c: fields.signing(c)["name"], "x\nSigned by: Officer {}\ny", "Officer {}")
_scalar("i02_refine_amount", "part", "p_partkey", lambda: fields.refine(F.concat(F.lit("| Rs. "), F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.lit(" Lakhs  more")), "amount"), "'Rs. ' || cast(p_retailprice as decimal(18,2)) || ' Lakhs'")
on_part("i01_labelled", lambda c: fields.labelled(c, [r"work\s+order", r"file\s+no"], "text"), "a\nFile No: F{} | x\nWork order: nil\n", "F{}")

# ---- B: classes ----
choice("b03_placeholder", P.placeholder, {" N/A ": True, "--": True, "open": False, "": True, "nil": True, "x": False})
choice("b04_label", fields.is_label, {"Tender Type:": True, "yes": False, "": True, "Bidding System": True, "part 5": False})
choice("b05_no_echo", fields.no_echo, {"Tender Type": None, "Open": "Open", "part": "part"})
choice("b13_line_class", P.line_class, {"": "blank", "Schedule A-x": "schedule", "Schedule Total": "total", "Description:- y": "description", "12": "serial", "1 2.00 Nos 3.00 4.00 AT Par 5.00": "priced", "free words": "text", "Above/": "bid", "[[PAGE:4]]": "chrome", "2. Item Breakup": "breakup"})
choice("b17_clause", P.clause_or_junk, {"abc": True, "meaning of similar works here": True, "LED display": False, "2.1 Scope": True})
choice("b18_civil_work", P.work_description, {"Excavation of cable trench in soil": True, "Supply of cable": False, "Refilling the trench": True})
choice("b19_prefixed_code", P.prefixed_code, {"NS04": True, "A": False, "12": False, "ABCDEFG1": False})
choice("b22_real_spec", P.real_spec, {"RDSO/SPN/": False, "RDSO/SPN/144": True, "IS:1": False, "specification": False})
choice("b24_number", P.number, {"1,200.50": True, "-3": False, "2 000": True, "x": False, "5.": False})
choice("b25_code_belongs", lambda c: P.code_belongs(c, F.lit("NS4"), F.lit("7")), {"ns4": True, "4": True, "7": True, "8": False, "NS5": False})
choice("b26_failure", P.failure_kind, {"Read timed out": "timeout", "HTTP 429": "quota", "boom": "error"})
choice("b27_upload", memory.is_upload, {"Uploaded tender.pdf": True, "a.pdf +2": True, "what is a pdf": False})


def _item(**k: Column) -> dict[str, Column]:
    return {f: none() for f in ITEM_FIELDS} | k


choice("b14_footer", lambda c: P.footer(_item(description=c, item_code=c)), {"Tender No: 5": True, "part": False, "Closing Date/Time: x": True})
_scalar("b15_valid_item", "lineitem", "l_orderkey", lambda: P.valid_item(_item(s_no=F.col("l_linenumber").cast("string"), description=F.when(F.col("l_tax") > 0.02, F.lit("Relay panel")), item_qty=F.when(F.col("l_discount") > 0.03, render.money(F.col("l_quantity"))), unit_rate=F.when(F.col("l_quantity") > 20, render.money(F.col("l_extendedprice"))))), "case when l_discount > 0.03 then (l_quantity > 20 or l_tax > 0.02) else l_tax > 0.02 end")
_scalar("b16_valid_row", "lineitem", "l_orderkey", lambda: P.valid_row(_item(s_no=F.col("l_linenumber").cast("string"), description=F.when(F.col("l_tax") > 0.02, F.lit("Relay panel")), item_qty=F.when(F.col("l_discount") > 0.03, render.money(F.col("l_quantity"))), unit_rate=F.when(F.col("l_quantity") > 20, render.money(F.col("l_extendedprice"))))), "case when l_tax > 0.02 then true else l_discount > 0.03 and l_quantity > 20 end")


# ---- I: sections, marketplace bids, mastheads, clauses ----
def _orders_text(spark: SparkSession, d: str, *parts: Column | str) -> DataFrame:
    o = spread(table(spark, d, "orders"), "o_orderkey")
    return o.select(F.col("o_orderkey").cast("string").alias("doc_id"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("text"))


_PRICE = "cast(cast(o_totalprice as decimal(18,2)) as varchar)"


@query("i10_masthead", "select cast(o_orderkey as varchar) as doc_id, 'UNIT ' || o_orderkey as head_division, 'Z' || o_custkey || ' RLY' as head_zone from orders")
def i10(spark: SparkSession, d: str) -> DataFrame:
    return header.masthead(_orders_text(spark, d, "Page 1/2\nUNIT ", key(), " / Z", F.col("o_custkey").cast("string"), " RLY\n\nTENDER DOCUMENT\nother / line\n"))


@query("i12_market_bid", f"select cast(o_orderkey as varchar) as doc_id, 'GEM/2026/B/' || o_orderkey as tender_no, 'Supply of item ' || o_custkey as name_of_work, replace({_PRICE}, '.', '') as earnest_money, strftime(o_orderdate, '%d-%m-%Y %H:%M:%S') as closing_date_time, 'Ministry ' || o_custkey as zone, '120' as bid_validity_days from orders")
def i12(spark: SparkSession, d: str) -> DataFrame:
    docs = _orders_text(spark, d, "Bid Number: GEM/2026/B/", key(), " Dated: 01-02-2026\nGeM bid\nBid End Date/Time ", F.date_format("o_orderdate", "dd-MM-yyyy HH:mm:ss"), "\nMinistry/State Name Ministry ", F.col("o_custkey").cast("string"), " / Department x\nBOQ Title Supply of item ", F.col("o_custkey").cast("string"), " Minimum turnover\nEMD Amount ", F.regexp_replace(price(), r"\.", ""), "\nBid Offer Validity (From End Date) 120 (Days)\n")
    return header.header_fields(docs).select("doc_id", "tender_no", "name_of_work", "earnest_money", "closing_date_time", "zone", "bid_validity_days")


@query("i06_header_block", "select cast(o_orderkey as varchar) as doc_id, 'T-' || o_orderkey as tender_no, '75' as bid_validity_days, case when o_orderkey % 2 = 0 then 'Open' else 'Limited' end as tender_type, cast(o_custkey as varchar) as number_of_jv_member_allowed, '12 Months' as period_of_completion from orders")
def i06(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 2 == 0, "Open").otherwise("Limited")
    docs = _orders_text(spark, d, "Tender Type: nil\n1. NIT HEADER\nTender No: T-", key(), "\nValidity of Offer (Days) 75\nTender Type\n", kind, "  Bidding Style x\nNumber of JV Members Allowed: ", F.col("o_custkey").cast("string"), " members\nPeriod of Completion: within 12 Months\n2. Payment Terms\nlater\n")
    return header.header_fields(docs).select("doc_id", "tender_no", "bid_validity_days", "tender_type", "number_of_jv_member_allowed", "period_of_completion")


@query("i15_financial", f"select cast(o_orderkey as varchar) as doc_id, {_PRICE} as estimated_value, 'Rs. ' || o_custkey as tender_fee, 'INR' as currency from orders")
def i15(spark: SparkSession, d: str) -> DataFrame:
    return header.section(_orders_text(spark, d, "Estimated Cost: ", price(), "\nTender Fee\nRs. ", F.col("o_custkey").cast("string"), "\n"), "financial").select("doc_id", "estimated_value", "tender_fee", "currency")


@query("i16_dates", "select cast(o_orderkey as varchar) as doc_id, strftime(o_orderdate, '%d/%m/%Y') as published_date, strftime(o_orderdate, '%d/%m/%Y %H:%M') as bid_submission_end from orders")
def i16(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    return header.section(_orders_text(spark, d, "NIT date: ", day, "\nBid End Date/Time: ", F.date_format("o_orderdate", "dd/MM/yyyy HH:mm"), "\n"), "dates").select("doc_id", "published_date", "bid_submission_end")


@query("i17_eligibility", "select cast(o_orderkey as varchar) as doc_id, 'Rs ' || o_custkey || ' Lakhs' as minimum_turnover, '5 years' as years_of_experience from orders")
def i17(spark: SparkSession, d: str) -> DataFrame:
    return header.section(_orders_text(spark, d, "Minimum Annual Turnover: Rs ", F.col("o_custkey").cast("string"), " Lakhs\nMinimum experience - 5 years\n"), "eligibility").select("doc_id", "minimum_turnover", "years_of_experience")


@query("i18_contact", "select cast(o_orderkey as varchar) as doc_id, 'Officer ' || o_custkey as officer_name, 'o' || o_orderkey || '@mail.example.com' as email, '0' || (7000000000 + o_orderkey) as phone, 'https://x.example/' || o_orderkey as website from orders")
def i18(spark: SparkSession, d: str) -> DataFrame:
    docs = _orders_text(spark, d, "Contact Person: Officer ", F.col("o_custkey").cast("string"), "\nmail o", key(), "@mail.example.com\nPhone no: 0", (F.lit(7000000000) + F.col("o_orderkey")).cast("string"), "\nsee https://x.example/", key(), ").\n")
    return header.section(docs, "contact").select("doc_id", "officer_name", "email", "phone", "website")


@query("i21_clauses_rendered", """select cast(o_orderkey as varchar) as doc_id, unnest(['Payment Terms', 'Warranty']) as clause_type,
  unnest(['Pay ' || o_custkey || ' within thirty days of the bill, against invoices in three copies and the receipt of the consignee.' || chr(10) || '[[PAGE:2]]', 'Two years for order ' || o_orderkey || ' from supply.']) as content, unnest([1, 2]) as page_number from orders""")
def i21(spark: SparkSession, d: str) -> DataFrame:
    """The content is whole: a clause runs over the page mark up to the next heading."""
    docs = _orders_text(spark, d, "[[PAGE:1]]\nPayment Terms:\nPay ", F.col("o_custkey").cast("string"), " within thirty days of the bill, against invoices in three copies and the receipt of the consignee.\n[[PAGE:2]]\n3. Warranty\nTwo years for order ", key(), " from supply.\n")
    return fields.clauses(docs).select("doc_id", "clause_type", "content", "page_number")


def _instructions(spark: SparkSession, d: str) -> DataFrame:
    """Rules from the parts, each twice in other letters, added to the store of the even ones."""
    part = table(spark, d, "part")
    say = lambda word: part.select(F.concat(F.lit(f"  {word} name part  "), part_key(), F.lit(" in full ")).alias("text"), F.lit("chat").alias("source"), F.col("p_partkey").alias("created"))
    store = memory.add_instructions(say("always").limit(0), say("always").where("created % 2 = 0"))
    return memory.add_instructions(store, say("always").union(say("ALWAYS").withColumn("created", F.col("created") + 1_000_000)))


@query("a17_instructions", "select 'always name part ' || p_partkey || ' in full' as text, p_partkey as created from part order by p_partkey desc limit 40")
def a17(spark: SparkSession, d: str) -> DataFrame:
    return _instructions(spark, d).select("text", "created")


@query("h31_instruction_block", "select string_agg(n || '. always name part ' || p_partkey || ' in full', chr(10) order by n) as block from (select p_partkey, row_number() over (order by p_partkey) as n from (select p_partkey from part order by 1 desc limit 15))")
def h31(spark: SparkSession, d: str) -> DataFrame:
    return memory.instruction_block(_instructions(spark, d))


@query("f06_newest_chats", "select cast(conv_id as varchar) as id, count(*) filter (conv_id % 3 <> 1) as messages from conversations group by conv_id having conv_id % 3 <> 1")
def f06(spark: SparkSession, d: str) -> DataFrame:
    """Chats of the conversations, every third without messages and title."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("messages"), F.min("turn").alias("created"))
    empty = F.col("conv_id") % 3 == 1
    chats = c.select(F.col("conv_id").cast("string").alias("id"), F.when(~empty, "named").alias("title"), "created", F.when(empty, F.array().cast("array<string>")).otherwise(F.col("messages")).alias("messages"))
    return memory.newest_chats(chats).select("id", F.size("messages").cast("bigint").alias("messages"))


# ---- C, E: lookups, running state ----
@query("c02_ocr_overlay", "select page_id % 20 as doc_id, page_id as page_number, case when page_id % 3 = 0 and page_id % 2 = 0 then 'seen ' || page_id else url end as text from pages")
def c02(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select((F.col("page_id") % 20).alias("doc_id"), F.col("page_id").alias("page_number"), F.col("url").alias("text"), F.when(F.col("page_id") % 3 == 0, 5).otherwise(500).alias("char_count"))
    ocr = p.where("page_number % 2 = 0").select("doc_id", "page_number", F.concat(F.lit("seen "), F.col("page_number").cast("string")).alias("text"))
    return page_source.overlay_ocr(p, ocr).select("doc_id", "page_number", "text")


@query("d02_marked_text", "select page_id % 20 as doc_id, string_agg('[[PAGE:' || page_id || ']]' || chr(10) || url, chr(10) || chr(10) order by page_id) as text from pages group by 1")
def d02(spark: SparkSession, d: str) -> DataFrame:
    return page_source.full_text(table(spark, d, "pages").select((F.col("page_id") % 20).alias("doc_id"), F.col("page_id").alias("page_number"), F.col("url").alias("text")), marked=True)


_EVENTS = "with e as (select user_id as doc_id, event_id as line_no, event_type as line from events)"


def _event_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("line_no"), F.col("event_type").alias("line"))


@query("e02_running_state", f"{_EVENTS} select line_no, last_value(case when line = 'error' then line_no end ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as since from e")
def e02(spark: SparkSession, d: str) -> DataFrame:
    return _event_lines(spark, d).select("line_no", lines.running(F.col("line") == "error", F.col("line_no")).alias("since"))


@query("e08_next_class", f"{_EVENTS} select line_no, first_value(case when line <> 'click' then line end ignore nulls) over (partition by doc_id order by line_no rows between 1 following and unbounded following) as next from e")
def e08(spark: SparkSession, d: str) -> DataFrame:
    return _event_lines(spark, d).select("line_no", lines.next_class(F.col("line"), "click").alias("next"))


@query(
    "c08_nearest_above",
    f"""{_EVENTS}, n as (select *, row_number() over (partition by doc_id order by line_no) as r from e),
    k as (select a.line_no, max(b.r) filter (b.line in ('error', 'signup')) as top from n a left join n b on a.doc_id = b.doc_id and b.r between a.r - 3 and a.r - 1 group by 1)
    select k.line_no, case when t.line = 'signup' then t.line_no end as above from k join n a on a.line_no = k.line_no left join n t on t.doc_id = a.doc_id and t.r = k.top""",
)
def c08(spark: SparkSession, d: str) -> DataFrame:
    return _event_lines(spark, d).select("line_no", lines.nearest_above(F.when(F.col("line") == "signup", F.col("line_no")), F.col("line") == "error", 3).alias("above"))


@query("c03_rules", r"""
with t as (
  select o_orderkey, 'buyer C-' || lpad(cast(o_custkey as varchar), 7, '0') || ' ' || coalesce(string_agg('item P-' || lpad(cast(l_partkey as varchar), 7, '0') || ' by S-' || lpad(cast(l_suppkey as varchar), 5, '0') || case when l_linenumber % 2 = 0 then ' model M' || lpad(cast(l_partkey as varchar), 7, '0') else '' end, '; '), '') as text
  from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_custkey),
x as (
  select o_orderkey, 'code' as field, '(?:item|part)\s*(?:no\.?\s*)?p-' || lpad(cast(min(l_partkey) as varchar), 7, '0') || '\b' as pattern from orders join lineitem on l_orderkey = o_orderkey group by 1
  union all select o_orderkey, 'model', '\bm' || lpad(cast(max(l_partkey) as varchar), 7, '0') || '\b' from orders join lineitem on l_orderkey = o_orderkey where l_linenumber % 2 = 0 group by 1
  union all select o_orderkey, 'buyer', 'Buyer\s+c-' || lpad(cast(o_custkey as varchar), 7, '0') from orders
  union all select o_orderkey, 'seller', 's-' || lpad(cast(min(l_suppkey) as varchar), 5, '0') || '\b|supplier\s+' || min(l_suppkey) || '\b' from orders join lineitem on l_orderkey = o_orderkey group by 1)
select * from x union all select o_orderkey, 'nines', '\d9{2}\b' from t where regexp_matches(text, '[0-9]99($|[^0-9A-Za-z_])')""")
def c03(spark: SparkSession, d: str) -> DataFrame:
    """Some thousand rules, grown with the parts, customers and suppliers, on the orders' texts; one rule without a literal."""
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    part = table(spark, d, "part")
    rules = part.select(F.lit("code").alias("field"), F.col("p_partkey").alias("priority"), F.concat(F.lit(r"(?:item|part)\s*(?:no\.?\s*)?p-"), pad("p_partkey", 7), F.lit(r"\b")).alias("pattern"))
    rules = rules.union(part.select(F.lit("model"), -F.col("p_partkey"), F.concat(F.lit(r"\bm"), pad("p_partkey", 7), F.lit(r"\b"))))
    rules = rules.union(table(spark, d, "customer").select(F.lit("buyer"), F.col("c_custkey"), F.concat(F.lit(r"Buyer\s+c-"), pad("c_custkey", 7))))
    rules = rules.union(table(spark, d, "supplier").select(F.lit("seller"), F.col("s_suppkey"), F.concat(F.lit("s-"), pad("s_suppkey", 5), F.lit(r"\b|supplier\s+"), F.col("s_suppkey").cast("string"), F.lit(r"\b"))))
    rules = rules.union(part.limit(1).select(F.lit("nines"), F.lit(1).cast("bigint"), F.lit(r"\d9{2}\b")))
    line = F.concat(F.lit("item P-"), pad("l_partkey", 7), F.lit(" by S-"), pad("l_suppkey", 5), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" model M"), pad("l_partkey", 7))).otherwise(""))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(line), "; ").alias("lines"))
    docs = table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    docs = docs.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("buyer C-"), pad("o_custkey", 7), F.lit(" "), F.coalesce("lines", F.lit(""))).alias("text"))
    return match_rules(docs, rules).withColumnRenamed("doc_id", "o_orderkey")


@query("c16_learned_prefix", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case l_orderkey % 4 when 0 then 'widget ' || l_suppkey when 1 then nullif(trim(substr(cast(l_partkey as varchar), 2) || ' spare'), '') end as rest
from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem)""")
def c16(spark: SparkSession, d: str) -> DataFrame:
    """Two prefixes per part, one of several pieces and one whose piece goes on in the text; the first in the list wins."""
    k = part_key()
    part = table(spark, d, "part")
    prefixes = part.select(F.concat(F.lit("Provision, fit & test of kit "), k, F.lit(" for")).alias("prefix"), F.col("p_partkey").alias("list_pos"))
    prefixes = prefixes.union(part.select(F.concat(F.lit("Kit"), k), F.col("p_partkey") + 10**9))
    one = F.concat(F.lit("provision ,fit&  TEST of  kit "), F.col("l_partkey").cast("string"), F.lit(" for widget "), F.col("l_suppkey").cast("string"))
    two = F.concat(F.lit("kit"), F.col("l_partkey").cast("string"), F.lit(" spare"))
    other = F.concat(F.lit("provision fit "), F.col("l_partkey").cast("string"))
    m = F.col("l_orderkey") % 4
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct().withColumn("description", F.when(m == 0, one).when(m == 1, two).otherwise(other))
    return names.prefix_rest(rows, prefixes).drop("description")


@query("i25_learn_prefix", r"""
select p_partkey, 'provision of kit ' || p_partkey || ', tuning & fitting of ' || p_name as key, 'Provision of kit ' || p_partkey || ', tuning & fitting of' as prefix,
  '(?i)^Provision\s+of\s+kit\s+' || p_partkey || '\s*,\s*tuning\s*&\s*fitting\s+of' as pattern, 'tuning,fitting' as verbs from part""")
def i25(spark: SparkSession, d: str) -> DataFrame:
    """What the correction of each part's name teaches; the older of two corrections is forgotten."""
    part = table(spark, d, "part")
    said = lambda name, at: part.select("p_partkey", F.concat(F.lit("Provision of kit "), part_key(), F.lit(", tuning & fitting of "), F.col("p_name")).alias("description"), name.alias("name"), F.lit(at).cast("bigint").alias("learned_at"))
    found = names.learn(said(F.lit("old name"), 1).union(said(F.col("p_name"), 2)).drop("p_partkey"))
    key = F.regexp_extract("prefix", r"kit (\d+)", 1).cast("bigint")
    return found.select(key.alias("p_partkey"), "key", "prefix", "pattern", F.array_join("verbs", ",").alias("verbs"))


@query("c19_second_chance", "with h as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as r, count(*) over (partition by user_id) as n from events where event_type = 'error'), f as (select user_id as q_id, event_id as vec_id, r as rank from h where r <= 1 + user_id % 2), s as (select q_id, count(*) as n from f group by 1), m as (select h.user_id as q_id, h.event_id as vec_id, h.r as rank from h where r <= 6), a as (select q_id, vec_id, 0 as part, rank from f union all select m.q_id, m.vec_id, 1, m.rank from m left join s using (q_id) where coalesce(s.n, 0) < 2 and not exists (select 1 from f where f.q_id = m.q_id and f.vec_id = m.vec_id)), z as (select q_id, vec_id, row_number() over (partition by q_id order by part, rank) as rank from a) select q_id, vec_id, cast(rank as integer) as rank from z where rank <= 4")
def c19(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'error'")
    r = e.select(F.col("user_id").alias("q_id"), F.col("event_id").alias("vec_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("rank"))
    return memory.second_chance(r.where("rank <= 1 + q_id % 2"), r.where("rank <= 6")).select("q_id", "vec_id", F.col("rank").cast("int").alias("rank"))


# ---- D, F: merging ----
def _bag(spark: SparkSession, d: str, **k: Column) -> DataFrame:
    li = render.numbered(table(spark, d, "lineitem"))
    cols = {f: none() for f in ITEM_FIELDS} | k
    return li.select("doc_id", F.lit(1).alias("pass_no"), F.col("sno").cast("bigint").alias("seq"), *[cols[f].alias(f) for f in ITEM_FIELDS], F.array().cast("array<int>").alias("page_numbers"), F.lit(None).cast("bigint").alias("source_pos"))


@query("d05_second_key", f"{_NUMBERED}, t as (select l_orderkey as k, l_linenumber as s, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as seq, 'c' || (l_partkey % 2) as code from lineitem), f as (select *, first_value(code) over (partition by k, s order by seq) as one from t) select cast(k as varchar) as doc_id, cast(s as varchar) as s_no, upper(code) as code, min(seq) as seq from f group by k, s, code")
def d05(spark: SparkSession, d: str) -> DataFrame:
    rows = _bag(spark, d, s_no=F.col("l_linenumber").cast("string"), item_code=F.concat(F.lit("c"), (F.col("l_partkey") % 2).cast("string"), F.lit("x")), schedule=F.lit("Schedule A-x"))
    return merge.merge_second(rows).select("doc_id", "s_no", F.upper(F.substring("item_code", 1, 2)).alias("code"), "seq")


@query("d07_letter_codes", f"{_NUMBERED} select doc_id, cast(sno as varchar) as s_no, 'A' as item_code, 'Schedule A-x' as schedule, count(*) as n from m group by 1, 2")
def d07(spark: SparkSession, d: str) -> DataFrame:
    k = {"s_no": sno(), "item_code": F.lit("A"), "item_qty": render.money(F.col("l_quantity")), "unit_rate": render.money(F.col("l_extendedprice")), "amount": sno(), "description": F.concat(F.lit("part "), sno())}
    with_, without = _bag(spark, d, **k, schedule=F.lit("Schedule A-x")), _bag(spark, d, **k).withColumn("pass_no", F.lit(2))
    return merge.fold_letters(with_.unionByName(without)).groupBy("doc_id", "s_no", "item_code", "schedule").agg(F.count(F.lit(1)).alias("n"))


@query("d12_promote_letters", f"{_NUMBERED} select doc_id, sno, case when cast(doc_id as bigint) % 2 = 0 then 'A' else cast(sno as varchar) end as item_code from m")
def d12(spark: SparkSession, d: str) -> DataFrame:
    code = F.when((F.col("sno") == 1) & (F.col("l_orderkey") % 2 == 0), "A").otherwise(sno())
    return merge.promote_letters(_bag(spark, d, s_no=sno(), item_code=code, schedule=F.lit("Schedule A-x"))).select("doc_id", F.col("seq").alias("sno"), "item_code")


@query("d15_repair_serials", f"{_NUMBERED} select doc_id, sno, case when count(*) over (partition by doc_id) > 1 then cast(sno + 100 as varchar) else '4' end as s_no from m")
def d15(spark: SparkSession, d: str) -> DataFrame:
    rows = _bag(spark, d, s_no=F.lit("4"), item_code=F.concat(F.lit("NS"), (F.col("sno") + 100).cast("string")), schedule=F.lit("Schedule B-x"))
    return merge.repair_serials(rows).select("doc_id", F.col("seq").alias("sno"), "s_no")


@query("d20_retag", f"{_NUMBERED} select doc_id, sno, case when sno % 3 = 0 then 'Item 7 Breakup' when max(case when sno % 3 = 1 then 1 else 0 end) over (partition by doc_id) = 1 and sno % 3 = 1 then 'NS Schedule of works' when sno % 3 = 2 then 'NS Schedule of works' end as schedule from m")
def d20(spark: SparkSession, d: str) -> DataFrame:
    """Captions of breakups, and NS codes that take the document's first NS title (C14)."""
    schedule = F.when(F.col("sno") % 3 == 0, "x Item - 07 earthing").when(F.col("sno") % 3 == 1, "NS Schedule of works")
    code = F.when(F.col("sno") % 3 == 2, F.lit("NS5"))
    return merge.retag(_bag(spark, d, item_code=code, schedule=schedule)).select("doc_id", F.col("seq").alias("sno"), "schedule")


@query("c10_backfill", f"{_NUMBERED} select doc_id, sno, case when sno % 2 = 0 then 'given ' || sno else 'part ' || l_partkey end as description from m")
def c10(spark: SparkSession, d: str) -> DataFrame:
    rows = _bag(spark, d, item_code=F.concat(F.lit("NS"), sno()), item_qty=render.money(F.col("l_quantity")), description=F.when(F.col("sno") % 2 == 0, F.concat(F.lit("given "), sno())))
    li = render.numbered(table(spark, d, "lineitem"))
    index = li.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.col("sno").alias("entry_no"), F.concat(F.lit("ns"), sno()).alias("code"), F.lit("").alias("sno"), T.norm_num(render.money(F.col("l_quantity"))).alias("qty"), F.lit("").alias("rate"), F.lit("").alias("amount"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("desc"))
    return merge.backfill(rows, index).select("doc_id", F.col("seq").alias("sno"), "description")


@query("c13_stubs", f"{_NUMBERED} select doc_id, cast(sno as varchar) as s_no, item_qty, 'Supply of part ' || l_partkey || ' with all of its long description' as description from m")
def c13(spark: SparkSession, d: str) -> DataFrame:
    """Rows without money join the priced row of their serial, whose short description they replace."""
    short, long = F.concat(F.lit("Supply of part "), F.col("l_partkey").cast("string")), F.concat(F.lit("Supply of part "), F.col("l_partkey").cast("string"), F.lit(" with all of its long description"))
    hosts = _bag(spark, d, s_no=sno(), item_qty=render.money(F.col("l_quantity")), description=short, schedule=F.lit("Schedule A-x"))
    stubs = _bag(spark, d, s_no=sno(), description=long, schedule=F.lit("Schedule A-x")).withColumn("pass_no", F.lit(2))
    return merge.fold_stubs(hosts.unionByName(stubs)).select("doc_id", "s_no", "item_qty", "description")


@query("f01_item_order", f"{_NUMBERED} select doc_id, sno, cast(row_number() over (partition by doc_id order by case when sno % 3 = 0 then 2 else 1 end, case when sno % 3 = 1 then 'a' when sno % 3 = 2 then 'b' else '' end, sno) as integer) as place from m")
def f01(spark: SparkSession, d: str) -> DataFrame:
    schedule = F.when(F.col("sno") % 3 == 1, "Schedule A-x").when(F.col("sno") % 3 == 2, "Schedule B-y").otherwise("Item 3 Breakup")
    rows = _bag(spark, d, s_no=sno(), schedule=schedule)
    return rows.select("doc_id", F.col("seq").alias("sno"), F.row_number().over(Window.partitionBy("doc_id").orderBy(merge.sort_key())).cast("int").alias("place"))


@query("d11_merge_sources", "select o_orderkey, case when o_orderkey % 3 = 0 then 'rule ' || o_orderkey when o_orderkey % 3 = 1 then 'model ' || o_orderkey || ' x' else 'model' end as v from orders")
def d11(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rule = F.when(k % 3 != 2, F.concat(F.lit("rule "), key()))
    model = F.when(k % 3 == 0, "Tender Type").when(k % 3 == 1, F.concat(F.lit("model "), key(), F.lit(" x"))).otherwise("model")
    return table(spark, d, "orders").select("o_orderkey", fields.merge_sources(rule, model).alias("v"))


@query("d16_counts", "with n as (select l_orderkey, count(*) as p, count(*) filter (l_tax > 0.02) as c from lineitem group by 1) select o_orderstatus as status, count(*) as documents, cast(coalesce(sum(p), 0) as bigint) as products, cast(coalesce(sum(c), 0) as bigint) as priced from orders left join n on l_orderkey = o_orderkey group by 1")
def d16(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status"))
    return export.summary(docs, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_tax") > 0.02, "1.00").alias("amount")))


@query("h25_model_rows", f"{_NUMBERED} select doc_id, case when sno % 2 = 0 then cast(sno as varchar) end as s_no, 'part ' || l_partkey as description, item_qty from m")
def h25(spark: SparkSession, d: str) -> DataFrame:
    li = render.numbered(table(spark, d, "lineitem"))
    json = F.to_json(F.struct(F.when(F.col("sno") % 2 == 0, sno()).otherwise("n/a").alias("itemSerialNo"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("itemDescription"), render.money(F.col("l_quantity")).alias("qty"), F.lit("null").alias("rate")))
    return memory.model_rows(li.select(F.col("l_orderkey").cast("string").alias("doc_id"), json.alias("json"))).select("doc_id", "s_no", "description", "item_qty")


# ---- K: schedules of real shape, paragraphs, the whole sanitiser ----
def _wrapped(spark: SparkSession, d: str) -> DataFrame:
    """Several schedules in a document, wrapped bidding units and descriptions, page headers between, a repeated column
    head, a total at each schedule's end."""
    n = (F.col("sno") - 1) % 3
    letter = F.element_at(F.split(F.lit("A,B,C,D,E,F,G,H,J,K,L,M,N,P,Q,R,S,T,U,V,W,X,Y,Z"), ","), (F.floor((F.col("sno") - 1) / 3) % 24 + 1).cast("int"))
    head = F.when(n == 0, F.concat(F.when(F.col("sno") > 1, "Schedule Total 1.00\n").otherwise(""), F.lit("Schedule () "), letter, F.lit("-Part works 9,100.00\nS.No. Item Code Item Qty Qty Unit\n"))).otherwise("")
    line = F.concat_ws(" ", sno(), render.money(F.col("l_quantity")), F.lit("Numbers"), render.money(F.col("l_extendedprice")), render.money(F.col("l_discount")), F.lit("AT Par"), render.money(F.col("l_tax")), F.lit("Above/"))
    body = F.concat(F.lit("\nBelow/Par\nDescription:- Supply of part "), F.col("l_partkey").cast("string"), F.lit("\n[[PAGE:2]]\nTender No: X-1\nfrom supplier "), F.col("l_suppkey").cast("string"), F.lit("\n"))
    return render.documents(render.numbered(table(spark, d, "lineitem")), F.concat(head, line, body), title=F.lit("x"), tail="Schedule Total")


_WRAPPED_SQL = f"{_NUMBERED} select doc_id, cast(sno as varchar) as s_no, 'Supply of part ' || l_partkey || ' from supplier ' || split_part(description, 'supplier ', 2) as description, item_qty, unit_rate, 'Schedule ' || string_split('A,B,C,D,E,F,G,H,J,K,L,M,N,P,Q,R,S,T,U,V,W,X,Y,Z', ',')[cast((sno - 1) // 3 % 24 + 1 as integer)] || '-Part works' as schedule from m"


@query("k07_wrapped_schedules", _WRAPPED_SQL)
def k07(spark: SparkSession, d: str) -> DataFrame:
    return items.parse_items(_wrapped(spark, d)).select("doc_id", "s_no", "description", "item_qty", "unit_rate", "schedule")


@query("e03_block_scan", _WRAPPED_SQL.replace("select doc_id,", "select 'all' as doc_id,"))
def e03_block_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same schedules as one document, a piece per order: its lines are read in blocks."""
    pieces = _wrapped(spark, d).select(F.lit("all").alias("doc_id"), F.col("doc_id").cast("bigint").alias("piece_no"), "text")
    return blocks.parse_items_blocked(pieces).select("doc_id", "s_no", "description", "item_qty", "unit_rate", "schedule")


def _crowded(spark: SparkSession, d: str) -> DataFrame:
    """Coded rows that wrap after the code and after the unit, and share lines with the row before; then a row in a total."""
    row = F.concat(F.lit(" "), sno(), F.lit("\n"), (F.col("l_partkey") + 10_000).cast("string"), F.lit(" "), render.money(F.col("l_quantity")), F.lit(" Nos\n"), F.concat_ws(" ", render.money(F.col("l_extendedprice")), render.money(F.col("l_discount")), F.lit("AT Par"), render.money(F.col("l_tax"))), F.lit("\n\nDescription:- "), render.description())
    return render.documents(render.numbered(table(spark, d, "lineitem")), row, tail="Schedule Total\n9 99999 1.00 Nos 1.00 1.00 AT Par 1.00")


@query("k08_sweep", f"{_NUMBERED} select doc_id, cast(sno as varchar) as s_no, cast(l_partkey + 10000 as varchar) as item_code, description, item_qty, 'Nos' as qty_unit, unit_rate, basic_value, 'AT Par' as escalation, amount, 'Schedule A-Supply Portion' as schedule from m")
def k08(spark: SparkSession, d: str) -> DataFrame:
    return items.sweep_regions(_crowded(spark, d)).select("doc_id", "s_no", "item_code", "description", "item_qty", "qty_unit", "unit_rate", "basic_value", "escalation", "amount", "schedule")


@query("g04_regions", "select cast(o_orderkey as varchar) as doc_id, unnest(['Schedule A-x', 'Schedule B-y']) as schedule, unnest(['Schedule A-x' || chr(10) || 'one ' || o_custkey, 'Schedule B-y' || chr(10) || 'two ' || o_orderkey]) as text, unnest([length('head ' || o_orderkey) + 1, length('head ' || o_orderkey) + 1 + length('Schedule A-x' || chr(10) || 'one ' || o_custkey || chr(10) || 'Schedule Total 5.00' || chr(10) || 'gone' || chr(10))]) as start from orders")
def g04(spark: SparkSession, d: str) -> DataFrame:
    docs = _orders_text(spark, d, "head ", key(), "\nSchedule A-x\none ", F.col("o_custkey").cast("string"), "\nSchedule Total 5.00\ngone\nSchedule B-y\ntwo ", key(), "\n2. Item Breakup\nSchedule C-z\nthree\nSpecial Conditions\nfour")
    return items.regions(docs).select("doc_id", "schedule", "text", F.col("offset").alias("start"))


@query("k09_anchors", f"{_NUMBERED}, x as (select *, unnest([1, 2]) as k from m) select doc_id, cast(sno as varchar) as s_no, 'NS' || sno as item_code, case when k = 1 then description else 'Variant ' || l_partkey || ' of the same row' end as description, item_qty, amount, 'Schedule A-Supply Portion' as schedule from x union all select distinct doc_id, null, 'ZX7', 'Orphan with code', null, null, null from m")
def k09(spark: SparkSession, d: str) -> DataFrame:
    """Two descriptions below each row, page furniture between; a coded description without a row, one without anything."""
    rows = F.concat(render.amounts(F.concat(F.lit("NS"), sno())), F.lit("\nTender No: X-1\n\nDescription:- "), render.description(), F.lit("\nAbove/\nDescription:- Variant "), F.col("l_partkey").cast("string"), F.lit("\nof the same row"))
    docs = render.documents(render.numbered(table(spark, d, "lineitem")), rows, title=F.lit("Description:- alone\nZX7 Description:- Orphan with code\nSchedule () A-Supply Portion"))
    return items.parse_anchors(docs).select("doc_id", "s_no", "item_code", "description", "item_qty", "amount", "schedule")


@query("k11_paragraphs", f"{_NUMBERED} select doc_id, cast(sno as varchar) as s_no, description || ' qty: ' || cast(item_qty as varchar) || ' Nos' as description, item_qty, 'Nos' as qty_unit from m")
def k11(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(sno(), F.lit(". "), render.description(), F.lit(" qty: "), render.money(F.col("l_quantity")), F.lit(" Nos"))
    return items.parse_paragraphs(render.documents(render.numbered(table(spark, d, "lineitem")), line, title=F.lit("x\nBill of Quantities"))).select("doc_id", "s_no", "description", "item_qty", "qty_unit")


@query("k13_price_blocks", f"{_NUMBERED} select doc_id, 'Part ' || l_partkey || ' ' || description as description, 'Part ' || l_partkey as product_name, item_qty, 'Nos' as qty_unit, unit_rate, amount from m")
def k13(spark: SparkSession, d: str) -> DataFrame:
    part = F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))
    block = F.concat(F.lit("Item Title: "), part, F.lit("\nItem Description - "), render.description(), F.lit("\nQty "), render.money(F.col("l_quantity")), F.lit(" Unit: Nos\nUnit Rate: Rs. "), render.money(F.col("l_extendedprice")), F.lit("\nTotal Amount: "), render.money(F.col("l_tax")))
    docs = render.documents(render.numbered(table(spark, d, "lineitem")), block, title=F.lit("GeM bid"), tail="")
    return items.parse_price_blocks(docs).select("doc_id", "description", "product_name", "item_qty", "qty_unit", "unit_rate", "amount")


@query("k14_defaults", f"{_NUMBERED} select doc_id, sno, cast(sno as varchar) as s_no, case when sno % 2 = 0 then 'NS' || sno else cast(sno as varchar) end as item_code, 'AT Par' as escalation, case when sno % 3 = 0 then 'Rs.' end as bidding_unit from m")
def k14(spark: SparkSession, d: str) -> DataFrame:
    rows = _bag(spark, d, s_no=F.when(F.col("sno") % 2 == 1, F.lpad(sno(), 5, "0")), item_code=F.when(F.col("sno") % 2 == 0, F.concat(F.lit("NS"), sno())), escalation=F.lit("at  par"), bidding_unit=F.when(F.col("sno") % 3 == 0, "Rs.").otherwise("x"))
    return items.defaults(rows.withColumn("s_no", F.regexp_replace("s_no", "^0000?", ""))).select("doc_id", F.col("seq").alias("sno"), "s_no", "item_code", "escalation", "bidding_unit")


@query("k15_sanitise", f"{_NUMBERED} select doc_id, cast(sno as varchar) as s_no, description, 'part ' || split_part(description, 'part ', 2) as product_name, item_qty from m")
def k15(spark: SparkSession, d: str) -> DataFrame:
    rows = _bag(spark, d, s_no=sno(), item_code=sno(), description=F.concat(F.lit("Description:- "), render.description()), item_qty=F.concat(F.lit(" "), render.money(F.col("l_quantity"))), unit_rate=sno(), amount=sno(), schedule=F.lit("Schedule A-x"))
    return flow.sanitise(rows).select("doc_id", "s_no", "description", "product_name", "item_qty")


# ---- J: grids of real shape ----
def _grid(spark: SparkSession, d: str, head: list[list[str]], pages: int = 1) -> DataFrame:
    li = render.numbered(table(spark, d, "lineitem"))
    row = F.array(sno(), render.description(), render.money(F.col("l_quantity")), F.lit("Nos"), render.money(F.col("l_extendedprice")))
    g = li.groupBy("doc_id", (F.floor((F.col("sno") - 1) / 4) if pages > 1 else F.lit(0)).cast("int").alias("p")).agg(F.array_sort(F.collect_list(F.struct("sno", row.alias("r")))).alias("rows"))
    top = F.array(*[F.array(*[F.lit(c) for c in r]) for r in head])
    cells = F.concat(F.when(F.col("p") == 0, top).otherwise(F.slice(top, 1, 0)), F.transform("rows", lambda x: x["r"]))
    return g.select("doc_id", (F.col("p") + 1).alias("page_number"), F.lit("a").alias("engine"), F.lit(0).alias("table_no"), cells.alias("cells"))


_GRID = f"{_NUMBERED} select doc_id, cast(sno as varchar) as s_no, description, item_qty, unit_rate from m"
_GRID_COLS = ["doc_id", "s_no", "description", "item_qty", "unit_rate"]


@query("j02_wrapped_header", _GRID)
def j02(spark: SparkSession, d: str) -> DataFrame:
    return tables.table_items(tables.parse_grids(_grid(spark, d, [["S.No.", "Description", "Item", "Qty", "Unit"], ["", "", "Qty", "Unit", "Rate"]]))).select(_GRID_COLS)


@query("j03_header_hunt", _GRID)
def j03(spark: SparkSession, d: str) -> DataFrame:
    return tables.table_items(tables.parse_grids(_grid(spark, d, [["Schedule B-Works", "", "", "", ""], ["S.No.", "Description", "Item Qty", "Qty Unit", "Unit Rate"]]))).select(_GRID_COLS)


@query("e05_continued_tables", f"{_NUMBERED} select doc_id, cast(sno as varchar) as s_no, description, item_qty, unit_rate, 'Schedule B-Works' as schedule from m")
def e05(spark: SparkSession, d: str) -> DataFrame:
    """Pages without a header row of their own inherit it, and the schedule (E06); then pages are merged."""
    raw = _grid(spark, d, [["Schedule B-Works", "", "", "", ""], ["S.No.", "Description", "Item Qty", "Qty Unit", "Unit Rate"]], pages=2)
    return tables.table_items(tables.merge_pages(tables.parse_grids(raw))).select(*_GRID_COLS, "schedule")


@query("c20_repeated_tables", _GRID)
def c20(spark: SparkSession, d: str) -> DataFrame:
    """Two engines find the same table; one copy stays."""
    one = _grid(spark, d, [["S.No.", "Description", "Item Qty", "Qty Unit", "Unit Rate"]])
    found = tables.select_tables(tables.parse_grids(one.unionByName(one.withColumn("engine", F.lit("b")))))
    return tables.table_items(found.drop("rank")).select(_GRID_COLS)


@query("b11_weak_pages", "select cast(l_orderkey as varchar) as doc_id, false as weak from lineitem group by 1")
def b11(spark: SparkSession, d: str) -> DataFrame:
    return tables.weak_pages(tables.parse_grids(_grid(spark, d, [["S.No.", "Description", "Item Qty", "Qty Unit", "Unit Rate"]]))).select("doc_id", "weak")


# ---- E, F, M: chat ----
@query("e12_remember", "select cast(conv_id as varchar) as chat_id, role, text, 'chat' as kind from conversations union all select cast(conv_id as varchar), 'assistant', substr(text, 1, 120) || ' -> name', 'correction' from conversations where turn = 1")
def e12(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("at", F.col("turn")).withColumn("description", F.col("text")).withColumn("product_name", F.lit("name"))
    return memory.remember(F.col("conv_id").cast("string"), c, c.where("turn = 1")).select("chat_id", "role", "text", "kind")


@query("b27_upload_spans", "select conv_id, turn, count(*) filter (turn % 3 = 0) over (partition by conv_id order by turn) as span from conversations")
def b27(spark: SparkSession, d: str) -> DataFrame:
    return memory.upload_spans(table(spark, d, "conversations").select("conv_id", "turn"), F.col("turn") % 3 == 0).select("conv_id", "turn", F.col("span").cast("bigint").alias("span"))



@query("i07_grid_pairs", """
select cast(o_orderkey as varchar) as doc_id, unnest(['tender_no', 'tender_type', 'name_of_work']) as field, unnest(['T-' || o_orderkey, 'Open ' || o_custkey, 'Supply of the longer list ' || o_orderkey]) as value from orders""")
def i07(spark: SparkSession, d: str) -> DataFrame:
    """Key/value grids: two pairs on a row, a value in two cells, and the longer of two names of work."""
    row = lambda *cells: F.array(*[F.lit(c) if isinstance(c, str) else c for c in cells])
    k = F.col("o_orderkey").cast("string")
    rows = F.array(row("Name of Work", "Supply"), row("Tender Type", "Open", F.col("o_custkey").cast("string"), ""), row("Name of Work", F.concat(F.lit("Supply of the longer list "), k)))
    grids = table(spark, d, "orders").select(k.alias("doc_id"), F.lit(1).alias("page_number"), F.lit(0).alias("table_no"), row("Tender No", F.concat(F.lit("T-"), k)).alias("headers"), rows.alias("rows"))
    return fields.grid_pairs(grids)


_scalar("i11_railway", "orders", "o_orderkey", lambda: fields.railway(F.concat(F.lit("x\nRailway Name: W"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 1, " railway website").otherwise(" line"), F.lit("\ny")), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("E"), F.col("o_custkey").cast("string"), F.lit(" RLY")))), "case o_orderkey % 3 when 0 then 'E' || o_custkey || ' RLY' when 2 then 'W' || o_custkey || ' line' end")
_scalar("i19_section", "orders", "o_orderkey", lambda: fields.slice_section(F.concat(F.lit("a\n2. Scope of Supply\nitems of "), F.col("o_custkey").cast("string"), F.lit(" as listed\nand "), F.col("o_orderkey").cast("string"), F.lit("\nPayment Terms\nnet")), ["aims", r"scope\s+of\s+supply"]), "chr(10) || 'items of ' || o_custkey || ' as listed' || chr(10) || 'and ' || o_orderkey || chr(10)")


@query("k06_pointers", """
select cast(o_orderkey as varchar) as doc_id, 'NS' || (o_orderkey % 90 + 1) as item_code, 'Annexure work ' || o_custkey as description, cast(cast(o_totalprice as decimal(18,2)) as varchar) as amount, 'AT Par' as escalation, cast(null as varchar) as item_qty, 'Schedule A-x' as schedule from orders""")
def k06(spark: SparkSession, d: str) -> DataFrame:
    """Rows that only point to an annexure and give its amount."""
    docs = _orders_text(spark, d, "Schedule () A-x\nPlease see Item Breakup for details ", price(), " at par ", price(), "\nNS", (F.col("o_orderkey") % 90 + 1).cast("string"), "\nDescription:- Annexure work ", F.col("o_custkey").cast("string"), "\nSchedule Total\n")
    return items.parse_items(docs).select("doc_id", "item_code", "description", "amount", "escalation", "item_qty", "schedule")


@query("d01_full_text", "select page_id % 20 as doc_id, string_agg(url, chr(10) || chr(10) order by page_id) as text from pages group by 1")
def d01(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select((F.col("page_id") % 20).alias("doc_id"), F.col("page_id").alias("page_number"), F.col("url").alias("text"))
    return page_source.full_text(p, marked=False).select("doc_id", "text")


@query("g02_placeholder", "select cast(null as bigint) as o_orderkey, cast(null as varchar) as o_orderstatus, 'none' as part union all select o_orderkey, o_orderstatus, 'some' from orders")
def g02(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return export.or_placeholder(o.where("o_orderkey < 0")).withColumn("part", F.lit("none")).union(export.or_placeholder(o).withColumn("part", F.lit("some")))
