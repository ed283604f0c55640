"""Registered queries of the document flow over the star-schema tables, each with the DuckDB text it must equal.

Names start with the identifier of the operator in the blueprint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..operators import fields, header, items, lines, memory, merge, names, tables
from ..operators.export import flat_rows
from ..schemas import ITEM_FIELDS
from .stages import spread
from ..sources import pages as page_source
from ..sources import sinks
from . import render

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- K: schedule layouts, parsed back ----
_NUMBERED = """
with n as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as sno from lineitem),
m as (select cast(l_orderkey as varchar) as doc_id, sno, l_partkey, cast(cast(l_quantity as decimal(18,2)) as varchar) as item_qty, cast(cast(l_extendedprice as decimal(18,2)) as varchar) as unit_rate,
  cast(cast(l_discount as decimal(18,2)) as varchar) as basic_value, cast(cast(l_tax as decimal(18,2)) as varchar) as amount, 'Supply of part ' || l_partkey || ' from supplier ' || l_suppkey as description from n)
"""
_COLS = ["doc_id", "s_no", "item_code", "description", "item_qty", "unit_rate", "basic_value", "amount", "schedule"]


def _layout(kind: str, code: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = render.documents(render.numbered(table(spark, d, "lineitem")), render.layout(kind))
        return items.parse_items(docs).select(_COLS)

    ids = {"plain": "k01_boq_roundtrip", "amounts": "k02_amounts_roundtrip", "inline": "k03_inline_roundtrip", "prefixed": "k04_prefixed_roundtrip", "letter": "k05_letter_roundtrip"}
    sql = f"{_NUMBERED} select doc_id, cast(sno as varchar) as s_no, {code} as item_code, description, item_qty, unit_rate, basic_value, amount, 'Schedule A-Supply Portion' as schedule from m"
    query(ids[kind], sql)(run)


for _kind, _code in {"plain": "cast(sno as varchar)", "amounts": "cast(sno as varchar)", "inline": "cast(l_partkey + 10000 as varchar)", "prefixed": "'NS' || sno", "letter": "'A'"}.items():
    _layout(_kind, _code)


@query("k10_breakup_roundtrip", f"{_NUMBERED} select doc_id, cast(sno as varchar) as s_no, cast(sno as varchar) as item_code, description, item_qty, unit_rate, amount, 'Item 3 Breakup' as schedule, '3' as parent_s_no from m")
def k10(spark: SparkSession, d: str) -> DataFrame:
    docs = render.documents(render.numbered(table(spark, d, "lineitem")), render.layout("breakup"), title=F.lit("Item Breakup\nItem- 3 Earthing"), tail="Total")
    return items.parse_breakups(docs).select("doc_id", "s_no", "item_code", "description", "item_qty", "unit_rate", "amount", "schedule", "parent_s_no")


@query(
    "k12_category_list",
    """with p as (select o_orderkey, list(distinct 'Part ' || p_name order by 'Part ' || p_name) as names from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey group by 1),
    e as (select cast(o_orderkey as varchar) as doc_id, unnest(list_filter(names, lambda x: length(x) >= 8)) as description, unnest(range(1, len(list_filter(names, lambda x: length(x) >= 8)) + 1)) as k from p)
    select doc_id, cast(k as varchar) as s_no, description from e where k <= 2""",
)
def k12(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    g = g.groupBy("o_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("Part "), F.col("p_name")))).alias("names"))
    docs = g.select(F.col("o_orderkey").cast("string").alias("doc_id"), F.concat(F.lit("Item Category: "), F.array_join("names", ", "), F.lit("\nTotal Quantity: 2\n")).alias("text"))
    return items.parse_categories(docs).select("doc_id", "s_no", "description")


# ---- E, C: lines, as-of, ranges, windows ----
@query("e01_line_offsets", "with l as (select doc_id, unnest(range(0, len(string_split(text, chr(10))))) as line_no, unnest(string_split(text, chr(10))) as raw from documents) select doc_id, cast(line_no as bigint) as line_no, cast(coalesce(sum(length(raw) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as bigint) as line_offset, length(raw) as n from l")
def e01(spark: SparkSession, d: str) -> DataFrame:
    return lines.explode_lines(table(spark, d, "documents")).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("offset").alias("line_offset"), F.length("raw").cast("bigint").alias("n"))


@query("c05_as_of_page", "with o as (select o_custkey, o_orderkey, o_orderdate from orders), e as (select o_custkey, o_orderkey, o_orderdate, max(o_orderdate) filter (o_orderkey % 3 = 0) over (partition by o_custkey order by o_orderdate range between unbounded preceding and current row) as mark from o) select o_orderkey, cast(mark as varchar) as mark from e")
def c05(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    marks = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey"), F.col("o_orderdate").alias("mark"), F.col("o_orderdate").alias("value"))
    found = lines.as_of(o, marks, by="o_custkey", at="o_orderdate")
    return found.select("o_orderkey", F.date_format("value", "yyyy-MM-dd HH:mm:ss").alias("mark"))


@query("c07_outside_spans", "select event_id, user_id from events e where not exists (select 1 from events s where s.user_id = e.user_id and s.event_id % 10 = 0 and e.event_id >= s.event_id and e.event_id < s.event_id + 50)")
def c07(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id")
    spans = e.where("event_id % 10 = 0").select("user_id", F.col("event_id").alias("a"), (F.col("event_id") + 50).alias("b"))
    return lines.outside(e, spans, by="user_id", at="event_id").select("event_id", "user_id")


@query(
    "e04_serial_fill",
    f"""{_NUMBERED}, r as (select doc_id, sno, case when sno % 3 = 0 then null else sno * 2 end as given from m),
    miss as (select doc_id, sno, row_number() over (partition by doc_id order by sno) as k from r where given is null),
    free as (select doc_id, n, row_number() over (partition by doc_id order by n) as k from (select distinct doc_id, unnest(range(1, 4000)) as n from r) c where not exists (select 1 from r where r.doc_id = c.doc_id and r.given = c.n))
    select doc_id, sno, cast(given as varchar) as s_no from r where given is not null union all select miss.doc_id, miss.sno, cast(free.n as varchar) from miss join free using (doc_id, k)""",
)
def e04(spark: SparkSession, d: str) -> DataFrame:
    li = render.numbered(table(spark, d, "lineitem"))
    rows = li.select("doc_id", F.col("sno").cast("bigint").alias("sno"), F.when(F.col("sno") % 3 != 0, (F.col("sno") * 2).cast("string")).alias("s_no"))
    return merge.fill_serials(rows, F.lit("A"), [F.col("sno")])


@query("e10_history_budget", "with r as (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations), c as (select conv_id, turn, role, case when length(trim(text, chr(10) || ' ')) > 200 then regexp_replace(substr(trim(text, chr(10) || ' '), 1, 199), '\\s+$', '') || '…' else trim(text, chr(10) || ' ') end as content from r where r <= 4), s as (select *, sum(length(content)) over (partition by conv_id order by turn) as total, row_number() over (partition by conv_id order by turn) as k from c where content <> ''), o as (select *, max(case when total > 600 and k > 1 then 1 else 0 end) over (partition by conv_id order by turn) as over_ from s) select conv_id, turn, role, content from o where over_ = 0")
def e10(spark: SparkSession, d: str) -> DataFrame:
    return memory.history_tail(table(spark, d, "conversations"))


@query("e11_batches", f"{_NUMBERED} select doc_id, sno, cast((sno - 1) // 3 as integer) as batch, (sno - 1) % 3 as in_batch from m")
def e11(spark: SparkSession, d: str) -> DataFrame:
    rows = render.numbered(table(spark, d, "lineitem")).select("doc_id", F.col("sno").cast("bigint").alias("sno"))
    return memory.batches(rows, [F.col("sno")], size=3).select("doc_id", "sno", "batch", F.col("in_batch").cast("bigint").alias("in_batch"))


@query("e13_previous_user", "select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as user_turn from conversations")
def e13(spark: SparkSession, d: str) -> DataFrame:
    return memory.previous_user(table(spark, d, "conversations")).select("conv_id", "turn", "user_turn")


# ---- D: keys, folds, completion ----
def _items(spark: SparkSession, d: str) -> DataFrame:
    """Items straight from lineitem: duplicates by (order, line number) are natural."""
    li = render.numbered(table(spark, d, "lineitem"))
    none = F.lit(None).cast("string")
    cols = {f: none for f in ITEM_FIELDS} | {"s_no": F.col("l_linenumber").cast("string"), "description": F.when(F.col("l_discount") > 0.02, F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))), "item_qty": render.money(F.col("l_quantity")), "unit_rate": F.when(F.col("l_tax") > 0.01, render.money(F.col("l_extendedprice"))), "qty_unit": F.lit("Nos"), "schedule": F.lit("Schedule A-Supply")}
    return li.select("doc_id", F.lit(1).alias("pass_no"), F.col("sno").cast("bigint").alias("seq"), *[v.alias(f) for f, v in cols.items()], F.array().cast("array<int>").alias("page_numbers"), F.lit(None).cast("bigint").alias("source_pos"))


_MONEY = "rtrim(rtrim(cast(cast({} as decimal(18,2)) as varchar), '0'), '.')"


@query(
    "d03_content_key",
    f"""with t as (select cast(l_orderkey as varchar) as doc_id, cast(l_linenumber as varchar) as sno, {_MONEY.format("l_quantity")} as qty, case when l_tax > 0.01 then {_MONEY.format("l_extendedprice")} else '' end as rate, case when l_discount > 0.02 then 'part ' || l_partkey else '' end as descr from lineitem)
    select doc_id, case when qty <> '' and rate <> '' and descr <> '' then 'qrd:' || qty || ':' || rate || ':' || descr else 'fallback:' || sno || ':' || qty || ':' || rate || '::' || descr end as content_key, count(*) as n from t group by 1, 2""",
)
def d03(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("doc_id", merge.content_key(merge.fields()).alias("content_key")).groupBy("doc_id", "content_key").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d04_prefer_fold",
    f"""with n as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as seq from lineitem),
    t as (select cast(l_orderkey as varchar) as doc_id, l_linenumber, seq, cast(cast(l_quantity as decimal(18,2)) as varchar) as qty, case when l_tax > 0.01 then cast(cast(l_extendedprice as decimal(18,2)) as varchar) end as rate, case when l_discount > 0.02 then 'Part ' || l_partkey end as descr from n)
    select doc_id, cast(l_linenumber as varchar) as s_no, min(seq) as seq, min_by(qty, seq) as item_qty, min_by(rate, seq) filter (rate is not null) as unit_rate, max_by(descr, length(descr) * 100000 - seq) filter (descr is not null) as description from t group by 1, 2""",
)
def d04(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one schedule serial are one item: first quantity, first known rate, longest description."""
    rows = _items(spark, d).withColumn("k", merge.second_key(merge.fields()))
    return merge.fold(rows, "doc_id", "k").select("doc_id", "s_no", "seq", "item_qty", "unit_rate", "description")


@query("d06_serial_score", "select p_partkey, cast(case when p_size <= 0 then -20 else (case when p_size = p_partkey % 50 then 50 else 0 end) + (case when p_size between 1 and 200 then 10 else -5 end) + greatest(0, 30 - p_size) end as integer) as score from part")
def d06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", merge.serial_score(F.col("p_size").cast("string"), (F.col("p_partkey") % 50).cast("string")).alias("score"))


@query(
    "d08_parent_completion",
    """with c as (select cast(l_orderkey as varchar) as doc_id, sum(cast(l_extendedprice as decimal(18,2))) as amount from lineitem group by 1)
    select doc_id, '3' as s_no, '1.00' as item_qty, cast(amount as varchar) as unit_rate, cast(amount as varchar) as amount, cast(amount as varchar) as basic_value, 'AT Par' as escalation from c where amount > 0""",
)
def d08(spark: SparkSession, d: str) -> DataFrame:
    li = render.numbered(table(spark, d, "lineitem"))
    none = F.lit(None).cast("string")
    base = [F.lit(1).alias("pass_no"), F.col("sno").cast("bigint").alias("seq")]
    kid = {f: none for f in ITEM_FIELDS} | {"s_no": F.col("sno").cast("string"), "amount": render.money(F.col("l_extendedprice")), "schedule": F.lit("Item 3 Breakup")}
    top = {f: none for f in ITEM_FIELDS} | {"s_no": F.lit("3"), "description": F.lit("Please see breakup, 01 no. location"), "schedule": F.lit("Schedule A-Supply")}
    kids = li.select(F.col("l_orderkey").cast("string").alias("doc_id"), *base, *[v.alias(f) for f, v in kid.items()])
    parents = li.where("sno = 1").select(F.col("l_orderkey").cast("string").alias("doc_id"), *base, *[v.alias(f) for f, v in top.items()])
    return merge.complete_parents(kids.unionByName(parents)).where("schedule like 'Schedule%'").select("doc_id", "s_no", "item_qty", "unit_rate", "amount", "basic_value", "escalation")


_D09_WHOLE = """with t as (select conv_id, turn, row_number() over (partition by conv_id, lower(coalesce(role, 'None') || '|' || regexp_replace(substr(coalesce(text, ''), 1, 120), '\\s+', ' ', 'g')) order by turn) as r from conversations)
    select cast(conv_id as varchar) as doc_id, turn as seq, cast(row_number() over (partition by conv_id order by turn) as varchar) as position from t where r = 1"""


@query("d09_dedupe_model_rows", _D09_WHOLE)
def d09(spark: SparkSession, d: str) -> DataFrame:
    """The whole text; the operator's own key takes 120 characters."""
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("seq"), F.lit(None).cast("string").alias("s_no"), F.col("role").alias("item_code"), F.col("text").alias("description"))
    return memory.dedupe_model_rows(c).select("doc_id", "seq", F.col("s_no").alias("position"))



@query("d10_longest_value", "select cast(o_custkey as varchar) as doc_id, o_orderstatus as key, max_by(o_orderpriority, length(o_orderpriority) * 10000000 - o_orderkey) as value from orders group by 1, 2")
def d10(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderstatus").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("chunk"))
    return fields.longest_values(rows)


@query("d17_summary", "select cast(c_custkey as varchar) as doc_id, unnest(['name', 'segment']) as field, unnest([c_name, c_mktsegment]) as value from customer")
def d17(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return sinks.summary_rows(c, ["name", "segment"])


# ---- A, B, C: pages, classes, lookups ----
def _pages(spark: SparkSession, d: str, strip_tags: bool) -> DataFrame:
    p = table(spark, d, "pages")
    text = F.regexp_replace("html", "<[^>]*>", "") if strip_tags else F.col("html")
    return p.select((F.col("page_id") % 20).cast("string").alias("doc_id"), F.col("page_id").cast("int").alias("page_number"), text.alias("text")).withColumn("char_count", page_source.density(F.col("text")))


_PAGES = "with a as (select cast(page_id % 20 as varchar) as doc_id, cast(page_id as integer) as page_number, length(replace(replace(html, ' ', ''), chr(10), '')) as x, length(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), ' ', ''), chr(10), '')) as y from pages)"


@query("c01_best_pages", f"{_PAGES} select doc_id, page_number, cast(greatest(x, y) as integer) as char_count, y > x as second from a")
def c01(spark: SparkSession, d: str) -> DataFrame:
    first = _pages(spark, d, False).withColumn("second", F.lit(False))
    other = _pages(spark, d, True).withColumn("second", F.lit(True))
    return page_source.best_pages(first, other).select("doc_id", "page_number", "char_count", "second")



@query("b01_page_classes", f"{_PAGES}, r as (select doc_id, count(*) as page_count, avg(case when y < 1500 then 1.0 else 0.0 end) as ratio from a group by 1) select doc_id, page_count, case when ratio >= 0.55 then 'scanned' when ratio > 0 then 'mixed' else 'text' end as pdf_type from r")
def b01(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d, True).withColumn("is_image_heavy", F.col("char_count") < 1500)
    return page_source.classify(p).select("doc_id", "page_count", "pdf_type")


@query("b02_portal", "with h as (select *, len(regexp_extract_all(text, '(?i)\\b(?:gem)\\b')) as n from documents) select doc_id, case when n >= 1 then 'gem' else 'generic' end as portal from h where source <> 'none'")
def b02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", P.portal(F.col("text")).alias("portal"))


@query("b06_list_serial", "select l_orderkey, count(*) filter (l_partkey between 1 and 999) as n from lineitem group by 1")
def b06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(P.list_serial(F.col("l_partkey").cast("string"))).alias("n"))


@query("b20_router", "select conv_id, turn, case when conv_id % 2 = 0 and not regexp_matches(lower(text), '^(hi|hello|thanks)[ !.]*$') then 'fix' else 'chat' end as route from conversations")
def b20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", P.route(F.col("text"), F.col("conv_id") % 2 == 0).alias("route"))


@query("b21_grounded", "select p_partkey, p_brand, contains(lower(p_name), lower(split_part(p_name, ' ', 1))) as one from part")
def b21(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_brand", P.grounded(F.split("p_name", " ")[0], F.col("p_name")).alias("one"))


@query("c15_learned_names", "select p_partkey, case when p_partkey % 7 = 3 then upper(p_name) end as learned_name from part where p_name not in (select p_name from part where p_partkey % 50 = 1)")
def c15(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("description"))
    rejected = p.where("p_partkey % 50 = 1").select("description")
    exact = p.where("p_partkey % 7 = 3").select("description", F.upper("description").alias("name"), F.col("p_partkey").alias("learned_at"))
    found = names.learned_names(p, exact, rejected)
    return found.select("p_partkey", F.when(F.col("p_partkey") % 7 == 3, F.col("learned_name")).alias("learned_name"))


@query("c17_apply_changes", f"{_NUMBERED} select doc_id, sno, case when sno % 2 = 0 then 'part ' || l_partkey end as product_name from m where sno % 5 <> 0")
def c17(spark: SparkSession, d: str) -> DataFrame:
    li = render.numbered(table(spark, d, "lineitem")).select("doc_id", F.col("sno").cast("bigint").alias("sno"), render.description().alias("description"), F.lit(None).cast("string").alias("product_name"), F.col("l_partkey"))
    changes = li.where("sno % 2 = 0 or sno % 5 = 0").select("doc_id", (F.col("sno") - 1).cast("int").alias("index"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("product_name"), (F.col("sno") % 5 == 0).alias("remove"), F.lit(0).alias("seq_no"))
    return memory.apply_changes(li, changes, [F.col("sno")]).select("doc_id", "sno", "product_name")


@query(
    "c18_memory_top_k",
    """with q as (select vec_id as q_id, embedding as q from embeddings where vec_id % 50 = 0), s as (select q_id, vec_id, round(list_cosine_similarity(cast(q as double[]), cast(embedding as double[])), 6) as score from q, embeddings),
    r as (select *, row_number() over (partition by q_id order by score desc, vec_id) as rank from s) select q_id, vec_id, cast(rank as integer) as rank from r where rank <= 4""",
)
def c18(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return memory.top_k(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec")), v).select("q_id", "vec_id", F.col("rank").cast("int").alias("rank"))



@query("a21_memory_upsert", "with t as (select *, substr(sha1(conv_id || ':' || role || ':' || substr(trim(text, chr(10) || ' '), 1, 200)), 1, 24) as id, row_number() over (partition by conv_id, role, substr(trim(text, chr(10) || ' '), 1, 200) order by turn desc) as r from conversations) select id, cast(conv_id as varchar) as chat_id, role, turn as at from t where r = 1 and length(text) >= 2")
def a21(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("chat_id"), "role", "text", F.lit("chat").alias("kind"), F.col("turn").alias("at"))
    empty = spark.createDataFrame([], "id string, chat_id string, role string, kind string, text string, at bigint")
    return memory.upsert(empty, turns).select("id", "chat_id", "role", "at")


# ---- H: scalar functions ----
def _scalar(name: str, tab: str, key: str, build: Callable[[], Column], sql: str) -> None:
    # tables of texts are cut by their bytes; of narrow ones a row group holds up to a million rows
    rows = (lambda t: t) if tab in ("documents", "conversations", "pages") else (lambda t: spread(t, key))
    query(name, f"select {key}, {sql} as v from {tab}")(lambda spark, d: rows(table(spark, d, tab)).select(key, build().alias("v")))


_scalar("h03_collapse", "documents", "doc_id", lambda: T.collapse(F.col("text")), "nullif(trim(regexp_replace(replace(text, chr(10), ' '), '[ \\t]+', ' ', 'g')), '')")
_scalar("h04_truncate", "documents", "doc_id", lambda: T.truncate(F.col("text"), 100), "case when length(trim(text, chr(10) || ' ')) > 100 then regexp_replace(substr(trim(text, chr(10) || ' '), 1, 97), '\\s+$', '') || '...' else trim(text, chr(10) || ' ') end")
_scalar("h10_lines", "documents", "doc_id", lambda: F.size(T.lines_of(F.col("text"))).cast("bigint"), "len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))")
_scalar("h12_norm_num", "lineitem", "l_orderkey", lambda: T.norm_num(F.concat(F.lit(" "), F.format_number("l_extendedprice", 2))), _MONEY.format("l_extendedprice"))
_scalar("h13_norm_desc", "part", "p_partkey", lambda: T.norm_desc(F.concat(F.lit("Description:-  "), F.col("p_name"), F.lit(" "), F.col("p_type"))), "trim(substr(lower(p_name) || ' ' || lower(p_type), 1, 50))")
_scalar("h14_item_code", "part", "p_partkey", lambda: T.item_code(F.when(F.col("p_partkey") % 2 == 0, F.lpad(F.col("p_partkey").cast("string"), 8, "0")).otherwise(F.concat(F.lit("ns"), F.col("p_partkey").cast("string")))), "case when p_partkey % 2 = 0 then case when p_partkey = 0 then '0' else cast(p_partkey as varchar) end else 'NS' || p_partkey end")
_scalar("h15_clean_numeric", "orders", "o_orderkey", lambda: T.clean_numeric(F.concat(F.col("o_custkey").cast("string"), F.lit(". 50"))), "o_custkey || '.50'")
_scalar("h18_guard", "customer", "c_custkey", lambda: T.guard_formula(F.concat(F.when(F.col("c_custkey") % 3 == 0, "=").otherwise(""), F.col("c_name"))), "case when c_custkey % 3 = 0 then '''=' || c_name else c_name end")
_scalar("h19_yes_no", "orders", "o_orderkey", lambda: T.yes_no(F.element_at(F.array(F.lit(" Yes "), F.lit("nil"), F.lit("not applicable here"), F.lit("as stated")), (F.col("o_orderkey") % 4 + 1).cast("int"))), "['Yes', 'No', 'No', 'as stated'][o_orderkey % 4 + 1]")
_scalar("h20_portal_datetime", "orders", "o_orderkey", lambda: T.portal_datetime(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy HH:mm")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))), "case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:00') else strftime(o_orderdate, '%Y-%m-%d') end")
_scalar("h21_schedule_letter", "nation", "n_nationkey", lambda: T.schedule_letter(F.concat(F.lit("Schedule () "), F.substring("n_name", 1, 1), F.lit("-"), F.col("n_name"))), "lower(substr(n_name, 1, 1))")
_scalar("h22_tokens", "documents", "doc_id", lambda: T.tokens(F.col("text")), "cast(greatest(length(text) // 4, 1) as integer)")
_scalar("h24_json", "events", "event_id", lambda: F.get_json_object(F.to_json(T.loose_json(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")), "map<string,string>")), "$.k"), "json_extract_string(props, '$.k')")
_scalar("h29_code_number", "part", "p_partkey", lambda: T.code_number(F.concat(F.lit("NS0"), (F.col("p_partkey") % 1000).cast("string"))), "cast(p_partkey % 1000 as varchar)")
_scalar("d13_checklist", "documents", "doc_id", lambda: F.array_join(fields.checklist(F.concat(F.col("text"), F.lit(" Balance Sheet, power of attorney"))), "|"), "'Balance Sheet|' || case when regexp_matches(text, '(?i)\\biso[0-9]*([^a-z0-9]|$)|\\biso') then 'ISO Certificate|' else '' end || 'Power of Attorney'")
_scalar("i18_email", "documents", "doc_id", lambda: T.nullif_empty(F.regexp_extract("text", fields.EMAIL, 0)), "nullif(regexp_extract(text, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}', 0), '')")


# ---- I: header fields, rendered and read back ----
@query("i05_header_fields", "select cast(o_orderkey as varchar) as doc_id, 'NIT-' || o_orderkey || '/A' as tender_no, strftime(o_orderdate, '%d/%m/%Y %H:%M') as closing_date_time, 'Supply of goods for customer ' || o_custkey as name_of_work, cast(cast(o_totalprice as decimal(18,2)) as varchar) as advertised_value, 'NIT-' || o_orderkey || '/A' as reference_no from orders")
def i05(spark: SparkSession, d: str) -> DataFrame:
    o = spread(table(spark, d, "orders"), "o_orderkey")  # far more work than bytes
    line = lambda label, v: F.concat(F.lit(f"{label}: "), v, F.lit("\n"))
    text = F.concat(line("Tender No", F.concat(F.lit("NIT-"), F.col("o_orderkey").cast("string"), F.lit("/A"))), line("Closing Date/Time", F.date_format("o_orderdate", "dd/MM/yyyy HH:mm")), line("Name of Work", F.concat(F.lit("Supply of goods for customer "), F.col("o_custkey").cast("string"))), line("Advertised Value", F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
    return header.header_fields(o.select(F.col("o_orderkey").cast("string").alias("doc_id"), text.alias("text"))).select("doc_id", "tender_no", "closing_date_time", "name_of_work", "advertised_value", "reference_no")


# ---- J: grids ----
@query("j05_header_map", "select p_partkey, 's_no:0,item_qty:2,unit_rate:4,qty_unit:3,description:1' as mapped from part")
def j05(spark: SparkSession, d: str) -> DataFrame:
    heads = F.array(F.lit("S.No."), F.concat(F.lit("Description of "), F.col("p_brand")), F.lit("Item Qty"), F.lit("Qty Unit"), F.lit("Unit Rate"))
    m = table(spark, d, "part").select("p_partkey", tables.map_headers(heads).alias("m"))
    order = F.array(*[F.lit(f) for f in ("s_no", "item_qty", "unit_rate", "qty_unit", "description")])
    shown = T.bind(F.col("m"), lambda m: F.array_join(F.transform(order, lambda f: F.concat(f, F.lit(":"), F.try_element_at(m, f).cast("string"))), ","))
    return m.select("p_partkey", shown.alias("mapped"))


@query("j04_align", "select p_partkey, case when p_partkey % 2 = 0 then p_name || '|' || p_brand || '|' else p_name || ' x y|' || p_brand || '|' || p_type end as cells from part")
def j04(spark: SparkSession, d: str) -> DataFrame:
    row = F.when(F.col("p_partkey") % 2 == 0, F.array("p_name", "p_brand")).otherwise(F.array("p_name", "p_brand", "p_type", F.lit("x"), F.lit("y")))
    fit = tables.fit_rows(F.array(row), F.lit(3), F.create_map(F.lit("description"), F.lit(0)))
    return table(spark, d, "part").select("p_partkey", F.array_join(fit[0], "|").alias("cells"))


@query("j07_grid_items", f"{_NUMBERED} select doc_id, cast(sno as varchar) as s_no, description, item_qty, unit_rate from m")
def j07(spark: SparkSession, d: str) -> DataFrame:
    li = render.numbered(table(spark, d, "lineitem"))
    row = F.array(F.col("sno").cast("string"), render.description(), render.money(F.col("l_quantity")), F.lit("Nos"), render.money(F.col("l_extendedprice")))
    g = li.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sno", row.alias("r")))).alias("rows"))
    head = F.array(*[F.lit(h) for h in ("S.No.", "Description", "Item Qty", "Qty Unit", "Unit Rate")])
    raw = g.select("doc_id", F.lit(1).alias("page_number"), F.lit("a").alias("engine"), F.lit(0).alias("table_no"), F.concat(F.array(head), F.transform("rows", lambda x: x["r"])).alias("cells"))
    return tables.table_items(tables.parse_grids(raw)).select("doc_id", "s_no", "description", "item_qty", "unit_rate")


# ---- G, export ----
@query("g03_flat_rows", f"{_NUMBERED} select cast(o_orderkey as varchar) as doc_id, 'T-' || o_orderkey as \"tenderNo\", strftime(o_orderdate, '%Y-%m-%d') as \"closingAt\", cast(m.sno as varchar) as \"itemSerialNo\", m.description as \"itemDescription\", m.item_qty as \"itemQty\" from orders left join m on m.doc_id = cast(o_orderkey as varchar) and o_orderkey % 10 <> 0")
def g03(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    header = o.select(F.col("o_orderkey").cast("string").alias("doc_id"), F.concat(F.lit("T-"), F.col("o_orderkey").cast("string")).alias("tender_no"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("closing_date_time"))
    li = render.numbered(table(spark, d, "lineitem"), "l_orderkey").where("l_orderkey % 10 <> 0").join(o.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    none = F.lit(None).cast("string")
    cols = {f: none for f in ITEM_FIELDS} | {"s_no": F.col("sno").cast("string"), "description": render.description(), "item_qty": render.money(F.col("l_quantity"))}
    rows = li.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(1).alias("pass_no"), F.col("sno").cast("bigint").alias("seq"), *[v.alias(f) for f, v in cols.items()])
    return flat_rows(header, rows).select("doc_id", "tenderNo", "closingAt", "itemSerialNo", "itemDescription", "itemQty")


# ---- rows-only: no SQL form ----
@query("h23_chunks")
def h23(spark: SparkSession, d: str) -> DataFrame:
    return memory.chunk_text(table(spark, d, "documents").select("doc_id", "text"), size=2000)


@query("i21_clauses")
def i21(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("[[PAGE:1]]\nPayment Terms:\n"), F.col("text"), F.lit("\n[[PAGE:2]]\nWarranty\nTwo years from the date of supply of the goods.\n")).alias("text"))
    return fields.clauses(docs)


@query("w01_event_windows", "select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def w01(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.ingest import windowed_counts

    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(e).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
