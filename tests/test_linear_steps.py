"""Expressions that use a value twice evaluate it once, and narrow tables are worked on by all cores."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from docloom.functions import text as T


def _steps(spark, build):
    return spark.range(1).select(build(F.col("id").cast("string")).alias("v"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")


def test_nested_cells_stay_linear(spark):
    assert _steps(spark, lambda c: T.cell(T.cell(T.cell(c)))) == 3 * _steps(spark, T.cell)


def test_empty_cells_are_null(spark):
    rows = spark.createDataFrame([(1, ""), (2, None), (3, " \r\n\t "), (4, " a \r\n b\t\tc ")], "k int, v string")
    got = {r[0]: tuple(r[1:]) for r in rows.select("k", T.nullif_empty(F.col("v")), T.cell(F.col("v"))).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (" \r\n\t ", None), 4: (" a \r\n b\t\tc ", "a b c")}


def test_narrow_tables_are_spread(spark):
    for name in ("h11_normal_description", "i13_name_of_work", "i22_product_name", "i26_spec_numbers"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 24


def test_numbers_are_read_once(spark):
    assert _steps(spark, T.norm_num) == 3
    rows = spark.createDataFrame([("1,200.50",), ("-3.",), (".5",), ("x Y",), ("",), (None,), ("9" * 40,)], "v string")
    assert [r[0] for r in rows.select(T.norm_num(F.col("v"))).collect()] == ["1200.5", "-3", "0.5", "xy", "", "", "9" * 40]


def test_names_are_lowered_once(spark):
    """the description was put in lower case again for each word of the name."""
    from docloom.functions import predicates as P

    df = spark.createDataFrame([("Signal Lamp", "Supply of signal LAMP"), ("signal post", "supply of lamp"), ("", "x"), (None, "x"), ("x", None)], "n string, d string")
    rows = df.select(P.grounded(F.col("n"), F.col("d")).alias("v"))
    assert rows._jdf.queryExecution().analyzed().toString().count("lower(") == 2
    assert [r[0] for r in rows.collect()] == [True, False, False, False, False]


def test_flat_cells_follow_the_exchange(spark):
    """cells are worked out after the rows are dealt by document."""
    from docloom.operators import export
    from docloom.schemas import ITEM_FIELDS

    header = spark.range(3).selectExpr("cast(id as string) as doc_id", "' a ' as name_of_work")
    items = spark.range(3).selectExpr("cast(id as string) as doc_id", "1 as pass_no", "id as seq", *[f"' b ' as {f}" for f in ITEM_FIELDS])
    rows = export.flat_rows(header, items)
    assert rows._jdf.queryExecution().analyzed().toString().count("RepartitionByExpression [doc_id") == 2
    assert rows.select("title", "itemDescription").distinct().collect() == [("a", "b")]


def test_letter_keys_are_linear(spark):
    """the numbers of a letter-code row were normalised many times over."""
    from docloom.operators import merge
    from docloom.schemas import ITEM_FIELDS

    cells = {"item_code": "'A'", "item_qty": "'1.50'", "unit_rate": "'2'", "amount": "'3'", "s_no": "'1'", "description": "'lamp'"}
    items = spark.range(4).selectExpr("'d' as doc_id", "1 as pass_no", "id as seq", *[f"{cells.get(f, 'cast(null as string)')} as {f}" for f in ITEM_FIELDS], "array(1) as page_numbers", "id as source_pos")
    keys = merge.fold_letters(items)
    plan = keys._jdf.queryExecution().analyzed().toString()
    assert max(line.count("regexp_replace") for line in plan.split("\n") if " AS lk#" in line) == 9
    assert keys.select("s_no", "item_code", "item_qty").collect() == [("1", "A", "1.50")]


def test_breakup_rows_are_matched_once(spark):
    """a breakup row met its expression once for each of its fields, and every unit at each of its letters."""
    from docloom.operators import items

    text = "Item Breakup\nItem- 3 Earthing\n1 02 Set of 2 sets, 4 Nos each Numbers 1,2.50 3.00 4.00\nwith lugs\n2 3 no amount Numbers 1.00 2.00\n03 4 A Man-Days 1.00 2.00 3.00\nTotal\n"
    rows = items.parse_breakups(spark.createDataFrame([("d", text)], "doc_id string, text string"))
    assert rows._jdf.queryExecution().analyzed().toString().count("Man-?Days?") == 1
    got = [tuple(r) for r in rows.orderBy("seq").select("s_no", "item_code", "description", "qty_unit", "item_qty", "unit_rate", "amount", "parent_s_no").collect()]
    assert got == [("1", "2", "Set of 2 sets, 4 Nos each with lugs 2 3 no amount Numbers 1.00 2.00", "Numbers", "1,2.50", "3.00", "4.00", "3"), ("3", "4", "A", "Man-Days", "1.00", "2.00", "3.00", "3")]


def test_lines_of_items_are_folded_once(spark):
    """lines carried the row of their item through two windows by item."""
    from docloom.operators import items

    text = "Schedule A-x\nB7\n1 2.00 Nos 3.00 4.00 AT Par 5.00 Rs.\nNS9\nbefore\nDescription:- lamp\n12\nof 3\nTotal\nDescription:- late\n2 10005 1.00 Nos\n2.00 3.00 AT Par 4.00\nlabel none\n"
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    rows = items.parse_items(docs)
    assert not re.search(r"Window .*\], \[doc_id#\d+, item_no#\d+L?\]", rows._jdf.queryExecution().analyzed().toString())
    got = [tuple(r) for r in rows.orderBy("seq").select("s_no", "item_code", "description", "item_qty", "unit_rate", "schedule").collect()]
    assert got == [("1", "NS9", "lamp of 3", "2.00", "3.00", "Schedule A-x")]


def test_clauses_look_for_a_heading_once(spark):
    """F32: a clause's heading was looked for again in every part of its content; texts of orders came in one task."""
    from docloom.operators import fields
    from docloom.plans import item_queries

    text = "[[PAGE:3]]\nPayment Terms:\nWithin thirty days of the bill.\n" + "more words\n" * 12 + "Other Heading Here\nnot this\n3. Warranty\nToo short"
    rows = fields.clauses(spark.createDataFrame([("d", text), ("n", None)], "doc_id string, text string"))
    assert rows._jdf.queryExecution().analyzed().toString().count("regexp_instr(") == sum(map(len, fields.CLAUSES.values()))
    got = [tuple(r) for r in rows.select("clause_type", "content", "page_number").collect()]
    assert got == [("Payment Terms", "Within thirty days of the bill.\n" + "\n".join(["more words"] * 12), 3)]
    assert item_queries._orders_text(spark, "/root/testdata/sf0.001", "x").rdd.getNumPartitions() >= 24
