"""Operators on small frames of our own wording."""

import random

from pyspark.sql import functions as F

from docloom.operators import fields, header, items, lines, memory, merge, tables
from docloom.operators.rules import match_rules
from docloom.schemas import ITEM_FIELDS, ITEM_SCHEMA
from docloom.sources import pages, sinks

TEXT = """Schedule () A-Main supply 100.00
1 2.00 Numbers 10.00 10.00 AT Par 20.00 Above/
Below/Par
Description:- Supply of four core cable
with drum
2
3.00 Metre 5.00 5.00 AT Par 15.00
Description:- Relay panel
Schedule Total 35.00
9 9.00 Numbers 9.00 9.00 AT Par 81.00
Description:- Ghost row
"""


def item(seq, **k):
    row = dict.fromkeys(ITEM_FIELDS) | k
    return ("d", k.get("pass_no", 2), seq, *[row[f] for f in ITEM_FIELDS], [1], seq)


def test_schedule_text(spark):
    got = items.parse_items(spark.createDataFrame([("d", TEXT)], "doc_id string, text string")).orderBy("seq").collect()
    assert [(r.s_no, r.item_qty, r.description) for r in got] == [("1", "2.00", "Supply of four core cable with drum"), ("2", "3.00", "Relay panel")]
    assert {r.schedule for r in got} == {"Schedule A-Main supply"}


def test_prefer_and_second_key(spark):
    rows = [item(1, s_no="1", item_code="1", description="cable", item_qty="2.00", schedule="Schedule A-x"), item(2, s_no="1", item_code="1", description="cable on drum", unit_rate="5.00", schedule="Schedule A-x"), item(3, s_no="1", item_code="9", description="other", schedule="Schedule A-x"), item(4, description="loose")]
    df = spark.createDataFrame(rows, ITEM_SCHEMA)
    got = {(r.item_code, r.description, r.item_qty, r.unit_rate) for r in merge.merge_second(df).collect()}
    assert got == {("1", "cable on drum", "2.00", "5.00"), ("9", "other", None, None), (None, "loose", None, None)}
    # any order of the input rows gives the same
    assert got == {(r.item_code, r.description, r.item_qty, r.unit_rate) for r in merge.merge_second(df.orderBy(F.desc("seq")).repartition(3)).collect()}


def test_parents(spark):
    rows = [item(1, s_no="33", description="Please see, 01 no. location", schedule="Schedule A-x"), item(2, s_no="1", amount="100.00", schedule="Item 33 Breakup"), item(3, s_no="2", amount="1,50.50", schedule="Item 33 Breakup")]
    got = {r.s_no: r for r in merge.complete_parents(spark.createDataFrame(rows, ITEM_SCHEMA)).collect() if r.schedule.startswith("Sch")}["33"]
    assert (got.item_qty, got.unit_rate, got.amount, got.escalation) == ("1.00", "250.50", "250.50", "AT Par")


def test_repair_and_promote(spark):
    rows = [item(1, s_no="4", item_code="4", schedule="Schedule B-x"), item(2, s_no="4", item_code="NS7", schedule="Schedule B-x")]
    assert {r.s_no for r in merge.repair_serials(spark.createDataFrame(rows, ITEM_SCHEMA)).collect()} == {"4", "7"}
    rows = [item(1, s_no="1", item_code="A", schedule="Schedule A-x"), item(2, s_no="2", item_code="2", schedule="Schedule A-x")]
    assert {r.item_code for r in merge.promote_letters(spark.createDataFrame(rows, ITEM_SCHEMA)).collect()} == {"A"}


def test_backfill(spark):
    rows = [item(1, item_code="NS4", item_qty="2.00"), item(2, s_no="5", item_qty="1.00", unit_rate="3.00"), item(3, description="has one")]
    index = spark.createDataFrame([("d", 1, "ns4", "", "2", "", "", "first"), ("d", 2, "ns4", "", "2", "", "", "second"), ("d", 3, "", "5", "1", "3", "", "by serial")], "doc_id string, entry_no int, code string, sno string, qty string, rate string, amount string, desc string")
    got = {r.seq: r.description for r in merge.backfill(spark.createDataFrame(rows, ITEM_SCHEMA), index).collect()}
    assert got == {1: "first", 2: "by serial", 3: "has one"}


def test_header_map_and_grid(spark):
    df = spark.createDataFrame([(["S.No.", "Item", "Unit Rate", "Unit", "Qty Unit", "Qty"],)], "h array<string>")
    assert df.select(tables.map_headers(F.col("h")).alias("m")).first().m == {"s_no": 0, "unit_rate": 2, "qty_unit": 4, "item_qty": 5}
    cells = [["Schedule A-Main", "", "", ""], ["S.No.", "Description", "Item Qty", "Unit Rate"], ["1", "Relay", "2.00", "5.00"], ["", "with base", "", ""], ["2", "Cable", "3.00", "7.00", "on drum"]]
    raw = spark.createDataFrame([("d", 1, "a", 0, cells)], "doc_id string, page_number int, engine string, table_no int, cells array<array<string>>")
    grid = tables.parse_grids(raw)
    assert grid.first().is_product_table
    got = tables.table_items(grid).orderBy("seq").collect()
    assert [(r.s_no, r.description, r.item_qty, r.schedule) for r in got] == [("1", "Relay with base", "2.00", "Schedule A-Main"), ("2", "Cable", "3.00", "Schedule A-Main")]


def test_header_fields(spark):
    text = "CENTRAL DIVISION-S AND T/WESTERN RLY\nTENDER DOCUMENT\nTender No: BCT-26-01  Closing Date/Time: 25/08/2026 15:00\nName of Work: Provision of cable and relays at several stations\nBidding type: Normal Tender\nAdvertised Value: 15,00,000.00\nPeriod of Completion: 12 Months\n"
    r = header.header_fields(spark.createDataFrame([("d", text)], "doc_id string, text string")).first()
    assert (r.tender_no, r.closing_date_time, r.zone, r.railway, r.division_name) == ("BCT-26-01", "25/08/2026 15:00", "WESTERN RLY", "WESTERN RLY", "CENTRAL DIVISION-S AND T")
    assert (r.name_of_work, r.advertised_value, r.period_of_completion, r.reference_no) == ("Provision of cable and relays at several stations", "15,00,000.00", "12 Months", "BCT-26-01")


def test_as_of_and_ranges(spark):
    p = spark.createDataFrame([("d", 1), ("d", 5), ("d", 9)], "doc_id string, pos int")
    m = spark.createDataFrame([("d", 2, "x"), ("d", 9, "y")], "doc_id string, mark int, value string")
    assert [r.value for r in lines.as_of(p, m).orderBy("pos").collect()] == [None, "x", "y"]
    s = spark.createDataFrame([("d", 4, 9)], "doc_id string, a int, b int")
    assert [r.pos for r in lines.outside(p, s).orderBy("pos").collect()] == [1, 9]


def test_chunks_and_model_rows(spark):
    d = spark.createDataFrame([("d", "One sentence here. Another sentence there. End")], "doc_id string, text string")
    got = [r.text for r in memory.chunk_text(d, size=30, most=8).orderBy("chunk").collect()]
    assert "".join(got).replace(" ", "") == "Onesentencehere.Anothersentencethere.End" and len(got) > 1
    j = spark.createDataFrame([("d", '{"itemDescription": "Relay panel", "qty": "2", "s_no": "x", "rate": "null"}'), ("d", '{"description": "no"}')], "doc_id string, json string")
    r = memory.model_rows(j).collect()
    assert [(x.description, x.item_qty, x.s_no, x.unit_rate) for x in r] == [("Relay panel", "2", None, None)]


def test_chunks_hold_the_whole_text(spark):
    rng = random.Random(3)
    long = " ".join("".join(rng.choices("abcé😀", k=rng.randint(1, 9))) + rng.choice(["", "", ".", " Schedule"]) for _ in range(6000))
    texts = {1: long, 2: "x" * 25_000, 3: "", 4: None, 5: "short one"}
    rows = memory.chunk_text(spark.createDataFrame(list(texts.items()), "doc_id int, text string"), size=500).collect()
    for k, t in texts.items():
        got = [r.text for r in sorted((r for r in rows if r.doc_id == k), key=lambda r: r.chunk)]
        assert "".join(got).replace(" ", "") == (t or "").replace(" ", "") and all(len(x) <= 500 for x in got)
    assert sum(r.doc_id == 2 for r in rows) == 50


def test_h23_chunks_cover_documents(spark, tmp_path):
    from docloom.plans.queries import QUERIES

    spark.createDataFrame([(1, "word. " * 9000)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["h23_chunks"](spark, str(tmp_path)).orderBy("chunk").collect()
    assert "".join(r.text for r in got).replace(" ", "") == "word." * 9000


def test_search_and_rules_take_all_rows(spark):
    q = spark.range(2500).selectExpr("id as q_id", "array(1.0D, cast(id as double)) as q_vec")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id int, embedding array<double>")
    got = {r.q_id: r.vec_id for r in memory.top_k(q, v, k=1).collect()}
    assert got == {k: 1 if k <= 1 else 2 for k in range(2500)}
    d = spark.createDataFrame([(1, "see mark10400 here")], "doc_id int, text string")
    rules = spark.range(10_500).selectExpr("'f' as field", "cast(id as int) as priority", r"concat('mark', id, '\\b') as pattern")
    assert [r.pattern for r in match_rules(d, rules).collect()] == [r"mark10400\b"]


def test_pages_and_sinks(spark, tmp_path):
    a = spark.createDataFrame([("d", 1, "x" * 50, 50), ("d", 2, "y", 1)], "doc_id string, page_number int, text string, char_count int")
    b = spark.createDataFrame([("d", 2, "y" * 60, 60), ("e", 1, "alone", 5)], "doc_id string, page_number int, text string, char_count int")
    assert {(r.doc_id, r.page_number, r.char_count) for r in pages.best_pages(a, b).collect()} == {("d", 1, 50), ("d", 2, 60), ("e", 1, 5)}
    assert pages.full_text(a, marked=True).first().text.startswith("[[PAGE:1]]\nx")
    sinks.write_csv(spark.createDataFrame([('a "q"', None)], "x string, y string").coalesce(1), f"{tmp_path}/c")
    body = next((tmp_path / "c").glob("part-*")).read_bytes()
    assert body == b'x,y\r\n"a ""q""",\r\n'
    assert sinks.write_xlsx([["a", "1"]], ["h", "i"])[:2] == b"PK"


def test_stream(spark, tmp_path):
    from docloom.streaming import ingest

    spark.createDataFrame([("d", TEXT)], "doc_id string, text string").write.parquet(f"{tmp_path}/in")
    q = ingest.process_stream(ingest.read_documents(spark, f"{tmp_path}/in"), lambda df: lines.explode_lines(df).select("doc_id", "line_no"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == TEXT.count("\n") + 1
