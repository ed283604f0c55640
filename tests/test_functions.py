"""Scalar functions and predicates on small cases of our own."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import arrow
from docloom.functions import describe as A
from docloom.functions import predicates as P
from docloom.functions import text as T
from docloom.operators import fields, names


def column(spark, f, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, c string")
    return [r.v for r in df.select("k", f(F.col("c")).alias("v")).orderBy("k").collect()]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (T.clean_text, ["word-\nwrap  two\n\n\n\nx", "Page 3 of 9\nbody", None], ["wordwrap two\n\nx", "body", ""]),
        (T.collapse, [" a \n b ", "", None], ["a b", None, None]),
        (lambda c: T.truncate(c, 8), ["short", "much too long"], ["short", "much..."]),
        (T.schedule_title, ["schedule () B-Cables 1,200.00", "Schedule Schedule 2-X", None], ["Schedule B-Cables", "Schedule 2-X", None]),
        (T.norm_num, ["1,200.50", "3.00", "007", "n/a", None], ["1200.5", "3", "7", "n/a", ""]),
        (T.item_code, ["0051", "ns4", "000", ""], ["51", "NS4", "0", None]),
        (T.clean_numeric, ["12. 50", "1 200", "ten"], ["12.50", "1200", "ten"]),
        (T.portal_datetime, ["25/08/2026 15:00", "2026-08-25", "31/02/2026", "25/08/2026 99:00", "nil", "45/01/2026"], ["2026-08-25T15:00:00", "2026-08-25", "2026-02-31", "2026-08-25", None, None]),
        (T.yes_no, ["Yes", "not applicable", "maybe", ""], ["Yes", "No", "maybe", None]),
        (T.guard_formula, ["=1+1", "x"], ["'=1+1", "x"]),
        (T.schedule_letter, ["Schedule () C-Works", "D - NS", "Works"], ["c", "d", ""]),
        (T.breakup_parent, ["Item 033 Breakup", "Schedule A"], ["33", None]),
        (lambda c: T.consecutive(c), ["60 61 62", "60 62"], [True, False]),
        (P.list_serial, ["5", "051", "0", "1000", "x", None], [True, True, False, False, False, False]),
        (P.number, ["1,200.50", "-3", "2 000"], [True, False, True]),
        (P.portal, ["Bid Number: x gem bid y", "IREPS nit header", "GeM", "plain"], ["gem", "ireps", "gem", "generic"]),
        (P.clause_or_junk, ["abc", "meaning of similar works here", "LED display"], [True, True, False]),
        (P.work_description, ["Excavation of cable trench in soil", "Supply of cable"], [True, False]),
        (fields.tender_token, ["BCT-26/01 Closing Date", "Open", "ab"], ["BCT-26/01", None, None]),
        (fields.currency, ["Rs. 5", "USD 5", "5 €", "5"], ["INR", "USD", "EUR", None]),
        (names.spec_numbers, ["as per IRS : S-63/2014 and RDSO / SPN / 144/2006, again IRS:S-63/2014", "specification only"], ["IRS:S-63/2014; RDSO/SPN/144/2006", None]),
        (names.warranty, ["Warranty period: 24 months", "24 months"], ["24 months", None]),
        (names.inspection_agency, ["(Inspection: RDSO)", "none"], ["RDSO", None]),
        (names.make_brand, ["relay M/s Acme make", "lamp (BRIGHT MAKE)", "make: Zed or similar", "to make good"], ["Acme", "BRIGHT", "Zed", None]),
    ],
)
def test_columns(spark, f, given, want):
    assert column(spark, f, given) == want


def test_line_classes(spark):
    got = column(spark, P.line_class, ["", "Schedule A-x", "Schedule Total", "Description:- y", "12", "1 2.00 Nos 3.00 4.00 AT Par 5.00", "free words", "Above/"])
    assert got == ["blank", "schedule", "total", "description", "serial", "priced", "text", "bid"]


def test_descriptions(spark):
    none = F.lit(None).cast("string")
    assert column(spark, A.repair_spaced, ["S u p p l y of H D P E pipe", "fix ing of box", "1 2 . 5 m", None]) == ["Supply of HDPE pipe", "fixing of box", "12.5 m", None]
    four = lambda c: A.drop_stray_number(c, F.lit("4"), none)
    given = ["tinned 4 copper conductor", "cable 4 core armoured", "Item 4: plug board", "as per IS 4 grade", "th 04 ermal pad", "part no. 4 x", "5 4 a"]
    assert column(spark, four, given) == ["tinned copper conductor", "cable 4 core armoured", "plug board", "as per IS 4 grade", "thermal pad", "part no. 4 x", "5a"]
    assert column(spark, A.drop_chrome, ["body text Page 3 of 9 more", "a 60 61 62 b", "a 60 62 b"]) == ["body text", "a b", "a 60 62 b"]
    assert column(spark, lambda c: A.clean_item(c, none, none), ["Specifi cation as per as per drawing SK.9/1 1", " ", "relayPanel 2. 5 x"]) == ["Specification as per drawing SK.9/11", None, "relay Panel 2.5 x"]
    assert column(spark, A.normal_description, ['Description:- "[[PAGE:2]] cable o f copper', "drum 12 3.00 Nos 4.00 5.00 AT Par", None]) == ["cable of copper", "drum", None]


def test_nfkc(spark):
    from docloom.plans.deploy import ship

    ship(spark)
    assert column(spark, arrow.nfkc, ["ﬁ–x", "plain", None]) == ["fi-x", "plain", ""]


def test_names(spark):
    name = lambda c: A.product_name(A.normal_description(c))
    given = ["Supply, installation and testing of LED display board as per RDSO spec", "Supply of GSM module (2 nos)", "meaning of similar works", None, "Laying of cable drum with all accessories and more"]
    assert column(spark, name, given) == ["LED display board", "GSM module", None, None, "cable drum"]
    long = "relay panel " + "with many words " * 20
    assert column(spark, A.finish_name, [long, "lamp post (old", "box. Inspection by us"]) == ["relay panel with many words", "lamp post", "box. Inspection by us"]
    assert column(spark, lambda c: A.checked_name(F.lit("supply of signal lamp unit"), c), ["supply of signal lamp unit", "meaning of similar works", "lamp"]) == ["signal lamp unit", None, "lamp"]


def test_learning(spark):
    c = spark.createDataFrame([("Casting and supply of pillar box", "pillar box", 1), ("Casting and supply of pillar box", "old name", 0), ("x", " ", 2)], "description string, name string, learned_at int")
    learned = names.learn(c)
    (r,) = learned.collect()
    assert (r.key, r.name, r.prefix, r.verbs) == ("casting and supply of pillar box", "pillar box", "Casting and supply of", ["casting"])
    given = names.prefix_rest(spark.createDataFrame([("Casting and  supply of lamp post",)], "description string"), names.learned_prefixes(learned))
    assert [x.n for x in given.select(A.product_name(A.normal_description(F.col("description")), None, tuple(r.verbs), F.col("rest")).alias("n")).collect()] == ["lamp post"]
    assert names.reject(learned, spark.createDataFrame([("casting and supply of Pillar box",)], "description string")).collect() == []


def test_grounded(spark):
    df = spark.createDataFrame([("LED board", "supply of led board", True), ("cable drum", "relay", False), (None, "x", False)], "n string, d string, want boolean")
    assert all(r.got == r.want for r in df.select("want", P.grounded(F.col("n"), F.col("d")).alias("got")).collect())


def test_header_cleaners(spark):
    assert column(spark, fields.tender_token, [" : NR-77/02 Closing Date x", "of", "Closing Date 5", '"GEM/2024/B/7".', None]) == ["NR-77/02", None, None, "GEM/2024/B/7", None]
    assert column(spark, fields.clean_period, ["18Months in all", "within 9 weeks", "30", "as agreed", None]) == ["18 Months", "9 weeks", "30", "as agreed", None]
    assert column(spark, fields.clean_division, ["NORTH / ER", "Tender Type Open", "see www.a.b"]) == ["NORTH", None, None]
    assert column(spark, fields.closing, ["Bid End Date 4 May 2024\nClosing date / time : 01/02/2024 10:15", "Bid end date: 4 May 2024", None]) == ["01/02/2024 10:15", "4 May 2024", None]
    assert column(spark, fields.tender_no, ["against Tender No 88-Y-2 for x", "GEM Bid Number: GEM/2023/B/9", "Tender No. of bidders"]) == ["88-Y-2", "GEM/2023/B/9", None]
    assert column(spark, fields.name_of_work, ["Name of the work - fan\nand lamp\nBidding Type x", "Name of Work: nil", "no"]) == ["fan and lamp", None, None]


def test_specification_numbers(spark):
    given = ["by RDSO/Spn/211 version 2 now", "RDSO/SPN305/2018 Rev. 1.0", "IRS: TC 31-2011 (Rev.1)", "IRS : S -9/94 or", "IS: 732/1989 and IS 302 (Part 2) 2008", "No. STS / E / TAN / 4005 dated", "latest RDSO specs"]
    want = ["RDSO/SPN/211 Ver. 2", "RDSO/SPN/305/2018 Rev. 1.0", "IRS:TC-31-2011 (Rev.1)", "IRS:S-9/94", "IS:732/1989; IS 302 (Part 2) 2008", "STS/E/TAN/4005", None]
    assert column(spark, names.spec_numbers, given) == want
