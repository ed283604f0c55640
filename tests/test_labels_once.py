"""A line meets the labels' expression once for each form of a label."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from docloom.operators import fields, header


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_labels_meet_a_line_once(spark):
    """the labels' expression was applied seven times to a line, twice of them to tell what it had found."""
    rules = {"no": ("text", [r"enquiry\s*no"]), "day": ("date", [r"due\s*date", r"due"])}
    text = "Enquiry No: A-5\nENQUIRY  no -\nNIT 7\n due date\n5 May 2020\nx due 3 enquiry no  B\nDue - date: 4\nenquiry no:"
    rows = header.candidates(spark.createDataFrame([("d", [text])], "doc_id string, texts array<string>"), rules)
    assert _plan(rows).count("enquiry\\s*no") == 4
    got = sorted(tuple(r) for r in rows.select("line_no", "form", "label", "rest").collect())
    inline = [(1, 2, "enquiry no", " -"), (3, 2, "due", " date"), (5, 2, "due", " 3 enquiry no  B"), (5, 2, "enquiry no", "  B"), (6, 2, "due", " - date: 4")]
    assert got == sorted([(0, 0, "enquiry no", "A-5"), (1, 1, "enquiry no", "NIT 7"), (3, 1, "due date", "5 May 2020"), (6, 0, "due", "date: 4"), *inline])


def test_names_of_works_are_sought_once(spark):
    """the text was searched for the name of work again in each part of the answer."""
    df = spark.createDataFrame([("Name of Work: lamps\nof two\nTender Type: Open",), ("x name of the work - nil",), ("none",), (None,)], "t string")
    rows = df.select(fields.name_of_work(F.col("t")).alias("v"))
    assert _plan(rows).count("regexp_instr(") == 1
    assert [r[0] for r in rows.collect()] == ["lamps of two", None, None, None]


def test_orders_are_spread(spark):
    """texts of orders came in as many tasks as their few bytes filled."""
    from docloom.plans import queries

    seen = []
    real = queries.header.header_fields
    queries.header.header_fields = lambda docs: seen.append(docs.rdd.getNumPartitions()) or real(docs.limit(1))
    try:
        entry.queries()["i05_header_fields"](spark, "/root/testdata/sf0.001")
    finally:
        queries.header.header_fields = real
    assert seen[0] >= 24
