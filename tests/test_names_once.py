"""Descriptions and names are worked on only where they may change."""

from pyspark.sql import functions as F

from docloom.functions import describe as D
from docloom.operators import merge
from docloom.schemas import ITEM_FIELDS


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_own_name_is_finished_once(spark):
    """a description's own name was worked out twice, and tidied five times even if it stayed."""
    cases = [("Supply of signal lamp no 5", None, "5"), ("supply and fixing of 7 lamp", "laying of lamp", "7"), ("Supply of relay 05 panel as per RDSO", "Testing of Supply of relay panel", "5"), ("item 12 - cable (2", "cable; ", "12"), ("s u p p l y of 12. 5 mm pipe", None, None)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, d string, n string, s string")
    rows = df.select("k", D.normal_description(F.col("d"), F.col("s")).alias("d"), "n").select("k", "d", D.product_name(F.col("d")).alias("own"), D.checked_name(F.col("d"), F.col("n")).alias("v"))
    assert _plan(df.select(D.product_name(F.col("d")))).count("(?:commissioning\\s+)?(?:of\\s+)?") == 4
    got = [tuple(r[1:]) for r in rows.orderBy("k").collect()]
    assert got == [
        ("Supply of signal lamp no 5", "signal lamp no 5", "signal lamp no 5"), ("supply and fixing of lamp", "lamp", "lamp"), ("Supply of relay panel as per RDSO", "relay panel", "relay panel"),
        ("cable (2", "cable", "cable"), ("supply of 12.5 mm pipe", None, "12.5 mm pipe"),
    ]


def test_titles_without_ns_are_left(spark):
    """each row's title was worked out three times to see whether it is an NS title."""
    cells = [("NS1", None), ("x", "(NS) Schedule () NS Schedule of works 5,000.00"), ("NS2", "Schedule A-x"), (None, None)]
    items = spark.createDataFrame([("d", 1, k, *[{"item_code": c, "schedule": t}.get(f) for f in ITEM_FIELDS]) for k, (c, t) in enumerate(cells)], "doc_id string, pass_no int, seq bigint, " + ", ".join(f"{f} string" for f in ITEM_FIELDS))
    rows = merge.retag(items)
    assert _plan(rows).count("(?i)\\b(schedule)\\b") == 1
    want = "(NS) Schedule NS Schedule of works"
    assert [r[0] for r in rows.orderBy("seq").select("schedule").collect()] == [want, cells[1][1], want, None]
