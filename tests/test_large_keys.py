"""Keys as long as those of large tables."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import header, items

ROW = " 44.00 Nos 43683.06 0.00 AT Par 0.00"


@pytest.mark.parametrize("code", ["99999", "1010000", "2147483648"])
def test_long_codes(spark, code):
    """numeric codes of seven digits and more, on one line and wrapped after the code."""
    text = f"Schedule () A-x\n1 {code}{ROW}\nDescription:- one\n2\n{code}{ROW}\n\nDescription:- two\nSchedule Total\n"
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    rows = items.sweep_regions(docs).select("s_no", "item_code", "description", "item_qty").collect()
    assert sorted(map(tuple, rows)) == [("1", code, "one", "44.00"), ("2", code, "two", "44.00")]
    inline = items.parse_items(docs).where(F.col("s_no") == "1").select("item_code", "description").collect()
    assert [tuple(r) for r in inline] == [(code, "one")]


@pytest.mark.parametrize("text, want", [("Contact Person: Officer 14644\nPhone no: 07000100004", "07000100004"), ("Contact no: 0700010000", "0700010000"), ("Contact Person: Officer", None)])
def test_phone_behind_numbers(spark, text, want):
    """a number in the contact's line is no phone if a telephone label has one."""
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    assert header.section(docs, "contact").first()["phone"] == want
