"""Labels: one compiled pattern, told apart by first letters."""

import re

from pyspark.sql import functions as F

from docloom.functions.describe import any_of, by_letter
from docloom.functions.text import before
from docloom.operators import fields


def test_by_letter_is_any_of():
    """The same leftmost matches."""
    for rules in [fields.RULES, *fields.SECTIONS.values()]:
        words = {p for _, ps in rules.values() for p in ps}
        a, b = (re.compile(rf"(?i)(?<![A-Za-z0-9])(?:{f(words)})") for f in (any_of, by_letter))
        plain = [re.sub(r"\\s[*+]|\\b", " ", re.sub(r"\(\?[:=!]|[()?^$]", "", w)) for w in sorted(words)]
        for text in [" ".join(plain), " / ".join(reversed(plain)), "Tender No: T-1 Closing Date/Time x EMD 5 e-mail a@b.c", "42 Ünit: none"]:
            assert [m.span() for m in a.finditer(text)] == [m.span() for m in b.finditer(text)]


def test_before_is_first_of_split(spark):
    rows = spark.createDataFrame([(s,) for s in ["a  b\tc", "|x", "no mark", "", "  lead", "a\n| b", None]], "s string")
    pattern = r"(?i)\s{2,}|\t|\|(?=\s)|\s+(?=B\b)"
    assert all(x == y for x, y in rows.select(before(F.col("s"), pattern), F.split("s", pattern, 2)[0]).collect())
