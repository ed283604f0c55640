"""Schedule texts rendered from the star-schema tables, so that parsers can be checked against plain SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(lineitem: DataFrame, by: str = "doc_id") -> DataFrame:
    """lineitem with doc_id and a serial per order; the order of the serials uses every column, as line numbers repeat.
    ``by``, doc_id or l_orderkey, is the key that rows are dealt by; plans that go on with it need no other exchange."""
    cols = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    keyed = lineitem.withColumn("doc_id", F.col("l_orderkey").cast("string"))
    return keyed.withColumn("sno", F.row_number().over(Window.partitionBy(by).orderBy(*cols)))


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)").cast("string")


def documents(rows: DataFrame, line: Column, title: Column | None = None, tail: str = "Schedule Total") -> DataFrame:
    """doc_id, text: a title, one piece per row in order of the serial, and a total."""
    title = F.lit("Schedule () A-Supply Portion") if title is None else title
    g = rows.select("doc_id", "sno", line.alias("line"), title.alias("title")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sno", "line"))).alias("lines"), F.max("title").alias("title"))
    return g.select("doc_id", F.concat(F.col("title"), F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n" + tail + "\n")).alias("text"))


def description() -> Column:
    return F.concat(F.lit("Supply of part "), F.col("l_partkey").cast("string"), F.lit(" from supplier "), F.col("l_suppkey").cast("string"))


def amounts(lead: Column) -> Column:
    """One amounts line: lead, quantity, unit, rate, basic value, escalation, amount."""
    return F.concat_ws(" ", lead, money(F.col("l_quantity")), F.lit("Numbers"), money(F.col("l_extendedprice")), money(F.col("l_discount")), F.lit("AT Par"), money(F.col("l_tax")), F.lit("Rs."))


def layout(kind: str) -> Column:
    """The text of one item in a layout."""
    d, sno = description(), F.col("sno").cast("string")
    label = F.concat(F.lit("\nDescription:- "), d)
    if kind == "plain":
        return F.concat(amounts(sno), label)
    if kind == "amounts":
        return F.concat(sno, F.lit("\n"), amounts(F.lit(None).cast("string")), label)
    if kind == "inline":
        return F.concat(amounts(F.concat_ws(" ", sno, (F.col("l_partkey") + 10_000).cast("string"))), label)
    if kind == "prefixed":
        return F.concat(amounts(F.concat(F.lit("NS"), sno)), label)
    if kind == "letter":
        return F.concat(amounts(F.lit("A")), F.lit("\n"), sno, label)
    if kind == "breakup":
        return F.concat_ws(" ", sno, sno, d, F.concat(F.lit("Numbers")), money(F.col("l_quantity")), money(F.col("l_extendedprice")), money(F.col("l_tax")))
    raise ValueError(kind)
