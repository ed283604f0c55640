"""Lines of a document with running state.

All windows are partitioned by document and ordered by line, so one exchange by doc_id serves the whole pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.predicates import stripped_class
from ..functions.text import schedule_title, strip


#: What parts the windows over lines: whole documents here, their blocks in ``blocks``.
BY = ("doc_id",)


def in_doc(by: tuple[str, ...] = BY) -> WindowSpec:
    return Window.partitionBy(*by).orderBy("line_no")


def so_far() -> WindowSpec:
    return in_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before() -> WindowSpec:
    return in_doc().rowsBetween(Window.unboundedPreceding, -1)


def explode_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), offset of the line, raw line, stripped line."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    return rows.withColumn("offset", F.coalesce(F.sum(F.length("raw") + 1).over(before()), F.lit(0)).cast("bigint")).withColumn("line", strip(F.col("raw")))


def running(event: Column, state: Column) -> Column:
    """The state of the last event at or before the line."""
    return F.last(F.when(event, state), True).over(so_far())


def events(line: Column | None = None, c: Column | None = None) -> dict[str, Column]:
    """The registers of a line pass: what a line of class c sets each to, null if it leaves it as it is."""
    line, c = F.col("line") if line is None else line, F.col("class") if c is None else c
    # a page mark is chrome; without one the cast of '' is null
    page = F.regexp_extract(line, r"^\[\[PAGE:(\d+)\]\]", 1)
    return {
        "page": F.when(c == "chrome", page.try_cast("int")), "schedule": F.when(c == "schedule", schedule_title(line)),
        "skip": F.when(c.isin("schedule", "total", "breakup"), c.isin("total", "breakup")), "in_breakup": F.when(c.isin("schedule", "breakup"), c == "breakup"),
    }


def switched(lines: DataFrame) -> DataFrame:
    """The switches are off where no line has set them."""
    return lines.withColumn("skip", F.coalesce("skip", F.lit(False))).withColumn("in_breakup", F.coalesce("in_breakup", F.lit(False)))


def annotate(lines: DataFrame) -> DataFrame:
    """Class, page and schedule above each line, and whether a total or breakup switched lines off."""
    out = lines.withColumn("class", stripped_class(F.col("line")))
    for name, event in events().items():
        out = out.withColumn(name, F.last(event, True).over(so_far()))
    return switched(out)


def as_of(points: DataFrame, marks: DataFrame, *, by: str = "doc_id", at: str = "pos", mark: str = "mark", value: str = "value") -> DataFrame:
    """C05 across tables: points with the value of the last mark at or before them.

    Marks and points are merged in one ordered window; nothing is multiplied.
    """
    both = points.withColumn("_m", F.lit(None).cast(marks.schema[value].dataType)).withColumn("_p", F.lit(1)).withColumn("_at", F.col(at)).unionByName(
        marks.select(by, F.col(mark).alias("_at"), F.col(value).alias("_m")).withColumn("_p", F.lit(0)), allowMissingColumns=True
    )
    w = Window.partitionBy(by).orderBy("_at", "_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last("_m", True).over(w)).where("_p = 1").drop("_m", "_p", "_at")


def outside(points: DataFrame, spans: DataFrame, *, by: str = "doc_id", at: str = "pos") -> DataFrame:
    """Points in none of the half-open spans (a, b): running count of open spans instead of a range join."""
    edges = spans.select(by, F.col("a").alias("_at"), F.lit(1).alias("_d")).union(spans.select(by, F.col("b"), F.lit(-1)))
    both = points.withColumn("_d", F.lit(0)).withColumn("_p", F.lit(1)).withColumn("_at", F.col(at)).unionByName(edges.withColumn("_p", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy("_at", "_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_open", F.sum("_d").over(w)).where("_p = 1 and _open = 0").drop("_d", "_p", "_at", "_open")


def nearest_above(value: Column, stop: Column, n: int, by: tuple[str, ...] = BY) -> Column:
    """The nearest non-null value in the n lines above, unless a stop line is nearer."""
    w = in_doc(by).rowsBetween(-n, -1)
    v = F.last(F.when(value.isNotNull() | stop, F.struct(stop.alias("stop"), value.alias("value"))), True).over(w)
    return F.when(~v["stop"], v["value"])


def next_class(c: Column, skip: str = "blank") -> Column:
    """The class of the next line that is not skipped."""
    return F.first(F.when(c != skip, c), True).over(in_doc().rowsBetween(1, Window.unboundedFollowing))
