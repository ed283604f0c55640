"""Documents of any length: line passes over blocks of lines.

The passes of ``items`` part their windows by document, which puts a huge document into one task.  Here a document comes in
pieces (its pages, or any cut at line ends), and its lines are dealt in blocks of a fixed number of lines.  What a block does
to the running state of the line automaton is a function that composes: each register (page, schedule, switches) is set or
left, the number of items grows, and an open item meets a label or an end or neither.  So every step is the same three:

1. each block's function, from one aggregation with the block as key;
2. a prefix scan over the blocks of a document, which gives the state before each block (one row per block);
3. the state of each line, from the one before its block and a window inside the block.

Lines that a pattern looks at above or below are copied into the neighbouring block.  An item's lines are folded block by
block first, to one row each, so that an item as long as the document is no large group either.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import stripped_class
from ..functions.text import collapse, strip
from ..plans.stages import Stages
from .items import ABOVE, BELOW, LAST, MAX_DESC, ROW_AT, assemble, closing, is_text, label_parts, match_rows, own_code, own_serial
from .lines import events, in_doc, switched

#: Lines of a block, and characters of a description's lines that a block keeps of one item: the item's text is cut at
#: ``MAX_DESC`` when label words, at most some dozen characters, are off.
LINES, KEPT = 4096, 3 * MAX_DESC
IN_BLOCK = ("doc_id", "block")


def sums_before(stages: Stages, rows: DataFrame, by: str, order: str, sizes: dict[str, Column]) -> DataFrame:
    """rows with the sum of each size over the rows of the same key before them, in two levels: ranges of rows, then rows."""
    t = rows.select("*", *[v.cast("bigint").alias(f"_{n}") for n, v in sizes.items()]).repartitionByRange(by, order)
    t = stages.write(t.sortWithinPartitions(by, order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = t.groupBy(by, "_part").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sizes])
    parts = parts.select(by, "_part", *[F.coalesce(F.sum(f"_{n}").over(across), F.lit(0)).alias(f"_before_{n}") for n in sizes])
    # rows are in their range already; the few rows of parts are joined to them
    out = t.join(parts, [by, "_part"])
    for n in sizes:
        out = out.withColumn(n, F.col(f"_before_{n}") + F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)))
    return out.drop("_part", *[f"_{n}" for n in sizes], *[f"_before_{n}" for n in sizes])


def block_lines(stages: Stages, pieces: DataFrame, size: int = LINES) -> DataFrame:
    """E01 over pieces (doc_id, piece_no, text) of documents: doc_id, block, line_no, offset, raw, line.  Pieces are joined by
    line ends; null text is an empty line."""
    p = pieces.select("doc_id", "piece_no", F.coalesce("text", F.lit("")).alias("text"))
    p = sums_before(stages, p, "doc_id", "piece_no", {"first": F.regexp_count("text", F.lit("\n")) + 1, "start": F.length("text") + 1})
    rows = p.select("doc_id", "first", "start", F.posexplode(F.split("text", "\n")).alias("k", "raw"), "piece_no")
    inside = Window.partitionBy("doc_id", "piece_no").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    line_no = F.col("first") + F.col("k")
    rows = rows.withColumn("offset", F.col("start") + F.coalesce(F.sum(F.length("raw") + 1).over(inside), F.lit(0)))
    return rows.select("doc_id", F.floor(line_no / size).cast("bigint").alias("block"), line_no.alias("line_no"), "offset", "raw", strip(F.col("raw")).alias("line"))


def registers_before(rows: DataFrame, names: list[str]) -> DataFrame:
    """Steps 1 and 2 for registers: doc_id, block and the last value of each before the block; rows have event columns."""
    ends = rows.groupBy(*IN_BLOCK).agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("line_no"))).alias(f"_{n}") for n in names])
    w = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(*IN_BLOCK, *[F.last(f"_{n}", True).over(w).alias(f"_{n}") for n in names])


def annotate_blocks(stages: Stages, lines: DataFrame) -> DataFrame:
    """Lines with class, page, schedule and switches, as :func:`lines.annotate` gives them."""
    made = lines.withColumn("class", stripped_class(F.col("line")))
    regs = events()
    made = stages.write(made.select("*", *[v.alias(n) for n, v in regs.items()]))
    w = in_doc(IN_BLOCK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = made.join(registers_before(made, list(regs)), list(IN_BLOCK))
    for n in regs:
        out = out.withColumn(n, F.coalesce(F.last(n, True).over(w), F.col(f"_{n}")))
    return switched(out.drop(*[f"_{n}" for n in regs]))


def with_margins(lines: DataFrame, above: int, below: int, size: int) -> DataFrame:
    """Lines, and copies (``margin``) of the last ones of each block in the next and of the first ones in the one before."""
    place = F.col("line_no") % size
    copies = [
        lines.withColumn("margin", F.lit(False)),
        lines.where(place >= size - above).withColumn("block", F.col("block") + 1).withColumn("margin", F.lit(True)),
        lines.where((place < below) & (F.col("block") > 0)).withColumn("block", F.col("block") - 1).withColumn("margin", F.lit(True)),
    ]
    return reduce(DataFrame.unionByName, copies)


def parse_items_blocked(pieces: DataFrame, pass_no: int = 2, *, size: int = LINES) -> DataFrame:
    """K01-K07, E03 over pieces (doc_id, piece_no, text) of documents of any length: the items that :func:`items.parse_items`
    finds in the joined text.  ``size`` is at least the lines that a pattern looks above."""
    if size < ABOVE:
        raise ValueError(f"a block has at least {ABOVE} lines")
    stages = Stages(pieces.sparkSession, "blocks")
    lines = stages.write(annotate_blocks(stages, block_lines(stages, pieces, size)))
    rows = match_rows(with_margins(lines, ABOVE, BELOW, size), IN_BLOCK).where("not margin and class <> 'blank'").drop("margin", "raw", "in_breakup")
    rows = stages.write(rows)
    stages.drop(lines)
    # the number of items so far
    opened = F.col("kind").isNotNull().cast("bigint")
    so_far = in_doc(IN_BLOCK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*IN_BLOCK).agg(F.sum(opened).alias("_n")).select(*IN_BLOCK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    rows = rows.join(counts, list(IN_BLOCK)).withColumn("item_no", F.col("_n") + F.sum(opened).over(so_far)).where("item_no > 0").drop("_n")
    # what the lines of a block do to an item
    part = ("doc_id", "block", "item_no")
    n, label = F.col("line_no"), F.col("class") == "description"
    first = lambda c: F.min(F.when(c, n))
    rows = rows.withColumn("label_no", first(label).over(Window.partitionBy(*part)))
    ends = closing() | (F.col("class") == "bid")
    kept = F.when(is_text(), F.length(F.coalesce(collapse(F.col("line")), F.lit(""))) + 1)
    after = in_doc(part).rowsBetween(Window.unboundedPreceding, -1)
    # characters since the label if the block has it, since its begin before that
    rows = rows.withColumn("half", n > F.coalesce("label_no", F.lit(LAST)))
    rows = rows.withColumn("used", F.coalesce(F.sum(kept).over(in_doc((*part, "half")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own_label, text = F.when(label & (n == F.col("label_no")), F.struct("line_no", *[v.alias(k) for k, v in zip(("code", "text"), label_parts(), strict=True)])), F.when(is_text() & (F.col("used") <= KEPT), F.struct("line_no", F.col("line").alias("t")))
    code = F.when(F.col("kind").isNull() & ~label, own_code())
    g = rows.groupBy(*part).agg(
        F.min(F.when(F.col("kind").isNotNull(), F.struct(*ROW_AT))).alias("at"),
        F.min(own_label).alias("label"), first(ends | label).alias("end_any"), first((ends | label) & (n > F.col("label_no"))).alias("end_after"), first(closing()).alias("end_bare"),
        F.min(F.when(code.isNotNull(), F.struct("line_no", code.alias("v")))).alias("code"), F.min(F.when(own_serial().isNotNull(), F.struct("line_no", own_serial().alias("v")))).alias("serial"),
        F.array_sort(F.collect_list(text)).alias("texts"),
    )
    # the fold over an item's blocks
    whole = Window.partitionBy("doc_id", "item_no")
    label_block = F.min(F.when(F.col("label").isNotNull(), F.col("block"))).over(whole)
    g = g.withColumn("label_block", label_block).withColumn("label_no", F.min("label.line_no").over(whole))
    limit = F.when(F.col("label_block").isNull(), F.col("end_bare")).when(F.col("block") == F.col("label_block"), F.col("end_after")).when(F.col("block") > F.col("label_block"), F.col("end_any"))
    g = g.withColumn("end_no", F.coalesce(F.min(limit).over(whole), F.lit(LAST).cast("bigint")))
    at_label = F.col("block") == F.col("label_block")
    upto = F.least(F.coalesce("label_no", F.lit(LAST)), "end_no")
    codes = F.array_compact(F.array(F.when(F.col("code.line_no") < upto, F.col("code")), F.when(at_label & F.col("label.code").isNotNull(), F.struct(F.col("label.line_no").alias("line_no"), F.col("label.code").alias("v")))))
    texts = F.filter("texts", lambda t: (t["line_no"] > F.col("label_no")) & (t["line_no"] < F.col("end_no")))
    head = F.when(at_label & F.col("label.text").isNotNull(), F.array(F.struct(F.col("label.line_no").alias("line_no"), F.col("label.text").alias("t")))).otherwise(F.array())
    g = g.select("doc_id", "item_no", "at", F.array_min(codes).alias("code"), F.when(F.col("serial.line_no") < F.col("end_no"), F.col("serial")).alias("serial"), F.concat(head, F.coalesce(texts, F.array())).alias("texts"))
    g = g.groupBy("doc_id", "item_no").agg(F.min("at").alias("at"), F.min("code").alias("code"), F.min("serial").alias("serial"), F.array_sort(F.flatten(F.collect_list("texts"))).alias("parts"))
    return assemble(g.select("doc_id", "at.*", F.col("code.v").alias("code"), F.col("serial.v").alias("serial"), F.transform("parts", lambda p: p["t"]).alias("parts")), pass_no)
