"""Exact dedup by content sort.

Every text is normalised (``[\\x20\\x09-\\x0D]`` deleted) to its UTF-8 bytes.  Spark samples splitters and range-partitions the
rows by a content key, the first ``HEAD`` bytes and the SHA-256 of all of them, and sorts each range externally; so equal
texts are adjacent.  Within a range each text is compared in full with the one before it, and the first of equal ones stays:
among equal texts the order is code points of the original text, most first, then identifier.  These are part of the range
key, so splitters cut a large group of copies too, and no range grows with a group.  At most the first and the last text of
a range can go on in another one; those edges, two per range, are compared in full once more and joined back.

Keys rather than whole texts are sampled, so the driver sees some 100 keys of under 120 bytes per range, however long the
texts are.  Texts are shuffled once; the written table holds them for edges only.

Defined results: null text counts as empty, and all empty or blank texts are equal; null identifiers come after all others;
of rows that agree in text and identifier one is kept; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stages import Stages
from .shared import binary, portions

#: Bytes of content that the range key begins with.
HEAD = 32
#: Bytes of texts that a task holds as Python objects.
PORTION = 16 << 20
SPACES = b" \t\n\v\f\r"


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in portions(batches, 1, PORTION):
        n = pc.fill_null(pc.utf8_length(b.column(1)), 0).cast(pa.int64())
        body = [(t or b"").translate(None, SPACES) for t in binary(b.column(1))]
        digest = [hashlib.sha256(t).digest() for t in body]
        cols = [pa.array([t[:HEAD] for t in body], pa.binary()), pa.array(digest, pa.binary()), pa.array(body, pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column(0), n, *cols], names=["doc_id", "n", "head", "digest", "body"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted batches (doc_id, n, digest, body): one row (part, run, doc_id, n, keep_id, kept, digest) per row, where a run
    is a stretch of equal bodies; and one row with ``size`` per run of several rows and per first or last run of the task.
    The latter two have the body too."""
    part, names = TaskContext.get().partitionId(), ["part", "run", "doc_id", "n", "keep_id", "kept", "digest", "size", "body"]
    run, size, last, first = -1, 0, None, None  # of the open run; first: doc_id, n, digest of its first row

    def summary(edge: bool) -> pa.RecordBatch:
        d, n, g = first
        empty = pa.nulls(1, pa.bool_())
        cols = [pa.array([part], pa.int32()), pa.array([run], pa.int64()), d, n, d, empty, g, pa.array([size], pa.int64()), pa.array([last if edge else None], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=names)

    for b in batches:
        m = b.num_rows
        if not m:
            continue
        body, new = b.column(3), np.ones(m, bool)
        new[1:] = pc.not_equal(body[1:], body[:-1]).to_numpy(zero_copy_only=False)
        new[0] = last is None or body[0].as_py() != last
        starts = np.flatnonzero(new)
        if len(starts) and run >= 0:
            size += int(starts[0])
            if run == 0 or size > 1:
                yield summary(run == 0)
        run_of = run + np.cumsum(new)
        since = np.maximum.accumulate(np.where(new, np.arange(m), -1))
        keep = b.column(0).take(pa.array(np.maximum(since, 0)))
        if not new[0]:
            head = int(starts[0]) if len(starts) else m
            keep = pa.concat_arrays([first[0].take(pa.array(np.zeros(head, np.int64))), keep[head:]])
        cols = [pa.array(np.full(m, part), pa.int32()), pa.array(run_of, pa.int64()), b.column(0), b.column(1), keep, pa.array(new), b.column(2), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=names)
        # runs that begin and end inside this batch
        lengths = np.diff(starts)
        for k in np.flatnonzero((lengths > 1) | (run_of[starts[:-1]] == 0)) if len(starts) > 1 else ():
            o = int(starts[k])
            first, run, size, last = tuple(b.column(c)[o : o + 1] for c in (0, 1, 2)), int(run_of[o]), int(lengths[k]), body[o].as_py()
            yield summary(run == 0)
        if len(starts):
            o = int(starts[-1])
            first, size = tuple(b.column(c)[o : o + 1] for c in (0, 1, 2)), m - o
        else:
            size += m
        run, last = int(run_of[-1]), body[m - 1].as_py()
    if run >= 0:
        yield summary(True)


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (see the module's text)."""
    stages = Stages(docs.sparkSession, "exact")
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    normal = source.mapInArrow(_normal, f"doc_id {kind}, n bigint, head binary, digest binary, body binary")
    order = [F.col("head"), F.col("digest"), F.col("n").desc(), F.col("doc_id").asc_nulls_last()]
    ranges = normal.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n", "digest", "body")
    table = stages.write(ranges.mapInArrow(_compare, f"part int, run bigint, doc_id {kind}, n bigint, keep_id {kind}, kept boolean, digest binary, size bigint, body binary"))
    rows, runs = table.where("size is null"), table.where("size is not null")
    # the same text at the edges of several ranges is one group; ranges are in the order of the key
    along = Window.partitionBy("digest").orderBy("part", "run")
    edges = runs.where("body is not null").withColumn("other", F.coalesce(F.lag("body").over(along) != F.col("body"), F.lit(True)).cast("int"))
    edges = edges.withColumn("piece", F.sum("other").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    group = Window.partitionBy("digest", "piece")
    best = F.first("keep_id").over(group.orderBy("part", "run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    edges = edges.select("part", "run", best.alias("best"), F.sum("size").over(group).alias("total"), (F.col("other") == 1).alias("heads"))
    inner = runs.where("body is null").select("part", "run", F.col("keep_id").alias("best"), F.col("size").alias("total"), F.lit(True).alias("heads"))
    out = rows.join(inner.union(edges), ["part", "run"], "left")
    return out.select(
        "doc_id", F.when(F.col("total").isNull(), F.col("keep_id")).otherwise(F.col("best")).alias("keep_id"), F.coalesce("total", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("kept") & F.coalesce("heads", F.lit(True))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay; identifiers are unique and not null here."""
    stay = exact_duplicates(docs, id_col=id_col, text_col=text_col).where("kept").select(F.col("doc_id").alias(id_col))
    return docs.join(stay, id_col, "left_semi")


#: The same for DuckDB (``documents`` is the table).
SQL = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body from documents)
select doc_id, first(doc_id) over g as keep_id, count(*) over (partition by body) as group_size, row_number() over g = 1 as kept, sha256(body) as text_sha256
from t window g as (partition by body order by n desc, doc_id nulls last)
"""
