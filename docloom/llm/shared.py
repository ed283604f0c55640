"""Run grouping, hub clusters and connected components used by several operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stages import Stages


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt and sorted by keys over a fixed number of partitions, for :func:`runs`."""
    return df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys in sorted record batches; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(n, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), n]
        if held and tuple(c[0] for c in cols) != last:
            yield pa.Table.from_batches(held)
            held = []
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            held.append(b.slice(i, j - i))
            if j < n:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


#: Rows of a narrow side that may be broadcast, and bytes of one whose rows hold arrays.
MAX_BROADCAST, MAX_BYTES = 250_000, 1 << 20


def small(df: DataFrame, size: Column | None = None) -> DataFrame:
    """df, to be broadcast if it has few rows and, where ``size`` (bytes of a row) is given, few bytes; else joined by
    shuffle."""
    if size is None:
        return F.broadcast(df) if df.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df
    n, total = df.agg(F.count(F.lit(1)), F.sum(size)).first()
    return F.broadcast(df) if n <= MAX_BROADCAST and (total or 0) <= MAX_BYTES else df.hint("merge")


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Record batches of fewer rows, so that Python objects of one are few."""
    for b in batches:
        for o in range(0, b.num_rows, rows):
            yield b.slice(o, rows)


def portions(batches: Iterator[pa.RecordBatch], column: int, size: int, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of at most so many rows and bytes of a text column (one row at least), so that a task's memory is
    bounded by ``size`` or by its longest text."""
    for b in batches:
        length = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        total, o = np.cumsum(length, dtype=np.int64), 0
        while o < b.num_rows:
            done = total[o - 1] if o else 0
            stop = min(max(int(np.searchsorted(total, done + size, side="right")), o + 1), o + rows)
            yield b.slice(o, stop - o)
            o = stop


def binary(col: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return col.cast(pa.binary()).to_pylist()


def labels(adjacent: np.ndarray) -> np.ndarray:
    """For each vertex of a symmetric boolean matrix, the smallest vertex of its component."""
    n = len(adjacent)
    out = np.full(n, -1)
    for i in range(n):
        if out[i] < 0:
            seen = np.zeros(n, bool)
            seen[i] = True
            front = seen
            while front.any():
                front = adjacent[front].any(0) & ~seen
                seen |= front
            out[seen] = i
    return out


def components(stages: Stages, edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v: bigint) by alternating large and small stars.

    Returns node, component (smallest node reachable) of every node that is not the smallest itself.  Each round is
    written; the driver only sees a count and a checksum.
    """
    e = stages.write(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    before = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = tuple(state)
        both = e.select(F.col("a").alias("x"), F.col("b").alias("y")).union(e.select("b", "a"))
        low = both.groupBy("x").agg(F.min(F.least("x", "y")).alias("m"))
        large = both.join(low, "x").where("y > x and y <> m").select(F.col("y").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stages.write(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        stages.drop(e)
        e = after


#: Rows and payload weight of a block of a cluster.
BLOCK_ROWS, BLOCK_WEIGHT = 192, 131_072


def hubs(stages: Stages, banded: DataFrame) -> DataFrame:
    """Distinct (hub, node) over the buckets of banded (bucket, node: bigint) with several nodes.

    A bucket's hub is its node that meets the most others over all buckets, so the clusters of a group of near copies
    share few hubs.  Any two nodes of a bucket are in its hub's cluster; a hub is in its own.
    """
    counts = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = stages.write(banded.join(counts, "bucket"))
    score = shared.groupBy("node").agg(F.sum("c").alias("score"))
    best = shared.join(score, "node").groupBy("bucket").agg(F.max(F.struct("score", (-F.col("node")).alias("neg"))).alias("best"))
    pairs = shared.select("bucket", "node").join(best.select("bucket", (-F.col("best.neg")).alias("hub")), "bucket")
    out = stages.write(pairs.select("hub", "node").distinct())
    stages.drop(shared)
    return out


def linked(stages: Stages, pairs: DataFrame, payload: DataFrame, kernel, *, weight: str = "weight", prune=None, heavy=None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Components of the links that ``kernel`` finds in clusters.

    pairs: (hub, node); payload: (node, weight, ...).  ``kernel(batches)`` gets rows (hub, i, j, comp, ...) sorted by
    (hub, i, j) and returns edges (u, v) that connect what is linked among rows of a run with different comp.  With
    ``prune``, the rows of payload go to ``prune(batches)`` first, which returns (hub, i, j, node, comp) of those worth a
    closer look; only these are joined with ``heavy(nodes)``, a table (node, ...) of at least these nodes, and go to
    ``kernel``.

    Clusters of one block are done in one run.  Larger ones are cut into blocks that each hold the hub; afterwards only
    nodes that are not connected to their hub meet the cluster's other blocks.
    """
    blocks = lambda n, w: f"cast(greatest(ceil({n} / {block_rows}), ceil({w} / {BLOCK_WEIGHT}), 1) as int)"

    def edges_of(rows: DataFrame) -> DataFrame:
        rows = rows.join(payload, "node")
        if prune is not None:
            rows = stages.write(spread(rows, "hub", "i", "j").mapInArrow(prune, "hub bigint, i int, j int, node bigint, comp bigint"))
            rows = rows.join(heavy(stages.write(rows.select("node").distinct())), "node")
        return stages.write(spread(rows, "hub", "i", "j").mapInArrow(kernel, "u bigint, v bigint"))

    sizes = pairs.join(payload.select("node", weight), "node").groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
    sizes = stages.write(sizes.where("n > 1").selectExpr("hub", f"{blocks('n', 'w')} as nb"))
    rows = pairs.join(sizes, "hub")
    first = rows.selectExpr("hub", "node", "nb", "explode(if(node = hub, sequence(0, nb - 1), array(cast(pmod(xxhash64(node), nb) as int)))) as i")
    edges = edges_of(first.selectExpr("hub", "node", "i", "0 as j", "node as comp"))
    comps = components(stages, edges)
    large = sizes.where("nb > 1")
    if large.isEmpty():
        return comps
    rows = pairs.join(large, "hub").join(comps, "node", "left").selectExpr("hub", "node", "nb", "coalesce(component, node) as comp")
    home = rows.where("hub = node").select("hub", F.col("comp").alias("home"))
    rows = stages.write(rows.join(home, "hub"))
    loose = rows.where("comp <> home")
    n_loose = loose.join(payload.select("node", weight), "node").groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
    rows = rows.join(n_loose.selectExpr("hub", f"{blocks('n', 'w')} as nl"), "hub")
    own = rows.where("comp <> home").selectExpr("hub", "node", "comp", "cast(pmod(xxhash64(node, 1), nl) as int) as i", "explode(sequence(0, nb - 1)) as j")
    rest = rows.selectExpr("hub", "node", "comp", "explode(sequence(0, nl - 1)) as i", "cast(pmod(xxhash64(node), nb) as int) as j")
    more = edges_of(own.union(rest.select("hub", "node", "comp", "i", "j")).distinct())
    return components(stages, edges.union(more))
