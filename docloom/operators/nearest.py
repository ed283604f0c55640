"""Exact nearest rows by pivots and the triangle inequality.

Rows are unit vectors, so cosine order is distance order.  Every row belongs to the nearest of some pivots and knows its
distance to it.  A query first meets the rows of its nearest pivots, which bounds the distance of its k-th hit; by the
triangle inequality a row can only be nearer if its distance to its pivot is within that bound of the query's, so the other
rows are joined by ring (pivot, rounded distance) and only rings that the bound reaches are opened.  No row that could count
is left out; how many are met depends on the data, at worst all.

Pivots are a sample of the rows of a fixed, documented size; they steer the work and never the result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind
from ..plans.stages import Stages, spread
from . import best
from .memory import dot

#: Pivots, rings per unit of distance, pivots whose rows a query meets first.
PIVOTS, RINGS, FIRST = 64, 40, 2
#: Rows, and queries, that meet in one matrix product's group.
TILE = 65_536
#: Distances of unit vectors are right to this; rings are opened with it to spare.
SLACK = 1e-6


def unit(c: Column) -> Column:
    v = F.transform(c, lambda x: x.cast("double"))
    return bind(F.sqrt(dot(c, c)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)))


def gap(x: Column, y: Column) -> Column:
    """Distance of unit vectors."""
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot(x, y)))


def placed(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """rows (id, u) with pivot, far: the nearest pivot, of those broadcast, and the distance to it."""
    near = rows.join(F.broadcast(pivots), F.lit(True)).groupBy("id").agg(F.min(F.struct(gap(F.col("u"), F.col("c")).alias("far"), "pivot")).alias("n"))
    return rows.join(near, "id").select("id", "u", F.col("n.pivot").alias("pivot"), F.col("n.far").alias("far"))


def top_k(queries: DataFrame, vectors: DataFrame, *, k: int = 4, pivots: int = PIVOTS, rings: int = RINGS, first: int = FIRST, stages: Stages | None = None) -> DataFrame:
    """q_id, vec_id, score, rank: for each query (q_id, q_vec) the k nearest rows (vec_id, embedding) by cosine rounded to six
    places, ties by vec_id.  Identifiers are unique; zero vectors and null ones are near to nothing."""
    stages = stages or Stages(vectors.sparkSession, "nearest")
    rows = stages.write(spread(vectors, "vec_id").select(F.col("vec_id").alias("id"), unit(F.col("embedding")).alias("u")).where("u is not null"))
    asked = stages.write(queries.select(F.col("q_id").alias("id"), unit(F.col("q_vec")).alias("u")).where("u is not null"))
    centres = stages.write(rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select(F.col("id").alias("pivot"), F.col("u").alias("c")))
    rows = stages.write(placed(rows, centres).withColumn("ring", F.floor(F.col("far") * rings)))
    to_pivot = asked.join(F.broadcast(centres), F.lit(True)).select(F.col("id").alias("q_id"), F.col("u").alias("q"), "pivot", gap(F.col("u"), F.col("c")).alias("reach"))
    order = Window.partitionBy("q_id").orderBy("reach", "pivot")
    to_pivot = stages.write(to_pivot.withColumn("n", F.row_number().over(order)))
    best_first = Window.partitionBy("q_id").orderBy(F.col("score").desc(), "vec_id")
    kind = f"q_id {asked.schema['id'].dataType.simpleString()}, vec_id bigint, score double"
    # rows of a pivot in tiles of neighbouring rings; rings that exist are few, pivots times rings
    spans = rows.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("a"), F.max("far").alias("b"))
    before = Window.partitionBy("pivot").orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)
    spans = stages.write(spans.withColumn("tile", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / TILE)))
    tiles = spans.groupBy("pivot", "tile").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.ceil(F.sum("n") / TILE).alias("slices"))
    rows = rows.join(F.broadcast(spans.select("pivot", "ring", "tile")), ["pivot", "ring"]).join(F.broadcast(tiles.select("pivot", "tile", "slices")), ["pivot", "tile"])
    # a ring of more rows than a tile is cut in slices, and so are the queries
    blocks = -(-asked.count() // TILE) or 1
    rows = rows.select("pivot", "tile", F.pmod(F.xxhash64("id"), "slices").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "u", "far")
    place, own = ["pivot", "tile", "slice", "block"], ["in_pivot", "in_tile", "in_slice", "in_block"]

    def met(asking: DataFrame) -> DataFrame:
        """Of each tile that a query (q_id, q, pivot, low, high, least) reaches, its k best rows."""
        opened = asking.join(F.broadcast(tiles), "pivot").where("a <= high and b >= low").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)))
        at = [F.col("pivot"), F.col("tile"), F.col("slice"), F.pmod(F.xxhash64("q_id"), F.lit(blocks)).cast("int")]
        opened = opened.select(*[c.alias(n) for c, n in zip(at, own, strict=True)], "q_id", "q", "low", "high", "least")
        return opened.groupBy(*own).cogroup(rows.groupBy(*place)).applyInArrow(_tile(k), kind)

    everywhere = {"low": F.lit(0.0), "high": F.lit(2.0 + SLACK), "least": F.lit(float("-inf"))}
    start = stages.write(met(to_pivot.where(F.col("n") <= first).withColumns(everywhere)))
    # the k-th score so far; a score of s is at most a distance of sqrt(2 - 2 s) away, half a unit of the sixth place to spare
    top = start.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    bound = top.groupBy("q_id").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("s"))
    bound = stages.write(bound.select("q_id", "c", "s", F.when(F.col("c") == k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (F.col("s") - F.lit(5e-7)))) + SLACK).alias("bound")))
    rest = to_pivot.where(F.col("n") > first).join(bound, "q_id", "left").withColumn("bound", F.coalesce("bound", F.lit(2.0 + SLACK)))
    low, high = F.greatest(F.lit(0.0), F.col("reach") - F.col("bound") - SLACK), F.least(F.lit(2.0), F.col("reach") + F.col("bound") + SLACK)
    least = F.when(F.col("c") == k, F.col("s")).otherwise(F.lit(float("-inf")))
    more = stages.write(met(rest.withColumns({"low": low, "high": high, "least": least})))
    kind = vectors.schema["vec_id"].dataType
    return start.union(more).withColumn("vec_id", F.col("vec_id").cast(kind)).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)


def _tile(k: int):
    def tile(asking: pa.Table, rows: pa.Table) -> pa.Table:
        q_ids, found = asking["q_id"].combine_chunks(), []
        ids, far = rows["id"].to_numpy().astype("int64"), rows["far"].to_numpy()
        low, high, least = (asking[c].to_numpy() for c in ("low", "high", "least"))
        held = {v.shape[1]: (at, v) for at, v in best.vectors(rows["u"])}
        for at, q in best.vectors(asking["q"]):
            if q.shape[1] in held:
                r, v = held[q.shape[1]]
                top = best.Best(q, k, scaled=False, least=least[at])
                top.add(ids[r], v, far[r], low[at], high[at])
                i, row, score = top.found()
                found.append((at[i], row, score))
        return best.table(q_ids, found)

    return tile
