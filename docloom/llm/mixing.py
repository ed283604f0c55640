"""Operator 8: mixing sources to target weights by subset-sum budget fitting.

1. Sizes (words) are counted once per document; (source, size) counts form a histogram.  A source has at most
   sqrt(2 * words) distinct sizes, so one source's histogram fits in a task at any scale.
2. Targets share the words of all sources by weight; a target stops at ``most`` times its source's size and the excess is
   shared again by weight.  The driver sees one row per source and refuses more than ``MAX_SOURCES``.
3. Per source, every document is taken ``floor(target / size)`` times.  What remains is filled by size counts: a
   proportional share of every size, single documents of seeded sizes until the rest is under ``DP_WORDS``, and a bounded
   knapsack over that rest that finds the count of each size whose sum is nearest the target.
4. Of each size, the counted number of documents is selected by seeded hash.  Large groups of one source and size are
   cut by hash digits and ranked inside a digit, so none is sorted in one task.

Defined results: a null text has size 0 and is taken 0 words; a null source is a source of its own, last in order; null
doc_ids and repeated rows are rows like others.  Sources of size 0 have target 0.  The same input gives the same output.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Stages

WEIGHTS, MOST, SEED = (5.0, 2.0, 1.0), 3, 42
MAX_SOURCES, DP_WORDS, DIGIT_ROWS, MAX_DIGITS = 1_000_000, 1 << 16, 512, 1 << 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Share sum(sizes) by weights; none above most * its size, the excess shared again by weight."""
    out = [0.0] * len(sizes)
    free, left = [k for k in range(len(sizes)) if sizes[k] > 0], float(sum(sizes))
    while free:
        total = math.fsum(weights[k] for k in free)
        full = [k for k in free if left * weights[k] / total > most * sizes[k]]
        if not full:
            for k in free:
                out[k] = left * weights[k] / total
            break
        for k in full:
            out[k] = float(most * sizes[k])
        left -= math.fsum(out[k] for k in full)
        free = [k for k in free if out[k] == 0.0]
    return out


def knapsack(lengths: list[int], available: list[int], goal: int) -> dict[int, int]:
    """Counts by length, none above available, whose sum is as near goal as any (bounded subset sum on bit sets)."""
    if goal <= 0 or not lengths:
        return {}
    top = goal + max(min(lengths), 1)
    mask = (1 << (top + 1)) - 1
    via = np.full(top + 1, -1, np.int64)
    pieces: list[tuple[int, int]] = []
    reach = 1
    for length, n in zip(lengths, available, strict=True):
        n, k = min(n, top // length), 1
        while n > 0 and not reach >> goal & 1:
            k = min(k, n)
            new = (reach << length * k) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(top // 8 + 1, "little"), np.uint8), bitorder="little")
                via[np.flatnonzero(bits[: top + 1])] = len(pieces)
                pieces.append((length, k))
                reach |= new
            n -= k
            k *= 2
        if reach >> goal & 1:
            break
    reached = np.flatnonzero(np.append(True, via[1:] >= 0))
    s = int(reached[np.argmin(np.abs(reached - goal))])
    out: dict[int, int] = {}
    while s:
        length, k = pieces[via[s]]
        out[length] = out.get(length, 0) + k
        s -= length * k
    return out


def fit(lengths: list[int], counts: list[int], target: float, seed: int = SEED) -> tuple[int, list[int]]:
    """Copies of every document, and how many documents of each length get one more, so that words come near target."""
    size = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if not size:
        return 0, [0] * len(lengths)
    copies = min(MOST, int(target // size))
    goal = 0 if copies == MOST else min(round(target - copies * size), size)
    take = [c * goal // size if n else 0 for n, c in zip(lengths, counts, strict=True)]
    left = goal - sum(n * t for n, t in zip(lengths, take, strict=True))
    order = np.random.default_rng([seed, len(lengths)]).permutation(len(lengths)).tolist()
    for k in order:
        n = lengths[k]
        if n and n <= left - DP_WORDS // 2 and take[k] < counts[k]:
            take[k] += 1
            left -= n
    if left > DP_WORDS:
        for k in sorted(order, key=lambda k: -lengths[k]):
            n = lengths[k]
            if n and left > DP_WORDS:
                more = max(0, min(counts[k] - take[k], (left - DP_WORDS // 2) // n))
                take[k] += more
                left -= more * n
    open_ = [k for k in order if lengths[k] and take[k] < counts[k]]
    for n, more in knapsack([lengths[k] for k in open_], [counts[k] - take[k] for k in open_], left).items():
        take[lengths.index(n)] += more
    return copies, take


def _plan(seed: int):
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        copies, more = fit(pdf["size"].tolist(), pdf["n"].tolist(), float(pdf["target"].iloc[0]), seed)
        return pdf.assign(copies=copies, more=more)[["absent", "name", "size", "n", "source_size", "target", "copies", "more"]]

    return kernel


def mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every row of docs (see the module's text)."""
    spark = docs.sparkSession
    stages = Stages(spark, "mixing")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).isNull().alias("absent"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"), n_words(F.col(text_col)).alias("size"))
    sized = stages.write(sized)
    hist = stages.write(sized.groupBy("absent", "name", "size").agg(F.count(F.lit(1)).alias("n")))
    rows = hist.groupBy("absent", "name").agg(F.sum(F.col("size") * F.col("n")).alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r.absent, r.name))
    goal = targets([int(r.words) for r in rows], [weights[k % len(weights)] for k in range(len(rows))])
    shares = spark.createDataFrame([(r.absent, r.name, int(r.words), g) for r, g in zip(rows, goal, strict=True)], "absent boolean, name string, source_size bigint, target double")
    kind = "absent boolean, name string, size bigint, n bigint, source_size bigint, target double, copies int, more bigint"
    chosen = stages.write(hist.join(shares, ["absent", "name"]).groupBy("absent", "name").applyInPandas(_plan(seed), kind))
    key = ["absent", "name", "size"]
    found = sized.join(chosen, key).withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id")))
    digits = F.least(F.ceil(F.col("n") / DIGIT_ROWS), F.lit(MAX_DIGITS)).cast("bigint")
    found = found.withColumn("digit", F.pmod("h", digits))
    some = found.where("more > 0 and more < n")
    before = some.groupBy(*key, "digit").agg(F.count(F.lit(1)).alias("in_digit"))
    before = before.withColumn("before", F.sum("in_digit").over(Window.partitionBy(*key).orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("in_digit")).drop("in_digit")
    ranked = some.join(before, [*key, "digit"]).withColumn("rank", F.row_number().over(Window.partitionBy(*key, "digit").orderBy("h", "doc_id")) + F.col("before"))
    out = ranked.withColumn("copies", F.col("copies") + (F.col("rank") <= F.col("more")).cast("int"))
    rest = found.where("not (more > 0 and more < n)").withColumn("copies", F.col("copies") + (F.col("more") > 0).cast("int"))
    cols = ["doc_id", "size", "source_size", "target", "copies"]
    return out.select(cols).union(rest.select(cols)).selectExpr("doc_id", "size", "source_size", "target", "size * copies as taken", "copies")
