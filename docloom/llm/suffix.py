"""Operator 3: removal of long repeated passages with a run-length (r-) index.

A byte goes if some ``LENGTH``-byte string that covers it also starts anywhere else.  Equal strings have the same
minimiser, the least hash of their ``GRAM``-byte grams, so each window is assigned to one anchor (a minimiser occurrence):

1. One pass over the distinct texts lists their anchors: gram hash, first and last window that chose it, and the hash of
   the bytes those windows span (the context).  Copies of a whole text are one text and removed entirely.
2. Anchors whose gram hash is unique are done.  Equal contexts repeat in full.  What is left are contexts whose anchor is
   shared but whose bytes differ somewhere: the rims of repeated passages.
3. Their bytes go to the task of their anchor.  There a suffix array is sorted, its Burrows-Wheeler transform cut into
   runs, and the longest common extensions kept only at run heads and ends (the irreducible ones).  Streaming over the text
   from sample to sample, one less per byte, gives each position's matching statistics against all other positions;
   windows with LENGTH or more are repeats.
4. Anchors with more than ``HOT`` different contexts (a phrase that many documents share) would fill one task.  Their
   windows are compared by hash within the anchor instead, which Spark spreads, in gaps of ``STEP`` windows: bytes common to
   a gap's windows that are unique make all of them unique, a repeated union makes all of them repeats; only the windows
   of the gaps in between, at the rims of a passage, are counted one by one.

Joins with texts broadcast the small side up to a counted number of rows and bytes and shuffle beyond it.  Anchors that hold
a good part of all rows are joined on the map side, as there can be only few of them.  Contexts are equal if the 64-bit hash
of their anchor, that of all their bytes and their lengths are.

Defined results: a null text is empty; a text shorter than LENGTH keeps all its bytes; an empty table gives no rows;
doc_id is passed on as it is, null and repeated ones too (each row counts as a text of its own, so repeated rows repeat
each other).  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing as H
from .shared import Stages, binary, partitions, pieces, runs, small, spread

LENGTH, GRAM, HOT, STEP, INDEX_BYTES, SLAB = 200, 40, 512, 8, 1 << 18, 1 << 19


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Gram hash, position, first window, last window and context hash of the anchors of one text."""
    n = len(data)
    empty = np.empty(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, empty
    s = H.prefix_sums(data)
    inverse = H.powers(n + 1)[1]
    g = H.mix((s[gram:] - s[:-gram]) * inverse[: n - gram + 1])
    w = length - gram + 1
    mask = np.uint64(2 * SLAB - 1)
    chosen = []
    for o in range(0, n - length + 1, SLAB):
        v = g[o : o + SLAB + w - 1]
        v = (v & ~mask) | (mask - np.arange(len(v), dtype=np.uint64))  # the last of equal hashes wins
        k = 1
        m = v
        while 2 * k <= w:
            m = np.minimum(m[:-k], m[k:])
            k *= 2
        m = np.minimum(m[: len(v) - w + 1], m[w - k :])
        chosen.append((mask - (m & mask)).astype(np.int64) + o)
    p = np.concatenate(chosen)
    first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    last = np.append(first[1:], len(p)) - 1
    p = p[first]
    ctx = H.mix((s[last + length] - s[first]) * inverse[first] + H.mix((p - first).astype(np.uint64) * np.uint64(4096) + (last - first).astype(np.uint64)))
    return g[p].view(np.int64), p, first, last, ctx.view(np.int64)


def _list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        k1, k2 = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        parts = [anchors(np.frombuffer(t or b"", np.uint8)) for t in binary(b.column(2))]
        n = [len(x[0]) for x in parts]
        cols = [np.concatenate([x[k] for x in parts]) if parts else np.empty(0, np.int64) for k in range(5)]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(k1, n)), pa.array(np.repeat(k2, n)), pa.array(cols[0]), pa.array(cols[4]), *(pa.array(cols[k], pa.int64()) for k in (1, 2, 3))], names=["k1", "k2", "h", "ctx", "p", "a", "b"])


def repeated(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each context, the starts of its length-byte strings that start elsewhere in the contexts too."""
    sizes = np.array([len(c) for c in contexts])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.uint64) + np.uint64(1)
    text[begin[1:] - 1] = 0
    n = len(text)
    # suffix order by doubling: nine bits a symbol, seven symbols first
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key <<= np.uint64(9)
        key[: n - k] |= text[k:]
    levels: list[tuple[int, np.ndarray]] = []
    depth, sa, rank = 7, None, None
    while True:
        sa = np.argsort(key, kind="stable")
        ordered = key[sa]
        rank = np.empty(n, np.uint64)
        rank[sa] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1])).astype(np.uint64)
        levels.append((depth, rank))
        if int(rank[sa[-1]]) == n - 1 or depth > 1024:
            break
        key = (rank + np.uint64(1)) << np.uint64(32)
        key[: n - depth] |= rank[depth:] + np.uint64(1)
        depth *= 2
    row = np.empty(n, np.int64)
    row[sa] = np.arange(n)
    bwt = text[sa - 1]
    change = bwt[1:] != bwt[:-1]
    remaining = np.repeat(begin[1:], sizes + 1) - 1 - np.arange(n)

    def extension(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for depth, rank in reversed(levels):
            for _ in range(2):
                x, y = i + out, j + out
                ok = (x < n) & (y < n)
                ok[ok] = rank[x[ok]] == rank[y[ok]]
                out += depth * ok
        # the rest, below seven symbols
        for _ in range(6):
            x, y = np.minimum(i + out, n - 1), np.minimum(j + out, n - 1)
            out += (text[x] == text[y]) & (i + out < n) & (j + out < n)
        return np.minimum(out, np.minimum(remaining[i], remaining[j]))

    best = np.zeros(n, np.int64)
    # heads of runs with the row above, ends of runs with the row below; context starts are samples too
    for step, sampled in ((-1, np.append(True, change)), (1, np.append(change, True))):
        sampled = sampled[row]
        sampled[begin[:-1]] = True
        where = np.flatnonzero(sampled)
        near = row[where] + step
        inside = (near >= 0) & (near < n)
        value = np.zeros(len(where), np.int64)
        value[inside] = extension(where[inside], sa[near[inside]])
        source = np.cumsum(sampled) - 1
        best = np.maximum(best, value[source] - (np.arange(n) - where[source]))
    best = np.minimum(best, remaining)
    hit = best >= length
    return [np.flatnonzero(hit[b : b + s]) for b, s in zip(begin[:-1], sizes, strict=True)]


def _spans(starts: np.ndarray) -> list[int]:
    """first, last, first, last ... of runs of consecutive starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return np.stack([starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)]], 1).ravel().tolist()


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, ctx, whole, bytes) sorted by h; several anchors share one index."""
    held: list[tuple[int, int, bool, bytes]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        found = repeated([x[3] for x in held])
        rows = [(x[0], x[1], _spans(f)) for x, f in zip(held, found, strict=True) if len(f) and not x[2]]
        held.clear()
        cols = list(zip(*rows, strict=True)) if rows else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64()))], names=["h", "ctx", "spans"])

    for t in runs(batches, ["h"]):
        rows = list(zip(t.column("h").to_pylist(), t.column("ctx").to_pylist(), t.column("whole").to_pylist(), t.column("bytes").to_pylist(), strict=True))
        held += rows
        size += sum(len(x[3]) for x in rows)
        if size >= INDEX_BYTES:
            yield flush()
            size = 0
    if held:
        yield flush()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        rows = []
        for t, need in zip(binary(b.column(0)), b.column(1).to_pylist(), strict=True):
            rows += [(x["h"], x["ctx"], x["whole"], x["p"] - x["a"], t[x["a"] : x["b"] + LENGTH]) for x in need]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["h", "ctx", "whole", "lead", "bytes"])


def _hash_at(s: np.ndarray, inverse: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return H.mix((s[j] - s[i]) * inverse[i] + (j - i).astype(np.uint64)).view(np.int64)


def _gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, ctx, lead, bytes): for each gap of STEP windows (by offset from the anchor) its first and last window in the
    context, the hash of the bytes common to all windows of the whole gap, and the hash of the union of those present."""
    for b in pieces(batches):
        parts = []
        for h, ctx, lead, t in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            data = np.frombuffer(t, np.uint8)
            s, inverse = H.prefix_sums(data), H.powers(len(data) + 1)[1]
            last = len(data) - LENGTH - lead
            gap = np.arange(-lead // STEP, last // STEP + 1)
            first, end = np.maximum(gap * STEP, -lead), np.minimum(gap * STEP + STEP - 1, last)
            core = _hash_at(s, inverse, gap * STEP + STEP - 1 + lead, gap * STEP + LENGTH + lead)
            union = _hash_at(s, inverse, first + lead, end + LENGTH + lead)
            parts.append(np.stack([np.full(len(gap), h), np.full(len(gap), ctx), gap, first, end, core, union]))
        cols = np.concatenate(parts, 1) if parts else np.empty((7, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["h", "ctx", "gap", "first", "last", "core", "union"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, ctx, lead, bytes, first, last): the hash of each window from first to last, by offset from the anchor."""
    for b in pieces(batches):
        parts = []
        for h, ctx, lead, t, first, last in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
            data = np.frombuffer(t, np.uint8)
            off = np.arange(first, last + 1)
            value = _hash_at(H.prefix_sums(data), H.powers(len(data) + 1)[1], off + lead, off + lead + LENGTH)
            parts.append(np.stack([np.full(len(off), h), np.full(len(off), ctx), off, value]))
        cols = np.concatenate(parts, 1) if parts else np.empty((4, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["h", "ctx", "off", "value"])


def hot_repeats(stages: Stages, contexts: DataFrame) -> DataFrame:
    """h, ctx, first, last: repeated windows (offsets from the anchor) of the contexts (h, ctx, lead, bytes)."""
    gaps = stages.write(contexts.select("h", "ctx", "lead", "bytes").mapInArrow(_gaps, "h bigint, ctx bigint, gap bigint, first bigint, last bigint, core bigint, union bigint"))
    n = F.count(F.lit(1)).alias("n")
    some = gaps.join(gaps.groupBy("h", "gap", "core").agg(n).where("n > 1").drop("n"), ["h", "gap", "core"])
    unions = gaps.groupBy("h", "first", "last", "union").agg(n).where("n > 1").select("h", "first", "last", "union", F.lit(True).alias("all"))
    some = stages.write(some.join(unions, ["h", "first", "last", "union"], "left").select("h", "ctx", "first", "last", "union", "all"))
    kind = "h bigint, ctx bigint, off bigint, value bigint"

    def windows(df: DataFrame) -> DataFrame:
        return contexts.join(df, ["h", "ctx"]).select("h", "ctx", "lead", "bytes", "first", "last").mapInArrow(_windows, kind)

    each = stages.write(windows(some.where("all is null").select("h", "ctx", "first", "last")))
    # a rim's window may also stand inside a union that repeats; one context stands for each of those
    one = some.where("all").groupBy("h", "first", "last", "union").agg(F.min("ctx").alias("ctx")).drop("union")
    seen = each.select("h", "off", "value").union(windows(one).select("h", "off", "value"))
    twice = seen.groupBy("h", "off", "value").agg(n).where("n > 1").drop("n")
    found = each.join(twice, ["h", "off", "value"]).select("h", "ctx", F.col("off").alias("first"), F.col("off").alias("last"))
    return found.union(some.where("all").select("h", "ctx", "first", "last"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        rows = []
        for t, full, marks in zip(binary(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            t = t or b""
            spans = [[0, len(t)]] if full and len(t) >= LENGTH else []
            if not spans:
                for m in sorted((m["a"], m["e"]) for m in marks or ()):
                    if spans and m[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], m[1])
                    else:
                        spans.append(list(m))
            digest, last, removed = hashlib.sha256(), 0, 0
            for s, e in spans:
                digest.update(t[last:s])
                last, removed = e, removed + e - s
            digest.update(t[last:])
            rows.append((len(t), removed, len(spans), digest.hexdigest()))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs (see the module's text)."""
    spark = docs.sparkSession
    stages = Stages(spark, "suffix")
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = ["k1", "k2"]
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"))
    copies = stages.write(source.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1").drop("n"))
    once = source.join(small(copies), key, "left").where(F.col("first_id").isNull() | (F.col("doc_id") == F.col("first_id")))
    table = stages.write(once.select(*key, "text").mapInArrow(_list_anchors, "k1 bigint, k2 bigint, h bigint, ctx bigint, p bigint, a bigint, b bigint"))
    shared = table.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi")).where("n > 1").selectExpr("h", "n", "lo <> hi as mixed")
    shared = stages.write(shared)
    # at most four per partition can be this frequent
    often = f"n > {max(HOT, table.count() // (4 * partitions(spark)))}"
    frequent = F.broadcast(shared.where(often).drop("n"))
    named = [r.h for r in shared.where(often).select("h").collect()]
    rest = table.where(~F.col("h").isin(named)).join(shared.where(f"not ({often})").drop("n"), "h")
    rows = stages.write(table.join(frequent, "h").unionByName(rest))
    stages.drop(table, shared)
    # one location stands for all occurrences of a context
    place = F.min(F.struct("k1", "k2", "p", "a", "b"))
    groups = stages.write(rows.groupBy("h", "ctx").agg(F.count(F.lit(1)).alias("n"), F.max("mixed").alias("mixed"), place.alias("at")).selectExpr("h", "ctx", "n > 1 as whole", "mixed", "at.*"))
    mixed = groups.where("mixed")
    hot = stages.write(mixed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(f"n > {HOT}").select("h"))
    is_hot = not hot.isEmpty()

    def contexts(df: DataFrame) -> DataFrame:
        """h, ctx, whole, lead, bytes of the contexts, each once (rows of repeated doc_ids may give one twice)."""
        need = stages.write(df.groupBy(*key).agg(F.collect_list(F.struct("h", "ctx", "whole", "p", "a", "b")).alias("need")))
        found = once.join(small(need, 24 + 56 * F.size("need")), key).select("text", "need").mapInArrow(_contexts, "h bigint, ctx bigint, whole boolean, lead bigint, bytes binary")
        return found.dropDuplicates(["h", "ctx"])

    every = stages.write(contexts(mixed)) if is_hot else contexts(mixed)
    cold = every.join(hot, "h", "left_anti") if is_hot else every
    found = spread(cold.drop("lead"), "h").mapInArrow(_index, "h bigint, ctx bigint, spans array<bigint>")
    found = found.selectExpr("h", "ctx", "explode(transform(sequence(0, cast(size(spans) / 2 as int) - 1), k -> struct(spans[2 * k] as s, spans[2 * k + 1] as e))) as x").selectExpr("h", "ctx", "x.s", "x.e")
    if is_hot:
        more = hot_repeats(stages, stages.write(every.join(hot, "h")))
        more = more.join(groups.where("not whole").select("h", "ctx", "p", "a"), ["h", "ctx"])
        found = found.union(more.selectExpr("h", "ctx", "first + p - a as s", "last + p - a as e"))
    marks = rows.join(groups.where("whole").select("h", "ctx"), ["h", "ctx"]).selectExpr(*key, "a", f"b + {LENGTH} as e")
    marks = marks.union(found.join(groups.select("h", "ctx", *key, "a"), ["h", "ctx"]).selectExpr(*key, "a + s as a", f"a + e + {LENGTH} as e"))
    # overlapping marks of a text are one span
    before = Window.partitionBy(*key).orderBy("a", "e").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("new", F.coalesce(F.col("a") > F.max("e").over(before), F.lit(True)).cast("int"))
    marks = marks.withColumn("span", F.sum("new").over(Window.partitionBy(*key).orderBy("a", "e").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    marks = marks.groupBy(*key, "span").agg(F.min("a").alias("a"), F.max("e").alias("e"))
    plan = marks.groupBy(*key).agg(F.collect_list(F.struct("a", "e")).alias("marks")).join(copies.select(*key, F.lit(True).alias("full")), key, "full")
    plan = stages.write(plan.withColumn("marks", F.when(F.col("full").isNull(), F.col("marks"))))
    return source.join(small(plan, 32 + 24 * F.coalesce(F.size("marks"), F.lit(0))), key, "left").select("doc_id", "text", "full", "marks").mapInArrow(_cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
