"""Operator 10: MinHash near-dedup with sequential Bayesian verification.

1. One pass over the texts makes each document's set of word shingles (64-bit hashes), a 96-value MinHash signature and
   a 128-bit key of the whole set.  Documents with equal sets are one class; a class is compared once.
2. Signatures are cut into 24 bands of four values.  Classes that share a band meet (a pair of similarity 0.8 shares
   none with probability 3e-6).  Each bucket's most connected class is its hub; the distinct (hub, class) rows form
   clusters, so a group of n near copies costs n rows and not n * n.
3. Within a cluster's block, pairs are compared by batches of 16 signature values.  After each batch the posterior of
   the similarity (Beta(1 + matches, 1 + misses)) prunes pairs whose chance of reaching the threshold is under ``miss``.
   This runs on signatures alone; only classes with a surviving pair in a block are joined with their texts, and the
   survivors are verified exactly, 100 * |A n B| >= percent * |A u B| on the full sets.
4. Links become components by star contraction in Spark.

Defined results: a null or wordless text has the empty set and links with nothing; repeated rows and documents with
equal sets are linked with each other; a null doc_id links with nothing, has component_id null and is kept.  Rows
that repeat a doc_id appear as often as in the input.  Further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .shared import Stages, binary, components, hubs, labels, linked, pieces, runs, small

BANDS, ROWS, BATCH = 24, 4, 16
SIZE = BANDS * ROWS
#: Default chance of pruning a pair whose similarity does reach the threshold, for each look at the signatures.
MISS = 1e-7

_A = np.random.default_rng(101).integers(0, 2**63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(102).integers(0, 2**63, SIZE, dtype=np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(SIZE, 2**32 - 1, np.uint32)
    for o in range(0, len(s), 512):
        np.minimum(out, ((s[o : o + 512, None] * _A + _B) >> np.uint64(32)).min(0).astype(np.uint32), out=out)
    return out


def sketch(width: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            n, k1, k2, sigs = [], [], [], []
            for t in binary(b.column(1)):
                s = H.shingle_set(t or b"", width)
                n.append(len(s))
                key = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                k1.append(int(key[0]))
                k2.append(int(key[1]))
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "k1", "k2", "sig"])

    return kernel


@lru_cache
def least_matches(threshold: float, miss: float = MISS) -> tuple[int, ...]:
    """For each number of batches seen, the fewest matches that keep a pair: P(similarity >= threshold) >= miss."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    high = grid >= threshold
    out = []
    for n in range(BATCH, SIZE + 1, BATCH):
        m = np.arange(n + 1)[:, None]
        logp = m * np.log(grid) + (n - m) * np.log1p(-grid)
        p = np.exp(logp - logp.max(1, keepdims=True))
        out.append(int(np.argmax(p[:, high].sum(1) / p.sum(1) >= miss)))
    return tuple(out)


def survivors(sig: np.ndarray, alive: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Pairs (rows of alive, a boolean upper triangle) that no look at the signatures prunes."""
    i, j = np.nonzero(alive)
    hits = np.zeros(len(i), np.int32)
    for k, least in enumerate(least_matches(threshold, miss)):
        cut = sig[:, k * BATCH : (k + 1) * BATCH]
        for o in range(0, len(i), 65_536):
            hits[o : o + 65_536] += (cut[i[o : o + 65_536]] == cut[j[o : o + 65_536]]).sum(1, dtype=np.int32)
        keep = hits >= least
        i, j, hits = i[keep], j[keep], hits[keep]
    return np.stack([i, j], 1)


def exact(sets: list[np.ndarray], pairs: np.ndarray, percent: int) -> np.ndarray:
    """Symmetric matrix of the pairs that are linked on their full sets."""
    n = len(sets)
    link = np.zeros((n, n), bool)
    if not len(pairs):
        return link
    used = np.unique(pairs)
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate([sets[k] for k in used])
    owner = np.repeat(np.arange(len(used)), sizes[used])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    rank = np.cumsum(new) - 1
    count = np.bincount(rank)
    both = count[rank] > 1
    owner, rank = owner[both], rank[both]
    common = np.zeros((len(used), len(used)))
    step = max(1, 8_000_000 // len(used))
    rank = np.cumsum(np.concatenate([[0], rank[1:] != rank[:-1]])).astype(np.int64) if len(rank) else rank
    for o in range(0, int(rank[-1]) + 1 if len(rank) else 0, step):
        a, b = np.searchsorted(rank, [o, o + step])
        m = np.zeros((len(used), min(step, int(rank[-1]) + 1 - o)), np.float32)
        m[owner[a:b], rank[a:b] - o] = 1
        common += m @ m.T
    at = np.searchsorted(used, pairs)
    i, j = pairs.T
    meet = np.rint(common[at[:, 0], at[:, 1]]).astype(np.int64)
    ok = 100 * meet >= percent * (sizes[i] + sizes[j] - meet)
    link[i[ok], j[ok]] = link[j[ok], i[ok]] = True
    return link


def _surviving(t: pa.Table, percent: int, miss: float) -> np.ndarray:
    """Pairs of the rows of a run (sorted by node, each once) that the signatures leave."""
    comp, size = t.column("comp").to_numpy(), t.column("n_shingles").to_numpy()
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(len(comp), SIZE)
    low, high = np.minimum.outer(size, size), np.maximum.outer(size, size)
    alive = np.triu((comp[:, None] != comp[None, :]) & (100 * low >= percent * high), 1)
    return survivors(sig, alive, percent / 100, miss)


def _nodes(t: pa.Table) -> tuple[np.ndarray, pa.Table]:
    node, first = np.unique(t.column("node").to_numpy(), return_index=True)
    return node, t.take(first)


def prune(percent: int, miss: float):
    """Rows of a run with a surviving pair in it."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["hub", "i", "j"]):
            node, t = _nodes(t)
            if len(node) < 2:
                continue
            pairs = _surviving(t, percent, miss)
            if len(pairs):
                yield from t.take(np.unique(pairs)).select(["hub", "i", "j", "node", "comp"]).to_batches()

    return kernel


def verify(width: int, percent: int, miss: float):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["hub", "i", "j"]):
            node, t = _nodes(t)
            if len(node) < 2:
                continue
            pairs = _surviving(t, percent, miss)
            if not len(pairs):
                continue
            need = np.zeros(len(node), bool)
            need[pairs] = True
            sets = [H.shingle_set(x, width) if k else node[:0].view(np.uint64) for x, k in zip(binary(t.column("text")), need, strict=True)]
            root = labels(exact(sets, pairs, percent))
            moved = root != np.arange(len(root))
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], names=["u", "v"])

    return kernel


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (see the module's text)."""
    spark = docs.sparkSession
    stages = Stages(spark, "minhash")
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    table = stages.write(source.mapInArrow(sketch(words), "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, sig binary"))
    some = table.where("n_shingles > 0 and doc_id is not null")
    classes = stages.write(some.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last"), F.max("n_shingles").alias("n_shingles"), F.max("sig").alias("sig")))
    parts = [F.xxhash64(F.lit(k), F.substring("sig", 1 + 4 * ROWS * k, 4 * ROWS)) for k in range(BANDS)]
    banded = classes.select("node", F.explode(F.array(*parts)).alias("bucket"))
    pairs = hubs(stages, banded)
    signed = stages.write(classes.join(pairs.select("node").distinct(), "node", "left_semi").select("node", F.col("n_shingles").alias("weight"), "n_shingles", "sig"))

    def heavy(nodes: DataFrame) -> DataFrame:
        texts = source.withColumnRenamed("doc_id", "node").join(small(nodes), "node").dropDuplicates(["node"])
        return texts.join(signed.select("node", "n_shingles", "sig"), "node")

    comps = linked(stages, pairs, signed, verify(words, percent, miss), prune=prune(percent, miss), heavy=heavy)
    moved = classes.join(comps, "node", "left").where("component is not null or last > node").selectExpr("k1", "k2", "coalesce(component, node) as component")
    return _result(table, moved)


def _result(table: DataFrame, moved: DataFrame) -> DataFrame:
    found = table.drop("sig").join(moved, ["k1", "k2"], "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")))
    return found.select("doc_id", "n_shingles", comp.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group (the smallest id) left; all columns stay, rows of null id too.

    Rows that repeat a kept id are one document: one of them stays.
    """
    stages = Stages(docs.sparkSession, "unique")
    found = stages.write(near_duplicates(docs, words=words, percent=percent, id_col=id_col, text_col=text_col))
    dropped = small(found.where("not kept").select(F.col("doc_id").alias("dropped_id")).distinct())
    out = docs.join(dropped, docs[id_col] == dropped["dropped_id"], "left_anti")
    again = stages.write(found.where("kept and doc_id is not null and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again_id")))
    if again.isEmpty():
        return out
    some = out.join(again, out[id_col] == again["again_id"], "left_semi").dropDuplicates([id_col])
    return out.join(again, out[id_col] == again["again_id"], "left_anti").union(some)
