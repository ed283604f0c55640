"""Operator 2: embedding near-dedup with randomised-rotation binary codes.

Every usable vector is normalised in double precision, rotated by several random orthogonal matrices, and reduced to
the signs of the rotated coordinates plus a stored correction factor ``f = <code, rotated vector>``.

* Bands of the code bits find candidates: two vectors of cosine ``threshold`` share none of the bands with a chance of
  at most ``MISS``.  The band width grows with the logarithm of the number of vectors, so buckets stay small.
* In a block of a cluster, ``<code(x), rotated y> / f(x)`` estimates the cosine without bias.  Pairs whose upper
  confidence bound is below the threshold are dropped; all others are computed again exactly, in double precision.
* Links become components in Spark; then the links inside each component are counted block by block the same way.

Defined results: a vector that is null, empty, zero or holds null or non-finite components links with nothing
(n_links 0, own component).  Vectors of different lengths never link.  Identical vectors are one class and count as
links of each other.  A null vec_id links with nothing, has component_id null and is kept.  A vec_id that repeats with
one vector keeps all its rows.  Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stages, hubs, labels, linked, runs, spread

#: Vectors of a block of a cluster or component (a block of pairs is one matrix product).
TILE = 1024
#: Chance that a pair at the threshold shares no band, and standard deviations of the confidence bound.
MISS, SIGMAS = 1e-4, 4.5


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a band and number of bands for n vectors."""
    bits = max(10, math.ceil(math.log2(max(n, 2))) + 2)
    same = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(MISS) / math.log1p(-(same**bits)))


@lru_cache(maxsize=8)
def rotations(dim: int, bits: int) -> np.ndarray:
    """ceil(bits / dim) random orthogonal matrices, stacked and scaled to keep lengths."""
    rng = np.random.default_rng([7, dim])
    k = -(-bits // dim)
    out = []
    for _ in range(k):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out) / math.sqrt(k)


def unit(values: np.ndarray) -> np.ndarray | None:
    with np.errstate(over="ignore"):
        top = np.abs(values).max(initial=0)
        if not len(values) or not np.isfinite(values).all() or not top:
            return None
        values = values / top
    return values / math.sqrt(values @ values)


def encode(bits: int, bands: int):
    total = bits * bands

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for v in b.column(1):
                x = None
                if v.is_valid and not v.values.null_count:
                    x = unit(v.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if x is None:
                    rows.append((None,) * 6)
                    continue
                y = rotations(len(x), total) @ x
                sign = y > 0
                code = np.packbits(sign).tobytes()
                part = np.packbits(sign[:total].reshape(bands, bits), axis=1)
                keys = [xxhash.xxh3_64_intdigest(p.tobytes(), seed=k + (len(x) << 16)) - 2**63 for k, p in enumerate(part)]
                key = np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64)
                rows.append((int(key[0]), int(key[1]), code, float(np.abs(y).sum() / math.sqrt(len(y))), x.tobytes(), keys))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["vec_id", "k1", "k2", "code", "factor", "unit", "bands"])

    return kernel


def links(t: pa.Table, total: int, threshold: float, allowed: np.ndarray) -> np.ndarray:
    """Pairs of allowed (boolean matrix) whose exact cosine reaches the threshold; codes rule out most others."""
    raw = t.column("unit").to_pylist()
    out = np.zeros(allowed.shape, bool)
    lengths = np.array([len(x) for x in raw])
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        x = np.frombuffer(b"".join(raw[k] for k in at), np.float64).reshape(len(at), -1)
        turn = rotations(x.shape[1], total)
        m = len(turn)
        code = np.unpackbits(np.frombuffer(b"".join(t.column("code")[int(k)].as_py() for k in at), np.uint8).reshape(len(at), -1), axis=1)[:, :m]
        f = t.column("factor").to_numpy()[at]
        estimate = ((code.astype(np.float32) * 2 - 1) / math.sqrt(m)) @ (turn @ x.T).astype(np.float32) / f[:, None]
        margin = SIGMAS * np.sqrt(np.maximum(1 - f * f, 1e-9)) / f / math.sqrt(max(m - len(turn) // x.shape[1], 1))
        i, j = np.nonzero((estimate + margin[:, None] >= threshold) & allowed[np.ix_(at, at)])
        for o in range(0, len(i), 262_144):
            a, b = i[o : o + 262_144], j[o : o + 262_144]
            ok = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            out[at[a[ok]], at[b[ok]]] = True
    return out


def connect(total: int, threshold: float):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["hub", "i", "j"]):
            node, first = np.unique(t.column("node").to_numpy(), return_index=True)
            if len(node) < 2:
                continue
            t = t.take(first)
            comp = t.column("comp").to_numpy()
            found = links(t, total, threshold, comp[:, None] != comp[None, :])
            root = labels(found | found.T)
            moved = root != np.arange(len(root))
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], names=["u", "v"])

    return kernel


def count_links(total: int, threshold: float):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["component", "i", "j"]):
            node, copies, block = (t.column(c).to_numpy() for c in ("node", "copies", "block"))
            one = t.column("i")[0].as_py() == t.column("j")[0].as_py()
            allowed = ~np.eye(len(node), dtype=bool) if one else block[:, None] != block[None, :]
            found = links(t, total, threshold, np.triu(allowed))
            n = (found | found.T) @ copies
            if n.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[n > 0]), pa.array(n[n > 0].astype(np.int64))], names=["node", "n"])

    return kernel


def near_embeddings(vectors: DataFrame, *, threshold: float = 0.95, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (see the module's text)."""
    spark = vectors.sparkSession
    stages = Stages(spark, "embedding")
    source = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bits, bands = plan(source.count(), threshold)
    total = bits * bands
    table = stages.write(source.mapInArrow(encode(bits, bands), "vec_id bigint, k1 bigint, k2 bigint, code binary, factor double, unit binary, bands array<bigint>"))
    some = table.where("k1 is not null and vec_id is not null")
    classes = some.groupBy("k1", "k2").agg(F.min("vec_id").alias("node"), F.max("vec_id").alias("last"), F.count(F.lit(1)).alias("copies"), F.max("code").alias("code"), F.max("factor").alias("factor"), F.max("unit").alias("unit"), F.max("bands").alias("bands"))
    classes = stages.write(classes)
    pairs = hubs(stages, classes.select("node", F.explode("bands").alias("bucket")))
    payload = classes.selectExpr("node", "1 as weight", "code", "factor", "unit")
    comps = stages.write(linked(stages, pairs, payload, connect(total, threshold), block_rows=tile))
    whole = comps.union(comps.select("component", "component").distinct())
    sizes = whole.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("nb"))
    parts = whole.join(sizes, "component").selectExpr("component", "node", "nb", "cast(pmod(xxhash64(node), nb) as int) as block")
    parts = parts.selectExpr("component", "node", "block", "explode(sequence(0, nb - 1)) as other").selectExpr("component", "node", "block", "least(block, other) as i", "greatest(block, other) as j")
    parts = parts.join(classes.select("node", "copies", "code", "factor", "unit"), "node")
    counts = spread(parts, "component", "i", "j").mapInArrow(count_links(total, threshold), "node bigint, n bigint").groupBy("node").agg(F.sum("n").alias("n"))
    moved = classes.join(comps, "node", "left").join(counts, "node", "left").where("component is not null or n is not null or copies > 1")
    moved = moved.selectExpr("k1", "k2", "coalesce(n, 0) + copies - 1 as n_links", "coalesce(component, node) as component")
    found = table.select("vec_id", "k1", "k2").join(moved, ["k1", "k2"], "left")
    links_ = F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("bigint")
    comp = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return found.select("vec_id", links_.alias("n_links"), comp.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
