"""Operator 9: quality classifier, a generalised additive model with pairwise interactions.

1. ``features`` turns every whole text into numbers (shape of words, symbols, repetition), vectorised over its bytes.
2. ``Model.fit`` boosts shallow trees cyclically: each step fits a tree of at most four leaves on one feature's bins
   (or on a pair's grid) to the logistic gradient and adds it to that feature's lookup table.  Pairs are chosen by the
   gain of a first grid step on the residuals of the additive part.
3. A score adds one table entry per feature and per pair, then the logistic function.

Fitting uses at most ``TRAIN_ROWS`` labelled rows, chosen by hash of doc_id; the bound is a parameter.  Scoring and
features cover all rows.  Defined results: a null or empty text has features like a text without words and is scored;
without labels of both kinds every score is the share of label 1 (0.5 without labels).  Rows that repeat are scored
alike; labels of null quality or of no document teach nothing; a null doc_id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .shared import Stages, binary, pieces

NAMES = ("words", "word_bytes", "upper", "symbols", "digits", "distinct", "top_word", "same_next", "same_lines", "no_letter", "line_bytes", "symbol_runs", "ends", "short", "distinct_pairs", "bangs")
TRAIN_ROWS, BINS, GRID, PAIRS, CYCLES, PAIR_CYCLES, RATE = 20_000, 32, 8, 6, 120, 60, 0.15

_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_HIGH = np.zeros(256, bool)
_HIGH[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = ~(_LOWER | _UPPER | _HIGH | _DIGIT | H.SPACE)
#: 0 space, 1 lower, 2 upper, 3 digit, 4 symbol, 5 high byte
_KIND = (_LOWER * 1 + _UPPER * 2 + _DIGIT * 3 + _SYMBOL * 4 + _HIGH * 5).astype(np.uint8)


def features(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    out = np.zeros(len(NAMES), np.float32)
    start, end = H.words(data)
    n = len(start)
    if not n:
        return out
    kind = _KIND[data]
    counts = np.bincount(kind, minlength=6)
    solid = len(data) - counts[0]
    letters = counts[1] + counts[2] + counts[5]
    h = H.word_hashes(data, start, end)
    _, per = np.unique(h, return_counts=True)
    same = h[1:] == h[:-1]
    pair = np.sort(h[1:] * np.uint64(3) + h[:-1])
    letter = np.add.reduceat(((kind == 1) | (kind == 2) | (kind == 5)).astype(np.int32), start)
    run = (kind[1:] == 4) & (kind[:-1] == 4)
    lines = [x for x in text.split(b"\n") if x.strip()]
    out[:] = (
        np.log1p(n),
        solid / n,
        counts[2] / max(letters, 1),
        counts[4] / solid,
        counts[3] / solid,
        len(per) / n,
        per.max() / n,
        same.mean() if n > 1 else 0,
        1 - len(set(lines)) / max(len(lines), 1),
        (letter == 0).mean(),
        np.log1p(len(data) / max(len(lines), 1)),
        run.sum() / n,
        (data[end - 1] == 46).mean(),
        (end - start <= 3).mean(),
        ((pair[1:] != pair[:-1]).sum() + 1) / (n - 1) if n > 1 else 1,
        (data == 33).sum() / n,
    )
    return out


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        rows = np.concatenate([features(t or b"") for t in binary(b.column(2))]) if b.num_rows else np.empty(0, np.float32)
        offsets = np.arange(0, len(rows) + 1, len(NAMES), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, pa.array(rows, pa.float32()))], names=["doc_id", "held_out", "features"])


def tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values by bin of a greedy tree with so many leaves at most, on gradient and Hessian sums by bin."""
    out = np.zeros(len(g))
    parts = [(0, len(g))]
    gain = lambda a, b: a * a / (b + 1.0)
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for lo, hi in parts:
            if hi - lo > 1:
                a, b = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
                x = gain(a[:-1], b[:-1]) + gain(a[-1] - a[:-1], b[-1] - b[:-1]) - gain(a[-1], b[-1])
                k = int(x.argmax())
                if x[k] > best[0]:
                    best = (x[k], (lo, hi), lo + k + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1.0)
    return out


def grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values by cell of the best depth-two tree on a grid (one cut by row, then one by column on each side), and its gain."""
    best, out = 0.0, np.zeros_like(g)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for cut in range(1, len(a)):
            value, total = np.zeros_like(a), 0.0
            for rows in (slice(0, cut), slice(cut, None)):
                t = tree(a[rows].sum(0), b[rows].sum(0), 2)
                value[rows] = t
                total += float((t * a[rows].sum(0)).sum())
            if total > best:
                best, out = total, value.T if turn else value
    return out, best


@dataclass
class Model:
    """Lookup tables: edges and table by feature, coarse edges and grid by pair."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Model:
        if not len(y) or y.min() == y.max():
            return cls(base=float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)))
        m = cls(base=float(np.clip(y.mean(), 1e-3, 1 - 1e-3)))
        cuts = lambda n: [np.unique(np.quantile(c, np.arange(1, n) / n)) for c in x.T.astype(np.float64)]
        m.edges, m.coarse = cuts(BINS), cuts(GRID)
        bins = [np.searchsorted(e, c, "right") for e, c in zip(m.edges, x.T, strict=True)]
        m.tables = [np.zeros(len(e) + 1) for e in m.edges]
        margin = np.full(len(y), m._logit())
        grad = lambda: (y - (p := 1 / (1 + np.exp(-margin))), p * (1 - p))
        for _ in range(CYCLES):
            for b, t in zip(bins, m.tables, strict=True):
                g, h = (np.bincount(b, w, len(t)) for w in grad())
                step = RATE * tree(g, h, 4)
                t += step
                margin += step[b]
        rough = [np.searchsorted(e, c, "right") for e, c in zip(m.coarse, x.T, strict=True)]

        def cells(i: int, j: int) -> tuple[np.ndarray, tuple[int, int]]:
            shape = (len(m.coarse[i]) + 1, len(m.coarse[j]) + 1)
            return rough[i] * shape[1] + rough[j], shape

        found = []
        w = grad()
        for i in range(x.shape[1]):
            for j in range(i + 1, x.shape[1]):
                c, shape = cells(i, j)
                g, h = (np.bincount(c, v, shape[0] * shape[1]).reshape(shape) for v in w)
                found.append((-grid_tree(g, h)[1], i, j))
        m.pairs = [(i, j, np.zeros(cells(i, j)[1])) for _, i, j in sorted(found)[:PAIRS]]
        for _ in range(PAIR_CYCLES):
            for i, j, t in m.pairs:
                c, shape = cells(i, j)
                g, h = (np.bincount(c, v, shape[0] * shape[1]).reshape(shape) for v in grad())
                step = RATE * grid_tree(g, h)[0]
                t += step
                margin += step.ravel()[c]
        return m

    def _logit(self) -> float:
        return float(np.log(self.base / (1 - self.base)))

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self._logit())
        for k, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            margin += t[np.searchsorted(e, x[:, k], "right")]
        for i, j, t in self.pairs:
            margin += t[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-margin))


def _score(model: Model):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return kernel


def classify(docs: DataFrame, labels: DataFrame, *, held: Column, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; learns from rows of labels that are not held out."""
    spark = docs.sparkSession
    stages = Stages(spark, "quality")
    kind = docs.schema[id_col].dataType.simpleString()
    some = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    table = stages.write(some.mapInArrow(extract, f"doc_id {kind}, held_out boolean, features array<float>"))
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    rows = table.where("not held_out").join(known, "doc_id").orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id", "label", "features").limit(train_rows).collect()
    x = np.array([r.features for r in rows], np.float32).reshape(-1, len(NAMES))
    model = Model.fit(x, np.array([r.label for r in rows], np.float64))
    return table.mapInArrow(_score(model), f"doc_id {kind}, held_out boolean, score double, predicted int")
