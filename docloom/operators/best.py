"""The k best rows of many queries by cosine (C18): matrix products inside a task, which find the few pairs that may count,
and exact scores of these.

A score is the sum of products in the order of the components, rounded to six places as Spark rounds; the matrix product only
rules out what is farther below the k-th score so far than rounding can make up for.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries and rows of one product, and rows of the first one, which sets the bounds.
QUERIES, ROWS, FIRST = 1024, 2048, 64
_SIX = Decimal("0.000001")


def vectors(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and double matrix of the lists of each length; lists without score (null, zero, not finite) are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        flat = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
        good = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
        if good.any():
            yield at[good], flat[good]


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of products of the rows of x and y, component by component."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * y[:, k]
    return out


def rounded(x: np.ndarray) -> np.ndarray:
    """Six places, halves up by the decimal that a double is written as."""
    y = np.abs(x) * 1e6
    out = np.copysign(np.rint(y) / 1e6, x)
    for k in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-4):
        out[k] = float(Decimal(repr(float(x[k]))).quantize(_SIX, ROUND_HALF_UP))
    return out


class Best:
    """The k best rows so far of queries q (a matrix): scores descending, ties by id.  ``scaled`` divides by the lengths."""

    def __init__(self, q: np.ndarray, k: int, *, scaled: bool = True, least: np.ndarray | None = None):
        self.q, self.k, self.scaled = q, k, scaled
        self.size = dots(q, q)
        self.unit = q / np.sqrt(self.size)[:, None] if scaled else q
        self.score, self.id = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        # scores that other rows reach already
        self.least = np.full(len(q), -np.inf) if least is None else least
        self.last = None

    def add(self, ids: np.ndarray, rows: np.ndarray, far: np.ndarray | None = None, low: np.ndarray | None = None, high: np.ndarray | None = None) -> None:
        """Rows, those of ``far`` from ``low`` to ``high`` of a query if given."""
        order = np.argsort(ids, kind="stable")
        ids, rows, far = ids[order], rows[order], None if far is None else far[order]
        size = dots(rows, rows)
        unit = rows / np.sqrt(size)[:, None] if self.scaled else rows
        at = 0
        while at < len(ids):
            n = FIRST if self.last is None else ROWS
            to = min(len(ids), at + n)
            # a row of a greater id than all before must be better than the k-th by a whole place
            later = self.last is not None and ids[at] > self.last
            for b in range(0, len(self.q), QUERIES):
                e = min(len(self.q), b + QUERIES)
                kth = self.score[b:e, -1]
                bar = np.maximum(kth + (4.9e-7 if later else -6e-7), self.least[b:e] - 6e-7)
                hit = self.unit[b:e] @ unit[at:to].T >= bar[:, None]
                if far is not None:
                    hit &= (far[None, at:to] >= low[b:e, None]) & (far[None, at:to] <= high[b:e, None])
                i, j = np.nonzero(hit)
                if len(i):
                    self._merge(i + b, j + at, ids, rows, size)
            self.last = ids[to - 1] if self.last is None else max(self.last, ids[to - 1])
            at = to

    def _merge(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray, rows: np.ndarray, size: np.ndarray) -> None:
        score = dots(self.q[i], rows[j])
        score = rounded(score / np.sqrt(self.size[i] * size[j]) if self.scaled else score)
        some = np.unique(i)
        who = np.concatenate([i, np.repeat(some, self.k)])
        score, row = np.concatenate([score, self.score[some].ravel()]), np.concatenate([ids[j], self.id[some].ravel()])
        order = np.lexsort((row, -score, who))
        place = order[np.searchsorted(who[order], some)[:, None] + np.arange(self.k)]
        self.score[some], self.id[some] = score[place], row[place]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the queries, ids and scores."""
        i, r = np.nonzero(np.isfinite(self.score))
        return i, self.id[i, r], self.score[i, r]


def table(q_ids: pa.Array, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    i, row, score = (np.concatenate([f[c] for f in found]) if found else np.empty(0, t) for c, t in enumerate((np.int64, np.int64, np.float64)))
    return pa.table({"q_id": q_ids.take(pa.array(i, pa.int64())), "vec_id": pa.array(row, pa.int64()), "score": pa.array(score)})
