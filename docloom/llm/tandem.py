"""Periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of words with smallest period q (words q apart are identical) that no neighbouring word extends, of at
least ``least`` words and ``power`` periods.  Texts stay in their rows; every task works on its record batches:

1. A run of period q repeats every pair of words within q words, for three periods on end.  Stretches where that can hold are
   the only text that can touch a run (:func:`regions`); everything else has none and is left.  The union of such stretches
   holds every run whole, so this loses nothing.
2. The stretches, parted by words of their own, form one sequence.  Names of all substrings of 1, 2, 4, ... words give its
   suffix array and longest common extensions; intervals of the array are the nodes of its suffix tree (:class:`Index`).
3. Lempel-Ziv blocks: the right half of a square meets at most two blocks, so extensions about block borders find a square at
   or left of the leftmost place of every square, from which the places between are squares too (:func:`leftmost_cover`).
4. From each of these, suffix-link walks rotate the square by one word: drop the first word (suffix link), descend by it.  The
   walks end at squares already marked, or where no place has the rotated one; then every kind of square is marked
   (:func:`vocabulary`).
   Only squares whose root is no power of a shorter stretch are walked; the others lie in the runs of those.
5. Squares are located by their intervals, at most O(n log n) places, and places side by side merge into runs
   (:func:`merged`).

Defined results: null text counts as empty (no words, no run); rows with repeated or null identifiers are each treated for
themselves; other columns are not looked at, whatever their names.  Memory of a task is O(m log m) for the m words of the
stretches of one portion of texts (about 4 MB, or one longer text).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.deploy import ship
from .shared import binary, portions

LEAST, POWER = 6, 4
#: Bytes of text whose words are looked at together.
PORTION = 4 << 20
NEVER = np.iinfo(np.int64).max


def regions(w: np.ndarray, ends: np.ndarray, least: int = LEAST, power: int = POWER) -> np.ndarray:
    """Rows (start, end) of disjoint stretches of the words w that hold every run whole; texts end at ``ends``."""
    n = len(w)
    if n < least:
        return np.empty((0, 2), np.int64)
    ends = np.unique(ends[ends > 0])  # of texts with words
    last = np.zeros(n, bool)
    last[ends - 1] = True
    text = np.cumsum(last) - last
    at = np.flatnonzero(~last)
    bits = int(n).bit_length()
    pair = w[at] * (int(w.max()) + 1) + w[at + 1]
    if int(pair.max(initial=0)).bit_length() + bits > 62:
        pair = np.unique(pair, return_inverse=True)[1]
    key = np.sort((pair << bits) | at)
    value, at = key >> bits, key & ((1 << bits) - 1)
    again = np.flatnonzero((value[1:] == value[:-1]) & (text[at[1:]] == text[at[:-1]])) + 1
    back = np.full(n, NEVER)
    back[at[again]] = at[again] - at[again - 1]
    near = np.flatnonzero(back < NEVER)
    back = back[near]
    longest, found, cap = int(np.diff(ends, prepend=0).max()), [], 1
    while power * (cap // 2 + 1) <= longest:
        # periods above cap / 2 and up to cap: so many pairs on end repeat within cap words
        q = cap // 2 + 1
        some = near[back <= cap]
        cut = np.flatnonzero(np.diff(some) != 1)
        first, stop = np.r_[0, cut + 1][: len(some)], np.r_[cut, len(some) - 1][: len(some)]
        need = max((power - 1) * q, least - cap) - 1
        if need < 1:  # so short that no pair of words repeats: all texts
            return np.stack([np.r_[0, ends[:-1]], ends], 1)
        fits = stop - first + 1 >= need
        if fits.any():
            first, stop = some[first[fits]], some[stop[fits]]
            begin = np.r_[0, ends][text[first]]
            found.append(np.stack([np.maximum(first - cap, begin), stop + 2], 1))
        cap *= 2
    if not found:
        return np.empty((0, 2), np.int64)
    spans = np.concatenate(found)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    # stretches of two texts may touch at the border between them, and are told apart by their text
    new = np.r_[True, (spans[1:, 0] > reach[:-1]) | (text[spans[1:, 0]] != text[spans[:-1, 0]])]
    return np.stack([spans[new, 0], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(spans) - 1]]], 1)


def _minima(a: np.ndarray) -> list[np.ndarray]:
    out, k = [a], 1
    while 2 * k <= len(a):
        out.append(np.minimum(out[-1][:-k], out[-1][k:]))
        k *= 2
    return out


def _leftward(m: list[np.ndarray], at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many values on end, up to and with ``at``, are at least x."""
    pos = at.copy()
    for k in range(len(m) - 1, -1, -1):
        s = pos - (1 << k) + 1
        pos -= ((s >= 0) & (m[k][np.clip(s, 0, len(m[k]) - 1)] >= x)).astype(np.int64) << k
    return at - pos


def _rightward(m: list[np.ndarray], at: np.ndarray, x: np.ndarray) -> np.ndarray:
    pos = at.copy()
    for k in range(len(m) - 1, -1, -1):
        pos += ((pos < len(m[k])) & (m[k][np.minimum(pos, len(m[k]) - 1)] >= x)).astype(np.int64) << k
    return pos - at


class Index:
    """Suffix array, ranks and common extensions of a sequence whose last word occurs once."""

    def __init__(self, t: np.ndarray):
        n = len(t)
        r = np.unique(t, return_inverse=True)[1].astype(np.int64)
        names, k = [r.astype(np.int32)], 1
        while int(r.max()) < n - 1:
            right = np.zeros(n, np.int64)
            right[: n - k] = r[k:] + 1
            key = r * (n + 1) + right
            order = np.argsort(key)
            key = key[order]
            r = np.empty(n, np.int64)
            r[order] = np.r_[0, np.cumsum(key[1:] != key[:-1])]
            names.append(r.astype(np.int32))
            k *= 2
        self.n, self.names, self.rank, self.t = n, names[: max(len(names) - 1, 1)], r, names[0]
        self.sa = np.empty(n, np.int64)
        self.sa[r] = np.arange(n)
        self.lcp = _minima(np.r_[-1, self.ahead(self.sa[:-1], self.sa[1:])])

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words on end from i and from j <> i."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a = self.names[k]
            out += (a[i + out] == a[j + out]).astype(np.int64) << k
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words on end up to and with i and j <> i; none where one is -1."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a, x, y = self.names[k], i - out - (1 << k) + 1, j - out - (1 << k) + 1
            out += ((x >= 0) & (y >= 0) & (a[np.maximum(x, 0)] == a[np.maximum(y, 0)])).astype(np.int64) << k
        return out

    def low(self, r: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """First rank of the node at this depth above the leaf of rank r."""
        return r - _leftward(self.lcp, r, depth)

    def high(self, r: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return r + _rightward(self.lcp, r + 1, depth)


def blocks(ix: Index) -> np.ndarray:
    """Borders of the Lempel-Ziv blocks: each is the longest stretch that starts earlier too, or a new word."""
    m, r = _minima(ix.sa), np.arange(ix.n)
    before, after = r - 1 - _leftward(m, r - 1, ix.sa), r + 1 + _rightward(m, r + 1, ix.sa)
    longest = np.zeros(ix.n, np.int64)
    for other in (before, after):
        has = np.flatnonzero((other >= 0) & (other < ix.n))
        i = ix.sa[has]
        longest[i] = np.maximum(longest[i], ix.ahead(i, ix.sa[other[has]]))
    out, h, steps = [0], 0, np.maximum(longest, 1).tolist()
    while h < ix.n:
        h += steps[h]
        out.append(h)
    return np.array(out, np.int64)


def _up_to(most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and 1, 2, ..., most of each row."""
    row = np.repeat(np.arange(len(most)), most)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(most) - most, most) + 1


def leftmost_cover(ix: Index) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of squares, among them one at or left of the leftmost place of each kind of square, with squares
    of that period at all places between."""
    edge = blocks(ix)
    # right half inside a block: the square starts before the block, whose border is in the left half
    h, size = edge[1:-1], np.diff(edge)[1:]
    row, k = _up_to(np.minimum(size, ix.n - 1 - h))
    b = h[row]
    ahead, behind = ix.ahead(b, b + k), ix.behind(b - 1, b + k - 1)
    i1 = np.maximum(b - behind, b - k)
    ok1 = (behind > 0) & (i1 + k <= b + ahead)
    # right half over the border of two blocks
    both = np.diff(edge)[:-1] + np.diff(edge)[1:]
    row, k2 = _up_to(np.minimum(both, h))
    b = h[row]
    ahead, behind = ix.ahead(b - k2, b), ix.behind(b - k2 - 1, b - 1)
    i2 = np.maximum(b - k2 - behind, b - 2 * k2 + 1)
    ok2 = (behind > 0) & (ahead > 0) & (i2 >= 0) & (i2 + 2 * k2 <= b + ahead)
    return np.r_[i1[ok1], i2[ok2]], np.r_[k[ok1], k2[ok2]]


def primitive(ix: Index, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the half of each square is no power of a shorter stretch."""
    factor = np.arange(int(period.max(initial=1)) + 1)
    for d in range(2, int(len(factor) ** 0.5) + 1):
        if factor[d] == d:
            part = factor[d * d :: d]
            part[part == np.arange(d * d, len(factor), d)] = d
    left, out = period.copy(), np.ones(len(start), bool)
    while (more := np.flatnonzero(left > 1)).size:
        d = factor[left[more]]
        shift = period[more] // d
        out[more] &= ix.ahead(start[more], start[more] + shift) < period[more] - shift
        left[more] //= d
    return out


def vocabulary(ix: Index, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rank and period of every kind of square of a primitive root, from a leftmost cover.

    While the next word in the text is the one that a walk descends by, its suffix links lead along the text; such a stretch
    of a walk, of one period at most, is taken at once.  Where it ends, one link and descent through the array decides.
    """
    width = ix.n + 1
    prim = primitive(ix, start, period)
    i, p = start[prim], period[prim]
    seen = np.empty(0, np.int64)
    while len(i):
        row, k = _up_to(np.minimum(ix.ahead(i, i + p) - p + 1, p))
        codes = ix.low(ix.rank[i[row] + k - 1], 2 * p[row]) * width + p[row]
        last = np.unique(codes[np.r_[row[1:] != row[:-1], True]])
        last = last[~np.isin(last, seen, assume_unique=True)]
        seen = np.union1d(seen, codes)
        low, p = last // width, last % width
        i = ix.sa[low]
        # suffix link: the node of the square without its first word
        inner, r, word = 2 * p - 1, ix.rank[i + 1], ix.t[i]
        lo, hi = ix.low(r, inner), ix.high(r, inner) + 1
        # its child by that word
        end = hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            less = ix.t[np.minimum(ix.sa[np.minimum(mid, ix.n - 1)] + inner, ix.n - 1)] < word
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        there = lo < end
        there[there] = ix.t[ix.sa[lo[there]] + inner[there]] == word[there]
        fresh = np.unique(lo[there] * width + p[there])
        fresh = fresh[~np.isin(fresh, seen, assume_unique=True)]
        i, p = ix.sa[fresh // width], fresh % width
    return seen // width, seen % width


def merged(ix: Index, low: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of the runs of at least two periods, from the kinds of squares."""
    row, k = _up_to(ix.high(low, 2 * period) - low + 1)
    place = np.unique(period[row] * ix.n + ix.sa[low[row] + k - 1])
    cut = np.flatnonzero((np.diff(place) != 1) | (place[1:] % ix.n == 0))
    first, stop = place[np.r_[0, cut + 1][: len(place)]], place[np.r_[cut, len(place) - 1][: len(place)]]
    p, s = first // ix.n, first % ix.n
    return np.stack([s, stop - first + 2 * p, p], 1)


def word_runs(w: np.ndarray, ends: np.ndarray, least: int = LEAST, power: int = POWER) -> np.ndarray:
    """Rows (start, length, period) of the runs of the words w (not negative) of texts that end at ``ends``."""
    spans = regions(w, ends, least, power)
    if not len(spans):
        return np.empty((0, 3), np.int64)
    size = spans[:, 1] - spans[:, 0] + 1
    shift = np.cumsum(size) - size
    row, k = _up_to(size)
    at = spans[row, 0] + k - 1
    end = k == size[row]
    # each stretch ends with a word of its own
    t = np.where(end, int(w.max()) + 1 + row, w[np.minimum(at, len(w) - 1)])
    ix = Index(t)
    found = merged(ix, *vocabulary(ix, *leftmost_cover(ix)))
    found = found[found[:, 1] >= np.maximum(least, power * found[:, 2])]
    home = np.searchsorted(shift, found[:, 0], side="right") - 1
    found[:, 0] += spans[home, 0] - shift[home]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _find(least: int, power: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 1, PORTION):
            names = defaultdict(count().__next__)
            texts = [(t or b"").split() for t in binary(b.column(1))]  # ASCII white space, as bytes
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            w = np.fromiter((names[x] for t in texts for x in t), np.int64, int(ends[-1]) if len(ends) else 0)
            del names
            runs = word_runs(w, ends, least, power) if len(w) else np.empty((0, 3), np.int64)
            home = np.searchsorted(ends, runs[:, 0], side="right")
            edge = np.searchsorted(home, np.arange(len(texts) + 1))
            begin = np.r_[0, ends]
            out, kept = [], []
            for k, t in enumerate(texts):
                mine = runs[edge[k] : edge[k + 1]] - [begin[k], 0, 0]
                mine = [dict(zip(("start", "length", "period"), r, strict=True)) for r in mine.tolist()]
                out.append(mine)
                if mine:
                    drop = np.zeros(len(t), bool)
                    for r in mine:
                        drop[r["start"] + r["period"] : r["start"] + r["length"]] = True
                    t = [x for x, d in zip(t, drop.tolist(), strict=True) if not d]
                kept.append(b" ".join(t))
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            size = pa.array(np.diff(begin), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(out, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return find


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str | Column = "text", least: int = LEAST, power: int = POWER) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start, then period), collapsed (the words without those that a
    run repeats, joined by one space) of every row of docs (see the module's text).  ``power`` is at least 2."""
    if power < 2:
        raise ValueError("a run holds two periods at least")
    ship(docs.sparkSession)
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(_find(least, power), f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


#: The text with a planted run: where crc32 of the identifier is divisible by ten, words from some place on repeat.
PLANTED = r"""case when pmod(crc32(cast(cast(doc_id as string) as binary)), 10) = 0 then
    transform(array(named_struct('w', filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> ''), 'g', crc32(cast(cast(doc_id as string) as binary)) div 10)), r ->
    transform(array(named_struct('w', r.w, 'g', r.g, 'n', size(r.w), 'a', if(size(r.w) = 0, 0, cast(r.g % size(r.w) as int)))), s ->
      if(s.n = 0, text, array_join(concat(slice(s.w, 1, s.a), transform(sequence(s.a, s.n - 1), i -> s.w[s.a + (i - s.a) % cast(1 + (s.n - s.a) div (3 + s.g % 8) as int)])), ' ')))[0])[0]
    else text end"""


def digests(runs: DataFrame) -> DataFrame:
    """The digest columns of the result of :func:`find_runs`."""
    # exact order of length / period; ties by start, then period, in which order the runs stand
    best = "aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (a, r) -> if(a is null or r.length * a.period > a.length * r.period, r, a))"
    out = runs.withColumn("best", F.expr(best))
    text = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    return out.selectExpr(
        "doc_id", "cast(size(runs) as bigint) as n_runs", "best.start as start", "best.length as length", "best.period as period", "1000 * best.length div best.period as exponent_milli",
        f"sha2({text}, 256) as runs_sha256", "sha2(collapsed, 256) as collapsed_sha256",
    )
