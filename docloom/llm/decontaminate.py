"""Operator 6: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

Words are runs of bytes other than white space and ASCII punctuation, A-Z folded; in scripts without spaces (Han, kana,
Thai, Lao, Burmese, Khmer) each character is a word.  All matching is on word hashes.

1. Seeds are three words in a row, and four words read in a row or with one word skipped in their middle, on either side:
   a word replaced, left out or put in after every second word still leaves seeds.  One pass over the whole texts looks
   them up in the benchmark's and keeps, for documents with hits, the hits and the hashes of the words around them.
2. Seeds and words of the benchmark are counted over the passages, in Spark.  Each item's seeds are ranked by these counts;
   the rarer half joins passages to the item outright.
3. A common seed joins a passage only to those of its items that also have one of their rarest words there.  An item of n
   words needs ``need`` of them in the passage to reach ``threshold``, so of its n - need + 1 rarest words one must be
   there: the pairs left out are just such as no alignment can accept.  Counts thus decide what a pair costs and never
   whether it is found, however many copies an edited variant has.
4. Pairs are aligned locally, word by word (match 2, mismatch -1, gap -1), unless the passage holds too few of the item's
   words.  The score is the best alignment over 2 * min(words of the item, words of the passage); ``threshold`` or more is
   a copy.  A document shorter than the item must also align ``LEAST_WORDS`` words' worth and ``SHARE`` of the item, or
   else ``threshold`` of the item.
5. Items of under ``LEAST_WORDS`` words (``LEAST_CHARS``, if most of them are characters of scripts without spaces) are
   copies only as a whole: their words in one run, or, under ``WHOLE`` words, as all words of the document.  Their rarest
   seed alone joins them.

The benchmark travels to the workers in chunks of about ``chunk_words`` words; a larger one takes several passes.  The
driver holds one chunk and the counts of its seeds and words.

Defined results: null and empty texts have no hits; repeated rows and items give repeated pairs; a null doc_id gives pairs
with null doc_id.  Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import hashing as H
from .shared import Stages, binary, portions, small

WHOLE, LEAST_WORDS, LEAST_CHARS, SHARE, THRESHOLD, CHUNK_WORDS = 4, 8, 20, 0.25, 0.5, 2_000_000
#: Words that the longest seed spans, and bytes of text that a task turns into Python objects at once.
SPAN, PORTION = 5, 8 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 128 else c for c in range(256))


#: UTF-8 of Han, kana, Thai, Lao, Burmese and Khmer characters, and of CJK and full-width punctuation.
_UNSPACED = re.compile(rb"\xe3\x81[\x80-\xbf]|\xe3[\x82\x83\x90-\xbf][\x80-\xbf]|[\xe4-\xe9][\x80-\xbf]{2}|\xef[\xa4-\xab][\x80-\xbf]|\xf0[\xa0-\xb3][\x80-\xbf]{2}|\xe0[\xb8-\xbb][\x80-\xbf]|\xe1[\x80-\x82\x9e\x9f][\x80-\xbf]")
_MARKS = re.compile(rb"\xe3\x80[\x80-\x82\x88-\x9f]|\xef\xbc[\x81-\x8f\x9a-\xa0]|\xef\xbd[\x9b-\xa5]")


def word_ids(text: bytes | None) -> np.ndarray:
    text = text or b""
    if not text.isascii():
        text = _UNSPACED.sub(rb" \g<0> ", _MARKS.sub(b" ", text))
    data = np.frombuffer(text.translate(_FOLD), np.uint8)
    return H.word_hashes(data, *H.words(data))


def short(text: bytes, n: int) -> bool:
    """Whether an item of n words is looked for as a whole only."""
    return n < LEAST_WORDS or n < LEAST_CHARS and 2 * len(_UNSPACED.findall(text)) > n


def seeds_of(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes by position of three words in a row (of all words, if they are fewer), of four in a row, and of four with
    the word in their middle skipped; the latter two are equal for equal words."""
    if len(w) < 3:
        return H.shingles(w, len(w)), w[:0], w[:0]
    two = H.mix(w[:-1] * H.U64(0xFF51AFD7ED558CCD) + w[1:])
    three = H.mix(two[:-1] * H.U64(0xC4CEB9FE1A85EC53) + w[2:])
    left = two * H.U64(0x9FB21C651E98DF25)
    return three, H.mix(left[:-2] + two[2:]), H.mix(left[:-3] + two[3:])


def places(a: np.ndarray, w: np.ndarray) -> list[int]:
    """Where the words of a short item start in a passage; an item under WHOLE words must be all of it."""
    if len(w) < len(a) or len(a) < WHOLE and len(w) != len(a):
        return []
    return np.flatnonzero((np.lib.stride_tricks.sliding_window_view(w, len(a)) == a).all(1)).tolist()


class Grams:
    """A set of hashes with a bitmap in front."""

    def __init__(self, grams: np.ndarray):
        self.grams = np.unique(grams)
        bits = max(16, int(np.ceil(np.log2(max(len(self.grams), 1)))) + 5)
        self.mask = np.uint64(2**bits - 1)
        self.map = np.zeros(2**bits, bool)
        self.map[self.grams & self.mask] = True

    def at(self, h: np.ndarray) -> np.ndarray:
        """Positions of h that are in the set."""
        p = np.flatnonzero(self.map[h & self.mask])
        if not len(p) or not len(self.grams):
            return p[:0]
        k = np.minimum(np.searchsorted(self.grams, h[p]), len(self.grams) - 1)
        return p[self.grams[k] == h[p]]


def _hits(three: np.ndarray, four: np.ndarray, gap: np.ndarray, longest: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Grams(three), Grams(gap), Grams(np.concatenate([four, gap]))
        for b in portions(batches, 1, PORTION):
            ids, rows = b.column(0).to_pylist(), []
            for i, t in zip(ids, binary(b.column(1)), strict=True):
                w = word_ids(t)
                read = seeds_of(w)
                at = [known.at(h) for known, h in zip(sets, read, strict=True)]
                p = np.concatenate(at)
                if not len(p):
                    continue
                g = np.concatenate([h[x] for h, x in zip(read, at, strict=True)])
                order = np.argsort(p, kind="stable")
                p, g = p[order], g[order]
                # passages: hits nearer than the longest item share one
                edges = [0, *(np.flatnonzero(np.diff(p) > longest) + 1).tolist(), len(p)]
                for x, y in zip(edges[:-1], edges[1:], strict=True):
                    lo, hi = max(0, int(p[x]) - longest), min(len(w), int(p[y - 1]) + SPAN + longest)
                    rows.append((i, lo, (p[x:y] - lo).tolist(), g[x:y].view(np.int64).tolist(), w[lo:hi].tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), *(pa.array(c, k) for c, k in zip(cols[1:], (pa.int64(), longs, longs, pa.binary()), strict=True))], names=["doc_id", "start", "at", "grams", "words"])

    return kernel


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Rows of hits as (doc_id, start, places of the hits, their hashes, word hashes)."""
    for b in portions(batches, 4, PORTION):
        ends = np.cumsum(pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False))[:-1]
        at, grams = (np.split(b.column(k).flatten().to_numpy(), ends) for k in (2, 3))
        words = [np.frombuffer(w, np.uint64) for w in b.column(4).to_pylist()]
        yield b, list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), at, [g.view(np.uint64) for g in grams], words, strict=True))


def _counts(vocabulary: np.ndarray):
    """(key, n): in how many passages of a task each seed, and each word of the benchmark, stands."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, keys, counts = Grams(vocabulary), np.empty(0, np.uint64), np.empty(0, np.int64)
        new: list[np.ndarray] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, at = np.unique(np.concatenate([keys, *new]), return_inverse=True)
            n = np.bincount(at, np.concatenate([counts, np.ones(len(at) - len(keys), np.int64)]), len(k))
            return k, n.astype(np.int64)

        waiting = 0
        for _, rows in _passages(batches):
            for *_, g, w in rows:
                new += [np.unique(g), np.unique(w[known.at(w)])]
                waiting += len(new[-1]) + len(new[-2])
            if waiting > max(1 << 20, len(keys)):
                keys, counts = merged()
                new, waiting = [], 0
        keys, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])

    return kernel


class Postings:
    """Sorted keys, each with its rows (item, place), by item."""

    def __init__(self, keys: np.ndarray, item: np.ndarray, place: np.ndarray):
        order = np.lexsort((place, item, keys))
        self.keys, first, self.size = np.unique(keys[order], return_index=True, return_counts=True)
        self.first, self.item, self.place = first.astype(np.int64), item[order].astype(np.int32), place[order].astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of h that are keys, and the keys' numbers."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        p = np.flatnonzero(self.keys[k] == h)
        return p, k[p]


def spread_out(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[0] .. first[0] + size[0] - 1, first[1] .. and so on."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


class Items:
    """A chunk of the benchmark: words, seeds, and what joins passages to them."""

    def __init__(self, loaded: list[tuple[object, np.ndarray, bool]], threshold: float):
        self.names, self.threshold = [x[0] for x in loaded], threshold
        self.exact = np.array([x[2] for x in loaded], bool)
        self.size = np.array([len(x[1]) for x in loaded], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.words = np.concatenate([x[1] for x in loaded])
        self.vocabulary, self.number = np.unique(self.words, return_inverse=True)
        #: Which words the passage at hand holds; made by each task.
        self.there: np.ndarray | None = None
        parts = []
        for k, (_, w, exact) in enumerate(loaded):
            for form, g in enumerate(seeds_of(w)[: 1 if exact else 3]):
                parts.append((g, np.full(len(g), k), np.arange(len(g)), np.full(len(g), form)))
        self.seed, self.item, self.place, self.form = (np.concatenate(c) for c in zip(*parts, strict=True))

    def need(self, long: bool) -> np.ndarray:
        """How many words of an item a passage must hold; ``long``: one of at least as many words as the item."""
        n, t = self.size, self.threshold
        least = t * np.maximum(n, LEAST_WORDS) if long else np.maximum(t * LEAST_WORDS, np.minimum(np.maximum(LEAST_WORDS, SHARE * n), t * n))
        return np.clip(np.ceil(np.where(self.exact, n, least) - 1e-9).astype(np.int64), 1, n)

    def rank(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Set the joins from the numbers of passages that hold each seed and word."""

        def count(h: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.zeros(len(h), np.int64)
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            return np.where(keys[k] == h, counts[k], 0)

        def places_in(order: np.ndarray, group: np.ndarray) -> np.ndarray:
            """The rank of each row in its group."""
            g = group[order]
            new = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            out = np.empty(len(order), np.int64)
            out[order] = np.arange(len(order)) - np.repeat(new, np.diff(np.r_[new, len(g)]))
            return out

        group = self.item * 3 + self.form
        _, same, held = np.unique(self.seed, return_inverse=True, return_counts=True)
        order = np.lexsort((self.place, self.seed, held[same], count(self.seed), group))
        rank, total = places_in(order, group), np.bincount(group)[group]
        exact = self.exact[self.item]
        rare = np.where(exact, rank == 0, 2 * rank < total)
        self.rare = Postings(self.seed[rare], self.item[rare], self.place[rare])
        rest = ~rare & ~exact
        self.common = Postings(self.seed[rest], self.item[rest], self.place[rest])
        owner = np.repeat(np.arange(len(self.size)), self.size)
        held = np.bincount(self.number)[self.number]
        order = np.lexsort((self.number, held, count(self.words), owner))
        rank = places_in(order, owner)
        self.telling = {}
        for long in (True, False):
            keep = (rank <= (self.size - self.need(long))[owner]) & ~self.exact[owner]
            self.telling[long] = Postings(self.number[keep], owner[keep], np.zeros(int(keep.sum()), np.int64))
        del self.seed, self.item, self.place, self.form

    def met(self, at: np.ndarray, grams: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items that a passage's seeds join and whose alignment can reach the threshold, where the rows of each begin,
        and rows of the seeds' shifts, by item."""
        p, k = self.rare.find(grams)
        rows = spread_out(self.rare.first[k], self.rare.size[k])
        item, shift = [self.rare.item[rows]], [np.repeat(at[p], self.rare.size[k]) - self.rare.place[rows]]
        own = np.searchsorted(self.vocabulary, words)
        own = np.unique(own[self.vocabulary[np.minimum(own, len(self.vocabulary) - 1)] == words])
        p, k = self.common.find(grams)
        if len(p):
            telling = self.telling[bool(len(words) >= self.size.max())]
            _, v = telling.find(own)
            likely = np.unique(telling.item[spread_out(telling.first[v], telling.size[v])])
            for x, j in zip(at[p].tolist(), k.tolist(), strict=True):
                o, n = int(self.common.first[j]), int(self.common.size[j])
                held = self.common.item[o : o + n]
                lo, hi = np.searchsorted(held, likely), np.searchsorted(held, likely, side="right")
                rows = o + spread_out(lo, hi - lo)
                item.append(self.common.item[rows])
                shift.append(x - self.common.place[rows])
        item, shift = np.concatenate(item), np.concatenate(shift)
        order = np.lexsort((shift, item))
        some, begin = np.unique(item[order], return_index=True)
        shift = shift[order]
        if not len(some):
            return some, begin, shift
        if self.there is None:
            self.there = np.zeros(len(self.vocabulary), bool)
        self.there[own] = True
        size = self.size[some]
        held = np.add.reduceat(self.there[self.number[spread_out(self.first[some], size)]], np.cumsum(size) - size, dtype=np.int64)
        self.there[own] = False
        able = held >= np.where(self.exact[some], size, self.threshold * np.maximum(np.minimum(size, len(words)), LEAST_WORDS))
        return np.where(able, some, -1), np.append(begin, len(shift)), shift


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best Smith-Waterman score of word sequences a (item) and b (passage), with its span in b; rows of a at once by b's
    columns: a gap along b is a running maximum."""
    n = len(b)
    h, origin = np.zeros(n + 1, np.int32), np.arange(n + 1, dtype=np.int32)
    best, span = 0, (0, 0)
    ramp = np.arange(n + 1, dtype=np.int32)
    for x in a:
        diag = h[:-1] + np.where(b == x, 2, -1)
        up = h[1:] - 1
        new = np.zeros(n + 1, np.int32)
        src = ramp.copy()
        take = diag >= up
        v = np.where(take, diag, up)
        pos = v > 0
        new[1:][pos] = v[pos]
        src[1:][pos] = np.where(take, origin[:-1], origin[1:])[pos]
        lifted = new + ramp
        top = np.maximum.accumulate(lifted)
        lead = np.maximum.accumulate(np.where(lifted == top, ramp, 0))
        gap = top - ramp
        better = gap > new
        new, src = np.where(better, gap, new), np.where(better, src[lead], src)
        h, origin = new, src
        k = int(h.argmax())
        if h[k] > best:
            best, span = int(h[k]), (int(origin[k]), k)
    return best, *span


def _align(items: Items, kind: pa.DataType):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, passages in _passages(batches):
            rows = []
            for i, start, at, grams, w in passages:
                some, begin, every = items.met(at, grams, w)
                for j in np.flatnonzero(some >= 0).tolist():
                    k = int(some[j])
                    name, a = items.names[k], items.words[items.first[k] : items.first[k] + items.size[k]]
                    shifts = every[begin[j] : begin[j + 1]]
                    if items.exact[k]:
                        if found := places(a, w):
                            rows.append((i, name, 1.0, len(shifts), start + found[0], start + found[0] + len(a)))
                        continue
                    top = None
                    for near in np.split(shifts, np.flatnonzero(np.diff(shifts) > len(a)) + 1):
                        lo, hi = max(0, int(near[0]) - len(a) // 2), min(len(w), int(near[-1]) + len(a) + len(a) // 2)
                        score, s, e = align(a, w[lo:hi])
                        value = score / (2 * max(min(len(a), len(w)), LEAST_WORDS))
                        if score < 2 * min(max(LEAST_WORDS, SHARE * len(a)), items.threshold * len(a)):
                            continue
                        if top is None or value > top[0]:
                            top = (value, len(near), start + lo + s, start + lo + e)
                    if top and top[0] >= items.threshold:
                        rows.append((i, name, *top))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], kind), pa.array(cols[2], pa.float64()), *(pa.array(c, pa.int64()) for c in cols[3:])], names=["doc_id", "item_id", "score", "n_seeds", "word_start", "word_end"])

    return kernel


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, chunk_words: int = CHUNK_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, score, n_seeds, word_start, word_end: the best alignment of each document and item that reaches
    threshold, one row for each passage apart from others by more than the longest item."""
    spark = docs.sparkSession
    stages = Stages(spark, "leaks")
    doc_kind, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    tests = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    letters = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(1, -(-int(letters) // (5 * chunk_words)))
    shape = f"doc_id {doc_kind}, item_id {item_type.simpleString()}, score double, n_seeds bigint, word_start bigint, word_end bigint"
    out = None
    for c in range(chunks):
        part = tests if chunks == 1 else tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c)
        loaded = [(r.item_id, w, short(t, len(w))) for r in part.collect() for t in (r.text.encode("utf-8", "surrogatepass"),) for w in (word_ids(t),) if len(w)]
        if not loaded:
            continue
        items = Items(sorted(loaded, key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0, x[1].tobytes())), threshold)
        known = [np.unique(items.seed[items.form == f]) for f in range(3)]
        hits = stages.write(some.mapInArrow(_hits(*known, int(items.size.max())), f"doc_id {doc_kind}, start bigint, at array<bigint>, grams array<bigint>, words binary"))
        # at most the seeds and words of this chunk
        counts = hits.mapInArrow(_counts(items.vocabulary), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        key, n = counts["key"].to_numpy().view(np.uint64), counts["n"].to_numpy()
        order = np.argsort(key)
        items.rank(key[order], n[order])
        rows = hits.mapInArrow(_align(items, to_arrow_type(item_type)), shape)
        out = rows if out is None else out.union(rows)
    return spark.createDataFrame([], shape) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that hold a copy of a benchmark item; a document without an id cannot be named and stays."""
    stages = Stages(docs.sparkSession, "clean")
    leaked = stages.write(find_leaks(docs, benchmark, threshold=threshold, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("leaked_id")).distinct())
    return docs.join(small(leaked), docs[id_col] == leaked["leaked_id"], "left_anti")
