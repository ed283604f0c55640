"""Operator 4: language identification with hyperdimensional profiles.

Each letter class has a random vector of +1 and -1.  A letter trigram binds its letters' vectors, permuted by position
(``roll(a, 2) * roll(b, 1) * c``); a text bundles (adds) the vectors of all its trigrams; a language's prototype bundles
its training texts.  A text gets the language whose prototype has the largest cosine with it.

Letters fold to lower case.  a-z and U+00DF-U+00FF have classes of their own, other letters share 67 more by code point,
so the trigram space is bounded for any script.  Runs of other characters are one word boundary.

Training adds integer vectors per task and then in Spark; only languages * dimensions numbers reach the driver.

:func:`limits` learns what counts as a known language: of the labelled texts of each length class (powers of two of
trigrams) the cosine with their own language that all but ``STRAYS`` of them reach, times ``SLACK``.  A class with fewer
than ``LEAST`` such texts takes the limit of the next shorter one, the shortest 0, so short texts are kept in doubt.
:func:`keep_identified` drops a text without a letter, one whose best cosine is under the limit of its length (noise, or a
language or script never learnt), and every text if nothing was learnt.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing can be
learnt.  The score is the cosine, 0 at least.  Rows with null lang or empty vectors teach nothing; a null doc_id is not
held out.  Ties go to the smaller language name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.deploy import ship

DIM, CLASSES, CAPACITY, BLOCK = 512, 128, 1 << 16, 256
MAX_LANGUAGES = 10_000
#: Share of labelled texts under a class's limit before the slack, the slack, labelled texts a class needs, steps of a cosine.
STRAYS, SLACK, LEAST, STEPS = 0.002, 0.7, 50, 400


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The letter class of every code point, 0 if it is no letter."""
    out = np.zeros(0x110000, np.int32)
    cps = np.fromiter((c for c in range(0x110000) if chr(c).isalpha()), np.int64)
    out[cps] = 60 + cps % 67
    out[97:123] = np.arange(1, 27)
    accented = cps[(cps >= 0xDF) & (cps <= 0xFF)]
    out[accented] = 27 + accented - 0xDF
    return out


def trigrams(text: str) -> np.ndarray:
    """Codes of the trigrams of classes with a letter in the middle."""
    c = classes()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not c.any():
        return c[:0]
    c = np.concatenate([[0], c, [0]])
    c = c[(c != 0) | np.concatenate([[True], c[:-1] != 0])]
    code = (c[:-2] << 14) | (c[1:-1] << 7) | c[2:]
    return code[c[1:-1] != 0]


class Memory:
    """Vectors of the trigrams met so far, at most CAPACITY of them."""

    def __init__(self):
        letter = np.random.default_rng(11).integers(0, 2, (CLASSES, DIM)).astype(np.int8) * 2 - 1
        self.a, self.b, self.c = np.roll(letter, 2, 1), np.roll(letter, 1, 1), letter
        self.clear()

    def clear(self) -> None:
        self.row = np.full(CLASSES**3, -1, np.int32)
        self.vectors = np.empty((4096, DIM), np.float32)
        self.n = 0

    def rows(self, codes: np.ndarray) -> np.ndarray:
        r = self.row[codes]
        if len(r) and r.min() < 0:
            new = np.unique(codes[r < 0])
            if self.n + len(new) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.empty((max(len(new), len(self.vectors)), DIM), np.float32)])
            self.vectors[self.n : self.n + len(new)] = self.a[new >> 14] * self.b[new >> 7 & 127] * self.c[new & 127]
            self.row[new] = np.arange(self.n, self.n + len(new))
            self.n += len(new)
            r = self.row[codes]
        return r

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """One bundled vector per text; a long text is bundled in pieces, so memory stays bounded."""
        return self.counted(texts)[0]

    def counted(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The bundled vectors and the numbers of trigrams."""
        out, number = np.zeros((len(texts), DIM)), np.zeros(len(texts), np.int64)
        pieces = [(i, g[o : o + CAPACITY // 2]) for i, t in enumerate(texts) if t for g in (trigrams(t),) for o in range(0, len(g), CAPACITY // 2)]
        k = 0
        while k < len(pieces):
            if self.n > CAPACITY // 2:
                self.clear()
            owner, rows = [], []
            while k < len(pieces) and self.n <= CAPACITY // 2 and len(rows) < BLOCK:
                owner.append(pieces[k][0])
                rows.append(self.rows(pieces[k][1]))
                k += 1
            counts = np.zeros((len(rows), self.n), np.float32)
            for i, r in enumerate(rows):
                counts[i] = np.bincount(r, minlength=self.n)
            np.add.at(out, owner, counts @ self.vectors[: self.n])
            np.add.at(number, owner, [len(r) for r in rows])
        return out, number


@lru_cache(maxsize=1)
def memory() -> Memory:
    return Memory()


def texts_of(b: pa.RecordBatch, i: int, step: int = BLOCK) -> Iterator[tuple[int, list[str | None]]]:
    for o in range(0, b.num_rows, step):
        yield o, b.column(i).slice(o, step).to_pylist()


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        lang = b.column(0).to_pylist()
        for o, texts in texts_of(b, 1):
            vectors = memory().bundle(texts)
            for name in set(lang[o : o + len(texts)]):
                mine = [x == name for x in lang[o : o + len(texts)]]
                sums[name] = sums.get(name, 0) + vectors[mine].sum(0)
    for name, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * DIM), pa.array(range(DIM), pa.int32()), pa.array(v)], names=["lang", "dim", "value"])


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototypes by language, from all rows of docs with a language."""
    ship(docs.sparkSession)
    some = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col))
    rows = some.mapInArrow(_learn, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value")).limit(MAX_LANGUAGES * DIM + 1).collect()
    if len(rows) > MAX_LANGUAGES * DIM:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out: dict[str, np.ndarray] = {}
    for lang, dim, value in rows:
        out.setdefault(lang, np.zeros(DIM))[dim] = value
    return {k: v / np.sqrt(v @ v) for k, v in sorted(out.items()) if v.any()}


def _predict(prototypes: dict[str, np.ndarray]):
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names]).reshape(len(names), DIM)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score = [], []
            for _, texts in texts_of(b, 2):
                v = memory().bundle(texts)
                norm = np.sqrt(np.einsum("ij,ij->i", v, v))
                cos = v @ matrix.T / np.maximum(norm, 1e-300)[:, None]
                for has, c in zip(norm > 0, cos, strict=True):
                    k = int(c.argmax()) if has and names else -1
                    pred.append(names[k] if k >= 0 else "und")
                    score.append(min(1.0, max(0.0, float(c[k]))) if k >= 0 else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return kernel


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], *, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    some = docs.select(F.col(id_col).alias("doc_id"), (F.lit(False) if held is None else held).alias("held_out"), F.col(text_col).alias("text"))
    return some.mapInArrow(_predict(prototypes), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def _class(n: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(n, 1)).astype(np.int64)


def _own(prototypes: dict[str, np.ndarray]):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((40, STEPS + 1), np.int64)
        for b in batches:
            lang = b.column(0).to_pylist()
            for o, texts in texts_of(b, 1):
                v, n = memory().counted(texts)
                own = np.array([prototypes.get(x, np.zeros(DIM)) for x in lang[o : o + len(texts)]]).reshape(-1, DIM)
                cos = np.einsum("ij,ij->i", v, own) / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-300)
                np.add.at(seen, (_class(n)[n > 0], (np.clip(cos[n > 0], 0, 1) * STEPS).astype(np.int64)), 1)
        k, step = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(step), pa.array(seen[k, step])], names=["size", "step", "n"])

    return kernel


def limits(docs: DataFrame, prototypes: dict[str, np.ndarray], *, text_col: str = "text", lang_col: str = "lang") -> np.ndarray:
    """The least cosine of a known language by length class, from all rows of docs with a learnt language."""
    ship(docs.sparkSession)
    some = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col))
    seen = np.zeros((40, STEPS + 1), np.int64)
    for r in some.mapInArrow(_own(prototypes), "size bigint, step bigint, n bigint").groupBy("size", "step").agg(F.sum("n").alias("n")).collect():
        seen[r["size"], r.step] = r.n
    out, last = np.zeros(40), 0.0
    for k, row in enumerate(seen):
        if row.sum() >= LEAST:
            last = SLACK * int(np.searchsorted(np.cumsum(row), STRAYS * row.sum(), "right")) / STEPS
        out[k] = last
    return out


def keep_identified(docs: DataFrame, prototypes: dict[str, np.ndarray], least: np.ndarray, *, text_col: str = "text") -> DataFrame:
    """docs without the rows whose language is not recognised (see the module's text); all columns stay."""
    ship(docs.sparkSession)
    k = docs.columns.index(text_col)
    matrix = np.array(list(prototypes.values())).reshape(len(prototypes), DIM)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for _, texts in texts_of(b, k):
                v, n = memory().counted(texts)
                norm = np.sqrt(np.einsum("ij,ij->i", v, v))
                top = (v @ matrix.T / np.maximum(norm, 1e-300)[:, None]).max(1, initial=-1)
                keep.append((norm > 0) & (top >= least[_class(n)]))
            yield b.filter(pa.array(np.concatenate(keep) if keep else np.empty(0, bool)))

    return docs.mapInArrow(kernel, docs.schema)
