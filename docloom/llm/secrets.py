"""Operator 7: secret scans with a character convolutional network in numpy.

1. One pass over the whole texts finds the base spans (fixed patterns below) and every further candidate, a run of 12 or
   more characters of ``A-Z a-z 0-9 + / _ = . -`` with a digit in it, and keeps a window of text around each.
2. The network is trained on labelled findings: base findings of the corpus (at most ``TRAIN_ROWS``, by hash of the
   window), seeded synthetic keys of random structure (prefix, alphabet, segments, length) and harmless look-alikes.
   The corpus's other candidates carry no label, since leaks that no base pattern knows are among them: of at most
   ``TRAIN_ROWS`` of those, a first network takes as harmless only the ones that score below what ``SURE`` of the positive
   findings reach; the rest teach nothing.
3. A part held back calibrates the logit (Platt scaling); another sets the threshold, the highest that keeps ``RECALL`` of
   its positive findings.
4. Every candidate is scored; those that reach the threshold and touch no base span are added as kind ``neural``.

Kinds are numbered in the order assign, access, hex, neural.  Offsets are code points, end exclusive.  Defined results: a
null or empty text has no spans (the hash is that of the empty string); repeated rows give repeated results; a null
doc_id is passed on.  Long candidates are scored by overlapping windows, the highest counts.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Stages, pieces

KINDS = ("assign", "access", "hex", "neural")
#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")

BEFORE, BODY, AFTER, STRIDE = 24, 48, 8, 36
WIDTH = BEFORE + BODY + AFTER
TRAIN_ROWS, RECALL, SURE = 2_000, 0.99, 0.999

_HEXMAP = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))
_TOKEN = np.zeros(256, np.int8)
_TOKEN[[*b"+/_=.-", *range(65, 91), *range(97, 123)]] = 1
_TOKEN[48:58] = 2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base findings in order."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "apikey" in low or "api_key" in low:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if "x" * 32 in text.encode("utf-8", "surrogatepass").translate(_HEXMAP).decode("ascii"):
        out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def candidates(text: str) -> list[tuple[int, int]]:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kind = _TOKEN[data]
    inside = np.concatenate([[0], (kind > 0).view(np.int8), [0]])
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not (end - start >= 12).any():
        return []
    digits = np.concatenate([[0], np.cumsum(kind == 2)])
    if not ((end - start >= 12) & (digits[end] > digits[start])).any():
        return []
    return [m.span() for m in CANDIDATE.finditer(text) if any(c in string.digits for c in m[0])]


def touched(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each span overlaps a base span (one sweep over the merged base spans)."""
    start, end = [], []
    for s, e, _ in base:
        if end and s <= end[-1]:
            end[-1] = max(end[-1], e)
        else:
            start.append(s)
            end.append(e)
    return [(k := bisect_left(start, e)) > 0 and end[k - 1] > s for s, e in spans]


def windows(text: str, start: int, end: int) -> list[bytes]:
    """ASCII windows over a candidate: BEFORE characters of context, BODY of it, AFTER that follow."""
    out = []
    for s in range(start, max(end - BODY, start) + STRIDE, STRIDE):
        if s > start and s >= end:
            break
        e = min(s + BODY, end)
        w = text[max(0, s - BEFORE) : s].rjust(BEFORE, "\0") + text[s:e].ljust(BODY, "\1") + text[e : e + AFTER].ljust(AFTER, "\0")
        out.append(w.encode("ascii", "replace"))
        if e == end:
            break
    return out


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.int64())
    for b in pieces(batches):
        rows = []
        for t in b.column(1).to_pylist():
            t = t or ""
            base = base_spans(t)
            cand = candidates(t)
            own = touched(cand, base)
            parts = [windows(t, s, e) for s, e in cand]
            rows.append(([x for s in base for x in s], [x for s in cand for x in s], own, [len(p) for p in parts], b"".join(w for p in parts for w in p)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (span, span, pa.list_(pa.bool_()), span, pa.binary()), strict=True))], names=["doc_id", "base", "cand", "own", "parts", "windows"])


class Net:
    """Character embedding, one convolution with maximum pooling over the candidate and over its context, one hidden layer."""

    E, K, C, N = 8, 5, 24, 32

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {"emb": r.normal(0, 0.5, (128, self.E)), "w": r.normal(0, 0.2, (self.K * self.E, self.C)), "b": np.zeros(self.C), "w1": r.normal(0, 0.2, (3 * self.C, self.N)), "b1": np.zeros(self.N), "w2": r.normal(0, 0.2, self.N), "b2": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.scale, self.shift, self.threshold, self.positives = 1.0, 0.0, 0.5, np.zeros(0)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        p, n, m = self.p, len(x), WIDTH - self.K + 1
        e = p["emb"][x]
        cols = np.concatenate([e[:, k : k + m] for k in range(self.K)], 2)
        z = cols.reshape(-1, self.K * self.E) @ p["w"] + p["b"]
        a = np.maximum(z, 0).reshape(n, m, self.C)
        before, body = a[:, : BEFORE - self.K + 1], a[:, BEFORE - self.K + 1 : BEFORE + BODY]
        real = (x[:, BEFORE : BEFORE + BODY] != 1)[:, :, None]
        real = np.concatenate([np.ones((n, body.shape[1] - BODY, 1), bool), real], 1)[:, : body.shape[1]]
        count = real.sum(1)
        i0, i1 = before.argmax(1), (body * real).argmax(1)
        f = np.concatenate([np.take_along_axis(before, i0[:, None], 1)[:, 0], np.take_along_axis(body, i1[:, None], 1)[:, 0], (body * real).sum(1) / count], 1)
        h = np.maximum(f @ p["w1"] + p["b1"], 0)
        return h @ p["w2"] + p["b2"][0], {"cols": cols, "a": a, "i0": i0, "i1": i1, "real": real, "count": count, "f": f, "h": h}

    def step(self, x: np.ndarray, y: np.ndarray, state: dict, rate: float) -> None:
        p, n, m = self.p, len(x), WIDTH - self.K + 1
        logit, c = self.forward(x)
        d = ((1 / (1 + np.exp(-logit)) - y) / n).astype(np.float32)
        g = {"w2": c["h"].T @ d, "b2": np.array([d.sum()])}
        dh = d[:, None] * p["w2"] * (c["h"] > 0)
        g["w1"], g["b1"] = c["f"].T @ dh, dh.sum(0)
        df = dh @ p["w1"].T
        da = np.zeros_like(c["a"])
        rows, ch = np.arange(n)[:, None], np.arange(self.C)[None]
        da[rows, c["i0"], ch] += df[:, : self.C]
        da[rows, c["i1"] + BEFORE - self.K + 1, ch] += df[:, self.C : 2 * self.C]
        da[:, BEFORE - self.K + 1 : BEFORE + BODY] += c["real"] * (df[:, 2 * self.C :] / c["count"])[:, None]
        dz = (da * (c["a"] > 0)).reshape(-1, self.C)
        g["w"], g["b"] = c["cols"].reshape(-1, self.K * self.E).T @ dz, dz.sum(0)
        dcols = (dz @ p["w"].T).reshape(n, m, self.K, self.E)
        de = np.zeros((n, WIDTH, self.E), np.float32)
        for k in range(self.K):
            de[:, k : k + m] += dcols[:, :, k]
        g["emb"] = np.zeros_like(p["emb"])
        np.add.at(g["emb"], x.ravel(), de.reshape(-1, self.E))
        state["t"] = t = state.get("t", 0) + 1
        for k in p:
            s = state.setdefault(k, [np.zeros_like(p[k]), np.zeros_like(p[k])])
            s[0] = 0.9 * s[0] + 0.1 * g[k]
            s[1] = 0.999 * s[1] + 0.001 * g[k] ** 2
            p[k] = (p[k] - rate * (s[0] / (1 - 0.9**t)) / (np.sqrt(s[1] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.concatenate([self.forward(x[o : o + 1024])[0] for o in range(0, len(x), 1024)]) if len(x) else np.zeros(0)
        return 1 / (1 + np.exp(-(self.scale * logit + self.shift)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, *, epochs: int = 8, seed: int = 5) -> Net:
        net, r = cls(seed), np.random.default_rng(seed)
        order = r.permutation(len(x))
        third = len(x) // 6
        one, two, train = order[:third], order[third : 2 * third], order[2 * third :]
        state: dict = {}
        for k in range(epochs):
            r.shuffle(train)
            for o in range(0, len(train), 128):
                net.step(x[train[o : o + 128]], y[train[o : o + 128]], state, 0.004 / (1 + 0.3 * k))
        logit = net.forward(x[one])[0].astype(np.float64)
        for _ in range(50):  # Newton steps of Platt scaling, with a small ridge
            q = 1 / (1 + np.exp(-(net.scale * logit + net.shift)))
            g = np.array([((q - y[one]) * logit).sum() + 1e-2 * (net.scale - 1), (q - y[one]).sum() + 1e-2 * net.shift])
            v = q * (1 - q) + 1e-6
            hess = np.array([[(v * logit * logit).sum() + 1e-2, (v * logit).sum()], [(v * logit).sum(), v.sum() + 1e-2]])
            d = np.linalg.solve(hess, g)
            net.scale, net.shift = net.scale - np.clip(d[0], -1, 1), net.shift - np.clip(d[1], -1, 1)
        net.positives = np.sort(net.score(x[two])[y[two] == 1])
        net.threshold = net.keeping(RECALL)
        return net

    def keeping(self, recall: float) -> float:
        """The highest threshold that keeps this share of the positive findings held back."""
        return float(self.positives[int((1 - recall) * len(self.positives))]) if len(self.positives) else 0.5


def _key(r: np.random.Generator) -> str:
    """A random key: maybe a prefix of letters, then one to three segments over one alphabet, with a digit in it."""
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    chars = lambda s, k: "".join(s[i] for i in r.integers(0, len(s), k))
    body = [low + up + dig, low + up + dig + "-_", low + up + dig + "+/", low + dig, up + dig, dig + "abcdef", dig + "ABCDEF"][int(r.choice(7, p=[0.38, 0.14, 0.12, 0.12, 0.1, 0.07, 0.07]))]
    lead = ""
    for _ in range(int(r.choice(3, p=[0.4, 0.4, 0.2]))):
        lead += chars([low, up, low + up][int(r.integers(3))], int(r.integers(2, 6))) + "_-.__"[int(r.integers(5))] * int(r.random() < 0.8)
    total, n = int(r.integers(18, 64)), int(r.choice([1, 2, 3], p=[0.7, 0.15, 0.15]))
    parts = [chars(body, max(6, total // n + int(r.integers(-3, 4)))) for _ in range(n)]
    key = lead + "-._"[int(r.integers(3))].join(parts)
    return key if any(c in dig for c in key) else key + chars(dig, 2)


def synthetic(n: int, seed: int = 9) -> tuple[list[bytes], list[int]]:
    """n labelled windows of each kind: random keys and harmless look-alikes in contexts."""
    r = np.random.default_rng(seed)
    pick = lambda s: s[int(r.integers(len(s)))]
    chars = lambda s, k: "".join(s[i] for i in r.integers(0, len(s), k))
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    con, vow = "bcdfghjklmnprstvwz", "aeiou"
    said = lambda: "".join(pick(con) + pick(vow) + (pick(con) if r.random() < 0.3 else "") for _ in range(int(r.integers(1, 4))))
    word = lambda: said() if r.random() < 0.7 else chars(low, int(r.integers(2, 9)))
    lead = ["key: ", "token=", "Authorization: Bearer ", "secret = ", "credentials ", "export KEY=", "password=", 'api_key: "', "auth "]
    num = lambda a, b: chars(dig, int(r.integers(a, b)))
    plain = [
        lambda: f"{word()}.{num(1, 4)}@{word()}.example.com",
        lambda: ".".join(str(int(x)) for x in r.integers(1, 256, 4)).ljust(12, "0"),
        lambda: f"20{chars(dig, 2)}-0{pick(dig[1:])}-1{pick(dig)}-{word()}",
        lambda: f"{word()}-{word()}-{num(2, 5)}.html",
        lambda: f"/{word()}/{word()}/{num(2, 6)}/{word()}",
        lambda: f"{num(3, 5)}-{num(3, 6)}-{num(4, 7)}",
        lambda: num(12, 25),
        lambda: f"{word()}_{word()}{num(1, 3)}_{word()}",
        lambda: f"{word()}{num(1, 3)}.{word()}.{word()}{word()}",
        lambda: f"v{chars(dig, 1)}.{chars(dig, 2)}.{chars(dig, 1)}-{word()}{chars(dig, 1)}",
        lambda: chars(dig, 4) + "=" * int(r.integers(10, 30)),
        lambda: "-" * int(r.integers(10, 40)) + chars(dig, 1),
        lambda: "".join(word().title() for _ in range(3)) + num(1, 4),
        lambda: f"www.{word()}{word()}{num(1, 3)}.example.org/{word()}/{word()}",
        lambda: f"{num(1, 3)}.{num(10, 20)}",
        lambda: f"{num(1, 4)}/{num(1, 4)}/{num(4, 5)}-{num(2, 3)}.{num(2, 3)}",
        lambda: "-".join(word() for _ in range(4)) + "-" + num(1, 3),
        lambda: f"{pick(up)}{pick(up)}-{num(4, 7)}-{num(3, 6)}",
        lambda: ".".join(pick([word(), num(1, 4)]) for _ in range(6)) + num(1, 2),
    ]
    out, label = [], []
    for k in range(2 * n):
        hot = k % 2
        t = " ".join(word() for _ in range(5)) + " "
        t += pick(lead) if r.random() < (0.5 if hot else 0.1) else ""
        s = t + (_key(r) if hot else pick(plain)()) + (" " + " ".join(word() for _ in range(3)))
        m = [x for x in CANDIDATE.finditer(s) if x.end() > len(t)]
        if m and any(c in dig for c in m[0][0]):
            out.append(windows(s, m[0].start(), m[0].end())[0])
            label.append(hot)
    return out, label


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a scanned table on a row of its own."""
    for b in batches:
        n = [m for row in b.column(1).to_pylist() for m in row]
        own = np.repeat(np.array([o for row in b.column(0).to_pylist() for o in row], bool), n)
        data = b"".join(b.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.bool_()), pa.array([data[k : k + WIDTH] for k in range(0, len(data), WIDTH)], pa.binary())], names=["own", "w"])


def train(table: DataFrame, rows: int = TRAIN_ROWS) -> Net:
    """The network for the candidates of a scanned table."""
    each = table.select("own", "parts", "windows").mapInArrow(_each, "own boolean, w binary").distinct()
    some = {own: [bytes(r.w) for r in each.where(F.col("own") == own).orderBy(F.xxhash64("w"), "w").limit(rows).collect()] for own in (True, False)}
    codes = lambda w: np.minimum(np.frombuffer(b"".join(w), np.uint8).reshape(-1, WIDTH), 127)
    w, label = synthetic(rows)
    x, y = codes(w + some[True]), np.array(label + [1] * len(some[True]), np.float32)
    net = Net.fit(x, y)
    if not some[False]:
        return net
    free = codes(some[False])
    harmless = free[net.score(free) < net.keeping(SURE)]
    return Net.fit(np.concatenate([x, harmless]), np.append(y, np.zeros(len(harmless), np.float32)))


def _finish(net: Net):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, cand, own, parts = (b.column(k).to_pylist() for k in (1, 2, 3, 4))
            x = np.minimum(np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint8).reshape(-1, WIDTH), 127)
            score = net.score(x)
            at, rows = 0, []
            for s, c, o, p in zip(base, cand, own, parts, strict=True):
                found = [tuple(s[k : k + 3]) for k in range(0, len(s), 3)]
                text = ",".join(f"{KINDS[k]}:{a}:{e}" for a, e, k in found)
                n = [sum(1 for x in found if x[2] == k) for k in range(3)]
                more = []
                for k, m in enumerate(p):
                    if score[at : at + m].max() >= net.threshold and not o[k]:
                        more.append((c[2 * k], c[2 * k + 1], 3))
                    at += m
                both = ",".join(f"{KINDS[k]}:{a}:{e}" for a, e, k in sorted(found + more, key=lambda s: (s[0], s[2], s[1])))
                rows.append((*n, hashlib.sha256(text.encode()).hexdigest(), both, len(more)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, k) for v, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_neural"])

    return kernel


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_neural of every row of docs."""
    stages = Stages(docs.sparkSession, "secrets")
    kind = docs.schema[id_col].dataType.simpleString()
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = stages.write(some.mapInArrow(scan, f"doc_id {kind}, base array<bigint>, cand array<bigint>, own array<boolean>, parts array<bigint>, windows binary"))
    net = train(table, train_rows)
    return table.mapInArrow(_finish(net), f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_neural bigint")


def redact(text: str, net: Net) -> str:
    """text with every found span replaced by ``[secret]``; overlapping spans are one, and a candidate around a base span goes
    as a whole."""
    base, every = base_spans(text), candidates(text)
    own = touched(every, base)
    spans = [(s, e) for s, e, _ in base] + [c for c, o in zip(every, own, strict=True) if o]
    cand = [c for c, o in zip(every, own, strict=True) if not o]
    if cand:
        parts = [windows(text, s, e) for s, e in cand]
        score = net.score(np.minimum(np.frombuffer(b"".join(w for p in parts for w in p), np.uint8).reshape(-1, WIDTH), 127))
        at = 0
        for c, p in zip(cand, parts, strict=True):
            if score[at : at + len(p)].max() >= net.threshold:
                spans.append(c)
            at += len(p)
    out, last = [], 0
    for s, e in sorted(spans):
        if s > last or not out:
            out += [text[last:s], "[secret]"]
        last = max(last, e)
    return "".join([*out, text[last:]])


def redact_secrets(docs: DataFrame, *, text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs with the found secrets of text_col replaced; all rows and columns stay."""
    stages = Stages(docs.sparkSession, "redact")
    table = stages.write(docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, "doc_id int, base array<bigint>, cand array<bigint>, own array<boolean>, parts array<bigint>, windows binary").where("size(cand) > 0"))
    net = train(table, train_rows)
    stages.drop(table)
    k = docs.columns.index(text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            clean = pa.array([None if t is None else redact(t, net) for t in b.column(k).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([clean if i == k else b.column(i) for i in range(b.num_columns)], names=b.schema.names)

    return docs.mapInArrow(kernel, docs.schema)
