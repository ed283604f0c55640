"""Many rules on many documents (C03, I04): required literals first, expressions on the hits only.

Every match of most expressions holds some literal.  :func:`required` reads such literals off an expression; of several, a
rule is filed under the one that fewest rules share.  Texts then run once through an automaton of all literals, in Arrow
batches, which gives the rules that may match; an equi-join brings their expressions, and only these are evaluated.  Rules
without a literal meet every text, as before.  Work is texts plus hits, not texts times rules, and the plan does not grow
with the rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stages import Stages
from .memory import in_blocks

#: Shorter literals hit too many texts to be worth a file, and rules of one automaton.
LEAST, BLOCK = 3, 50_000
_OPENERS = ("(?:", "(?i:", "(?>")


def required(pattern: str) -> list[list[str]]:
    """Choices of literals, lower-case ASCII: each match of the (case-insensitive) expression holds one of every choice.

    Only what is sure counts: literals outside optional parts, alternatives if each has one.  Empty where the expression
    uses notation that this reading does not know.
    """
    try:
        out, at = _alternatives(pattern, 0)
    except (IndexError, ValueError):
        return []
    return out if at == len(pattern) else []


def _alternatives(p: str, at: int) -> tuple[list[list[str]], int]:
    """Choices of the alternatives from ``at`` up to a closing bracket or the end."""
    branches: list[list[list[str]]] = []
    while True:
        choices, at = _sequence(p, at)
        branches.append(choices)
        if at == len(p) or p[at] == ")":
            break
        at += 1
    if len(branches) == 1:
        return branches[0], at
    # one literal per branch, the longest
    if all(branches):
        return [sorted({x for b in branches for x in max(b, key=lambda c: min(map(len, c)))})], at
    return [], at


def _sequence(p: str, at: int) -> tuple[list[list[str]], int]:
    choices: list[list[str]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if run:
            choices.append([run])
        run = ""

    while at < len(p) and p[at] not in "|)":
        c = p[at]
        atom: str | None = None  # a literal character
        group: list[list[str]] = []
        if c == "(":
            lead = next((o for o in _OPENERS if p.startswith(o, at)), None)
            named = p.startswith("(?<", at) and p[at + 3] not in "=!"
            look = p.startswith(("(?=", "(?!", "(?<=", "(?<!"), at)
            if p.startswith("(?", at) and not (lead or named or look):
                end = p.index(")", at)
                if p[at + 2 : end] != "i":
                    raise ValueError(p)
                at = end + 1
                continue
            start = at + len(lead) if lead else p.index(">", at) + 1 if named else at + (4 if p.startswith("(?<", at) else 3) if look else at + 1
            group, at = _alternatives(p, start)
            if p[at] != ")":
                raise ValueError(p)
            at += 1
            group = [] if look else group
        elif c == "[":
            depth, at = 1, at + 1
            at += p[at] == "^"
            at += p[at] == "]"
            while depth:
                depth += (p[at] == "[") - (p[at] == "]")
                at += 2 if p[at] == "\\" else 1
        elif c == "\\":
            e = p[at + 1]
            if e in "QEx0ucNkG":
                raise ValueError(p)
            at += 2
            if e in "pP":
                at = p.index("}", at) + 1 if p[at] == "{" else at + 1
            elif e.isdigit():
                while at < len(p) and p[at].isdigit():
                    at += 1
            elif not e.isalpha():
                atom = e
        else:
            at += 1
            atom = None if c in ".^$" or ord(c) > 127 else c
        # what follows an atom
        least, more = 1, False
        if at < len(p) and p[at] in "?*+{":
            more = True
            if p[at] == "{":
                end = p.index("}", at)
                least, at = int(p[at + 1 : end].split(",")[0]), end + 1
            else:
                least, at = int(p[at] == "+"), at + 1
            at += at < len(p) and p[at] in "?+"
        if atom is None or not least:
            close()
            if least:
                choices += group
        else:
            run += atom.lower()
            if more:
                close()
    close()
    return choices, at


def _file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(r, k, x) for r, p in zip(b["rule"], b["pattern"], strict=True) for k, c in enumerate(required(p)) if min(map(len, c)) >= LEAST for x in c]
        yield pd.DataFrame(rows, columns=["rule", "choice", "literal"]).astype({"rule": "int64", "choice": "int32", "literal": "str"})


def literals(rules: DataFrame) -> DataFrame:
    """rule, literal: the literals that each rule (rule, pattern) is filed under; rules without one are missing."""
    every = rules.select("rule", "pattern").mapInPandas(_file, "rule bigint, choice int, literal string")
    every = every.withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("literal")))
    # the choice whose commonest literal is rarest among the rules, then the longest
    score = every.groupBy("rule", "choice").agg(F.max("shared").alias("shared"), (-F.min(F.length("literal"))).alias("size"))
    best = score.groupBy("rule").agg(F.min(F.struct("shared", "size", "choice")).alias("b")).select("rule", F.col("b.choice").alias("choice"))
    return every.join(best, ["rule", "choice"]).select("rule", "literal").distinct()


def _scan(filed: dict[str, list[int]]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = ahocorasick.Automaton()
        for word, ids in filed.items():
            a.add_word(word, tuple(ids))
        a.make_automaton()
        low = {k: k + 32 for k in range(65, 91)}
        for b in batches:
            hits = [sorted({r for _, ids in a.iter((t or "").translate(low)) for r in ids}) for t in b.column(1).to_pylist()]
            some = pa.array([bool(h) for h in hits])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hits, pa.list_(pa.int64()))], names=["doc_id", "text", "hits"]).filter(some)

    return scan


def match_rules(docs: DataFrame, rules: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """doc_id, field, pattern of the first rule (field, priority, pattern) of each field that occurs in the document;
    by priority, then pattern.  Expressions ignore ASCII case; null patterns and texts match nothing.

    At most ``block`` rules with literals go to all tasks as one automaton, and texts are not shuffled.  More are found by
    hash: windows of the texts that may be literals, told by a bitmap, are joined with the rules, so that work grows with the
    texts and their hits and not with texts times rules.
    """
    stages = Stages(docs.sparkSession, "rules")
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    known = stages.write(rules.select("field", "priority", "pattern").where("pattern is not null").distinct().withColumn("rule", F.monotonically_increasing_id()))
    filed = stages.write(literals(known))
    one = filed.select("rule").distinct().count() <= block
    matches = F.expr("text rlike concat('(?i)', pattern)")
    if one:
        words: dict[str, list[int]] = {}
        for r in filed.toLocalIterator():
            words.setdefault(r.literal, []).append(r.rule)
        found = []
        if words:
            hits = texts.mapInArrow(_scan(words), f"doc_id {kind}, text string, hits array<bigint>").select("doc_id", "text", F.explode("hits").alias("rule"))
            found.append(hits.join(F.broadcast(known.join(filed, "rule", "left_semi")), "rule").where(matches))
    else:
        texts = stages.write(texts)
        may = _candidates(stages, texts, filed, kind).join(known, "rule").groupBy(F.col("doc_id").alias("_d")).agg(F.collect_list(F.struct("field", "priority", "pattern")).alias("may"))
        found = [texts.join(may, F.col("doc_id").eqNullSafe(F.col("_d"))).select("doc_id", "text", F.inline("may")).where(matches)]
    for part in in_blocks(known.join(filed, "rule", "left_anti"), block):
        found.append(texts.join(F.broadcast(part), matches))
    hits = reduce(DataFrame.unionByName, [h.select("doc_id", "field", "priority", "pattern") for h in found])
    return hits.groupBy("doc_id", "field").agg(F.min_by("pattern", F.struct("priority", "pattern")).alias("pattern"))


#: Sizes of literals' heads that are hashed, bits of the bitmap per literal and at most, rows of a hash that one task joins.
HEADS, BITS, MOST_BITS, COMMON = (*range(LEAST, 17), 24, 32, 48, 64), 32, 1 << 29, 100_000
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _hashes(data: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """The hash of every window of each size."""
    power = lambda n: np.uint64(pow(int(_STEP), n, 1 << 64))
    joined = lambda x, y, n, m: x[: len(data) - n - m + 1] * power(m) + y[n : len(data) - m + 1]
    doubled = {1: (data.astype(np.uint64) + np.uint64(1)) * _MIX[0]}
    while 2 * max(doubled) <= max(sizes):
        n = max(doubled)
        doubled[2 * n] = joined(doubled[n], doubled[n], n, n) if len(data) >= 2 * n else np.empty(0, np.uint64)
    out = {}
    for size in sizes:
        if len(data) < size:
            continue
        n, h = 0, None
        for m in sorted((m for m in doubled if m & size), reverse=True):
            h = doubled[m] if h is None else joined(h, doubled[m], n, m)
            n += m
        out[size] = h ^ np.uint64(size)
    return out


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(h * m) >> np.uint64(64 - bits) for m in _MIX]


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h, sizes = [], []
        for word in b.column(1).to_pylist():
            size = max(n for n in HEADS if n <= len(word))
            h.append(int(_hashes(np.frombuffer(word[:size].encode(), np.uint8), [size])[size][0].view(np.int64)))
            sizes.append(size)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h, pa.int64()), pa.array(sizes, pa.int32())], names=["rule", "h", "size"])


def _windows(sizes: list[int], bitmap: np.ndarray, bits: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.arange(256, dtype=np.uint8)
        low[65:91] += 32
        for b in batches:
            parts = [(t or "").encode() for t in b.column(1).to_pylist()]
            data = low[np.frombuffer(b"\0".join(parts), np.uint8)]
            starts = np.cumsum([0, *[len(p) + 1 for p in parts[:-1]]])
            who, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for h in _hashes(data, sizes).values():
                hit = np.ones(len(h), bool)
                for at in _places(h, bits):
                    hit &= (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                at = np.flatnonzero(hit)
                who.append(np.searchsorted(starts, at, side="right") - 1)
                found.append(h[at])
            pairs = np.unique(np.stack([np.concatenate(who), np.concatenate(found).view(np.int64)]), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pairs[0])), pa.array(pairs[1])], names=["doc_id", "h"])

    return windows


def _candidates(stages: Stages, texts: DataFrame, filed: DataFrame, kind: str) -> DataFrame:
    """doc_id, rule: rules (rule, literal) of which a literal's head may stand in the text."""
    heads = stages.write(filed.select("rule", "literal").mapInArrow(_heads, "rule bigint, h bigint, size int"))
    sizes, n = sorted(r.size for r in heads.select("size").distinct().collect()), heads.count()
    bits = max(10, min(MOST_BITS, BITS * n).bit_length())
    bitmap, parts = np.zeros(1 << (bits - 3), np.uint8), -(-n // 1_000_000)
    # only bits stay of the hashes
    for k in range(parts):
        h = heads.where(F.pmod("h", F.lit(parts)) == k).select("h").toArrow()["h"].to_numpy().view(np.uint64)
        for at in _places(h, bits):
            np.bitwise_or.at(bitmap, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    hits = stages.write(texts.mapInArrow(_windows(sizes, bitmap, bits), f"doc_id {kind}, h bigint"))
    # a literal of many texts would fill one task; such literals are few
    common = stages.write(hits.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMMON).select("h"))
    rare = hits.join(F.broadcast(common), "h", "left_anti").join(heads, "h")
    often = hits.join(F.broadcast(heads.join(F.broadcast(common), "h", "left_semi")), "h")
    return rare.select("doc_id", "rule").unionByName(often.select("doc_id", "rule")).distinct()
