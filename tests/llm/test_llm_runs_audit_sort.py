"""Periodic runs, source divergence and content sort against brute force, with edge cases."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from docloom.llm import divergence, exact
from docloom.llm.queries import QUERIES
from docloom.llm.tandem import PLANTED, digests, find_runs, word_runs

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACES = " \t\n\v\f\r"


def brute_runs(w, least=6, power=4):
    out = []
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(least, power * q) and not any(all(w[i + x] == w[i + x + d] for x in range(size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def split(text):
    return [x.decode() for x in (text or "").encode().split()]


def planted(doc_id, text):
    h = zlib.crc32(str(doc_id).encode())
    w, g = split(text), h // 10
    if h % 10 or not w:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def expected_runs(doc_id, text):
    w = planted(doc_id, text)
    runs = brute_runs(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(11)
    texts = []
    for k in range(150):
        w = [f"w{x}" for x in rng.integers(0, rng.integers(2, 30), int(rng.integers(0, 120)))]
        if k % 3 == 0 and w:
            p = int(rng.integers(1, 9))
            w = w + w[:p] * 6 + w[-3:]
        texts.append(" ".join(w))
    texts += ["", None, " \t\n", "a " * 50, "a b " * 40, "x y x y x y x y x y x y", "same same", "é É é É é É é É", " ".join(f"u{k}" for k in range(3000)) + " z" * 3000]
    return [(k, t, ("en", "de", None, "")[k % 4], (None, "s1", "s2")[k % 3], 0) for k, t in enumerate(texts)]


def test_runs_equal_brute_force_on_small_words():
    rng = np.random.default_rng(2)
    for _ in range(150):
        texts = [rng.integers(0, rng.integers(1, 5), int(rng.integers(0, 60))) for _ in range(3)]
        ends = np.cumsum([len(t) for t in texts])
        for least, power in ((6, 4), (2, 2), (9, 3)):
            want = [(s + int(o), n, q) for t, o in zip(texts, [0, *ends], strict=False) for s, n, q in brute_runs(t.tolist(), least, power)]
            assert [tuple(r) for r in word_runs(np.concatenate(texts).astype(np.int64), ends, least, power).tolist()] == want


def test_runs_query_equals_brute_force(spark, corpus, tmp_path):
    rows = corpus[:-1]  # the brute force is quadratic
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    assert got == {k: expected_runs(k, t) for k, t, *_ in rows}
    assert sum(v[1] > 0 for v in got.values()) > 40


def test_runs_edge_cases(spark, corpus):
    import pyspark.sql.functions as F

    long = " ".join(f"v{k % 7000}" for k in range(40_000))
    rows = [(1, long), (1, long), (None, "a a a a a a"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("runs", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], len(r.collapsed.split())) for r in find_runs(df).collect()))
    assert got == [(0, 6, [(0, 6, 1)], 1), (1, 40_000, [(0, 40_000, 7000)], 7000), (1, 40_000, [(0, 40_000, 7000)], 7000), (2, 0, [], 0)]
    assert digests(find_runs(df.limit(0))).count() == 0
    assert digests(find_runs(df.where("doc_id is null"), text_col=F.expr(PLANTED))).first().n_runs == 1


def duck(rows, sql):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    if rows:
        con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(repr(sorted(zip(names, r, strict=True))) for r in cur.fetchall())


def ours(df):
    return sorted(repr(sorted(r.asDict().items())) for r in df.collect())


def test_divergence_equals_sql(spark, corpus):
    rng = np.random.default_rng(4)
    rows = list(corpus)
    for k in range(200):  # words enough for a vocabulary
        rows.append((1000 + k, " ".join(f"Wort{'abcdefgh'[x]},über-{'xyz'[x % 3]}1" for x in rng.integers(0, 8, 20)), "de", f"s{k % 5}", 0))
        rows.append((2000 + k, " ".join("kpqr"[x] * 3 for x in rng.integers(0, 4, 9)), "fr", "only", 0))
    got = ours(source := divergence.source_divergence(spark.createDataFrame(rows, DOCS)))
    assert got == duck(rows, divergence.SQL)
    assert source.where("part = 'term'").count() > 20
    assert ours(divergence.source_divergence(spark.createDataFrame([], DOCS))) == []


def test_divergence_names_that_clash(spark):
    rows = spark.createDataFrame([("a b", "x", "s", 1, 2, 3), ("a", "x", "t", 1, 2, 3)], "text string, lang string, source string, term int, count int, docs int")
    got = divergence.source_divergence(rows, least=2).collect()
    assert {(r.source, r.part, r.item) for r in got} >= {("s", "pair", "t"), ("t", "pair", "s")}


def test_copies_equal_sql(spark, corpus):
    rows = list(corpus)
    rows += [(5000 + k, "one  group of copies"[: 20 - k % 2] + " " * (k % 5), "en", "s", 0) for k in range(400)]
    rows += [(6000, "ab c", "", "", 0), (6001, "a bc", "", "", 0), (6002, "abc  ", "", "", 0), (6003, "long " * 30_000, "", "", 0), (6004, "lo ng" * 30_000, "", "", 0)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    assert ours(exact.exact_duplicates(df)) == duck(rows, exact.SQL)
    stay = exact.drop_copies(df)
    assert stay.columns == df.columns and stay.count() == df.select("text").fillna("").selectExpr("regexp_replace(text, '[ \\t-\\r]', '')").distinct().count()


def test_copies_over_many_ranges(spark):
    # one group fills most ranges, whose edges are one group all the same
    rows = [(k, "the same text" + " " * (k % 3), "en", "s", 0) for k in range(900)] + [(1000 + k, f"text {k % 7}", "en", "s", 0) for k in range(60)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        df = spark.createDataFrame(rows, DOCS).repartition(9)
        assert ours(exact.exact_duplicates(df)) == duck(rows, exact.SQL)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_copies_edge_cases(spark):
    rows = [(7, None, "x"), (None, "", "y"), (8, " \t", "z"), (9, "q", "a"), (9, "q", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, digest string").selectExpr("*", "1 as part", "2 as run")
    got = sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(df).collect())
    assert got == [("7", 8, 3, False), ("8", 8, 3, True), ("9", 9, 2, False), ("9", 9, 2, True), ("None", 8, 3, False)]
    assert exact.exact_duplicates(df.limit(0)).count() == 0
