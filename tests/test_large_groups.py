"""Keys and values that many rows share, and searches over many rows."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docloom.operators import best, memory, names, nearest


def _vectors(spark, n=20_000, copies=3_000):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(n, 32)).astype("float32")
    v[5 : 5 + copies] = v[5]  # ties
    return spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.array(list(v), pa.list_(pa.float32()))})), v.astype("float64")


def test_searches_over_many_rows(spark):
    """8 million pairs, most of which were scored by an expression each; a group of copies, null and zero vectors."""
    df, v = _vectors(spark)
    odd = spark.createDataFrame([(30_000, None), (30_001, [0.0] * 32), (30_002, [1.0]), (30_050, None)], "vec_id long, embedding array<float>")
    df = df.union(odd).localCheckpoint()
    q = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
    begin = time.time()
    got = [sorted((r.q_id, r["rank"], r.vec_id) for r in f.select("q_id", "rank", "vec_id").collect()) for f in (memory.top_k(q, df), nearest.top_k(q, df))]
    assert time.time() - begin < 60
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = []
    for k in range(0, len(v), 50):
        s = np.round(u @ u[k], 6)
        want += [(k, n + 1, int(i)) for n, i in enumerate(np.lexsort((np.arange(len(v)), -s))[:4])]
    assert got[0] == want and got[1] == want


def test_scores_round_as_spark_does(spark):
    x = [0.1234565, -0.1234565, 0.12345649999999999, 1.0000005, 0.0000005, 0.5, -1.0, 0.9999995]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    assert best.rounded(np.array(x)).tolist() == [r[0] for r in df.select(F.round("v", 6)).collect()]


def test_common_keys_of_prefixes(spark):
    """rows of a key that most descriptions share came to one task."""
    rows = spark.range(400).select("id", F.when(F.col("id") % 4 == 0, F.concat(F.lit("kit"), F.col("id").cast("string"), F.lit(" spare"))).otherwise(F.concat(F.lit("provision of "), F.col("id").cast("string"))).alias("description"))
    prefixes = spark.createDataFrame([("kit4", 1), ("provision of", 2), ("prov", 3)], "prefix string, list_pos int")
    got = [{r.id: r.rest for r in names.prefix_rest(rows, prefixes, most=n, probe=1).collect()} for n in (10, 100_000)]
    assert got[0] == got[1] and got[0][1] == "1" and got[0][4] == "spare" and got[0][8] is None and got[0][40] == "0 spare"
    plan = names.prefix_rest(rows, prefixes, most=10, probe=1)._jdf.queryExecution().optimizedPlan().toString()
    assert "own.pattern" in plan or "here" in plan


def test_rules_beyond_a_block_are_one_pass(spark):
    """texts were read again for every block of rules."""
    from docloom.operators.rules import match_rules

    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("Common word, code C-"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit(" a rather long literal that goes on and on beyond all of the heads of "), F.col("id").cast("string")).alias("text"))
    rules = spark.range(200).select(F.lit("code").alias("field"), F.col("id").alias("priority"), F.concat(F.lit(r"\bc-"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("pattern"))
    rules = rules.union(spark.createDataFrame([("any", 1, "common"), ("long", 1, r"a rather long literal that goes on and on beyond all of the heads of 7\b")], rules.schema))
    got = match_rules(docs, rules, block=10)
    assert got._jdf.queryExecution().analyzed().toString().count("rlike") <= 2
    found = sorted((r.field, r.doc_id) for r in got.collect())
    assert found == sorted([("any", k) for k in range(300)] + [("code", k) for k in range(200)] + [("long", 7)])


def test_labels_of_price_blocks_have_a_kind(spark):
    """a label met six expressions to learn its kind."""
    from docloom.operators import items

    text = "Item\tTitle: lamp\nITEM  DETAILS - of brass\nQuantity 5 UoM: Nos\nUnit\nPrice: Rs. 7.00\nTOTAL price: 35.00\nprice list none"
    rows = items.parse_price_blocks(spark.createDataFrame([("d", text)], "doc_id string, text string"))
    assert rows._jdf.queryExecution().analyzed().toString().count("(?i)^(?:item") <= 1
    assert [tuple(r) for r in rows.select("description", "product_name", "item_qty", "qty_unit", "unit_rate", "amount").collect()] == [("lamp of brass", "lamp", "5", "Nos", "7.00", "35.00")]
