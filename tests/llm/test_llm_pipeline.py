"""The corpus pipeline on a small corpus."""

import corpus_pipeline
import numpy as np


def test_run(spark, tmp_path):
    rng = np.random.default_rng(1)
    text = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(n))
    item = text(30)
    base = text(120)
    rows = [(k, text(60), "en", f"s{k % 2}", 1) for k in range(20)]
    rows += [(30, base, "en", "s0", 1), (31, base + " tail", "en", "s0", 1), (32, text(40) + " " + item, "en", "s1", 1), (33, "123 456", "en", "s1", 1), (34, text(50) + " password=abcdef1234567890 end", "en", "s1", 1), (35, None, None, None, None)]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.dtypes == spark.read.parquet(f"{tmp_path}/documents.parquet").dtypes
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id for r in docs.collect()})
    everything = {*range(20), 30, 31, 32, 34}
    assert kept == [everything, everything - {31}, everything - {31, 32}, everything - {31, 32}]
    assert "abcdef1234567890" not in next(r.text for r in docs.collect() if r.doc_id == 34)
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} == kept[-1]
