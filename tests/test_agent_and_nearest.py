"""The agent's turns as a state machine, in batch and stream; nearest rows by pivots."""

import numpy as np
from pyspark.sql import functions as F

from docloom.operators import agent, memory, nearest
from docloom.plans.stages import Stages
from docloom.streaming import ingest

TURNS = [("a", 1, "user", "rename the first"), ("a", 2, "assistant", "done"), ("a", 3, "user", "thanks!"), ("a", 4, "user", "remove it"), ("a", 5, "user", "and the other"), ("a", 6, "user", "again"), ("b", 1, "user", "no products here"), ("b", 2, "user", None)]
CHANGES = [("a", 1, 0, 0, "LED lamp", False), ("a", 1, 1, 1, "unheard words", False), ("a", 1, 2, 9, "LED lamp", False), ("a", 3, 0, 0, None, True), ("a", 4, 0, 0, None, True), ("a", 5, 0, 0, "relay box", None), ("a", 5, 1, 0, None, True), ("a", 6, 0, 0, None, True), ("b", 1, 0, 0, "x", True)]
PRODUCTS = [("a", 1, "supply of led lamp 5W", None), ("a", 2, "relay box", "old")]
WANT = [
    ("a", 1, "fix", 0, 1, 0, 2, ["LED lamp", "old"]), ("a", 3, "chat", 3, 0, 0, 2, ["LED lamp", "old"]), ("a", 4, "fix", 4, 0, 1, 1, ["old"]),
    ("a", 5, "fix", 4, 1, 1, 0, []), ("a", 6, "chat", 4, 0, 0, 0, []), ("b", 1, "chat", 0, 0, 0, 0, []), ("b", 2, "chat", 1, 0, 0, 0, []),
]


def told(df):
    return sorted(tuple(r) for r in df.collect())


def events(spark):
    turns = spark.createDataFrame(TURNS, "conv_id string, turn int, role string, text string")
    changes = spark.createDataFrame(CHANGES, "conv_id string, turn int, seq_no int, index int, product_name string, remove boolean")
    return agent.events(turns, changes, spark.createDataFrame(PRODUCTS, "conv_id string, seq int, description string, product_name string"))


def test_agent_turns(spark):
    rows = events(spark)
    assert told(agent.run_turns(rows)) == WANT
    assert told(agent.run_turns(rows.limit(0))) == []


def test_agent_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = events(spark)
    for some in ("turn < 4", "turn >= 4"):
        rows.where(some).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ingest.read_documents(spark, f"{tmp_path}/in", rows.schema)
        out = agent.stream_turns(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        out.awaitTermination(120)
    assert told(spark.read.parquet(f"{tmp_path}/out")) == WANT


def test_pivots_equal_all_pairs_and_prune_clusters(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    rows = [(int(k), (centres[k % 12] + 0.05 * rng.normal(size=16)).tolist()) for k in range(900)]
    rows += [(900 + k, r[1]) for k, r in enumerate(rows[:30])] + [(990, [0.0] * 16), (991, None)]  # ties, and vectors near to nothing
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
    stages = Stages(spark, "pivots")
    got = nearest.top_k(q, v, stages=stages)
    want = memory.top_k(q, v.where("vec_id < 990"))
    key = lambda df: sorted((r.q_id, r["rank"], r.vec_id) for r in df.collect())
    assert key(got) == key(want)
    met = sum(spark.read.parquet(f"{stages.root}/{n}").count() for n in (7, 9))
    assert met < 0.2 * q.count() * 930
    assert nearest.top_k(q, v.limit(0)).count() == 0
