"""Anchors that hold a good part of all rows are left out of the shuffle without a join."""

import pytest

from docloom.llm import suffix


def test_frequent_anchors_need_no_anti_join(spark, monkeypatch):
    """The check counted the rows of a left anti join, which is there only where an anchor is frequent."""
    docs = spark.createDataFrame([(k, f"{k:04d} " + "".join(chr(97 + i * i % 23) for i in range(260))) for k in range(20)], "doc_id long, text string")
    plans = []
    write = suffix.Stages.write

    def noted(self, df):
        plans.append(df._jdf.queryExecution().analyzed().toString())
        if len(plans) == 4:
            raise StopIteration
        return write(self, df)

    monkeypatch.setattr(suffix.Stages, "write", noted)
    with pytest.raises(StopIteration):
        suffix.remove_repeats(docs)
    assert "Union" in plans[3] and "LeftAnti" not in plans[3]
