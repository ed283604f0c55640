"""Compressed text sinks."""

from pyspark.sql import functions as F

from docloom.operators import names
from docloom.sources import sinks


def test_packed_text_round_trip(spark, tmp_path):
    """JSON and CSV written with gzip come back whole, in under a tenth of the bytes."""
    cols = {"a": F.concat(F.lit("wide header value, \"quoted\" ह "), (F.col("id") % 50).cast("string")), "b": F.when(F.col("id") % 3 == 0, F.lit("x\ny")), "c": F.col("id").cast("string")}
    df = spark.range(20_000).select(*[v.alias(k) for k, v in cols.items()], *[F.lit(f"constant of column {k}").alias(f"d{k}") for k in range(20)])
    size = lambda p: sum(f.stat().st_size for f in p.rglob("part-*"))
    for kind in ("json", "csv"):
        plain = sinks.save(df, str(tmp_path / "plain"), (kind,))
        packed = sinks.save(df, str(tmp_path / "packed"), (kind,), compression="gzip")
        assert size(tmp_path / f"packed.{kind}") * 10 < size(tmp_path / f"plain.{kind}")
        back = sinks.load(spark, packed, kind, df.columns)
        assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0
        assert plain[kind].endswith(f"plain.{kind}")


def test_spec_numbers_distinct(spark):
    text = "as per IRS : S-63/2014 and RDSO / SPN / 144/2006, again IRS:S-63/2014"
    got = spark.range(1).select(names.spec_numbers(F.lit(text)), names.spec_numbers(F.lit("none"))).first()
    assert tuple(got) == ("IRS:S-63/2014; RDSO/SPN/144/2006", None)
