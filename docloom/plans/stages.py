"""Stage tables: results that a plan reads more than once, written to the session's shared folder.

The folder is the one that the session names in ``spark.checkpoint.dir``; a lost executor then costs only tasks of the
running stage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .deploy import ship

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set, the warehouse, or on ``local[n]`` a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    return _LOCAL.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="docloom-"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores by its key: a narrow table of many rows comes in a few row groups, which one task each would work on."""
    return df.repartition(max(24, 2 * df.sparkSession.sparkContext.defaultParallelism), key)


class Stages:
    """Tables written by one call of an operator; :meth:`drop` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = ship(spark), f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            if path := self.paths.pop(id(t), None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
