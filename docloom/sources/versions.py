"""Versioned tables in a folder: snapshots, compare-and-swap, copy-on-write merge, revert.

Rows lie in buckets by a hash of their key.  ``_log/<version>.json`` is the manifest of a version: its schema and, for each
bucket, the folders of its Parquet files.  A change writes new folders for the buckets that it touches and then a manifest
that keeps the others as they are; a reader opens one manifest, so it sees a version whole.  Versions are numbered without
gaps, and a manifest is put only if its number is free.  A writer that loses a race is told (:class:`Conflict`), unless the
versions in between left its buckets alone: then its change goes on top of them.  Reverting makes a new version with the
folders of an old one and copies nothing.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has changed the same buckets since the version that a change was made for."""


class VersionedTable:
    """The table of a folder; ``key`` and ``buckets`` count when it is made."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        jvm = spark.sparkContext._jvm
        self._at: Callable = jvm.org.apache.hadoop.fs.Path
        self._store = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- the log ----
    def version(self) -> int:
        """The newest version; -1 if the table was never written."""
        log = self._at(f"{self.path}/_log")
        if not self._store.exists(log):
            return -1
        names = [f.getPath().getName() for f in self._store.listStatus(log)]
        return max((int(n[:20]) for n in names if len(n) == 25 and n.endswith(".json")), default=-1)

    def entry(self, version: int) -> dict:
        """The manifest of a version."""
        path = self._at(f"{self.path}/_log/{version:020d}.json")
        if not self._store.exists(path):
            raise KeyError(f"no version {version}")
        return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(self._store.open(path), "UTF-8"))

    def _put(self, version: int, entry: dict) -> bool:
        """Whether the manifest's number was free.  Local folders link a whole file; other stores create it exclusively."""
        name, body = f"{self.path}/_log/{version:020d}.json", json.dumps(entry).encode()
        if self._store.getUri().getScheme() == "file":
            plain = "/" + name.removeprefix("file:").lstrip("/")
            os.makedirs(os.path.dirname(plain), exist_ok=True)
            part = f"{plain}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(body)
            try:
                os.link(part, plain)
            except FileExistsError:
                return False
            finally:
                os.unlink(part)
            return True
        try:
            out = self._store.create(self._at(name), False)
        except Exception as e:  # the gateway wraps the store's own exception
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(bytearray(body))
        out.close()
        return True

    def _commit(self, base: int, operation: str, schema: StructType, change: dict[str, list[str]] | None, whole: bool) -> int:
        """Put ``change`` (folders by bucket; null folders empty it) on top of the newest version."""
        while True:
            now = self.version()
            old = self.entry(now) if now >= 0 else {"files": {}, "key": self.key, "buckets": self.buckets}
            if now != base:
                since = {b for v in range(base + 1, now + 1) for b in self.entry(v)["touched"]}
                if whole or since & set(change):
                    raise Conflict(f"version {now} was written since {base}")
            files = dict(change) if whole else old["files"] | change
            touched = sorted(set(change) | (set(old["files"]) if whole else set()))
            entry = {"version": now + 1, "operation": operation, "schema": schema.json(), "key": old["key"], "buckets": old["buckets"], "files": {b: p for b, p in files.items() if p}, "touched": touched}
            if self._put(now + 1, entry):
                return now + 1

    # ---- the data ----
    def _shape(self, version: int) -> tuple[list[str], int]:
        return (self.key, self.buckets) if version < 0 else (lambda e: (e["key"], e["buckets"]))(self.entry(version))

    def _bucket(self, version: int) -> Column:
        key, n = self._shape(version)
        return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")

    def _write(self, rows: DataFrame, base: int) -> dict[str, list[str]]:
        folder = f"data/{uuid.uuid4().hex}"
        # equal keys go to one task, so a bucket has few files
        rows.withColumn("_bucket", self._bucket(base)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        made = [f.getPath().getName() for f in self._store.listStatus(self._at(f"{self.path}/{folder}"))]
        return {n.removeprefix("_bucket="): [f"{folder}/{n}"] for n in made if n.startswith("_bucket=")}

    def read(self, version: int | None = None, buckets: set[str] | None = None) -> DataFrame:
        """The rows of a version, the newest by default; of some buckets only, if these are given."""
        version = self.version() if version is None else version
        entry = self.entry(version)
        schema = StructType.fromJson(json.loads(entry["schema"]))
        folders = [f"{self.path}/{p}" for b, ps in entry["files"].items() if buckets is None or b in buckets for p in ps]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def overwrite(self, rows: DataFrame, *, expected: int | None = None) -> int:
        """Make rows the table; returns the version.  ``expected`` is the version that the caller has seen."""
        base = self.version() if expected is None else expected
        return self._commit(base, "overwrite", rows.schema, self._write(rows, base), True)

    def upsert(self, rows: DataFrame, order: list[Column], *, remove: Column | None = None, expected: int | None = None) -> int:
        """Rows take the place of those with their key, the first by ``order`` of all stays; keys whose row ``remove`` holds for
        go.  Only the buckets of rows are read and written."""
        base = self.version() if expected is None else expected
        if base < 0:
            base = self.overwrite(rows.limit(0))
        key, _ = self._shape(base)
        touched = {str(r[0]) for r in rows.select(self._bucket(base)).distinct().collect()}  # at most as many as buckets
        if not touched:
            return base
        old = self.read(base, touched)
        best = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
        merged = old.unionByName(rows).withColumn("_r", best).where("_r = 1").drop("_r")
        merged = merged if remove is None else merged.where(~F.coalesce(remove, F.lit(False)))
        made = self._write(merged, base)
        return self._commit(base, "upsert", old.schema, {b: made.get(b, []) for b in touched}, False)

    def revert(self, version: int, *, expected: int | None = None) -> int:
        """A new version with the rows of an old one."""
        base, old = self.version() if expected is None else expected, self.entry(version)
        return self._commit(base, f"revert to {version}", StructType.fromJson(json.loads(old["schema"])), old["files"], True)

    def history(self) -> list[tuple[int, str]]:
        return [(v, self.entry(v)["operation"]) for v in range(self.version() + 1)]


def retried(change: Callable[[], int], attempts: int = 5) -> int:
    """The version that a change makes, computed anew after each conflict."""
    for _ in range(attempts - 1):
        try:
            return change()
        except Conflict:
            pass
    return change()
