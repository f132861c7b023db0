"""V1/V4: dictionaries that grow: append-only ids in versions.

A dictionary is a folder.  Version v is what deltas 0 .. v hold together; a delta holds the keys that no earlier version has, with the
next free ids in sorted key order, and is renamed into place when it is whole, so a reader sees a version or doesn't.  Adding a split
reads the dictionary's keys and the new split only: no id changes and no earlier split is read again.  ``compact`` merges all deltas into one sorted table
beside them; later versions are that table and the deltas behind it, and readers pinned to an earlier version keep theirs.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagflow.operators.ids import dense_index

SCHEMA = "key string, id bigint, version int"


@dataclass
class GrowingDictionary:
    spark: SparkSession
    path: str

    # ------------------------------------------------------------ files
    def _hadoop(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _numbers(self, kind: str) -> list[int]:
        fs, p = self._hadoop(f"{self.path}/{kind}-*")
        return sorted(int(f.getPath().getName().rsplit("-", 1)[1]) for f in fs.globStatus(p) or [])

    def _commit(self, rows: DataFrame, name: str) -> None:
        made = f"{self.path}/_making-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(made)
        fs, target = self._hadoop(f"{self.path}/{name}")
        if fs.exists(target) or not fs.rename(self._hadoop(made)[1], target):
            raise FileExistsError(f"{target} was committed by another writer")

    # ------------------------------------------------------------ versions
    @classmethod
    def create(cls, spark: SparkSession, path: str, reserved: dict[str, int]) -> "GrowingDictionary":
        """A new dictionary of the reserved keys (version 0); other ids follow the largest of theirs."""
        out = cls(spark, path)
        out._commit(spark.createDataFrame([(k, i, 0) for k, i in reserved.items()], SCHEMA), "delta-000000")
        return out

    @property
    def version(self) -> int:
        return self._numbers("delta")[-1]

    def read(self, version: int | None = None) -> DataFrame:
        """(key, id) of a version, the last one by default."""
        return self._rows(self.version if version is None else version).select("key", "id")

    def _rows(self, version: int) -> DataFrame:
        deltas, bases = self._numbers("delta"), [b for b in self._numbers("base") if b <= version]
        if version not in deltas:
            raise ValueError(f"no version {version}")
        paths = [f"{self.path}/base-{bases[-1]:06d}"] if bases else []
        paths += [f"{self.path}/delta-{d:06d}" for d in deltas if d <= version and (not bases or d > bases[-1])]
        return self.spark.read.schema(SCHEMA).parquet(*paths)

    def add(self, keys: DataFrame, col: str = "key") -> int:
        """Adds the keys that the dictionary lacks; returns the new version.  Null keys are left out."""
        last = self.version
        known = self._rows(last)
        first = (known.agg(F.max("id")).first()[0] if known.columns else None)
        fresh = keys.select(F.col(col).alias("key")).where(F.col("key").isNotNull()).distinct().join(known.select("key"), "key", "left_anti")
        numbered = dense_index(fresh, ["key"], "id", (-1 if first is None else first) + 1).select("key", "id", F.lit(last + 1).cast("int").alias("version"))
        self._commit(numbered, f"delta-{last + 1:06d}")
        return last + 1

    def compact(self) -> None:
        """One sorted table of all keys so far; versions and ids stay what they are."""
        last = self.version
        if last not in self._numbers("base"):
            self._commit(self._rows(last).repartitionByRange("key").sortWithinPartitions("key"), f"base-{last:06d}")
