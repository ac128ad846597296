"""A store of texts by key, as Parquet files in versions.

Writes append; of several rows of one key the one of the latest write counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbarium.session import _hadoop_path


def latest(rows: DataFrame, key: str, version: str, *tie: str) -> DataFrame:
    """The row of each key with the highest version; partial maxima, so a hot key is no matter."""
    rest = [c for c in rows.columns if c not in (key, version, *tie)]
    best = F.max(F.struct(F.col(version).alias(version), *[F.col(c) for c in (*tie, *rest)])).alias("_best")
    return rows.groupBy(key).agg(best).select(key, *[F.col(f"_best.{c}").alias(c) for c in rows.columns if c != key])


class DocStore:
    """``doc_id, text`` in a folder."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path, read_only

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> DocStore:
        return cls(spark, path)

    @classmethod
    def open_read_only(cls, spark: SparkSession, path: str) -> DocStore:
        return cls(spark, path, read_only=True)

    @classmethod
    def bulk_load(cls, docs: DataFrame, path: str) -> DocStore:
        """A store of ``docs(doc_id, text)``, range-partitioned and sorted by key."""
        store = cls(docs.sparkSession, path)
        store._append(docs.select("doc_id", "text").repartitionByRange("doc_id"))
        return store

    def _exists(self) -> bool:
        p, fs = _hadoop_path(self.spark, self.path)
        return fs.exists(p)

    def _append(self, docs: DataFrame) -> None:
        if self.read_only:
            raise PermissionError("the store is read-only")
        version = 0 if not self._exists() else self._rows().agg(F.max("version")).first()[0] + 1
        docs.withColumn("version", F.lit(version)).sortWithinPartitions("doc_id").write.mode("append").parquet(self.path)

    def _rows(self) -> DataFrame:
        return self.spark.read.schema("doc_id bigint, text string, version int").parquet(self.path)

    def add(self, docs: DataFrame) -> None:
        """Adds texts; those of known keys are replaced."""
        self._append(docs.select("doc_id", "text"))

    def scan(self) -> DataFrame:
        return latest(self._rows(), "doc_id", "version").select("doc_id", "text")

    def get(self, doc_id: int) -> DataFrame:
        """The row of one key, or none; the key's filter reaches the files."""
        return latest(self._rows().filter(F.col("doc_id") == doc_id), "doc_id", "version").select("doc_id", "text")

    def iterate(self) -> DataFrame:
        return self.scan().orderBy("doc_id")

    def keys(self) -> DataFrame:
        return self._rows().select("doc_id").distinct().orderBy("doc_id")

    def size(self) -> int:
        return self._rows().select("doc_id").distinct().count()
