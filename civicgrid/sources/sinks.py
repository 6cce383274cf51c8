"""Writes that can be repeated: the same batch twice leaves the same table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import insert_absent, replace_group, upsert

C = F.col


def refresh_slice(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace exactly the partitions present in the batch; other slices stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


class VersionedTable:
    """A table kept as whole versions under one folder; the newest finished version is the table.

    A new version is written beside the old one and becomes current when its commit marker exists, so a lost executor
    or a failed job leaves the last good version in place.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        root = self._path(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(n for n in names if self._fs.exists(self._path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        done = self.versions()
        return self.spark.read.parquet(f"{self.path}/{done[-1]}") if done else None

    def write(self, df: DataFrame) -> None:
        n = int(self.versions()[-1].split("-")[0]) + 1 if self.versions() else 0
        df.write.parquet(f"{self.path}/{n:010d}-{uuid.uuid4().hex[:8]}")

    def upsert(self, batch: DataFrame, key: list[str]) -> None:
        old = self.read()
        self.write(batch.dropDuplicates(key) if old is None else upsert(old, batch.dropDuplicates(key), key))

    def insert_absent(self, batch: DataFrame, key: list[str]) -> None:
        old = self.read()
        self.write(batch.dropDuplicates(key) if old is None else insert_absent(old, batch, key))

    def replace_group(self, batch: DataFrame, key: list[str]) -> None:
        old = self.read()
        self.write(batch if old is None else replace_group(old, batch, key))


def csv_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def geojson_lines(features: DataFrame, path: str) -> None:
    """One GeoJSON feature per line, from ``geojson_features``."""
    features.select("feature").write.mode("overwrite").text(path)


def feature_collection(features: DataFrame, key: list[str]) -> DataFrame:
    """One FeatureCollection text per key, for map tiles: give a key fine enough for one page."""
    body = F.array_join(F.array_sort(F.collect_list("feature")), ",")
    return features.groupBy(*key).agg(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("collection"))


def as_json_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nested columns as JSON text at the edge of the tables."""
    return df.withColumns({c: F.to_json(C(c)) for c in columns})
