"""Cutting lineage and joining on keys that one value may dominate."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only a local session without it gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = _LOCAL.setdefault("folder", tempfile.mkdtemp(prefix="checkpoint-"))
    return folder.rstrip("/")


_LOCAL: dict[str, str] = {}


def checkpoint(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there.

    A written table outlives lost executors, is computed once, and is read back by column with its true size known.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted(df: DataFrame, by: Column, n: int, name: str = "_salt") -> DataFrame:
    """A bucket number from a row's own key, so that one hot join key spreads over ``n`` tasks."""
    return df.withColumn(name, F.pmod(F.xxhash64(by), F.lit(n)).cast("int"))


def spread(df: DataFrame, n: int, name: str = "_salt") -> DataFrame:
    """Every row once per bucket; for the side with one row per key."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
