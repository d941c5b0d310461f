"""Versions of a table as folders: a reader sees the last one that was written completely."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Complete versions of a table that are kept.
KEPT = 3


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete versions under ``root``, ascending."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [(s.getPath(), re.fullmatch(r"v(\d+)", s.getPath().getName())) for s in files.listStatus(path)]
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(m[1]) for p, m in names if m and files.exists(marker(p, "_SUCCESS")))


def publish(df: DataFrame, root: str, keep: int = KEPT) -> int:
    """Writes ``df`` as the next version; it counts from the moment its success marker is there. A table has one publisher.

    The last ``keep`` versions stay, for readers that began before.
    """
    spark = df.sparkSession
    before = versions(spark, root)
    number = (before or [0])[-1] + 1
    df.write.mode("overwrite").parquet(f"{root}/v{number:08d}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for old in [*before, number][:-keep]:
        gone = path(f"{root}/v{old:08d}")
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    return number


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The last complete version, or None."""
    numbers = versions(spark, root)
    return spark.read.parquet(f"{root}/v{numbers[-1]:08d}") if numbers else None
