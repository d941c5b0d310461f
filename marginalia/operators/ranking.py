"""Numbering rows where one key may hold most of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key are numbered in this many separate windows at least, and no window has many more rows than the second number.
RANK_BUCKETS, RANK_ROWS = 16, 50_000


def rank_within(rows: DataFrame, key: str, order: list[str], n_rows: int) -> DataFrame:
    """``rows`` with ``rank`` from 0 within ``key``, also where one key holds most rows.

    Rows of a key are spread over hashed buckets; the counts of the buckets give each bucket its first number. The order is
    that of ``order`` within a bucket only.
    """
    buckets = max(RANK_BUCKETS, -(-n_rows // RANK_ROWS))
    spread = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = spread.groupBy(key, "_bucket").count().select(key, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order))
    numbered = spread.withColumn("_n", within - 1).join(firsts, [key, "_bucket"])
    return numbered.withColumn("rank", F.col("_first") + F.col("_n")).drop("_bucket", "_first", "_n")
