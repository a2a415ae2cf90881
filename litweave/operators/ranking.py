"""Top-n and full ranking per key without sorting a whole key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litweave.session import written


def top_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """First `n` rows per key with their 0-based rank.

    Spark turns the rank filter into a group limit below the exchange, so every task sends at
    most `n` rows per key.
    """
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where(F.col(rank) <= n).withColumn(rank, F.col(rank) - 1)


def rank_all(
    df: DataFrame,
    keys: Sequence[str],
    buckets: Sequence[Column],
    order: Sequence[Column],
    rank: str = "rank",
) -> DataFrame:
    """0-based rank of every row of a key, computed per bucket.

    `buckets` are expressions that split a key into ranges following `order` (ascending). Only
    one counter per bucket meets in one task; the rows are sorted inside their bucket. The rows
    are written first, because they are read twice.
    """
    names = [f"_bucket{i}" for i in range(len(buckets))]
    rows = written(df.withColumns(dict(zip(names, buckets))), "unranked")
    counts = rows.groupBy(*keys, *names).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, *names, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, *names).orderBy(*order)
    ranked = rows.join(offsets, [*keys, *names]).withColumn(
        rank, (F.row_number().over(inside) - 1 + F.col("_offset")).cast("int")
    )
    return ranked.drop(*names, "_offset")
