"""Token-budget batches in length buckets of least padding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_SPACE, partitions, written

BUCKETS = 8
BUDGET = 16384


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"^{WHITE_SPACE}|{WHITE_SPACE}$", ""), WHITE_SPACE)
    return F.when(F.coalesce(text, F.lit("")).rlike("[^\\x20\\x09-\\x0D]"), F.size(parts)).otherwise(0).cast("long")


def _layer(before: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every j the least before[i] + lengths[j] × (rows[j + 1] − rows[i]) over i <= j, and the smallest such i.

    The smallest best i never falls as j grows. So the middle j of a range bounds the searches of both halves; the
    middles of all ranges of one depth are searched together, over about 2 n candidates.
    """
    n = len(lengths)
    best, cut = np.empty(n, before.dtype), np.empty(n, np.int64)
    first, last, low, high = (np.array([v], np.int64) for v in (0, n - 1, 0, n - 1))
    while len(first):
        mid = (first + last) // 2
        size = np.minimum(high, mid) - low + 1
        starts = np.cumsum(size) - size
        i = np.arange(size.sum()) - np.repeat(starts - low, size)
        j = np.repeat(mid, size)
        tried = before[i] + lengths[j] * (rows[j + 1] - rows[i])
        least = np.minimum.reduceat(tried, starts)
        at = np.minimum.reduceat(np.where(tried == np.repeat(least, size), i, n), starts)
        best[mid], cut[mid] = least, at
        left, right = first < mid, mid < last
        first, last, low, high = (
            np.concatenate((first[left], mid[right] + 1)),
            np.concatenate((mid[left] - 1, last[right])),
            np.concatenate((low[left], at[right])),
            np.concatenate((at[left], high[right])),
        )
    return best, cut


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """At most `buckets` of the ascending `lengths` as upper boundaries, the last one included, such
    that sum(boundary × rows) is least; of equal choices the one with the smallest boundaries from
    the end.

    Dynamic programming over the histogram: cost[k][j] is the least cost of the first j + 1 lengths
    in k buckets, in O(buckets × n log n).
    """
    n = len(lengths)
    if not n:
        return []
    rows = np.concatenate(([0], np.cumsum(counts)))
    cost = lengths * rows[1:]
    cuts = []
    for _ in range(min(buckets, n) - 1):
        # a bucket (i, j] follows the first i lengths; i = 0 stands for fewer buckets
        cost, cut = _layer(np.concatenate(([0], cost)), lengths, rows)
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(cut[j - 1])
    if j:
        out.append(int(lengths[j - 1]))
    return sorted(out)


def packed(
    df: DataFrame,
    length: Column,
    id_col: str = "doc_id",
    buckets: int = BUCKETS,
    budget: int = BUDGET,
) -> DataFrame:
    """Rows → (doc_id, n_tokens, bucket, bound, batch, slot).

    `bucket` numbers the length buckets from 0, `bound` is the padded length of its rows, `batch`
    the batch within the bucket and `slot` the place in the batch. Batches take the bucket's rows in
    order of (length, identifier), as many as keep rows × bound within `budget`, one at least.

    Boundaries come from the histogram of all rows, which is all the driver gets: one row per distinct length.
    n different lengths take n² / 2 words at least, so 100 TB of text have under 6 million. Rows are dealt out by ranges of (length, identifier), so
    a length that a third of the rows share is spread too; their place follows from the counts of
    the ranges before, so no bucket is ever in one task.

    Defined results: a null length counts as 0; rows of length 0 are a length like any other and
    cost nothing; null identifiers come first; repeated rows each take a slot; a row longer than
    the budget is a batch of its own; an empty table gives no rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("doc_id"), F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("n_tokens"))
    # Written before they are dealt out: ranges are sampled from all rows, and words would be counted for that too.
    rows = written(rows, "row-lengths")
    ranged = rows.repartitionByRange(partitions(spark), F.col("n_tokens"), F.col("doc_id").asc_nulls_first())
    placed = ranged.sortWithinPartitions("n_tokens", F.col("doc_id").asc_nulls_first())
    # Written once: the numbers below hold for this order of rows.
    placed = written(placed.withColumn("place", F.monotonically_increasing_id()), "lengths")
    histogram = placed.groupBy(F.col("n_tokens").alias("bound")).agg(F.count("*").alias("n")).orderBy("bound").toPandas()
    bounds = best_boundaries(histogram["bound"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64), buckets)
    sizes = [int(histogram["n"][histogram["bound"] <= b].sum()) for b in bounds]

    part = F.shiftright("place", 33)
    ends = placed.groupBy(part.alias("part")).agg(F.max("place").alias("last")).collect()  # one row per partition
    offset, offsets = 0, []
    for r in sorted(ends):
        offsets.append((int(r["part"]), offset))
        offset += (int(r["last"]) & ((1 << 33) - 1)) + 1
    starts = spark.createDataFrame(offsets or [(0, 0)], "part long, offset long")
    located = placed.join(F.broadcast(starts), part == F.col("part")).withColumn(
        "nth", F.col("offset") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    )
    before = [0, *sizes[:-1]]
    table = F.array(*[F.struct(F.lit(k).alias("bucket"), F.lit(b).alias("bound"), F.lit(s).cast("long").alias("start")) for k, (b, s) in enumerate(zip(bounds, before))])
    if not bounds:
        return placed.select("doc_id", "n_tokens", *[F.lit(0).cast(t).alias(c) for c, t in (("bucket", "int"), ("bound", "long"), ("batch", "long"), ("slot", "long"))])
    own = F.get(F.filter(table, lambda b: b["bound"] >= F.col("n_tokens")), F.lit(0))
    held = located.withColumn("own", own)
    bound = F.col("own.bound").cast("long")
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(bound, F.lit(1)))).cast("long")
    nth = F.col("nth") - F.col("own.start")
    return held.select(
        "doc_id",
        "n_tokens",
        F.col("own.bucket").alias("bucket"),
        bound.alias("bound"),
        F.floor(nth / fit).cast("long").alias("batch"),
        (nth % fit).alias("slot"),
    )
