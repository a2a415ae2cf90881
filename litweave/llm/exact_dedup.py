"""Exact duplicates by content sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WHITE_SPACE, partitions, row_of, written

#: Rows of one text that one sorted run may hold; a text with more is spread over several runs.
RUN_ROWS = 4096
#: Characters of a text by which splitters are chosen and rows sorted first.
HEAD = 64


def normalised(text: Column) -> Column:
    """White space runs become one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def exact_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_rows: int = RUN_ROWS
) -> DataFrame:
    """Each row of `df` with its group of equal texts.

    Returns `row` (the input row as a struct), `keep_id` (smallest identifier of the group),
    `group_size`, `kept` (true for one row of the group, one with that identifier) and
    `text_sha256` (of the normalised text).

    The normalised bytes are dealt out by sampled splitters (`repartitionByRange`) and sorted
    externally, first by their heads; the window over the sorted rows compares each text in full
    with its neighbour.
    Equal texts may be a third of all rows, so a first pass counts digests (combined map-side) and
    those with more than `run_rows` rows are spread over several runs; the totals of such a text
    come from that count. The texts themselves move once.

    Defined results: null text equals the empty text; rows with a null identifier come last in
    their group, and a group of only such rows has a null `keep_id` and keeps one of them; of
    repeated rows (same identifier and text) one is kept; an empty table gives no rows; columns
    of `df` are never looked at except the two named.
    """
    rows = df.select(
        row_of(df).alias("row"),
        F.col(id_col).alias("id"),
        normalised(F.col(text_col)).alias("norm"),
    ).withColumn("text_sha256", F.sha2(F.col("norm"), 256))
    counted = rows.groupBy("text_sha256").agg(
        F.count("*").alias("all_rows"), F.min("id").alias("all_min")
    )
    # A written table has a known size: Spark broadcasts it only below its threshold.
    large = written(counted.where(F.col("all_rows") > run_rows), "large-texts")
    runs = F.ceil(F.col("all_rows") / run_rows)
    salted = rows.join(large, "text_sha256", "left").withColumn(
        "run", F.when(runs > 1, F.pmod(F.xxhash64("id"), runs)).otherwise(F.lit(0))
    )
    # Splitters are sampled from the head of the text and its digest, so the sample that the driver
    # gets is small however long the texts are; equal texts have equal heads and digests.
    ranged = salted.withColumn("head", F.substring("norm", 1, HEAD)).repartitionByRange(
        partitions(df.sparkSession), "head", "text_sha256", "run"
    )
    same = W.partitionBy("head", "text_sha256", "run", "norm")
    ordered = ranged.select(
        "row",
        "id",
        "text_sha256",
        F.row_number().over(same.orderBy(F.asc_nulls_last("id"))).alias("nth"),
        F.when(F.col("all_rows").isNull(), F.min("id").over(same)).otherwise(F.col("all_min")).alias("keep_id"),
        F.coalesce("all_rows", F.count("*").over(same)).alias("group_size"),
    )
    kept = (F.col("nth") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))
    return ordered.select("row", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` with one row of each group of equal texts, the one with the smallest identifier."""
    return exact_groups(df, id_col, text_col).where("kept").select("row.*")
