"""Files for readers: review documents, graphs and spilled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litweave import fixed
from litweave.functions.arrays import add_distinct
from litweave.functions.text import cut, file_slug
from litweave.operators.graph import Graph


def export_md(reviews: DataFrame, folder: str, order: str = "task_id") -> DataFrame:
    """Write reviews(task_id, title, content) below `folder`, one directory per title slug.

    Returns (task_id, path). Equal slugs share a directory: of one call the review with the largest
    `order` is written, and a later call replaces it.
    """
    named = reviews.withColumn("slug", file_slug(F.col("title")))
    last = named.groupBy("slug").agg(F.max_by("content", F.struct(order, "task_id")).alias("content"))
    options = {"partitionOverwriteMode": "dynamic"}
    last.select("slug", "content").write.options(**options).mode("overwrite").partitionBy(
        "slug"
    ).text(folder)
    return named.select("task_id", review_path(folder, F.col("slug")).alias("path"))


def review_path(folder: str, slug: Column) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/slug="), slug)


def register_artifacts(boards: DataFrame, paths: DataFrame) -> DataFrame:
    """Add each task's path to its artifacts once."""
    joined = boards.join(paths, "task_id", "left")
    added = F.when(F.col("path").isNull(), F.col("artifacts")).otherwise(
        add_distinct(F.col("artifacts"), F.col("path"))
    )
    return joined.withColumn("artifacts", added).drop("path")


def graph_records(graph: Graph) -> DataFrame:
    """The graph as JSON records (task_id, kind, part, p1, p2, record), in reading order.

    One record per node, member, edge and gap, so that a graph of any size stays distributed.
    """

    def rows(df: DataFrame, kind: str, part: str, p1: str, p2: str, *fields: str) -> DataFrame:
        return df.select(
            "task_id",
            F.lit(kind).alias("kind"),
            F.expr(part).alias("part"),
            F.expr(p1).alias("p1"),
            F.expr(p2).alias("p2"),
            F.to_json(F.struct(*fields)).alias("record"),
        )

    return (
        rows(graph.nodes, "node", "part", "p1", "p2", "id", "label", "type")
        .unionByName(rows(graph.members, "member", "0", "pos", "0", "cluster_id", "paper_id"))
        .unionByName(
            rows(graph.edges, "edge", "part", "p1", "p2", "source", "target", "relation",
                 "rationale", "evidence")
        )
        .unionByName(rows(graph.gaps, "gap", "part", "pos", "0", "gap"))
    )


def export_graph(graph: Graph, folder: str) -> None:
    """One directory per task with JSON lines (kind, part, p1, p2, record), in reading order."""
    records = graph_records(graph).repartition("task_id").sortWithinPartitions("task_id", "kind", "part", "p1", "p2")
    records.write.mode("overwrite").partitionBy("task_id").json(folder)


def spill_large(
    df: DataFrame, content: str, path: Column, threshold: int = fixed.SPILL_THRESHOLD,
    language: str = "zh",
) -> DataFrame:
    """Replace texts above the threshold by a pointer and their first 500 characters."""
    note = F.format_string(
        fixed.messages(language)["spilled"], path, cut(F.col(content), fixed.SPILL_SUMMARY_CHARS)
    )
    large = F.length(content) > threshold
    return df.withColumn(content, F.when(large, note).otherwise(F.col(content)))


def spilled_texts(df: DataFrame, content: str, threshold: int = fixed.SPILL_THRESHOLD) -> DataFrame:
    """The rows whose text goes to the side table."""
    return df.where(F.length(content) > threshold)


def spill(
    df: DataFrame, content: str, path: Column, folder: str, threshold: int = fixed.SPILL_THRESHOLD,
    language: str = "zh",
) -> DataFrame:
    """Append (path, content) of the texts above the threshold to the side table in `folder`, and
    return `df` with pointers in their place."""
    large = spilled_texts(df, content, threshold).select(path.alias("path"), F.col(content).alias("content"))
    large.write.mode("append").parquet(folder)
    return spill_large(df, content, path, threshold, language)
