"""The chunk store: chunk and vector tables on shared storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litweave import schema
from litweave.operators.vectors import embed
from litweave.session import written
from litweave.sources.buckets import BucketStore, read_table


def all_chunks(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """Chunks with their metadata and no vectors; filters reach the file scan."""
    chunks = BucketStore(spark, path, schema.CHUNKS).read()
    if where is not None:
        chunks = chunks.where(where)
    return chunks.withColumn("text", F.coalesce("text", F.lit("")))


def list_papers(chunks: DataFrame) -> DataFrame:
    """(paper_id, title, year) as the first chunk of each paper tells them."""
    first = (
        chunks.where("paper_id <> ''")
        .groupBy("paper_id")
        .agg(F.min_by(F.struct("title", "year"), "chunk_index").alias("first"))
    )
    return first.select(
        "paper_id",
        F.coalesce("first.title", F.lit("")).alias("title"),
        F.coalesce("first.year", F.lit(0)).alias("year"),
    )


def count(chunks: DataFrame) -> int:
    return chunks.count()


def all_vectors(spark: SparkSession, path: str) -> DataFrame:
    return BucketStore(spark, path, schema.VECTORS).read()


def add_chunks(
    chunks: DataFrame,
    path: str,
    vector_path: str | None = None,
    provider: Callable[[list[str]], list[list[float]]] | None = None,
) -> None:
    """Store chunks, and with a provider their vectors in a table of their own.

    A stored row is never replaced, and running the same append again adds nothing. The batch is computed
    once; the provider gets only chunks without a stored vector, each once.
    """
    spark = chunks.sparkSession
    batch = written(chunks, "chunks") if vector_path and provider else chunks
    BucketStore(spark, path, schema.CHUNKS).append(batch)
    if vector_path and provider:
        vectors = BucketStore(spark, vector_path, schema.VECTORS)
        vectors.append(batch.select("chunk_id", "text"), lambda fresh: embed(fresh, "text", provider))
