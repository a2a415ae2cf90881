"""A directory of files into the chunk store in one call, with a report."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litweave.plans.ingest import chunk_rows, ingest_report, ingest_totals, parse_papers
from litweave.session import written
from litweave.sources.papers import decode_files, pdf_files
from litweave.sources.store import add_chunks


class Ingested(NamedTuple):
    report: DataFrame
    totals: DataFrame
    errors: DataFrame


def ingest_dir(
    spark: SparkSession,
    directory: str,
    decode: Callable[[bytes], dict],
    chunk_path: str,
    vector_path: str | None = None,
    provider: Callable[[list[str]], list[list[float]]] | None = None,
    pattern: str = "*.pdf",
) -> Ingested:
    """Store the chunks of all files below `directory`.

    `report` has (paper_id, title, year, chunks) per file, `totals` the files and chunks, `errors` (source,
    error) of files that could not be decoded; those have no chunks but are counted. Files are decoded once.
    Files stored by an earlier call add nothing. A directory without such files gives empty tables.
    """
    papers = written(decode_files(pdf_files(spark, directory, pattern), decode), "decoded")
    parsed = written(parse_papers(papers), "parsed")
    add_chunks(chunk_rows(parsed), chunk_path, vector_path, provider)
    report = ingest_report(parsed)
    return Ingested(report, ingest_totals(report), papers.where(F.col("error").isNotNull()).select("source", "error"))
