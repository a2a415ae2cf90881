"""Ingest: papers → titles, years, sections, chunks → chunk rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litweave import fixed
from litweave.functions.arrays import let
from litweave.functions.text import publication_year
from litweave.operators import structure
from litweave.sources.papers import full_text


def parse_papers(
    papers: DataFrame, size: int = fixed.CHUNK_CHARS, overlap: int = fixed.CHUNK_OVERLAP
) -> DataFrame:
    """(paper_id, source, title, year, chunks) from papers with their lines. Map-only.

    A paper without lines keeps its file stem as title, year 0 and no chunks.
    """
    lines = F.col("lines")
    has_lines = F.size(lines) > 0
    year = publication_year(F.col("creation_date"), full_text(lines))
    facts = papers.select(
        "paper_id",
        "source",
        structure.title(lines, F.col("stem")).alias("title"),
        F.when(has_lines, year).otherwise(F.lit(0)).alias("year"),
        structure.body_size(lines).alias("body"),
        "lines",
    )
    split = facts.withColumn("sections", structure.sections(lines, F.col("body")))
    return split.select(
        "paper_id",
        "source",
        "title",
        "year",
        structure.chunks(F.col("sections"), size, overlap).alias("chunks"),
    )


def chunk_rows(parsed: DataFrame) -> DataFrame:
    """One row per chunk: chunk_id, paper_id, text and flat metadata.

    Whole rows are built inside the array: a column computed beside an exploded array would be
    computed again for each of its elements.
    """

    def row(paper: Column, c: Column, i: Column) -> Column:
        return F.struct(
            F.concat_ws("_", paper["paper_id"], i).alias("chunk_id"),
            paper["paper_id"].alias("paper_id"),
            c["text"].alias("text"),
            paper["title"].alias("title"),
            paper["year"].alias("year"),
            paper["source"].alias("source"),
            c["section"].alias("section"),
            c["page"].alias("page"),
            c["start_page"].alias("start_page"),
            i.alias("chunk_index"),
        )

    rows = let(
        F.struct("paper_id", "title", "year", "source"),
        lambda paper: F.transform("chunks", lambda c, i: row(paper, c, i)),
    )
    return parsed.select(F.inline(rows))


def ingest_report(parsed: DataFrame) -> DataFrame:
    """Chunks per paper; papers that gave none are counted with 0."""
    return parsed.select("paper_id", "title", "year", F.size("chunks").alias("chunks"))


def ingest_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count("*").alias("papers"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks")
    )
