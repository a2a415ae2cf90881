"""Typed paper cards from model-written text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litweave import fixed
from litweave.functions.json_text import (
    evidence_field, json_object, list_field, text_field, year_field,
)
from litweave.functions.text import blank_to

CARD_COLUMNS = (
    "task_id", "pos", "paper_id", "title", "authors", "year", "venue", "core_claim", "method",
    "method_family", "key_results", "stance_tags", "opposes", "limitations", "evidence_spans",
)


def read_cards(card_raw: DataFrame) -> DataFrame:
    """card_raw(task_id, pos, paper_id, final_text) → cards. Unknown keys are ignored, and so is
    a `paper_id` inside the text."""
    objects = card_raw.select(
        "task_id", "pos", "paper_id", json_object(F.col("final_text")).alias("v")
    )
    v = F.col("v")
    fields = {f: text_field(v, f) for f in fixed.TEXT_FIELDS}
    fields |= {f: F.coalesce(fields[f], F.lit("")) for f in fixed.TEXT_FIELDS if f != "venue"}
    fields |= {f: list_field(v, f) for f in fixed.LIST_FIELDS if f != "evidence_spans"}
    fields["year"] = year_field(v)
    fields["evidence_spans"] = evidence_field(v)
    return objects.withColumns(fields).select(*CARD_COLUMNS)


def fill_metadata(cards: DataFrame, papers: DataFrame) -> DataFrame:
    """Take a missing title ('') or year (0) from the catalogue papers(paper_id, title, year)."""
    known = papers.select(
        "paper_id", F.col("title").alias("_title"), F.col("year").alias("_year")
    )
    joined = cards.join(known, "paper_id", "left")
    return joined.select(
        *[c for c in CARD_COLUMNS if c not in ("title", "year")],
        F.coalesce(F.nullif("title", F.lit("")), "_title", F.lit("")).alias("title"),
        F.coalesce(F.nullif("year", F.lit(0)), "_year", F.lit(0)).alias("year"),
    ).select(*CARD_COLUMNS)


def parse_cards(card_raw: DataFrame, papers: DataFrame) -> DataFrame:
    return fill_metadata(read_cards(card_raw), papers)


def card_briefs(cards: DataFrame, language: str = "zh") -> DataFrame:
    """One line per card: id, title, year, family, claim and opposed views."""
    text = fixed.messages(language)
    year = F.coalesce(F.nullif("year", F.lit(0)).cast("string"), F.lit("?"))
    line = F.format_string(
        text["brief"],
        "paper_id",
        blank_to(F.col("title"), "?"),
        year,
        blank_to(F.col("method_family"), "?"),
        blank_to(F.col("core_claim"), "?"),
        blank_to(F.array_join("opposes", ", "), text["brief_none"]),
    )
    return cards.select("task_id", "pos", line.alias("brief"))


def task_briefs(tasks: DataFrame, briefs: DataFrame, language: str = "zh") -> DataFrame:
    """Brief lines of every task; a task without cards gets one placeholder line."""
    joined = tasks.select("task_id").join(briefs, "task_id", "left")
    return joined.select(
        "task_id",
        F.coalesce("pos", F.lit(0)).alias("pos"),
        F.coalesce("brief", F.lit(fixed.messages(language)["brief_empty"])).alias("brief"),
    )
