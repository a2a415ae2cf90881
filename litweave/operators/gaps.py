"""Research gaps by fixed heuristics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litweave import fixed
from litweave.functions.text import strip
from litweave.operators.graph import family_label
from litweave.operators.ranking import top_n


def single_families(cards: DataFrame, language: str = "zh") -> DataFrame:
    """Families of one paper, by exact label (clusters go by slug), in first-seen order."""
    unclassified = fixed.messages(language)["unclassified"]
    counted = (
        cards.withColumn("family", family_label(language))
        .groupBy("task_id", "family")
        .agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    )
    return counted.where((F.col("n") == 1) & (F.col("family") != unclassified)).drop("n")


def frequent_limitations(cards: DataFrame) -> DataFrame:
    """The 3 most stated limitations of a task, kept when stated twice or more and not empty.

    Repeats inside one card count. Ties go to the one seen first.
    """
    stated = cards.select(
        "task_id", "pos", F.posexplode("limitations").alias("lim_pos", "limitation")
    ).withColumn("limitation", strip(F.col("limitation")))
    counted = stated.groupBy("task_id", "limitation").agg(
        F.count("*").alias("n"), F.min(F.struct("pos", "lim_pos")).alias("first")
    )
    top = top_n(counted, ["task_id"], [F.desc("n"), F.col("first")], fixed.TOP_LIMITATIONS)
    return top.where("n >= 2 and limitation <> ''")


def detect_gaps(cards: DataFrame, language: str = "zh") -> DataFrame:
    """(task_id, part, pos, gap) in order of (part, pos); no cards, no gaps."""
    text = fixed.messages(language)

    def rows(df: DataFrame, part: int, pos: Column, gap: Column) -> DataFrame:
        return df.select(
            "task_id", F.lit(part).alias("part"), pos.cast("int").alias("pos"), gap.alias("gap")
        )

    singles = rows(
        single_families(cards, language),
        1,
        F.col("first"),
        F.format_string(text["gap_single"], F.col("family")),
    )
    limits = rows(
        frequent_limitations(cards),
        2,
        F.col("rank"),
        F.format_string(text["gap_limitation"], F.col("limitation")),
    )
    flags = cards.groupBy("task_id").agg(F.bool_or(F.size("opposes") > 0).alias("opposed"))
    opposed = rows(flags.where("opposed"), 3, F.lit(0), F.lit(text["gap_opposition"]))
    found = singles.unionByName(limits).unionByName(opposed)
    calm = flags.where("not opposed").join(
        singles.unionByName(limits).select("task_id"), "task_id", "left_anti"
    )
    return found.unionByName(rows(calm, 4, F.lit(0), F.lit(text["gap_none"])))
