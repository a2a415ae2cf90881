"""Review documents assembled from cards and graph.

A document is a table of text pieces (task_id, part, p1, p2, p3, glue, text); its text is
glue + text of all pieces in order. Pieces stay rows until someone asks for one string per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litweave import fixed
from litweave.functions.arrays import first_n
from litweave.functions.text import blank_to, longer_of, looks_like_review, strip
from litweave.operators.graph import Graph

PIECE_ORDER = ("part", "p1", "p2", "p3")


def _pieces(df: DataFrame, part: int, p1, p2, p3, glue, text: Column) -> DataFrame:
    def number(x) -> Column:
        return (x if isinstance(x, Column) else F.lit(x)).cast("int")

    return df.select(
        "task_id",
        F.lit(part).alias("part"),
        number(p1).alias("p1"),
        number(p2).alias("p2"),
        number(p3).alias("p3"),
        (glue if isinstance(glue, Column) else F.lit(glue)).alias("glue"),
        text.alias("text"),
    )


def labelled_oppositions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Opposition edges with the labels of both ends, or their ids where no node exists."""
    names = nodes.select("task_id", "id", "label")
    source = names.toDF("task_id", "source", "_source_label")
    target = names.toDF("task_id", "target", "_target_label")
    joined = (
        edges.where("relation = 'opposes'")
        .join(source, ["task_id", "source"], "left")
        .join(target, ["task_id", "target"], "left")
    )
    return joined.select(
        "task_id",
        "p1",
        "p2",
        F.coalesce("_source_label", "source").alias("source_label"),
        F.coalesce("_target_label", "target").alias("target_label"),
        "rationale",
    )


def family_titles(graph: Graph, cards: DataFrame) -> DataFrame:
    """One row per family member that has a card: the family's place and label, the title."""
    families = graph.nodes.where("type = 'method_family'").select(
        "task_id", F.col("id").alias("cluster_id"), "label", F.col("p1").alias("family_pos")
    )
    named = graph.members.select("task_id", "cluster_id", "paper_id", "pos").join(
        cards.select("task_id", "paper_id", "title"), ["task_id", "paper_id"]
    )
    return families.join(named, ["task_id", "cluster_id"], "left").select(
        "task_id",
        "cluster_id",
        "family_pos",
        "label",
        "pos",
        blank_to(F.col("title"), F.col("paper_id")).alias("title"),
    )


def review_pieces(tasks: DataFrame, cards: DataFrame, graph: Graph, language: str = "zh") -> DataFrame:
    """Pieces of the four-part review of every task in tasks(task_id, topic)."""
    text = fixed.messages(language)
    heads = [
        (0, "", F.concat(F.format_string(text["review_title"], "topic"), F.lit("\n\n" + text["review_families"] + "\n"))),
        (2, "\n\n", F.lit(text["review_papers"] + "\n")),
        (4, "\n", F.lit(text["review_oppositions"] + "\n")),
        (6, "\n\n", F.lit(text["review_gaps"] + "\n")),
    ]
    out = [_pieces(tasks, part, 0, 0, 0, glue, head) for part, glue, head in heads]

    families = graph.nodes.where("type = 'method_family'")
    out.append(
        _pieces(families, 1, F.col("p1"), -1, 0, "\n", F.format_string(text["review_family"], "label"))
    )
    titles = family_titles(graph, cards).where("title is not null")
    # The first member of a family is the card that opened it.
    glue = F.when(F.col("pos") == F.col("family_pos"), F.lit("")).otherwise(F.lit(", "))
    out.append(_pieces(titles, 1, F.col("family_pos"), F.col("pos"), 0, glue, F.col("title")))

    year = F.coalesce(F.nullif("year", F.lit(0)).cast("string"), F.lit("?"))
    results = F.array_join(first_n(F.col("key_results"), fixed.RESULTS_PER_PAPER), "; ")
    lines = [
        F.format_string(text["review_paper"], blank_to(F.col("title"), F.col("paper_id")), year),
        F.format_string(text["review_claim"], blank_to(F.col("core_claim"), text["not_extracted"])),
        F.format_string(text["review_method"], blank_to(F.col("method"), text["not_extracted"])),
        F.when(F.size("key_results") > 0, F.format_string(text["review_results"], results)),
        F.lit(""),
    ]
    listed = cards.select("task_id", "pos", F.posexplode(F.array(*lines)).alias("i", "line"))
    listed = listed.where("line is not null")
    out.append(_pieces(listed, 3, F.col("pos"), F.col("i"), 0, "\n", F.col("line")))

    opposed = labelled_oppositions(graph.nodes, graph.edges)
    line = F.format_string(text["review_opposition"], "source_label", "target_label", "rationale")
    out.append(_pieces(opposed, 5, F.col("p1"), F.col("p2"), 0, "\n", line))
    gap = F.format_string(text["review_gap"], "gap")
    out.append(_pieces(graph.gaps, 7, F.col("part"), F.col("pos"), 0, "\n", gap))
    pieces = out[0]
    for more in out[1:]:
        pieces = pieces.unionByName(more)
    return pieces


def review_text(pieces: DataFrame) -> DataFrame:
    """One string per task. A task has at most 8 candidate papers, which bounds its document."""
    ordered = F.array_sort(F.collect_list(F.struct(*PIECE_ORDER, "glue", "text")))
    body = F.array_join(F.transform(ordered, lambda p: F.concat(p["glue"], p["text"])), "")
    return pieces.groupBy("task_id").agg(body.alias("review"))


def choose_review(
    reviews: DataFrame, finals: DataFrame, existing: DataFrame | None = None
) -> DataFrame:
    """The model's text, or the stored one if longer; the assembled review if that is not usable.

    reviews(task_id, review), finals(task_id, final_text), existing(task_id, stored_text).
    """
    joined = reviews.join(finals, "task_id", "left")
    if existing is None:
        joined = joined.withColumn("stored_text", F.lit(""))
    else:
        joined = joined.join(existing, "task_id", "left")
    best = longer_of(
        strip(F.coalesce("final_text", F.lit(""))), strip(F.coalesce("stored_text", F.lit("")))
    )
    chosen = joined.withColumn("best", best)
    usable = looks_like_review(F.col("best"))
    return chosen.select(
        "task_id",
        F.when(usable, F.col("best")).otherwise(F.col("review")).alias("review"),
        usable.alias("supplied"),
    )
