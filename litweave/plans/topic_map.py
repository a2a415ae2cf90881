"""Map research topics: retrieve → read → synthesise → review, for many topics at once.

Each stage is written to the shared folder before the next one reads it, so a lost executor
costs one stage at most and no stage is computed twice.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litweave.operators import quality, review
from litweave.operators.candidates import named_papers, topic_candidates
from litweave.operators.cards import parse_cards
from litweave.operators.graph import Graph, build_graph
from litweave.session import written
from litweave.sources.store import list_papers
from litweave.sources.vector_cache import VectorCache


class TopicMap(NamedTuple):
    candidates: DataFrame
    cards: DataFrame
    graph: Graph
    reviews: DataFrame
    verdicts: DataFrame
    rework: DataFrame
    tasks: DataFrame


def map_topics(
    topics: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame,
    trace: DataFrame,
    finals: DataFrame,
    card_texts: DataFrame,
    drafts: DataFrame,
    cache: VectorCache | None = None,
) -> TopicMap:
    """topics(task_id, topic, embedding), finals(task_id, final_text) and
    trace(task_id, seq, type, result_preview) of the retrieval run, card_texts(paper_id,
    final_text[, task_id]) as the reading model wrote them, drafts(task_id, final_text) of the
    reviews. With a `cache`, whose provider made `vectors`, quotes are looked up by both lists."""
    papers = written(list_papers(chunks), "papers")
    asked = topics.select(
        F.col("task_id").alias("query_id"), F.col("topic").alias("text"), "embedding"
    )
    named = named_papers(
        finals.withColumnRenamed("task_id", "query_id"),
        trace.withColumnRenamed("task_id", "query_id"),
        papers,
    )
    found = topic_candidates(chunks, vectors, asked, named)
    candidates = written(found.withColumnRenamed("query_id", "task_id"), "candidates")

    wanted = candidates.select("task_id", "paper_id", F.col("rank").alias("pos"))
    keys = [c for c in ("task_id", "paper_id") if c in card_texts.columns]
    cards = written(parse_cards(card_texts.join(wanted, keys), papers), "cards")

    built = build_graph(cards)
    graph = Graph(*[written(df, name) for name, df in zip(Graph._fields, built)])
    pieces = review.review_pieces(topics.select("task_id", "topic"), cards, graph)
    reviews = written(review.choose_review(review.review_text(pieces), drafts), "reviews")

    missing = quality.missing_cards(candidates, cards)
    if cache is None:
        checked = quality.check_quotes(cards, chunks)
    else:
        checked = quality.check_quotes(cards, chunks, vectors, quality.quote_vectors(cards, cache))
    bad = written(quality.unverified_quotes(checked), "unverified")
    issues = quality.issues(topics, missing, bad, graph.nodes, graph.edges)
    verdict_rows = written(quality.verdicts(topics, issues), "verdicts")
    # A failed gate still ends as done; `passed` tells the difference.
    tasks = topics.select("task_id", "topic").join(
        verdict_rows.select("task_id", "passed"), "task_id"
    ).withColumn("status", F.lit("done"))
    return TopicMap(
        candidates, cards, graph, reviews, verdict_rows,
        quality.rework(verdict_rows, missing, graph.nodes), tasks,
    )
