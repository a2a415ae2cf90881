"""Graph of method families, papers and opposing views, as node and edge tables.

Every table carries its own order columns (`part`, `p1`, `p2`) in place of list positions. Family
members are rows, not arrays, so a family of any size stays distributed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litweave import fixed
from litweave.functions.arrays import first_n
from litweave.functions.json_text import quotes
from litweave.functions.text import blank_to, slug, strip
from litweave.operators.matching import first_match


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    members: DataFrame
    gaps: DataFrame


def family_label(language: str = "zh") -> Column:
    return blank_to(F.col("method_family"), fixed.messages(language)["unclassified"])


def family_id() -> Column:
    return F.concat(F.lit("family::"), slug(F.col("family")))


def with_family(
    cards: DataFrame, paper_ids: list[str] | None = None, language: str = "zh"
) -> DataFrame:
    """Cards with `family` and `cluster_id`. A non-empty id list selects and orders the cards."""
    if paper_ids:
        wanted = F.array(*[F.lit(p) for p in paper_ids])
        cards = cards.where(F.col("paper_id").isin(paper_ids)).withColumn(
            "pos", (F.array_position(wanted, F.col("paper_id")) - 1).cast("int")
        )
    named = cards.withColumn("family", family_label(language))
    return named.withColumn("cluster_id", family_id())


def cluster_cards(
    cards: DataFrame, paper_ids: list[str] | None = None, language: str = "zh"
) -> DataFrame:
    """(task_id, cluster_id, label, first_pos, n_members); the label seen first names a family."""
    return (
        with_family(cards, paper_ids, language)
        .groupBy("task_id", "cluster_id")
        .agg(
            F.min_by("family", "pos").alias("label"),
            F.min("pos").alias("first_pos"),
            F.count("*").alias("n_members"),
        )
    )


def cluster_members(
    cards: DataFrame, paper_ids: list[str] | None = None, language: str = "zh"
) -> DataFrame:
    """(task_id, cluster_id, pos, paper_id), members ordered by `pos`."""
    return with_family(cards, paper_ids, language).select(
        "task_id", "cluster_id", "pos", "paper_id"
    )


def _name() -> Column:
    return blank_to(F.col("title"), F.col("paper_id"))


def _supports(cards: DataFrame, clusters: DataFrame, text: dict, language: str) -> DataFrame:
    joined = with_family(cards, None, language).join(clusters, ["task_id", "cluster_id"])
    return joined.select(
        "task_id",
        F.lit(0).alias("part"),
        F.col("first_pos").alias("p1"),
        F.col("pos").alias("p2"),
        F.col("paper_id").alias("source"),
        F.col("cluster_id").alias("target"),
        F.lit("supports").alias("relation"),
        F.format_string(text["supports"], _name(), F.col("label")).alias("rationale"),
        F.array().cast("array<string>").alias("evidence"),
    )


def _targets(cards: DataFrame, clusters: DataFrame) -> DataFrame:
    """What an opposition may name. A repeated title keeps its first place and its last paper."""
    titles = (
        cards.where("title <> ''")
        .groupBy("task_id", F.lower("title").alias("text"))
        .agg(F.min("pos").alias("pos"), F.max_by("paper_id", "pos").alias("target"))
        .withColumn("kind", F.lit(0))
    )
    families = clusters.select(
        "task_id",
        F.lower("label").alias("text"),
        F.col("first_pos").alias("pos"),
        F.col("cluster_id").alias("target"),
        F.lit(1).alias("kind"),
    )
    return titles.unionByName(families)


def _oppositions(cards: DataFrame, clusters: DataFrame) -> DataFrame:
    """Each opposed view with the node it names, if any."""
    stated = cards.select(
        "task_id",
        "pos",
        "paper_id",
        _name().alias("name"),
        first_n(quotes(F.col("evidence_spans")), 1).alias("evidence"),
        F.posexplode("opposes").alias("opp_pos", "opp"),
    ).withColumn("key", strip(F.lower("opp")))
    names = stated.select("task_id", F.col("key").alias("name"))
    resolved = first_match(names, _targets(cards, clusters)).withColumnRenamed("name", "key")
    return stated.join(resolved, ["task_id", "key"], "left")


def _viewpoint() -> Column:
    return F.concat(F.lit("viewpoint::"), slug(F.col("opp")))


def _opposes(oppositions: DataFrame, text: dict) -> DataFrame:
    return oppositions.select(
        "task_id",
        F.lit(1).alias("part"),
        F.col("pos").alias("p1"),
        F.col("opp_pos").alias("p2"),
        F.col("paper_id").alias("source"),
        F.coalesce("target", _viewpoint()).alias("target"),
        F.lit("opposes").alias("relation"),
        F.format_string(text["opposes"], F.col("name"), F.col("opp")).alias("rationale"),
        "evidence",
    )


def _nodes(cards: DataFrame, clusters: DataFrame, oppositions: DataFrame) -> DataFrame:
    def node(kind: str, part: int, node_id, label, p1, p2) -> list[Column]:
        return [
            F.col("task_id"),
            node_id.alias("id"),
            label.alias("label"),
            F.lit(kind).alias("type"),
            F.struct(F.lit(part).alias("part"), p1.alias("p1"), p2.alias("p2")).alias("at"),
        ]

    zero = F.lit(0)
    families = clusters.select(
        *node("method_family", 0, F.col("cluster_id"), F.col("label"), F.col("first_pos"), zero)
    )
    papers = cards.select(*node("paper", 1, F.col("paper_id"), _name(), F.col("pos"), zero))
    views = oppositions.where("target is null").select(
        *node("viewpoint", 2, _viewpoint(), F.col("opp"), F.col("pos"), F.col("opp_pos"))
    )
    every = families.unionByName(papers).unionByName(views)
    first = every.groupBy("task_id", "id").agg(
        F.min_by(F.struct("label", "type", "at"), "at").alias("n")
    )
    return first.select(
        "task_id", "id", "n.label", "n.type", "n.at.part", "n.at.p1", "n.at.p2"
    )


def build_graph(cards: DataFrame, language: str = "zh") -> Graph:
    """Nodes, edges, family members and gaps of every task that has cards.

    Papers support their family. An opposed view points at the first title that contains it or
    is contained in it, else at such a family, else at a viewpoint node of its own. The evidence
    of an opposition is the first quote of the card that states it.
    """
    from litweave.operators.gaps import detect_gaps

    text = fixed.messages(language)
    clusters = cluster_cards(cards, None, language)
    oppositions = _oppositions(cards, clusters)
    edges = _supports(cards, clusters, text, language).unionByName(_opposes(oppositions, text))
    return Graph(
        nodes=_nodes(cards, clusters, oppositions),
        edges=edges,
        members=cluster_members(cards, None, language),
        gaps=detect_gaps(cards, language),
    )


def with_strength(edges: DataFrame) -> DataFrame:
    """Optional downgrade: oppositions without evidence are only `possibly_related`."""
    weak = (F.col("relation") == "opposes") & (F.size("evidence") == 0)
    return edges.withColumn(
        "strength", F.when(weak, F.lit("possibly_related")).otherwise(F.lit("asserted"))
    )


def graph_totals(tasks: DataFrame, graph: Graph) -> DataFrame:
    """Numbers of nodes, edges and gaps per task, 0 where there are none."""

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("task_id").agg(F.count("*").alias(name))

    counts = tasks.select("task_id")
    for df, name in ((graph.nodes, "nodes"), (graph.edges, "edges"), (graph.gaps, "gaps")):
        counts = counts.join(count(df, name), "task_id", "left")
    return counts.na.fill(0, ["nodes", "edges", "gaps"])
