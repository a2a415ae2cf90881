"""Reciprocal-rank fusion and hybrid retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litweave import fixed
from litweave.functions.numbers import round_exact
from litweave.functions.text import cut
from litweave.operators.bm25 import CHUNK_KEYS, bm25
from litweave.operators.keyword_index import KeywordIndex, search
from litweave.operators.ranking import top_n
from litweave.operators.vectors import nearest
from litweave.session import written


def paper_filter(year_min: int | None = None, paper_id: str | None = None) -> Column:
    """Metadata predicate on chunks: year at least, paper equal, both, or none."""
    condition = F.lit(True)
    if year_min is not None:
        condition = condition & (F.col("year") >= year_min)
    if paper_id:
        condition = condition & (F.col("paper_id") == paper_id)
    return condition


def with_year_scopes(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Chunks once per distinct `year_min` of the queries they satisfy.

    For query sets in which every query has its own year limit: search the result with
    `scope=["year_min"]`, and the statistics of each limit are those of its own corpus. The last
    year is that of the newest chunk, so the comparison is an equi-join on the year. Queries
    without a limit match nothing here; `mixed_search` takes them.
    """
    newest = chunks.select(F.max("year")).scalar()
    limits = queries.select("year_min").where("year_min is not null").distinct()
    reached = limits.withColumn("newest", newest).where("year_min <= newest")
    years = F.explode(F.sequence("year_min", "newest")).alias("year")
    return chunks.join(reached.select("year_min", years), "year")


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame) -> DataFrame:
    """Merge two ranked lists: raw = Σ 1 / (60 + rank)."""
    none = F.lit(None).cast("int")
    from_vectors = vector_hits.select(
        "query_id", *CHUNK_KEYS, F.col("rank").alias("v_rank"), none.alias("k_rank")
    )
    from_keywords = keyword_hits.select(
        "query_id", *CHUNK_KEYS, none.alias("v_rank"), F.col("rank").alias("k_rank")
    )
    merged = (
        from_vectors.unionByName(from_keywords)
        .groupBy("query_id", *CHUNK_KEYS)
        .agg(F.max("v_rank").alias("v_rank"), F.max("k_rank").alias("k_rank"))
    )

    def share(rank: str) -> Column:
        return F.coalesce(1.0 / (fixed.RRF_K + F.col(rank)), F.lit(0.0))

    return merged.withColumn("raw", share("v_rank") + share("k_rank"))


def fused_order() -> list[Column]:
    """Higher sum first; ties as found: the vector list's order, then the keyword list's."""
    return [F.desc("raw"), F.asc_nulls_last("v_rank"), F.asc_nulls_last("k_rank")]


def located(vectors: DataFrame, corpus: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Vectors of the chunks of a corpus, with the columns that order and scope them."""
    keys = list(dict.fromkeys([*CHUNK_KEYS, *scope]))
    return vectors.select("chunk_id", "embedding").join(corpus.select(*keys), "chunk_id")


def hybrid_search(
    chunks: DataFrame,
    vectors: DataFrame | None,
    queries: DataFrame,
    top_k: int = fixed.DEFAULT_TOP_K,
    year_min: int | None = None,
    paper_id: str | None = None,
    scope: Sequence[str] = (),
    index: KeywordIndex | None = None,
) -> DataFrame:
    """Vector and keyword retrieval fused per query.

    chunks(chunk_id, paper_id, chunk_index, text, year…), vectors(chunk_id, embedding),
    queries(query_id, text, embedding[, scope…]). Each list is cut at 3 × top_k before fusing.
    `scope=["paper_id"]` searches each query only inside the paper it names. Without `vectors`
    the keyword list is fused alone. A query whose filtered corpus is empty has no hits.
    With an `index` of the chunks no text is read: papers are searched by their stored terms, all else by
    posting blocks, and limits on the year are conditions on the shards.
    """
    fetch = fixed.OVERFETCH * top_k
    if index is not None:
        chunks = index.corpus if not scope or "year_min" not in scope else with_year_scopes(index.corpus, queries)
    corpus = chunks.where(paper_filter(year_min, paper_id))
    if index is not None and not paper_id and "paper_id" not in scope:
        asked = queries.select("query_id", "text", *scope)
        if year_min is not None:
            asked = asked.withColumn("year_min", F.lit(year_min))
        keyword_hits = search(index, asked, fetch)
    else:
        keyword_hits = bm25(corpus, queries, fetch, scope)
    if vectors is None:
        vector_hits = keyword_hits.where(F.lit(False))
    else:
        placed = located(vectors, corpus, scope)
        # With a scope they are counted twice and then sent.
        vector_hits = nearest(written(placed, "located-vectors") if scope else placed, queries, fetch, scope)
    ranked = top_n(fuse(vector_hits, keyword_hits), ["query_id"], fused_order(), top_k)
    return ranked.select("query_id", *CHUNK_KEYS, fused_score().alias("score"), "rank")


def mixed_search(
    chunks: DataFrame,
    vectors: DataFrame | None,
    queries: DataFrame,
    top_k: int = fixed.DEFAULT_TOP_K,
    index: KeywordIndex | None = None,
) -> DataFrame:
    """Hybrid retrieval for queries(query_id, text, embedding, year_min, paper_id) that each have
    both filters, one, or none: a null year and a null or blank paper are no filter.

    Queries with the same kind of filter are answered together, each in the corpus and with the
    statistics of its own filter.
    """
    by_year = F.col("year_min").isNotNull()
    by_paper = F.trim(F.coalesce("paper_id", F.lit(""))) != ""
    own = queries.where(by_paper & by_year)
    if index is not None:
        chunks = index.corpus
    in_paper = chunks.join(own.select("paper_id").distinct(), "paper_id", "left_semi")
    dated = queries.where(by_year & ~by_paper).drop("paper_id")
    of_years = chunks if index is not None else with_year_scopes(chunks, dated)
    found = [
        hybrid_search(chunks, vectors, queries.where(~by_year & ~by_paper).drop("year_min", "paper_id"), top_k, index=index),
        hybrid_search(chunks, vectors, queries.where(by_paper & ~by_year).drop("year_min"), top_k, scope=["paper_id"], index=index),
        hybrid_search(of_years, vectors, dated, top_k, scope=["year_min"], index=index),
        hybrid_search(with_year_scopes(in_paper, own), vectors, own, top_k, scope=["paper_id", "year_min"]),
    ]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def fused_score() -> Column:
    return round_exact(F.col("raw"), 6)


def hits(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Displayable hits: text cut to 600 characters, score rounded to 3, chunk metadata."""
    details = chunks.select("chunk_id", "text", "title", "year", "source", "section", "page")
    return found.join(details, "chunk_id").select(
        "query_id",
        "rank",
        "paper_id",
        cut(F.col("text"), fixed.HIT_TEXT_CHARS).alias("text"),
        round_exact(F.col("score"), 3).alias("score"),
        F.struct("title", "year", "source", "section", "page", "chunk_index").alias("meta"),
    )


def rag_query(
    chunks: DataFrame,
    vectors: DataFrame | None,
    queries: DataFrame,
    top_k: int = fixed.DEFAULT_TOP_K,
    year_min: int = 0,
    paper_id: str = "",
    scope: Sequence[str] = (),
    index: KeywordIndex | None = None,
) -> DataFrame:
    """Hybrid search for display; year 0 and an empty paper id mean "no filter"."""
    found = hybrid_search(
        chunks, vectors, queries, top_k, year_min or None, paper_id or None, scope, index
    )
    return hits(found, chunks)


def ask(
    chunks: DataFrame, vectors: DataFrame | None, queries: DataFrame, index: KeywordIndex | None = None
) -> DataFrame:
    return rag_query(chunks, vectors, queries, fixed.ASK_TOP_K, index=index)
