"""Candidate papers of a topic: papers named in text first, then retrieved ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litweave import fixed
from litweave.functions.text import cut, paper_ids_in
from litweave.operators.bm25 import CHUNK_KEYS, bm25
from litweave.operators.fusion import fuse, fused_order, fused_score, located
from litweave.operators.keyword_index import KeywordIndex, build_keyword_index, ranks, search
from litweave.operators.ranking import rank_all, top_n
from litweave.operators.vectors import nearest, vector_ranks
from litweave.session import written

#: Depth of the first heads; it changes the work, not the result.
FIRST_DEPTH = 256


def expand_topics(topics: DataFrame, expansions: DataFrame | None = None) -> DataFrame:
    """(query_id, pos, term): the topic itself, then the terms an `expansions(topic, pos, term)`
    table lists for it. Without a table every topic expands to itself."""
    own = topics.select("query_id", F.lit(0).alias("pos"), F.col("text").alias("term"))
    if expansions is None:
        return own
    more = topics.join(expansions, topics["text"] == expansions["topic"]).select(
        "query_id", (F.col("pos") + 1).alias("pos"), "term"
    )
    every = own.unionByName(more)
    return every.groupBy("query_id", "term").agg(F.min("pos").alias("pos"))


def observations(trace: DataFrame) -> DataFrame:
    """Text pool of a run: the previews of its `observe` events, in order of `seq`."""
    preview = cut(F.coalesce("result_preview", F.lit("")), fixed.PREVIEW_CHARS)
    return trace.where("type = 'observe'").select("query_id", "seq", preview.alias("text"))


def named_papers(finals: DataFrame, trace: DataFrame, papers: DataFrame) -> DataFrame:
    """(query_id, paper_id, seq, pos): known paper ids named in final texts and observations.

    finals(query_id, final_text) come before the trace. Ids the catalogue lacks are dropped.
    """
    pool = finals.select(
        "query_id", F.lit(-1).cast("long").alias("seq"), F.col("final_text").alias("text")
    ).unionByName(observations(trace).withColumn("seq", F.col("seq").cast("long")))
    found = pool.select(
        "query_id", "seq", F.posexplode(paper_ids_in(F.col("text"))).alias("pos", "paper_id")
    )
    first = found.groupBy("query_id", "paper_id").agg(F.min(F.struct("seq", "pos")).alias("at"))
    valid = first.join(papers.select("paper_id"), "paper_id", "left_semi")
    return valid.select("query_id", "paper_id", "at.seq", "at.pos")


def paper_rollup(fused: DataFrame) -> DataFrame:
    """Best score of each paper, never below 0, and where its first chunk stands."""
    return (
        fused.where("paper_id <> ''")
        .groupBy("query_id", "paper_id")
        .agg(
            F.greatest(F.lit(0.0), F.max("score")).alias("score"),
            F.min("rank").alias("rank"),
        )
    )


def chunk_pool(
    chunks: DataFrame, vectors: DataFrame, topics: DataFrame, pool: int | None = None
) -> DataFrame:
    """Fused chunk ranking of each topic, cut at `pool` rows (each list at 3 × pool).

    By default the pool grows with the library, 30 rows per paper and 60 at least, so that
    usually every chunk is ranked. Those rankings are computed by score ranges; `leading_chunks`
    gives the same first papers without them.
    """
    source = located(vectors, chunks)
    if pool is not None:
        fetch = fixed.OVERFETCH * pool
        fused = fuse(nearest(source, topics, fetch), bm25(chunks, topics, fetch))
        ranked = top_n(fused, ["query_id"], fused_order(), pool)
    else:
        papers = chunks.select(F.count_distinct("paper_id")).scalar()
        limit = F.greatest(papers * fixed.POOL_PER_PAPER, F.lit(fixed.MIN_POOL))
        cut_off = limit * fixed.OVERFETCH
        fused = fuse(
            nearest(source, topics, None).where(F.col("rank") < cut_off),
            bm25(chunks, topics, None).where(F.col("rank") < cut_off),
        )
        ranges = [F.floor(-F.log2("raw") * 64)]
        ranked = rank_all(fused, ["query_id"], ranges, fused_order()).where(F.col("rank") < limit)
    return ranked.withColumn("score", fused_score())


def leading_chunks(
    chunks: DataFrame,
    vectors: DataFrame,
    topics: DataFrame,
    papers: int = fixed.MAX_CANDIDATES,
    index: KeywordIndex | None = None,
) -> DataFrame:
    """The part of the growing pool that holds the first `papers` papers of each topic.

    Let R be the rank at which that many papers have appeared in one of the two lists. Each of
    them scores at least 1/(60 + R), and a chunk beyond rank m in both lists at most 2/(60 + m), so
    with m = 61 + 2R both heads hold every chunk that can win. Heads are deepened for the topics
    that need it only. Of the chunks known from one list, those that can still reach the bound get
    their exact place in the other by counting.
    """
    source = located(vectors, chunks)
    total, all_papers, named = chunks.agg(
        F.count("*"),
        F.count_distinct("paper_id"),
        F.count_distinct(F.when(F.col("paper_id") != "", F.col("paper_id"))),
    ).first()
    limit = max(all_papers * fixed.POOL_PER_PAPER, fixed.MIN_POOL)
    cut_off = limit * fixed.OVERFETCH
    most, wanted = max(1, min(cut_off, total)), max(1, min(papers, named))
    index = index or build_keyword_index(chunks)

    def nth(rank: str) -> Column:
        return F.get(F.sort_array(F.collect_list(rank)), F.lit(wanted - 1))

    topics = written(topics, "topics")
    open_topics, heads, depth = topics, None, FIRST_DEPTH
    while True:
        n = min(depth, most)
        lists = written(fuse(nearest(source, open_topics, n), search(index, open_topics, n)), "heads")
        firsts = lists.where("paper_id <> ''").groupBy("query_id", "paper_id").agg(
            F.min("v_rank").alias("v_rank"), F.min("k_rank").alias("k_rank")
        )
        reached = firsts.groupBy("query_id").agg(F.least(nth("v_rank"), nth("k_rank")).alias("R"))
        bound = F.coalesce(1.0 / (fixed.RRF_K + F.col("R")), F.lit(0.0))
        needed = F.least(fixed.RRF_K + 1 + 2 * F.col("R"), F.lit(most))
        closed = reached.where((needed <= n) | F.lit(n >= most)).select("query_id", bound.alias("bound"))
        part = lists.join(closed, "query_id").withColumn("rest", F.lit(1.0 / (fixed.RRF_K + n)))
        heads = part if heads is None else heads.unionByName(part)
        if n >= most:
            break
        open_topics = written(open_topics.join(closed, "query_id", "left_anti"), "topics")
        if open_topics.isEmpty():
            break
        depth *= 4

    # The factor keeps chunks that rounding puts just below the bound.
    able = written(heads.where("raw + rest >= bound * (1 - 1e-9)"), "able")
    by_vector = vector_ranks(source, topics, able.where("v_rank is null")).withColumnRenamed("rank", "v_found")
    by_word = ranks(index, topics, able.where("k_rank is null")).withColumnRenamed("rank", "k_found")
    keys = ["query_id", "chunk_id"]
    placed = able.join(by_vector, keys, "left").join(by_word, keys, "left").select(
        "query_id", *CHUNK_KEYS,
        F.coalesce("v_rank", "v_found").alias("v_rank"),
        F.coalesce("k_rank", "k_found").alias("k_rank"),
    )

    def listed(rank: str) -> DataFrame:
        return placed.where(F.col(rank) < cut_off).select("query_id", *CHUNK_KEYS, F.col(rank).alias("rank"))

    fused = fuse(listed("v_rank"), listed("k_rank"))
    return top_n(fused, ["query_id"], fused_order(), limit).withColumn("score", fused_score())


def merge_candidates(
    named: DataFrame, retrieved: DataFrame, limit: int = fixed.MAX_CANDIDATES
) -> DataFrame:
    """(query_id, paper_id, rank): named before retrieved, each paper once, `limit` per topic."""

    def at(source: int, first: Column, second: Column) -> Column:
        return F.struct(
            F.lit(source).alias("source"),
            first.cast("double").alias("first"),
            second.cast("long").alias("second"),
        ).alias("at")

    both = named.select("query_id", "paper_id", at(0, F.col("seq"), F.col("pos"))).unionByName(
        retrieved.select("query_id", "paper_id", at(1, -F.col("score"), F.col("rank")))
    )
    first = both.groupBy("query_id", "paper_id").agg(F.min("at").alias("at"))
    return top_n(first, ["query_id"], [F.col("at")], limit).select("query_id", "paper_id", "rank")


def topic_candidates(
    chunks: DataFrame,
    vectors: DataFrame,
    topics: DataFrame,
    named: DataFrame,
    limit: int = fixed.MAX_CANDIDATES,
    index: KeywordIndex | None = None,
) -> DataFrame:
    """Named papers, then the first retrieved ones."""
    # Of the first `limit` papers at most as many are named as named papers take places.
    ranked = leading_chunks(chunks, vectors, topics, limit, index)
    return merge_candidates(named, paper_rollup(ranked), limit)
