"""BM25 keyword retrieval for sets of queries, with statistics per scope.

A scope is the filtered corpus a query searches: all chunks, the chunks of one paper, the chunks
of papers from some year on. It is named by columns that chunks and queries share. The term
statistics are joined to the query side, which is small, so the corpus meets the queries in one
equi-join on (scope, term).

The weighed query terms are written to the shared folder before that join, so Spark knows their
size. Below its broadcast threshold they are sent to the tasks: chunks then get their scores in place, and only each task's best n rows per query
are shuffled. Above it Spark shuffles by term, and adaptive execution splits the partitions of
very common terms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litweave import fixed
from litweave.functions.arrays import let
from litweave.functions.numbers import order_score
from litweave.functions.text import search_tokens, term_counts
from litweave.operators.ranking import rank_all, top_n
from litweave.session import written

# A term no text can hold. Chunks carry it with frequency 0, so a query that lists it meets
# every chunk of its scope with a contribution of 0.
ANY_CHUNK = ""

_POSTING = "array<struct<dl:int,term:string,tf:int>>"

#: In a scope whose queries have at most so many terms, chunks list those terms only. It decides the route, never a result.
LISTED = 1024

CHUNK_KEYS = ("chunk_id", "paper_id", "chunk_index")


def _keys(*columns: str) -> list[str]:
    """Column names without repeats (a scope may be one of the chunk keys)."""
    return list(dict.fromkeys(columns))


def chunk_order() -> list[Column]:
    """Corpus order."""
    return [F.col("paper_id"), F.col("chunk_index")]


def hit_order() -> list[Column]:
    return [F.desc(order_score(F.col("score"))), *chunk_order()]


def postings(chunks: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, chunk, dl, term, tf): one row per distinct term of a chunk, or of those in its `_asked` if that is given."""
    keys = _keys(*scope, *CHUNK_KEYS)
    asked = F.col("_asked") if "_asked" in chunks.columns else None

    def rows(tokens: Column) -> Column:
        # The length goes into the exploded rows: beside them it would be counted once per row.
        counted = F.transform(
            F.when(F.size(tokens) > 0, term_counts(tokens)),
            lambda t: F.struct(F.size(tokens).alias("dl"), t["term"].alias("term"), t["tf"].alias("tf")),
        )
        any_chunk = F.struct(
            F.size(tokens).alias("dl"), F.lit(ANY_CHUNK).alias("term"), F.lit(0).alias("tf")
        )
        return _wanted(F.concat(F.coalesce(counted, F.array().cast(_POSTING)), F.array(any_chunk)), asked)

    if "terms" in chunks.columns:
        return _stored_postings(chunks, keys, asked)
    return chunks.select(*keys, F.inline(let(search_tokens(F.col("text")), rows)))


def _wanted(entries: Column, asked: Column | None) -> Column:
    """The entries whose term is asked for; all if nothing tells what is."""
    if asked is None:
        return entries

    def few(all_: Column) -> Column:
        met = F.array_intersect(F.transform(all_, lambda t: t["term"]), asked)
        kept = let(met, lambda words: F.filter(all_, lambda t: F.array_contains(words, t["term"])))
        return F.when(asked.isNull(), all_).otherwise(kept)

    return let(entries, few)


def _with_asked(chunks: DataFrame, terms: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Chunks with the terms that queries of their scope ask for as `_asked`, null where they are many. So only
    postings that a query needs are made and moved. The lists are written, so Spark knows their size: with few scopes
    they are sent to the chunks, and a scope of very many chunks stays spread."""
    distinct = terms.select(*scope, "term").distinct()
    few = distinct.groupBy(*scope).agg(F.count("*").alias("n")).where(F.col("n") <= LISTED).drop("n")
    lists = distinct.join(few.hint("merge"), list(scope), "left_semi").groupBy(*scope).agg(F.collect_list("term").alias("_asked"))
    return chunks.join(written(lists, "asked-lists"), list(scope), "left")


def _stored_postings(chunks: DataFrame, keys: Sequence[str], asked: Column | None = None) -> DataFrame:
    """The same from stored `terms` and `dl`."""
    any_chunk = F.array(F.struct(F.lit(ANY_CHUNK).alias("term"), F.lit(0).alias("tf")))
    terms = F.concat(F.coalesce("terms", F.array().cast("array<struct<term:string,tf:int>>")), any_chunk)
    return chunks.select(*keys, "dl", F.inline(_wanted(terms, asked)))


def term_statistics(chunks: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, term, df, tokens) from one pass over the corpus.

    `df` counts the chunks holding a term. The row of ANY_CHUNK counts all chunks of the scope,
    and its `tokens` is their total length.
    """

    def rows(tokens: Column) -> Column:
        none = F.lit(0)
        terms = F.transform(
            F.array_distinct(tokens), lambda t: F.struct(t.alias("term"), none.alias("tokens"))
        )
        total = F.struct(F.lit(ANY_CHUNK).alias("term"), F.size(tokens).alias("tokens"))
        return F.concat(terms, F.array(total))

    if "terms" in chunks.columns:
        tokens = F.when(F.col("term") == ANY_CHUNK, F.col("dl")).otherwise(F.lit(0)).alias("tokens")
        found = _stored_postings(chunks, scope).select(*scope, "term", tokens)
    else:
        found = chunks.select(*scope, F.inline(let(search_tokens(F.col("text")), rows)))
    return found.groupBy(*scope, "term").agg(
        F.count("*").alias("df"), F.sum("tokens").alias("tokens")
    )


def idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def corpus_stats(statistics: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, n_chunks, avgdl, n_terms, mean_idf) of each non-empty scope.

    The mean runs over the histogram of document frequencies, not over the vocabulary.
    """
    totals = statistics.where(F.col("term") == ANY_CHUNK).select(
        *scope, F.col("df").alias("n_chunks"), "tokens"
    )
    words = statistics.where(F.col("term") != ANY_CHUNK)
    histogram = words.groupBy(*scope, "df").agg(F.count("*").alias("n"))
    if scope:
        joined = histogram.join(totals.select(*scope, "n_chunks"), list(scope))
        vocabulary = _vocabulary(joined, scope, F.col("n_chunks"))
        stats = totals.join(vocabulary, list(scope), "left")
    else:
        # One row in all, whatever the corpus: it is read as a scalar.
        one = _vocabulary(histogram, scope, totals.select("n_chunks").scalar())
        vocabulary = one.select(F.struct("n_terms", "mean_idf")).scalar()
        stats = totals.withColumn("v", vocabulary).select(
            "n_chunks", "tokens", "v.n_terms", "v.mean_idf"
        )
    return stats.select(
        *scope,
        "n_chunks",
        (F.col("tokens") / F.col("n_chunks")).alias("avgdl"),
        F.coalesce("n_terms", F.lit(0)).alias("n_terms"),
        "mean_idf",
    )


def _vocabulary(histogram: DataFrame, scope: Sequence[str], n: Column) -> DataFrame:
    weighed = histogram.select(*scope, "n", (F.col("n") * idf(n, F.col("df"))).alias("w"))
    return weighed.groupBy(*scope).agg(
        F.sum("n").alias("n_terms"), (F.sum("w") / F.sum("n")).alias("mean_idf")
    )


def _apart(df: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The right side of a join on scope and term. With a scope there may be as many queries as scopes, and both
    sides are exploded texts, many times what Spark takes them for, so neither is broadcast."""
    return df.hint("merge") if scope else df


def query_terms(
    queries: DataFrame, statistics: DataFrame, scope: Sequence[str] = ()
) -> DataFrame:
    """(query_id, scope, term, weight, avgdl, negative): terms the scope knows.

    `weight` is idf × (k1 + 1) × occurrences in the query. A negative idf is replaced by a
    share of the mean idf, which is itself negative only in odd corpora; `negative` marks that.
    """
    tokens = queries.select("query_id", *scope, F.explode(search_tokens(F.col("text"))).alias("term"))
    counted = tokens.groupBy("query_id", *scope, "term").agg(F.count("*").alias("times"))
    known = counted.join(_apart(statistics.drop("tokens"), scope), [*scope, "term"])
    stats = corpus_stats(statistics, scope)
    if scope:
        known = known.join(stats, list(scope))
    else:
        totals = stats.select(F.struct("n_chunks", "avgdl", "mean_idf")).scalar()
        known = known.withColumn("s", totals).select("*", "s.n_chunks", "s.avgdl", "s.mean_idf")
    return weighed(known, "query_id", *scope)


def weighed(known: DataFrame, *keys: str) -> DataFrame:
    """known(keys, term, times, df, n_chunks, avgdl, mean_idf) → (keys, term, weight, avgdl, negative)."""
    raw = idf(F.col("n_chunks"), F.col("df"))
    floored = F.when(raw < 0, fixed.BM25_EPSILON * F.col("mean_idf")).otherwise(raw)
    return known.select(
        *keys,
        "term",
        (floored * (fixed.BM25_K1 + 1) * F.col("times")).alias("weight"),
        "avgdl",
        (floored < 0).alias("negative"),
    )


def bm25_scores(postings: DataFrame, terms: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(query_id, chunk, score) of every (query, chunk) pair sharing a listed term."""
    hits = postings.join(_apart(terms, scope), [*scope, "term"])
    length_norm = 1 - fixed.BM25_B + fixed.BM25_B * F.col("dl") / F.col("avgdl")
    part = F.col("weight") * F.col("tf") / (F.col("tf") + fixed.BM25_K1 * length_norm)
    # ANY_CHUNK has tf 0; in a scope without tokens avgdl is 0 and the part is not a number.
    part = F.when(F.col("tf") > 0, part).otherwise(F.lit(0.0))
    return hits.groupBy(*_keys("query_id", *scope, *CHUNK_KEYS)).agg(F.sum(part).alias("score"))


def bm25(
    chunks: DataFrame,
    queries: DataFrame,
    n: int | None,
    scope: Sequence[str] = (),
    statistics: DataFrame | None = None,
) -> DataFrame:
    """Best `n` chunks per query: (query_id, chunk_id, paper_id, chunk_index, score, rank).

    Order: score descending, then corpus order. Chunks with score 0 count: a query with fewer
    than `n` matches is filled in corpus order. `n=None` ranks the whole scope. `statistics`
    takes a stored `term_statistics` of the same chunks and scope.
    """
    scope = list(scope)
    queries = queries.select("query_id", *scope, "text")
    if scope:
        chunks = chunks.join(queries.select(*scope).distinct(), scope, "left_semi")
    if statistics is None:
        # Read three times below, with different filters: one pass and one table are cheaper.
        statistics = written(term_statistics(chunks, scope), "term-statistics")
    terms = written(query_terms(queries, statistics, scope), "query-terms")

    def scores(wanted: DataFrame) -> DataFrame:
        return bm25_scores(postings(_with_asked(chunks, wanted, scope) if scope else chunks, scope), wanted, scope)

    every = queries.select("query_id", *scope).withColumn("negative", F.lit(False))
    result = ["query_id", *CHUNK_KEYS, "score", "rank"]
    if n is None:
        scored = scores(terms.unionByName(_any_chunk(every, scope)))
        return _rank_scope(scored).select(*result)

    # A negative score ranks below unmatched chunks, so such a query must see its whole scope.
    # That at most doubles its work: a term with a negative idf is in over half of the chunks.
    negative = terms.groupBy("query_id", *scope).agg(F.bool_or("negative").alias("negative"))
    wide = _any_chunk(negative.where("negative"), scope)
    best = top_n(scores(terms.unionByName(wide)), ["query_id"], hit_order(), n)

    # All other queries have fewer than n positive matches or need no filling, so the first n
    # unmatched chunks are among the first 2n of the scope.
    narrow = every.select("query_id", *scope).join(
        negative.where("negative").select("query_id"), "query_id", "left_anti"
    )
    filled = best.drop("rank").unionByName(_filling(chunks, narrow, n, scope))
    merged = filled.groupBy("query_id", *CHUNK_KEYS).agg(F.max("score").alias("score"))
    return top_n(merged, ["query_id"], hit_order(), n).select(*result)


def _any_chunk(queries: DataFrame, scope: Sequence[str]) -> DataFrame:
    return queries.select(
        "query_id",
        *scope,
        F.lit(ANY_CHUNK).alias("term"),
        F.lit(0.0).alias("weight"),
        F.lit(1.0).alias("avgdl"),
        "negative",
    )


def _filling(chunks: DataFrame, queries: DataFrame, n: int, scope: Sequence[str]) -> DataFrame:
    """The first 2n chunks of each query's scope, with score 0."""
    slots = 2 * n
    slim = chunks.select(*_keys(*scope, *CHUNK_KEYS))
    if scope:
        first = top_n(slim, scope, chunk_order(), slots, "slot")
    else:
        first = slim.orderBy(*chunk_order()).limit(slots)
        first = top_n(first, [], chunk_order(), slots, "slot")
    wanted = queries.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return wanted.join(first, [*scope, "slot"]).select(
        *_keys("query_id", *scope, *CHUNK_KEYS), F.lit(0.0).alias("score")
    )


def _rank_scope(scored: DataFrame) -> DataFrame:
    """Rank all chunks of a scope; those with score 0, often the most, are split by paper."""
    key = order_score(F.col("score"))
    buckets = [
        -F.floor(key / 62_500_000),  # a sixteenth
        (key == 0).cast("int"),  # the bucket from 0 on also holds small positive scores
        F.when(key == 0, F.substring("paper_id", 1, 2)).otherwise(F.lit("")),
    ]
    return rank_all(scored, ["query_id"], buckets, hit_order())
