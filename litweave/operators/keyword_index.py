"""A stored keyword index: block postings, statistics by year, and search that reads only the
buckets of the queries' terms.

Chunks are numbered in corpus order and cut into shards of neighbouring numbers. A posting block holds
one term's chunks in one shard (or in a part of it) with bounds of its contributions (largest tf, smallest length, which hold for
any average length). A search sends each needed block once to its shard, where a task adds up the scores of a
query over the shard's chunks; terms whose bounds together can't reach the n-th score found so far are skipped (MaxScore).
Document frequencies are kept by year, so a limit on the year changes the statistics and is a
condition on the shard's chunks, but copies nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litweave import fixed
from litweave.functions.arrays import let
from litweave.functions.batches import grouped
from litweave.functions.text import search_tokens, term_counts
from litweave.operators.bm25 import CHUNK_KEYS, hit_order, idf, weighed
from litweave.operators.ranking import top_n
from litweave.session import new_folder, packed, written

#: A shard has 2^SHARD_BITS chunks at most.
SHARD_BITS = 12
#: Folders of the posting table.
BUCKETS = 64
#: Query terms that meet a shard together.
QUERY_TERMS = 50_000
#: Stands for "no limit", and for the year of chunks without one.
ANY_YEAR = -(2**31)

_POSTINGS = "term string, shard long, at array<smallint>, tf array<int>, max_tf int, min_dl int, bucket int"
_AT = (1 << SHARD_BITS) - 1


class KeywordIndex:
    """The tables of an index at `path`.

    forward(doc, chunk_id, paper_id, chunk_index, year, dl, terms): the tokenised chunks by number;
    shards(shard, dl, year): arrays over the shard's chunks; postings(bucket, term, shard, at, tf, max_tf, min_dl);
    statistics(term, year, df); years(year_from, n_chunks, avgdl, n_terms, mean_idf): the corpus from each year on.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.forward, self.shards, self.statistics, self.years = (
            spark.read.parquet(f"{path}/{name}") for name in ("forward", "shards", "statistics", "years")
        )
        # An index without terms has no posting file that tells its columns.
        self.postings = spark.read.schema(_POSTINGS).parquet(f"{path}/postings")

    @property
    def corpus(self) -> DataFrame:
        """The chunks with `terms` and `dl` instead of their text, as `bm25` takes them too."""
        return self.forward


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


_BLOCKS = "term string, shard long, at array<smallint>, tf array<int>, max_tf int, min_dl int"


class _Inverter:
    """The posting blocks of one shard, from its chunks in order. Terms are held as numbers."""

    def __init__(self, shard: int) -> None:
        self.shard = shard
        self.known: list[pa.Array] = []  # distinct terms of each batch
        self.code: list[np.ndarray] = []  # of postings, counted on from those of earlier batches
        self.at: list[np.ndarray] = []
        self.tf: list[np.ndarray] = []
        self.dl: list[np.ndarray] = []
        self.terms = 0

    def add(self, batch: pa.RecordBatch) -> None:
        terms = batch.column("terms")
        n = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
        flat = pc.list_flatten(terms)
        words = pc.dictionary_encode(flat.field("term"))
        self.known.append(pc.cast(words.dictionary, pa.string()))
        self.code.append(words.indices.to_numpy(zero_copy_only=False).astype(np.int32) + self.terms)
        self.terms += len(words.dictionary)
        self.tf.append(flat.field("tf").to_numpy(zero_copy_only=False).astype(np.int32))
        for held, name, kind in ((self.at, "at", np.int16), (self.dl, "dl", np.int32)):
            held.append(np.repeat(batch.column(name).to_numpy(zero_copy_only=False).astype(kind), n))

    def blocks(self) -> pa.RecordBatch:
        words = pc.dictionary_encode(pa.concat_arrays(self.known))
        code = words.indices.to_numpy(zero_copy_only=False)[np.concatenate(self.code)]
        order = np.argsort(code, kind="stable")  # chunks stay in order inside a term
        at, tf, dl = (np.concatenate(x)[order] for x in (self.at, self.tf, self.dl))
        n = len(words.dictionary)
        bounds = np.searchsorted(code[order], np.arange(n + 1)).astype(np.int32)
        most = np.maximum.reduceat(tf, bounds[:-1]) if n else tf
        least = np.minimum.reduceat(dl, bounds[:-1]) if n else dl
        lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)) for x in (at, tf)]
        columns = [words.dictionary, pa.array(np.full(n, self.shard, np.int64)), *lists, pa.array(most), pa.array(least)]
        return pa.RecordBatch.from_arrays(columns, names=["term", "shard", "at", "tf", "max_tf", "min_dl"])


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order → posting blocks; one shard is held at a time."""
    held = None
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if held is None or held.shard != shard[a]:
                if held is not None:
                    yield held.blocks()
                held = _Inverter(int(shard[a]))
            held.add(batch.slice(a, b - a))
    if held is not None:
        yield held.blocks()


def build_keyword_index(chunks: DataFrame, path: str | None = None) -> KeywordIndex:
    """Write the index of chunks(chunk_id, paper_id, chunk_index, text[, year]) once.

    `chunks` is read twice (the order is sampled first) and tokenised in one pass. All tables but `years` grow with the corpus.
    A shard's chunks lie together and become posting blocks where they lie, so postings are neither sorted nor sent one
    by one; a block is bounded by its shard, so a term of most chunks is no large group.
    """
    spark = chunks.sparkSession
    path = path or new_folder(spark, "keyword-index")
    year = F.col("year").cast("int") if "year" in chunks.columns else F.lit(None).cast("int")

    def counted(tokens: Column) -> Column:
        return F.struct(F.size(tokens).alias("dl"), F.when(F.size(tokens) > 0, term_counts(tokens)).alias("terms"))

    # Texts are sorted, not their terms, which are several times as large as rows.
    ordered = chunks.select(*CHUNK_KEYS, year.alias("year"), "text").repartitionByRange("paper_id", "chunk_index")
    ordered = ordered.sortWithinPartitions("paper_id", "chunk_index")
    tokens = ordered.select(
        F.monotonically_increasing_id().alias("doc"), *CHUNK_KEYS, "year", let(search_tokens(F.coalesce("text", F.lit(""))), counted).alias("t")
    )
    packed(tokens.select("doc", *CHUNK_KEYS, "year", "t.dl", "t.terms"), f"{path}/forward")
    forward = spark.read.parquet(f"{path}/forward").withColumns(
        {"shard": F.shiftright("doc", SHARD_BITS), "at": F.col("doc").bitwiseAND(F.lit(_AT)).cast("smallint"), "year": F.coalesce("year", F.lit(ANY_YEAR))}
    )

    own = forward.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("at", "dl", "year"))).alias("c"))
    packed(own.select("shard", "c.dl", "c.year"), f"{path}/shards")

    # The files hold whole shards in order, so chunks are not moved again; a shard that a scan cuts in two gives two blocks a term.
    blocks = forward.select("shard", "at", "dl", "terms").mapInArrow(_inverted, _BLOCKS)
    blocks = blocks.select(_bucket(F.col("term")).alias("bucket"), "*").hint("rebalance", "bucket")
    packed(blocks.sortWithinPartitions("bucket", "term", "shard"), f"{path}/postings", "bucket")

    posted = forward.select("year", F.inline("terms"))
    packed(posted.groupBy("term", "year").agg(F.count("*").alias("df")), f"{path}/statistics")
    _years(forward, spark.read.parquet(f"{path}/statistics")).write.parquet(f"{path}/years")
    return KeywordIndex(spark, path)


def _years(forward: DataFrame, statistics: DataFrame) -> DataFrame:
    """Totals of the corpus from each of its years on. A term's document frequency from a year on is
    a suffix sum; the mean idf runs over the histogram of these. One row per year, so windows over years are small."""
    totals = forward.groupBy("year").agg(F.count("*").alias("n"), F.sum("dl").alias("tokens"))
    zero = F.lit(0).cast("long")
    totals = totals.unionByName(forward.sparkSession.range(1).select(F.lit(ANY_YEAR).alias("year"), zero.alias("n"), zero.alias("tokens")))
    totals = totals.groupBy("year").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    down = Window.orderBy(F.desc("year"))
    totals = written(
        totals.select("year", F.row_number().over(Window.orderBy("year")).alias("no"), F.sum("n").over(down).alias("n_chunks"), F.sum("tokens").over(down).alias("tokens")),
        "years",
    )
    by_term = Window.partitionBy("term")
    found = statistics.join(totals.select("year", "no"), "year").select(
        "no",
        F.sum("df").over(by_term.orderBy(F.desc("no"))).alias("df"),
        F.coalesce(F.lag("no").over(by_term.orderBy("no")), F.lit(0)).alias("before"),
    )
    histogram = found.select(F.explode(F.sequence(F.col("before") + 1, F.col("no"))).alias("no"), "df").groupBy("no", "df").agg(F.count("*").alias("n"))
    weighed_terms = histogram.join(totals.select("no", "n_chunks"), "no").select("no", "n", (F.col("n") * idf(F.col("n_chunks"), F.col("df"))).alias("w"))
    means = weighed_terms.groupBy("no").agg(F.sum("n").alias("n_terms"), (F.sum("w") / F.sum("n")).alias("mean_idf"))
    return totals.where("n_chunks > 0").join(means, "no", "left").select(
        F.col("year").alias("year_from"), "n_chunks", (F.col("tokens") / F.col("n_chunks")).alias("avgdl"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"), "mean_idf"
    )


# --- queries ---------------------------------------------------------------------------------


def _asked(index: KeywordIndex, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """queries(query_id, text[, year_min]) → (query_id, q, year_from), numbered, and the weighed terms
    (q, term, weight, avgdl, year_from) that the limited corpus knows. A limit beyond the last year has no corpus."""
    if "year_min" not in queries.columns:
        queries = queries.withColumn("year_min", F.lit(None).cast("int"))
    years = index.years.agg(F.sort_array(F.collect_list("year_from"))).scalar()
    reached = F.get(F.filter("_years", lambda y: y >= F.col("year_min")), F.lit(0))
    numbered = queries.withColumn("_years", years).select(
        "query_id", "text", F.when(F.col("year_min").isNull(), F.lit(ANY_YEAR)).otherwise(reached).alias("year_from")
    ).where("year_from is not null").withColumn("q", F.monotonically_increasing_id())
    numbered = written(numbered, "asked")
    tokens = numbered.select("q", "year_from", F.explode(search_tokens(F.col("text"))).alias("term"))
    counted = written(tokens.groupBy("q", "year_from", "term").agg(F.count("*").alias("times")), "asked-terms")
    wanted = counted.select("term", "year_from").distinct()
    found = index.statistics.join(wanted, "term").where("year >= year_from").groupBy("term", "year_from").agg(F.sum("df").alias("df"))
    known = counted.join(found, ["term", "year_from"]).join(index.years, "year_from")
    terms = weighed(known, "q", "year_from").drop("negative")
    return numbered.select("query_id", "q", "year_from"), written(terms, "query-terms")


_ARRAYS = {
    "at": "array<smallint>", "tf": "array<int>", "max_tf": "int", "min_dl": "int", "dl": "array<int>", "year": "array<int>", "term": "string",
    "q": "array<long>", "q_term": "array<string>", "q_weight": "array<double>", "q_avgdl": "array<double>", "q_year": "array<int>",
    "m_q": "array<long>", "m_doc": "array<long>", "m_key": "array<double>",
}


def _met(index: KeywordIndex, asked: DataFrame, terms: DataFrame, marks: DataFrame | None = None, shards: DataFrame | None = None) -> DataFrame:
    """Rows sorted by query block and shard: the shard's chunks, the posting blocks of the query
    terms, each read once per query block, and the block's queries (and marks) as arrays."""
    n = max(1, -(-terms.count() // QUERY_TERMS))
    block = F.pmod(F.xxhash64("q"), F.lit(n)).cast("int").alias("block")
    each = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block")
    own = index.shards if shards is None else index.shards.join(shards, "shard", "left_semi")
    used = sorted(r[0] for r in terms.select(_bucket(F.col("term")).alias("b")).distinct().collect())  # at most BUCKETS
    posted = index.postings.where(F.col("bucket").isin(used)).join(terms.select("term").distinct(), "term", "left_semi")
    if shards is not None:
        posted = posted.join(shards, "shard", "left_semi")

    def rows(df: DataFrame, *columns: str) -> DataFrame:
        rest = [F.lit(None).cast(kind).alias(c) for c, kind in _ARRAYS.items() if c not in columns]
        return df.select("block", "shard", *columns, *rest).select("block", "shard", *_ARRAYS)

    def listed(df: DataFrame, fields: list[str]) -> DataFrame:
        return df.groupBy("block").agg(F.sort_array(F.collect_list("x")).alias("x")).select("block", *[F.col(f"x.{c}") for c in fields])

    both = asked.join(terms, ["q", "year_from"], "left").select(
        block, F.struct("q", F.coalesce("term", F.lit("")).alias("q_term"), F.coalesce("weight", F.lit(0.0)).alias("q_weight"), F.coalesce("avgdl", F.lit(1.0)).alias("q_avgdl"), F.col("year_from").alias("q_year")).alias("x")
    )
    columns = ["q", "q_term", "q_weight", "q_avgdl", "q_year"]
    packed = listed(both, columns)
    if marks is not None:
        held = marks.select(block, F.struct(F.col("q").alias("m_q"), F.col("doc").alias("m_doc"), F.col("key").alias("m_key")).alias("x"))
        given = ["m_q", "m_doc", "m_key"]
        packed, columns = packed.join(listed(held, given), "block", "left"), [*columns, *given]
    met = (
        rows(own.select("*", each), "dl", "year")
        .union(rows(posted.select("*", each), "term", "at", "tf", "max_tf", "min_dl"))
        .union(rows(own.select("shard", each).join(packed, "block"), *columns))
    )
    return met.repartition("block", "shard").sortWithinPartitions("block", "shard")


def _whole(blocks: pd.DataFrame) -> pd.DataFrame:
    """One block per term, from the blocks of a shard that a scan has cut."""
    if not blocks["term"].duplicated().any():
        return blocks

    def joined(parts: pd.Series) -> list:
        return [x for part in parts for x in part]

    kinds = {"at": joined, "tf": joined, "max_tf": "max", "min_dl": "min"}
    return blocks.groupby("term", as_index=False).agg(kinds)


class _Shard:
    """One shard's chunks, the posting blocks it was sent, and the queries to answer."""

    def __init__(self, frame: pd.DataFrame) -> None:
        self.shard = int(frame["shard"].iloc[0])
        own = frame[frame["dl"].notna()].iloc[0]
        self.dl, self.year = np.asarray(own["dl"], float), np.asarray(own["year"])
        blocks = _whole(frame[frame["at"].notna()])
        self.at = [np.asarray(x, np.int64) for x in blocks["at"]]
        self.tf = [np.asarray(x, float) for x in blocks["tf"]]
        self.max_tf, self.min_dl = blocks["max_tf"].to_numpy(float), blocks["min_dl"].to_numpy(float)
        asked = frame[frame["q"].notna()].iloc[0]
        self.q = np.asarray(asked["q"])
        self.place = pd.Index(blocks["term"]).get_indexer(pd.Index(asked["q_term"]))
        self.weight, self.avgdl, self.limit = (np.asarray(asked[c]) for c in ("q_weight", "q_avgdl", "q_year"))
        self.marks = {}
        if asked["m_q"] is not None and len(np.atleast_1d(asked["m_q"])):
            m = pd.DataFrame({"q": asked["m_q"], "doc": asked["m_doc"], "key": asked["m_key"]})
            self.marks = {q: (f["doc"].to_numpy(), f["key"].to_numpy(float)) for q, f in m.groupby("q")}
        self.parts: dict[tuple[int, float], np.ndarray] = {}
        self.skipped = self.read = 0

    def queries(self) -> Iterator[tuple[int, slice]]:
        cuts = [0, *(np.flatnonzero(np.diff(self.q)) + 1).tolist(), len(self.q)]
        return ((int(self.q[a]), slice(a, b)) for a, b in zip(cuts[:-1], cuts[1:]))

    def _norm(self, dl: np.ndarray, avgdl: float) -> np.ndarray:
        return fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * dl / avgdl)

    def part(self, k: int, avgdl: float) -> np.ndarray:
        """Contributions of a block at weight 1."""
        found = self.parts.get((k, avgdl))
        if found is None:
            tf = self.tf[k]
            found = self.parts[k, avgdl] = tf / (tf + self._norm(self.dl[self.at[k]], avgdl))
        return found

    def scores(self, own: slice, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the shard's chunks, and the chunks that satisfy the limit and may reach `least`; only their scores are whole."""
        place, weight, avgdl = self.place[own], self.weight[own], float(self.avgdl[own.start])
        weight, place = weight[place >= 0], place[place >= 0]
        limit, total = self.limit[own.start], np.zeros(len(self.dl))
        able = np.ones(len(total), bool) if limit == ANY_YEAR else self.year >= limit
        bound = np.maximum(0, weight * self.max_tf[place] / (self.max_tf[place] + self._norm(self.min_dl[place], avgdl)))
        order = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0.0)
        pruned = least > 0 and (weight >= 0).all()
        for i, o in enumerate(order):
            if pruned:
                able &= total + rest[i] >= least
                if not able.any():
                    self.skipped += len(order) - i
                    break
            k = place[o]
            total[self.at[k]] += weight[o] * self.part(k, avgdl)
            self.read += 1
        if pruned:
            able &= total >= least
        return total, np.flatnonzero(able)


def _keys(score: np.ndarray) -> np.ndarray:
    """As `order_score`."""
    return np.floor(score * 1e9 + 0.5)


def _best(n: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The n best chunks of each query in each shard that can still be among the n best of all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, bars = None, {}
        for frame in grouped(batches, ["block", "shard"]):
            if frame["block"].iloc[0] != block:
                block, bars = frame["block"].iloc[0], {}
            shard, out = _Shard(frame), []
            for q, own in shard.queries():
                bar = bars.get(q, np.empty(0))
                least = (bar.min() - 1) / 1e9 if len(bar) == n else -np.inf
                score, able = shard.scores(own, least)
                key = _keys(score[able])
                if len(able) > n:
                    first = key >= np.partition(key, -n)[-n]
                    able, key = able[first], key[first]
                first = np.lexsort((able, -key))[:n]
                able, key = able[first], key[first]
                bars[q] = np.sort(np.append(bar, key))[-n:]
                out.append(pd.DataFrame({"q": q, "doc": (shard.shard << SHARD_BITS) + able, "score": score[able]}))
            yield pd.concat(out, ignore_index=True)

    return run


def search(index: KeywordIndex, queries: DataFrame, n: int) -> DataFrame:
    """Best `n` chunks per query, as `bm25` gives them: (query_id, chunk_id, paper_id, chunk_index,
    score, rank). queries(query_id, text[, year_min]); a null limit is none."""
    asked, terms = _asked(index, queries)
    found = _met(index, asked, terms).mapInPandas(_best(n), "q long, doc long, score double")
    best = top_n(found, ["q"], [hit_order()[0], F.col("doc")], n)
    named = best.join(index.forward.select("doc", *CHUNK_KEYS), "doc").join(asked.select("query_id", "q"), "q")
    return named.select("query_id", *CHUNK_KEYS, "score", "rank")


def _mark_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The scores of the marks in each shard."""
    for frame in grouped(batches, ["block", "shard"]):
        shard, out = _Shard(frame), [pd.DataFrame({"q": [], "doc": [], "key": []})]
        for q, own in shard.queries():
            docs = shard.marks.get(q, (np.empty(0, np.int64), None))[0]
            docs = docs[docs >> SHARD_BITS == shard.shard]
            if len(docs):
                out.append(pd.DataFrame({"q": q, "doc": docs, "key": _keys(shard.scores(own)[0])[docs & _AT]}))
        yield pd.concat(out, ignore_index=True)


def _before(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many of a shard's chunks stand before each mark."""
    for frame in grouped(batches, ["block", "shard"]):
        shard, out = _Shard(frame), [pd.DataFrame({"q": [], "doc": [], "rows": []})]
        for q, own in shard.queries():
            if q not in shard.marks:
                continue
            docs, marks = shard.marks[q]
            score, able = shard.scores(own)
            key = _keys(score[able])
            up = np.sort(key)
            better = len(up) - np.searchsorted(up, marks, "right")
            ties = (docs >> SHARD_BITS > shard.shard) * (np.searchsorted(up, marks, "right") - np.searchsorted(up, marks, "left"))
            for i in np.flatnonzero(docs >> SHARD_BITS == shard.shard):
                ties[i] = np.count_nonzero((key == marks[i]) & (able < docs[i] & _AT))
            out.append(pd.DataFrame({"q": q, "doc": docs, "rows": better + ties}))
        yield pd.concat(out, ignore_index=True)


def ranks(index: KeywordIndex, queries: DataFrame, marks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank): place in the full list of each marks(query_id, chunk_id).

    Shards score their chunks in place and send back one count per mark, so no table of (query, chunk)
    pairs is made, whatever the queries share with the corpus.
    """
    asked, terms = _asked(index, queries.select("query_id", "text"))
    located = marks.select("query_id", "chunk_id").join(index.forward.select("doc", "chunk_id"), "chunk_id").join(asked, "query_id")
    located = written(located.select("query_id", "chunk_id", "q", "doc"), "marks")
    used = written(located.select(F.shiftright("doc", SHARD_BITS).alias("shard")).distinct(), "mark-shards")
    asked = asked.join(located.select("q").distinct(), "q", "left_semi")
    plain = located.select("q", "doc", F.lit(0.0).alias("key"))
    keyed = written(_met(index, asked, terms, plain, used).mapInPandas(_mark_keys, "q long, doc long, key double"), "mark-scores")
    counted = _met(index, asked, terms, keyed).mapInPandas(_before, "q long, doc long, rows long")
    places = counted.groupBy("q", "doc").agg(F.sum("rows").cast("int").alias("rank"))
    return located.join(places, ["q", "doc"]).select("query_id", "chunk_id", "rank")
