"""Embedding and nearest-neighbour search.

Similarity is 1 − squared Euclidean distance. Distances are block matrix products in numpy inside
Spark tasks; each task keeps its own best n per query, so only n rows per query and task travel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litweave import fixed
from litweave.operators.ranking import rank_all, top_n
from litweave.session import written

VECTOR_BLOCK = 8192
QUERY_BLOCK = 1024
SCORE_CELLS = 2_000_000
#: Keys of at most so many pairs of query and vector are scored together. It decides the route, never a result.
KEY_PAIRS = 4096
SLACK = 1e-8

HIT = "query_id string, chunk_id string, paper_id string, chunk_index int, score double"


def embed(
    df: DataFrame,
    text: str,
    provider: Callable[[list[str]], list[list[float]]],
    batch: int = fixed.EMBED_BATCH,
    name: str = "embedding",
) -> DataFrame:
    """Add an embedding column; `provider` gets at most `batch` texts per call, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[text].tolist()
            vectors: list[list[float]] = []
            for i in range(0, len(texts), batch):
                vectors.extend(provider(texts[i : i + batch]))
            yield pdf.assign(**{name: vectors})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, `{name}` array<float>")


def hit_order() -> list[Column]:
    return [F.desc(F.col("score")), F.col("paper_id"), F.col("chunk_index")]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _best(
    vectors: pd.DataFrame, ids: np.ndarray, q: np.ndarray, n: int | None
) -> Iterator[pd.DataFrame]:
    """Best n for every query, from slices small enough to bound the score matrix."""
    step = max(1, SCORE_CELLS // max(1, len(ids)))
    for start in range(0, len(vectors), step):
        yield _slice_best(vectors.iloc[start : start + step], ids, q, n)


def _slice_best(
    vectors: pd.DataFrame, ids: np.ndarray, q: np.ndarray, n: int | None
) -> pd.DataFrame:
    """Best n of a slice of vectors for every query. Scores carry 9 decimals, so that equal
    distances tie whatever the slice they were computed in; ties follow corpus order."""
    vectors = vectors.sort_values(["paper_id", "chunk_index"], kind="stable")
    v = _matrix(vectors["embedding"])
    squared = (q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2.0 * (q @ v.T)
    scores = np.round(1.0 - squared, 9) + 0.0
    k = len(v) if n is None else min(n, len(v))
    if k < len(v):
        # Everything at or above the k-th score, so that no tie is lost, then a stable cut.
        floor = np.partition(scores, len(v) - k, axis=1)[:, len(v) - k]
        rows, cols = np.nonzero(scores >= floor[:, None])
    else:
        rows, cols = np.divmod(np.arange(scores.size), len(v))
    values = scores[rows, cols]
    order = np.lexsort((cols, -values, rows))
    rows, cols, values = rows[order], cols[order], values[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    keep = place < k
    rows, cols, values = rows[keep], cols[keep], values[keep]
    picked = vectors.iloc[cols]
    return pd.DataFrame(
        {
            "query_id": ids[rows],
            "chunk_id": picked["chunk_id"].to_numpy(),
            "paper_id": picked["paper_id"].to_numpy(),
            "chunk_index": picked["chunk_index"].to_numpy(),
            "score": values,
        }
    )


def _best_by_key(v: pd.DataFrame, q: pd.DataFrame, keys: Sequence[str], n: int | None) -> list[pd.DataFrame]:
    """Best n of each key's vectors for the key's queries. The pairs of small keys are one list, scored and sorted
    together in slices of bounded size; a large key has matrices of its own."""
    keys = list(keys)
    code = pd.concat([v[keys], q[keys]], ignore_index=True).groupby(keys).ngroup().fillna(-1).to_numpy(np.int64)
    of_v, of_q = code[: len(v)], code[len(v) :]
    total = code.max(initial=-1) + 1
    n_v, n_q = (np.bincount(c[c >= 0], minlength=total) for c in (of_v, of_q))
    small = n_v * n_q <= KEY_PAIRS
    # Keys may have vectors of their own length.
    if len({np.shape(x) for part in (v, q) for x in part["embedding"]}) > 1:
        small[:] = False
    found = []
    for k in np.flatnonzero(~small & (n_v > 0) & (n_q > 0)):
        own = q[of_q == k]
        found += _best(v[of_v == k], own["query_id"].to_numpy(), _matrix(own["embedding"]), n)
    v = v.assign(_code=of_v)[(of_v >= 0) & np.append(small, False)[of_v]]
    q = q.assign(_code=of_q)[(of_q >= 0) & np.append(small, False)[of_q]]
    q = q[n_v[q["_code"]] > 0]
    if not len(q):
        return found
    v = v.sort_values(["_code", "paper_id", "chunk_index"], kind="stable")
    begin = np.searchsorted(v["_code"].to_numpy(), np.arange(total))
    m_v, m_q, ids = _matrix(v["embedding"]), _matrix(q["embedding"]), q["query_id"].to_numpy()
    first, size = begin[q["_code"]], n_v[q["_code"]]
    before = np.append(0, np.cumsum(size))
    at, limit = 0, max(1, SCORE_CELLS // max(1, m_v.shape[1]))
    while at < len(q):
        to = max(at + 1, int(np.searchsorted(before, before[at] + limit, "right")) - 1)
        rows = np.repeat(np.arange(at, to), size[at:to])
        cols = np.arange(before[at], before[to]) - np.repeat(before[at:to] - first[at:to], size[at:to])
        a, b = m_q[rows], m_v[cols]
        squared = (a * a).sum(axis=1) + (b * b).sum(axis=1) - 2.0 * (a * b).sum(axis=1)
        scores = np.round(1.0 - squared, 9) + 0.0
        order = np.lexsort((cols, -scores, rows))
        rows, cols, scores = rows[order], cols[order], scores[order]
        keep = np.arange(before[at], before[to]) - before[rows] < (len(v) if n is None else n)
        picked = v.iloc[cols[keep]]
        columns = {c: picked[c].to_numpy() for c in ("chunk_id", "paper_id", "chunk_index")}
        found.append(pd.DataFrame({"query_id": ids[rows[keep]], **columns, "score": scores[keep]}))
        at = to
    return found


def _with_joined_queries(
    vectors: DataFrame, queries: DataFrame, n: int | None, keys: Sequence[str]
) -> DataFrame:
    """Best `n` of every piece of the block join for each query."""

    def best(v: pd.DataFrame, q: pd.DataFrame, names: Sequence[str]) -> list[pd.DataFrame]:
        if names:
            return _best_by_key(v, q, names, n)
        return list(_best(v, q["query_id"].to_numpy(), _matrix(q["embedding"]), n))

    return _block_join(vectors, queries, keys, ["query_id", "embedding"], best, HIT)


def _block_join(
    vectors: DataFrame,
    queries: DataFrame,
    keys: Sequence[str],
    query_columns: Sequence[str],
    work: Callable[[pd.DataFrame, pd.DataFrame, Sequence[str]], list[pd.DataFrame]],
    result: str,
) -> DataFrame:
    """Block join: vectors and queries sharing `keys` meet in pieces of bounded size.

    Both sides of a key are cut by hash into as many pieces as its row counts ask for, and pairs
    of pieces meet in one group, so no key is too large for a task. Small keys share groups; `work` gets a group and
    the names of its key columns.
    """
    keys = list(keys)

    def pieces(df: DataFrame, block: int, name: str) -> DataFrame:
        counted = df.groupBy(*keys).agg(F.count("*").alias("_n"))
        return counted.select(*keys, F.ceil(F.col("_n") / block).cast("int").alias(name))

    v_pieces = pieces(vectors, VECTOR_BLOCK, "_vn")
    q_pieces = pieces(queries, QUERY_BLOCK, "_qn")
    if keys:
        groups = vectors.select(F.ceil(F.count("*") / VECTOR_BLOCK).alias("n")).scalar()
        group_of = F.pmod(F.xxhash64(*keys), F.greatest(groups, F.lit(1)))
        grid = v_pieces.join(q_pieces, keys)
        vectors, queries = vectors.join(grid, keys), queries.join(grid, keys)
    else:
        group_of = F.lit(0)
        sizes = {"_vn": v_pieces.select("_vn").scalar(), "_qn": q_pieces.select("_qn").scalar()}
        vectors, queries = vectors.withColumns(sizes), queries.withColumns(sizes)

    def piece(column: str, count: str) -> Column:
        return F.pmod(F.xxhash64(column), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = vectors.withColumn("_v", piece("chunk_id", "_vn")).withColumn("_q", every("_qn"))
    right = queries.withColumn("_q", piece("query_id", "_qn")).withColumn("_v", every("_vn"))

    names = [part.split()[0] for part in result.split(", ")]

    def run(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = work(v, q, fresh) if len(v) and len(q) else []
        return pd.concat(found) if found else pd.DataFrame(columns=names)

    # New names for the keys: the two sides of a cogroup must not share a column.
    fresh = [f"_key{i}" for i in range(len(keys))]
    group = ["_g", "_v", "_q"]
    shared = [*group, *[F.col(k).alias(name) for k, name in zip(keys, fresh)]]
    v_side = left.withColumn("_g", group_of).select(
        *shared, "chunk_id", "paper_id", "chunk_index", "embedding"
    )
    q_side = right.withColumn("_g", group_of).select(*shared, *query_columns)
    return v_side.groupBy(*group).cogroup(q_side.groupBy(*group)).applyInPandas(run, result)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    n: int | None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Exact best `n` vectors per query inside its scope; `n=None` ranks all of them.

    vectors(chunk_id, paper_id, chunk_index, embedding, scope…), queries(query_id, embedding,
    scope…) → (query_id, chunk_id, paper_id, chunk_index, score, rank).
    """
    queries = queries.where(F.col("embedding").isNotNull())
    hits = _with_joined_queries(vectors, queries, n, scope)
    if n is None:
        return rank_all(hits, ["query_id"], [-F.floor(F.col("score") * 256)], hit_order())
    return top_n(hits, ["query_id"], hit_order(), n)


def _pair_scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            v, q = _matrix(pdf["embedding"]), _matrix(pdf["asked"])
            squared = (q * q).sum(axis=1) + (v * v).sum(axis=1) - 2.0 * (q * v).sum(axis=1)
            yield pdf.drop(columns=["embedding", "asked"]).assign(score=np.round(1.0 - squared, 9) + 0.0)


def _count_better(vectors: pd.DataFrame, queries: pd.DataFrame, keys: Sequence[str] = ()) -> list[pd.DataFrame]:
    """How many of these vectors stand before each mark of each query."""
    out: list[tuple[str, str, int]] = []
    q = _matrix(queries["embedding"])
    step = max(1, SCORE_CELLS // max(1, len(queries)))
    for start in range(0, len(vectors), step):
        part = vectors.iloc[start : start + step]
        v = _matrix(part["embedding"])
        squared = (q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2.0 * (q @ v.T)
        scores = np.round(1.0 - squared, 9) + 0.0
        places = list(zip(part["paper_id"], part["chunk_index"]))
        for row, query_id, marks in zip(scores, queries["query_id"], queries["marks"]):
            ascending = np.sort(row)
            for mark in marks:
                above = len(row) - int(np.searchsorted(ascending, mark["score"], "right"))
                own = (mark["paper_id"], mark["chunk_index"])
                tied = sum(places[i] < own for i in np.flatnonzero(row == mark["score"]))
                out.append((query_id, mark["chunk_id"], above + tied))
    return [pd.DataFrame(out, columns=["query_id", "chunk_id", "better"])] if out else []


def vector_ranks(vectors: DataFrame, queries: DataFrame, marks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank): place in the full vector list of each marks(query_id, chunk_id).

    Every block counts what stands before each mark, and only the counts are shuffled. Meant for
    few marks per query. Marks without a vector on either side have no rank.
    """
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    pairs = marks.select("query_id", "chunk_id").join(vectors, "chunk_id").join(
        asked.withColumnRenamed("embedding", "asked"), "query_id"
    )
    scored = pairs.select("query_id", "chunk_id", "paper_id", "chunk_index", "embedding", "asked").mapInPandas(
        _pair_scores, HIT
    )
    packed = scored.groupBy("query_id").agg(
        F.collect_list(F.struct("score", "paper_id", "chunk_index", "chunk_id")).alias("marks")
    )
    counts = _block_join(
        vectors, asked.join(packed, "query_id"), [], ["query_id", "embedding", "marks"], _count_better,
        "query_id string, chunk_id string, better long",
    )
    return counts.groupBy("query_id", "chunk_id").agg(F.sum("better").cast("int").alias("rank"))


def fit_cells(vectors: DataFrame, cells: int, seed: int = 42, sample: float = 1.0) -> np.ndarray:
    """Centres of a KMeans split of the vectors; training may use a sample of them."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    train = vectors.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    if sample < 1.0:
        train = train.sample(fraction=sample, seed=seed)
    return np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(train).clusterCenters())


def _closest_cells(centres: np.ndarray, count: int):
    @F.pandas_udf("array<int>")
    def closest(embedding: pd.Series) -> pd.Series:
        m = _matrix(embedding)
        gap = (centres * centres).sum(axis=1)[None, :] - 2.0 * (m @ centres.T)
        return pd.Series(list(np.argsort(gap, axis=1, kind="stable")[:, :count].astype(np.int32)))

    return closest


def nearest_by_cells(
    vectors: DataFrame, queries: DataFrame, n: int, centres: np.ndarray, probes: int
) -> DataFrame:
    """Approximate best `n`: search only the `probes` cells closest to each query."""
    cell_of, cells_of = _closest_cells(centres, 1), _closest_cells(centres, probes)
    placed = vectors.withColumn("cell", F.get(cell_of("embedding"), F.lit(0)))
    asked = queries.where(F.col("embedding").isNotNull()).withColumn(
        "cell", F.explode(cells_of("embedding"))
    )
    hits = _with_joined_queries(placed, asked, n, ["cell"])
    return top_n(hits, ["query_id"], hit_order(), n)


def _cells_to_search(centres: np.ndarray, counts: np.ndarray, radii: np.ndarray, n: int):
    """Embedding, n-th score so far (null: not known) → cells. Without a score: the closest cells that
    hold n vectors. With one: the other cells that may hold a vector at least as good."""

    @F.pandas_udf("array<int>")
    def cells(embedding: pd.Series, score: pd.Series) -> pd.Series:
        m = _matrix(embedding)
        gap = np.sqrt(np.maximum(((m[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2), 0))
        out = []
        for row, reached in zip(gap, score.to_numpy(float)):
            order = np.argsort(row, kind="stable")
            held = np.cumsum(counts[order])
            first = int(np.searchsorted(held, n)) + 1
            if np.isnan(reached):
                out.append(order[:first].astype(np.int32))
                continue
            rest = order[first:]
            # Scores are rounded to 9 decimals: the slack keeps every tie.
            limit = np.sqrt(max(1.0 - reached, 0.0) + SLACK) + SLACK
            out.append(rest[(counts[rest] > 0) & (row[rest] - radii[rest] <= limit)].astype(np.int32))
        return pd.Series(out)

    return cells


def nearest_in_cells(vectors: DataFrame, queries: DataFrame, n: int, centres: np.ndarray) -> DataFrame:
    """Exact best `n`, as of `nearest`, by cells.

    The closest cells that hold n vectors give each query an n-th score. Another cell is skipped only
    if the distance to its centre minus its radius is larger than the distance of that score. With at
    most n vectors in all, every cell is searched.
    """
    cell_of = _closest_cells(centres, 1)

    @F.pandas_udf("double")
    def apart(embedding: pd.Series, cell: pd.Series) -> pd.Series:
        return pd.Series(np.sqrt(((_matrix(embedding) - centres[cell.to_numpy(int)]) ** 2).sum(axis=1)))

    placed = written(vectors.withColumn("cell", F.get(cell_of("embedding"), F.lit(0))), "placed-vectors")
    counts, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max(apart("embedding", "cell")).alias("radius")).collect():
        counts[r["cell"]], radii[r["cell"]] = r["n"], r["radius"]
    cells = _cells_to_search(centres, counts, radii, n)
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    unknown = F.lit(None).cast("double")
    near = _with_joined_queries(placed, asked.withColumn("cell", F.explode(cells("embedding", unknown))), n, ["cell"])
    near = written(top_n(near, ["query_id"], hit_order(), n).select("query_id", "chunk_id", "paper_id", "chunk_index", "score"), "cell-hits")
    reached = near.groupBy("query_id").agg(F.min("score").alias("reached"))
    further = asked.join(reached, "query_id").withColumn("cell", F.explode(cells("embedding", F.col("reached"))))
    far = _with_joined_queries(placed, further.drop("reached"), n, ["cell"])
    return top_n(near.unionByName(far), ["query_id"], hit_order(), n)
