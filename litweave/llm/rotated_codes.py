"""Nearest neighbours by cosine from randomly rotated one-bit codes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, written

#: Bits of a code at least; vectors are padded with zeros to the next power of two.
BITS = 256
#: Width of the error bounds, in standard deviations of the estimate.
EPSILON = 4.0
#: Bits of a query's rotated components.
QUERY_BITS = 4
#: Bytes of the query vectors of one block, and vectors and queries that are compared together.
QUERY_BYTES = 1 << 24
CANDIDATES, QUERIES = 4096, 256
#: Pairs whose exact cosine is computed together.
PAIRS = 1 << 14


def bits_of(width: int) -> int:
    return max(BITS, 1 << (width - 1).bit_length())


def scaled(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows, halved or doubled until their largest component is near one; cosines of such
    rows are those of the original ones, without overflow."""
    plain = np.array(vectors.tolist(), np.float64)
    _, power = np.frexp(np.abs(plain).max(1, keepdims=True, initial=0))
    return np.ldexp(plain, -power)


def norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(1))


def rotated(unit: np.ndarray) -> np.ndarray:
    """Rows after a fixed random rotation: three times random signs and a Hadamard transform."""
    size = bits_of(unit.shape[1])
    signs = np.random.default_rng(size).choice([-1.0, 1.0], (3, size))
    out = np.zeros((len(unit), size))
    out[:, : unit.shape[1]] = unit
    for sign in signs:
        out *= sign
        step = 1
        while step < size:
            pair = out.reshape(len(out), -1, 2, step)
            out = np.stack((pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]), 2).reshape(len(out), size)
            step *= 2
        out /= math.sqrt(size)
    return out


def codes(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the rotated components as packed words, and the correction: the inner product of a
    unit vector with the direction its code stands for."""
    rows = scaled(vectors)
    turned = rotated(rows / norms(rows)[:, None])
    return np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64), np.abs(turned).sum(1) / math.sqrt(turned.shape[1])


class Queries:
    """Query vectors with their rotated components in QUERY_BITS bits, one plane a bit."""

    def __init__(self, vectors: pd.Series) -> None:
        self.rows = scaled(vectors)
        self.norm = norms(self.rows)
        levels, parts = (1 << QUERY_BITS) - 1, []
        for at in range(0, len(self.rows), CANDIDATES):
            turned = rotated(self.rows[at : at + CANDIDATES] / self.norm[at : at + CANDIDATES, None])
            low = turned.min(1, keepdims=True)
            step = np.maximum((turned.max(1, keepdims=True) - low) / levels, 1e-300)
            level = np.rint((turned - low) / step).astype(np.uint8)
            lost = turned - (low + step * level)
            planes = [np.packbits(level >> j & 1, axis=1, bitorder="little").view(np.uint64) for j in range(QUERY_BITS)]
            parts.append((np.stack(planes, 1), low[:, 0], step[:, 0], (turned - lost).sum(1), (lost * lost).sum(1)))
        self.planes, self.low, self.step, self.sum, self.lost = (np.concatenate(x) for x in zip(*parts))
        self.size = self.planes.shape[2] * 64

    def estimates(self, own: slice, code: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines of some queries with coded vectors, and how far above them the true ones
        may lie."""
        met = np.zeros((len(self.planes[own]), len(code)), np.int32)
        for w in range(code.shape[1]):
            word = np.ascontiguousarray(code[:, w])
            for j in range(QUERY_BITS):
                met += np.bitwise_count(word & self.planes[own, j, w][:, None]).astype(np.int32) << j
        ones = np.bitwise_count(code).sum(1, dtype=np.int64)
        both = 2 * (self.low[own, None] * ones + self.step[own, None] * met) - self.sum[own, None]
        spread = (1 - np.minimum(1, scale * scale)) / (self.size - 1) + self.lost[own, None] / self.size
        return both / (math.sqrt(self.size) * scale), EPSILON * np.sqrt(spread) / scale


class Nearest:
    """The best rows found so far for the queries of a block."""

    def __init__(self, queries: Queries, most: int) -> None:
        self.queries, self.most, n = queries, most, len(queries.rows)
        self.query, self.score, self.ids = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.least = np.full(n, -np.inf)
        self.exact = 0

    def _keep(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Take rows in, keep the `most` best of each query; ties go to the smaller identifier."""
        query, score, ids = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.ids, ids)))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.most
        self.query, self.score, self.ids = query[kept], score[kept], ids[kept]
        full = rank == self.most - 1
        self.least[query[full]] = score[full]

    def _compare(self, query: np.ndarray, which: np.ndarray, rows: np.ndarray, norm: np.ndarray, ids: list[np.ndarray]) -> None:
        """Exact cosines of the given pairs."""
        self.exact += len(query)
        for at in range(0, len(query), PAIRS):
            q, v = query[at : at + PAIRS], which[at : at + PAIRS]
            score = (self.queries.rows[q] * rows[v]).sum(1) / (self.queries.norm[q] * norm[v])
            good = score >= self.least[q]
            q, v, score = q[good], v[good], score[good]
            named = [ids[i] for i in v.tolist()]
            times = np.fromiter(map(len, named), np.int64, len(named))
            self._keep(np.repeat(q, times), np.repeat(score, times), np.concatenate([*named, np.empty(0, np.int64)]))

    def add(self, batch: pd.DataFrame) -> None:
        """Compare coded vectors with all queries: first those that promise most, then all that the
        error bounds don't rule out."""
        for at in range(0, len(batch), CANDIDATES):
            part = batch.iloc[at : at + CANDIDATES]
            rows, ids = scaled(part["embedding"]), part["ids"].tolist()
            norm, scale = norms(rows), part["scale"].to_numpy()
            code = np.frombuffer(b"".join(part["code"]), np.uint64).reshape(len(part), -1)
            for first in range(0, len(self.queries.rows), QUERIES):
                own = slice(first, first + QUERIES)
                about, error = self.queries.estimates(own, code, scale)
                best = np.argpartition(-about, min(self.most, len(part)) - 1, axis=1)[:, : self.most]
                query = np.repeat(np.arange(len(about)), best.shape[1])
                self._compare(query + first, best.ravel(), rows, norm, ids)
                about += error
                left = about >= self.least[own][:, None]
                left[query, best.ravel()] = False
                query, which = np.nonzero(left)
                # The most promising first, so that the bar rises early.
                order = np.argsort(-about[query, which], kind="stable")
                self._compare(query[order] + first, which[order], rows, norm, ids)


def _encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        width = batch["embedding"].map(len)
        for _, part in batch.groupby(width, sort=False):
            code, scale = codes(part["embedding"])
            yield part.assign(code=[c.tobytes() for c in code], scale=scale)


def usable(vector: Column) -> Column:
    """Vectors with components, all of them finite and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors_of(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    kind = df.schema[vector_col].dataType
    vector = F.col(f"`{vector_col}`")
    if not isinstance(kind.elementType, T.FloatType):
        vector = vector.cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))


def code_index(rows: DataFrame, most: int) -> DataFrame:
    """rows(vec_id, embedding) → an entry per different vector: entry, embedding, ids (its `most` smallest
    identifiers: no more of equal vectors can be among the `most` nearest), code, scale."""
    told = rows.groupBy("embedding", "vec_id").agg(F.lit(1).alias("one"))
    ranked = told.withColumn("k", F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))).where(F.col("k") <= most)
    entries = ranked.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    kind = rows.schema["embedding"].dataType.simpleString()
    coded = entries.mapInPandas(_encoded, f"embedding {kind}, ids array<long>, code binary, scale double")
    return written(coded.withColumn("entry", F.monotonically_increasing_id()), "code-index")


def _search(most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows sorted by key, queries (no code) before vectors → the best of each query of the key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, asked, found = None, [], None

        def answers() -> Iterator[pd.DataFrame]:
            if found is None or not len(found.query):
                return
            names = np.concatenate([a["entry"].to_numpy() for a in asked])
            cut = np.flatnonzero(np.diff(found.query, prepend=-1))
            ends = np.append(cut[1:], len(found.query)).astype(int)
            best = [
                [{"down": -s, "vec_id": i} for s, i in zip(found.score[a:b].tolist(), found.ids[a:b].tolist())] for a, b in zip(cut, ends)
            ]
            yield pd.DataFrame({"entry": names[found.query[cut]], "best": best})

        for batch in batches:
            if not len(batch):
                continue
            keys = batch[["width", "block", "share", "vector"]].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                key, part = tuple(keys[a, :3]), batch.iloc[a:b]
                if key != now:
                    yield from answers()
                    now, asked, found = key, [], None
                if not keys[a, 3]:
                    asked.append(part)
                elif asked:
                    if found is None:
                        found = Nearest(Queries(pd.concat([p["embedding"] for p in asked], ignore_index=True)), most)
                    found.add(part)
        yield from answers()

    return run


def nearest(index: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """index and entries(entry, embedding) to search with → (entry, best): the `most` nearest rows
    (down, vec_id), best first; `down` is the cosine with its sign changed.

    Query blocks of bounded bytes meet shares of the index; a task streams a share past a block and gives back at most `most`
    rows per query.
    """
    n = partitions(index.sparkSession)
    size = F.size("embedding").alias("width")
    amount = queries.agg(F.sum(F.size("embedding").cast("long") * 8)).first()[0] or 1
    blocks = -(-amount // QUERY_BYTES)
    shares = -(-2 * n // blocks)
    spread = [F.pmod(F.xxhash64("embedding", F.lit(k)), F.lit(m)).cast("int") for k, m in ((0, blocks), (1, shares))]
    every = [F.explode(F.sequence(F.lit(0), F.lit(int(m) - 1))) for m in (blocks, shares)]
    asked = queries.select(size, spread[0].alias("block"), every[1].alias("share"), F.lit(0).alias("vector"), "entry", "embedding")
    asked = asked.withColumns({"ids": F.lit(None).cast("array<long>"), "code": F.lit(None).cast("binary"), "scale": F.lit(0.0)})
    given = index.select(size, every[0].alias("block"), spread[1].alias("share"), F.lit(1).alias("vector"), "entry", "embedding", "ids", "code", "scale")
    keys = ["width", "block", "share"]
    dealt = asked.union(given).repartition(n, *keys).sortWithinPartitions(*keys, "vector")
    found = dealt.mapInPandas(_search(most), "entry long, best array<struct<down: double, vec_id: long>>")
    return found.groupBy("entry").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, most).alias("best"))


def neighbours(df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The `k` nearest other vectors of each query: (query_id, rank, vec_id, score).

    `is_query` is a condition on `vec_id`. A code is one bit for each rotated component; its inner product with a query,
    divided by the correction, estimates the cosine. Vectors whose estimate plus error bound
    (EPSILON standard deviations) reaches the k-th best exact cosine so far are compared exactly on the original vectors.

    Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    identifier, take no part; vectors of another length are no candidates; rows that repeat identifier and vector are
    one; rows that share a query's identifier are its own; equal cosines go to the smaller identifier; an empty table
    gives no rows; other columns are not read.
    """
    rows = vectors_of(df, id_col, vector_col)
    index = code_index(rows, k + 1)
    asking = rows.where(is_query).distinct().join(index.select("embedding", "entry"), "embedding").select("vec_id", "entry")
    asking = written(asking, "queries")
    queries = index.select("entry", "embedding").join(asking.select("entry").distinct(), "entry", "left_semi")
    found = asking.join(nearest(index, queries, k + 1), "entry")
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)
    listed = found.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("rank", "other"))
    return listed.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("other.vec_id").alias("vec_id"), (-F.col("other.down")).alias("score"))
