"""Near-duplicate vectors by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, partitions, written
from .simhash import joined

COSINE = 0.98
#: Leading principal dimensions that order the grid.
AXES = 8
#: Vectors of one sequence block.
BLOCK = 512
#: Intervals of a sequence up to this length are compared directly.
LEAF = 32
#: Allowance for rounding in projected distances; it only lets more pairs be compared.
SLACK = 1e-6


def _moments(size: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Sums of products of all unit vectors of a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size + 1, size))
        for batch in batches:
            unit, _ = _units(batch["embedding"], size)
            total[:size] += unit.T @ unit
            total[size] += unit.sum(0)
        i, j = np.divmod(np.arange(total.size), size)
        yield pd.DataFrame({"i": i, "j": j, "s": total.ravel()})

    return run


def _units(vectors: pd.Series, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows padded with zeros, divided by their length; and the plain rows."""
    plain = np.zeros((len(vectors), size))
    for row, v in zip(plain, vectors):
        row[: len(v)] = v
    scale = np.abs(plain).max(1, keepdims=True, initial=0)
    unit = plain / np.where(scale > 0, scale, 1)
    norm = np.sqrt((unit * unit).sum(1, keepdims=True))
    return unit / np.where(norm > 0, norm, 1), plain


def principal_axes(valid: DataFrame, size: int, axes: int = AXES) -> np.ndarray:
    """Orthonormal leading principal directions (axes × size) of all unit vectors; the driver gets
    size × (size + 1) sums."""
    sums = valid.mapInPandas(_moments(size), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    total = np.zeros((size + 1, size))
    total[sums["i"], sums["j"]] = sums["s"]
    n = max(1.0, np.trace(total[:size]))  # each unit vector adds one
    mean = total[size] / n
    _, axis = np.linalg.eigh(total[:size] / n - np.outer(mean, mean))
    return axis[:, ::-1].T[: min(axes, size)].copy()


def _cells(axes: np.ndarray, epsilon: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            unit, _ = _units(batch["embedding"], axes.shape[1])
            cell = np.floor(unit @ axes.T / epsilon).astype(np.int32)
            yield batch.assign(cell=list(cell))

    return run


def _blocks(axes: np.ndarray, epsilon: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Sorted rows → blocks of one group: their vectors as bytes and the box of their projections."""
    size = axes.shape[1]

    def block(frame: pd.DataFrame, number: int) -> dict:
        unit, plain = _units(frame["embedding"], size)
        at = unit @ axes.T
        return {
            "label": frame["label"].iloc[0], "width": frame["width"].iloc[0], "block": number,
            "nodes": frame["node"].to_numpy(np.int64).tobytes(), "copies": frame["copies"].to_numpy(np.int64).tobytes(),
            "vectors": plain.astype(np.float64).tobytes(), "low": at.min(0).tolist(), "high": at.max(0).tolist(),
        }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, number = None, 0
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            out, held = _cut(held, False)
            if out:
                yield pd.DataFrame([block(f, int(f["node"].iloc[0])) for f in out])
        if held is not None and len(held):
            yield pd.DataFrame([block(f, int(f["node"].iloc[0])) for f in _cut(held, True)[0]])

    return run


def _cut(frame: pd.DataFrame, end: bool) -> tuple[list[pd.DataFrame], pd.DataFrame]:
    """Cut sorted rows into blocks that hold one group each; the rest waits for more rows."""
    keys = frame[["label", "width"]].to_numpy()
    bounds = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(frame)]
    out, rest = [], len(frame)
    for a, b in zip(bounds[:-1], bounds[1:]):
        for at in range(a, b, BLOCK):
            if not end and b == len(frame) and at + BLOCK > b:
                rest = at
                break
            out.append(frame.iloc[at : min(b, at + BLOCK)])
    return out, frame.iloc[rest:]


class _Sequence:
    """Vectors in grid order with the box of the projections of any interval."""

    def __init__(self, vectors: bytes, axes: np.ndarray) -> None:
        plain = np.frombuffer(vectors, np.float64).reshape(-1, axes.shape[1])
        scale = np.abs(plain).max(1, keepdims=True)
        self.plain = plain / scale
        self.norm = np.sqrt((self.plain * self.plain).sum(1))
        self.at = (self.plain / self.norm[:, None]) @ axes.T

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return self.at[a:b].min(0), self.at[a:b].max(0)


def _join(one: _Sequence, two: _Sequence, same: bool, cosine: float, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked index pairs of two sequences; halves whose boxes are further apart than `reach` are
    skipped, short intervals compared."""
    todo = [(0, len(one.at), 0, len(two.at))]
    while todo:
        a, b, c, d = todo.pop()
        if same and d <= a:
            continue  # the mirror image of another interval
        (low, high), (low2, high2) = one.box(a, b), two.box(c, d)
        gap = np.maximum(0, np.maximum(low - high2, low2 - high))
        if gap @ gap > reach * reach:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            close = one.plain[a:b] @ two.plain[c:d].T / np.outer(one.norm[a:b], two.norm[c:d]) >= cosine
            i, j = np.nonzero(close)
            i, j = i + a, j + c
            yield (i[i < j], j[i < j]) if same else (i, j)
        elif b - a >= d - c:
            middle = (a + b) // 2
            todo += [(a, middle, c, d), (middle, b, c, d)]
        else:
            middle = (c + d) // 2
            todo += [(a, b, c, middle), (a, b, middle, d)]


def _compare(axes: np.ndarray, cosine: float, reach: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Pairs of blocks → for each vector with links in it: their number, and one link that keeps
    linked vectors connected."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                same = r.block == r.other
                nodes = [np.frombuffer(x, np.int64) for x in ((r.nodes,) if same else (r.nodes, r.nodes_2))]
                copies = np.concatenate([np.frombuffer(x, np.int64) for x in ((r.copies,) if same else (r.copies, r.copies_2))])
                shift, node = (0 if same else len(nodes[0])), np.concatenate(nodes)
                one = _Sequence(r.vectors, axes)
                two = one if same else _Sequence(r.vectors_2, axes)
                links, root = np.zeros(len(node), np.int64), np.arange(len(node))
                for i, j in _join(one, two, same, cosine, reach):
                    j = j + shift
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    root = joined(root, i, j)
                some = np.flatnonzero(links)
                if len(some):
                    yield pd.DataFrame({"node": node[some], "links": links[some], "hook": node[root[some]]})

    return run


def vector_groups(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
) -> DataFrame:
    """Rows → (vec_id, n_links, component_id, kept) by links of cosine >= `cosine` within a label.

    Equal vectors of a label are one entry with a number of copies, which all link with each other.
    Unit vectors of cosine c lie sqrt(2 - 2c) apart and their projections no further, so entries are
    sorted by grid cells of that width on the leading principal dimensions, cut into blocks, and
    two blocks are joined only if the boxes of their projections are near enough; inside, intervals
    are halved in the same way down to direct comparison in double precision. Blocks that might meet are
    found by the cells of the first dimension that they span. A pair of blocks gives back sums and
    at most one link per vector, never its pairs.

    Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
    rows with a null label, link with nothing and are their own component; vectors of different
    lengths never link; rows that repeat a vector under the same identifier count as further
    vectors; null identifiers take part and are never a component's smallest; an empty table gives no rows.
    """
    spark = df.sparkSession
    n = partitions(spark)
    vector = F.col("embedding")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    rows = df.select(
        F.col(id_col).alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding")
    ).withColumn("usable", F.coalesce(usable, F.lit(False)))
    valid = rows.where("usable")
    # -0.0 and 0.0 are the same component
    plain = F.transform(vector, lambda x: x + F.lit(0.0))
    entries = valid.select("vec_id", "label", plain.alias("embedding")).groupBy("label", "embedding").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("least")
    ).withColumn("width", F.size("embedding"))
    size = entries.agg(F.max("width")).first()[0] or 1
    axes = principal_axes(entries, size)
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    reach = epsilon + SLACK

    celled = entries.mapInPandas(
        _cells(axes, max(epsilon, SLACK)), "label long, embedding array<double>, copies long, least long, width int, cell array<int>"
    )
    ordered = celled.repartitionByRange(n, "label", "width", "cell", "embedding").sortWithinPartitions("label", "width", "cell", "embedding")
    # Written once, so that the numbers hold.
    ordered = written(ordered.withColumn("node", F.monotonically_increasing_id()), "grid-order")
    blocks = written(
        ordered.select("node", "copies", "label", "width", "embedding").sortWithinPartitions("label", "width", "node").mapInPandas(
            _blocks(axes, epsilon),
            "label long, width int, block long, nodes binary, copies binary, vectors binary, low array<double>, high array<double>",
        ),
        "blocks",
    )
    cell_of = lambda x: F.floor(x / F.lit(reach))
    spans = blocks.select(
        "label", "width", "block", "low", "high",
        F.explode(F.sequence(cell_of(F.get("low", F.lit(0))) - 1, cell_of(F.get("high", F.lit(0))))).alias("cell"),
    )
    right = spans.select("label", "width", "cell", F.col("block").alias("other"), F.col("low").alias("low_2"), F.col("high").alias("high_2"))
    near_boxes = F.aggregate(
        F.zip_with(
            F.zip_with("low", "high_2", lambda a, b: a - b), F.zip_with("low_2", "high", lambda a, b: a - b), lambda a, b: F.greatest(F.lit(0.0), a, b)
        ),
        F.lit(0.0),
        lambda s, g: s + g * g,
    ) <= reach * reach
    pairs = spans.join(right, ["label", "width", "cell"]).where(F.col("block") <= F.col("other")).where(near_boxes)
    pairs = pairs.select("block", "other").distinct()
    second = blocks.select(F.col("block").alias("other"), *[F.col(c).alias(f"{c}_2") for c in ("nodes", "copies", "vectors")])
    sent = pairs.join(blocks.select("block", "nodes", "copies", "vectors"), "block").join(second, "other")
    found = written(sent.repartition(n).mapInPandas(_compare(axes, cosine, reach), "node long, links long, hook long"), "links")

    roots = components(found.select(F.col("node").alias("a"), F.col("hook").alias("b")))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = ordered.select("node", "label", "embedding", "copies", "least").join(counted, "node", "left").join(roots, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = named.join(least, "root").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    good = valid.select("vec_id", "label", plain.alias("embedding")).join(linked, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = good.union(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
