"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litweave.session import written

__all__ = ["components", "give_back", "marked", "partitions", "placed", "released", "row_of", "seeded_rank", "slices", "sliced", "words", "written"]

#: Word characters of the contracts: everything but the ASCII white space. `bytes.split()` cuts
#: UTF-8 text at exactly these bytes.
WHITE_SPACE = "[\\x20\\x09-\\x0D]+"

#: Slots of a bit map of keys, at most.
MOST_SLOTS = 1 << 27

#: Bytes of an Arrow batch that are Python objects at a time.
AT_ONCE = 1 << 21
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes; none for null."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def give_back() -> None:
    """Return freed memory to the system. Spark keeps a task's Python process for later tasks and deals these out in
    turn, so what every process has once used would else count for all of them, also for idle ones."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function over batches; a task that is done with it gives memory back."""

    def over(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return over


def slices(rows: int, size: int) -> Iterator[tuple[int, int]]:
    """Where slices of about AT_ONCE bytes of `rows` rows with `size` bytes begin, and their numbers of rows."""
    step = max(1, min(rows, rows * AT_ONCE // max(1, size)))
    return ((at, min(step, rows - at)) for at in range(0, rows, step))


def sliced(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> Callable:
    """A function over pandas batches as one for `mapInArrow`. It gets slices of some MB, so no batch is ever
    held as Python objects as a whole beside its Arrow buffers."""
    fields = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = (b.slice(at, n).to_pandas() for b in batches for at, n in slices(b.num_rows, b.nbytes))
        for frame in run(frames):
            yield pa.RecordBatch.from_pandas(frame, fields, preserve_index=False)

    return released(over)


def partitions(spark: SparkSession) -> int:
    """Number of partitions for data dealt out by a key."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_of(df: DataFrame) -> Column:
    """The whole input row as one column, so that added columns can't clash with its names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def seeded_rank(key: Column, seed: int) -> Column:
    """A fixed pseudo-random order of rows, the same in every run and on every partitioning."""
    return F.xxhash64(F.lit(seed), key)


def placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of `df` with their place among the rows of their key: `pos` (from 0 in `order`, nulls
    first), `total` (rows of the key) and `at`, a number that ascends over (keys, order).

    The rows are sorted once by range, and rows that agree in everything are told apart by where they
    were read, so a key with a third of all rows fills many tasks. Places in a task's piece of a key come from `at`,
    what lies before it from a running sum over the pieces. The result is read from a table, so its
    numbers hold. Keys are not null.
    """
    columns = [c for c in df.columns]
    sort = [*keys, *order, "_read"]
    told = df.withColumn("_read", F.monotonically_increasing_id())
    ordered = told.repartitionByRange(partitions(df.sparkSession), *sort).sortWithinPartitions(*sort)
    ordered = written(ordered.select(*columns, F.monotonically_increasing_id().alias("at")), "ordered")
    ordered = ordered.withColumn("piece", F.shiftright("at", 33))
    pieces = ordered.groupBy(*keys, "piece").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    own = W.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(own.orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(*keys, "piece", "first", before.alias("before"), F.sum("n").over(own).alias("total"))
    met = ordered.join(pieces, [*keys, "piece"])
    return met.select(*columns, "at", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "total")


def marked(keys: DataFrame, key: str) -> tuple[np.ndarray, int]:
    """A bit map over slots of a column of integers, 16 MB at most, built by the tasks, and the number of
    slots. A key's slot is its value modulo that number. It lets few other keys through while the keys are
    fewer than the slots; whatever it lets through must be joined away."""
    slots = min(MOST_SLOTS, 1 << max(20, (16 * keys.count()).bit_length()))
    slot = F.pmod(key, F.lit(slots)) + 1
    maps = keys.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(slots // 8, np.uint8)
    for k, bits in maps.collect():
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(bits, np.uint8)
    return out, slots


def _star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; rows are (a, b) with b < a."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.where("a <> b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    hung = large.join(least, "a")
    small = hung.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return small.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b), two long columns → (node, root).

    Every node of an edge between two different nodes is returned once, with the smallest node of
    its component. Alternating star contraction: the number of rounds grows with the logarithm of
    the component's size, edges never outnumber those given, minima are combined map-side, and
    each round is a table in the shared folder, so nothing is collected and a lost executor costs
    one round. No edges give no rows; loops and nulls are ignored.
    """
    clean = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(clean.distinct(), "edges")
    seen = None
    while True:
        digest = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        state = tuple(now.agg(F.count("*"), digest).first())
        if state == seen or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = state
        now = written(_star_round(now), "edges")
