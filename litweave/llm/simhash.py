"""SimHash near-duplicates: bit-sliced comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, partitions, words, written

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints of one bucket that are compared with each other in one block.
BLOCK = 8192
#: Small buckets are put together until they hold so many fingerprints.
TOGETHER = 2048
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the word shingles in their order; none for a text without words."""
    found = [w.lower() for w in words(text)]  # bytes.lower changes A-Z only
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(found))
    cut = [joined[a:b] for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist())]
    return np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64, len(cut))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles; 0 for a text without words."""
    return _folded(shingle_hashes(text, shingle))


def _folded(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 64):
        part = hashes[at : at + 255 * 64]
        bits = np.zeros((-(-len(part) // 255) * 255, 64), np.uint8)
        bits[: len(part)] = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # sums of 255 bits fit a byte, so they are added without widening
        ones += np.add.reduce(bits.reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    values = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts))
    return pd.Series(values.view(np.int64))


def planes(values: np.ndarray) -> np.ndarray:
    """Vertical bit planes: row k holds bit k of every value, 64 values to a word."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _add(a, b, c):
    """Carry-save adder: three bits of equal weight become a sum bit and a carry bit."""
    ab = a ^ b
    return ab ^ c, (a & b) | (ab & c)


def near(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of `left` × `right` (at most 7 apart, see `radius`), compared bit-sliced.

    64 distances advance together in words of three counter planes; what passes 7 sticks in an
    overflow plane. After 24, 32 and 48 planes, blocks of 64 in which every distance has passed the
    radius are abandoned.
    """
    assert 0 <= radius <= 7
    target, query = planes(right), left.astype(np.uint64)
    width = target.shape[1]
    q = np.repeat(np.arange(len(query)), width)
    w = np.tile(np.arange(width), len(query))
    one = two = four = over = np.zeros(len(q), np.uint64)
    if len(right) % 64:
        over = np.where(w == width - 1, FULL << np.uint64(len(right) % 64), np.uint64(0))

    def past() -> np.ndarray:
        """Lanes whose distance is already above the radius."""
        above, equal = over, FULL
        for plane, bit in ((four, radius & 4), (two, radius & 2), (one, radius & 1)):
            above = above | (np.uint64(0) if bit else equal & plane)
            equal = equal & (plane if bit else ~plane)
        return above

    for k in range(0, 64, 4):
        bits = [target[k + i][w] ^ (np.uint64(0) - ((query >> np.uint64(k + i)) & np.uint64(1)))[q] for i in range(4)]
        one, carry_a = _add(one, bits[0], bits[1])
        one, carry_b = _add(one, bits[2], bits[3])
        two, carry = _add(two, carry_a, carry_b)
        over = over | (four & carry)
        four = four ^ carry
        if k + 4 in (24, 32, 48, 64):
            alive = np.flatnonzero(past() != FULL)
            q, w, one, two, four, over = (x[alive] for x in (q, w, one, two, four, over))
            if not len(q):
                break
    lanes = np.unpackbits((~past()).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(lanes)
    return q[row], w[row] * 64 + lane


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`root` (each node's smallest known node) after the links a–b."""
    while True:
        differ = root[a] != root[b]
        a, b = a[differ], b[differ]
        if not len(a):
            return root
        low, ra, rb = np.minimum(root[a], root[b]), root[a], root[b]
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped


def _forest(values: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between `values[left]` and `values[right]`, at most one per value: enough to connect
    what the links connect, however many there are."""
    root = np.arange(len(values))
    width = max(1, len(right) // 64)
    tile = max(1, 65536 // width)
    for at in range(0, len(left), tile):
        mine = left[at : at + tile]
        a, b = near(values[mine], values[right], radius)
        root = joined(root, mine[a], right[b])
    node = np.flatnonzero(root != np.arange(len(values)))
    return values[node], values[root[node]]


def _compare(radius: int, together: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows sorted by bucket → links. Small buckets are compared together: a link is a link,
    whichever bucket it is found in."""

    def links(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        values = frame["fp"].to_numpy().view(np.uint64)
        side, i, j = (frame[c].to_numpy() for c in ("side", "i", "j"))
        ends = np.flatnonzero(np.append(_changes(frame), True)) + 1
        first = 0
        for k, end in enumerate(ends):
            cross = i[end - 1] != j[end - 1]
            if k + 1 < len(ends) and not cross and ends[k + 1] - first <= together and i[ends[k + 1] - 1] == j[ends[k + 1] - 1]:
                continue
            part, nodes = values[first:end], np.arange(end - first)
            ours = side[first:end] == i[first:end]
            if cross:
                a, b = _forest(part, nodes[ours], nodes[~ours], radius)
            else:
                a, b = _forest(part, nodes, nodes, radius)
            first = end
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            tail.append(batch)
            held = pd.concat(tail, ignore_index=True)
            changes = np.flatnonzero(_changes(held))
            last = changes[-1] + 1 if len(changes) else 0
            if last:
                yield from links(held.iloc[:last])
            tail = [held.iloc[last:]]
        if tail:
            yield from links(pd.concat(tail, ignore_index=True))

    return run


def _changes(frame: pd.DataFrame) -> np.ndarray:
    keys = frame[["segment", "value", "i", "j"]].to_numpy()
    return (keys[1:] != keys[:-1]).any(axis=1)


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """fps(fp) distinct → links (a, b) that connect all fingerprints at most `radius` apart.

    Two such fingerprints agree on at least one of radius + 1 segments of their bits, so they are
    dealt out by each segment's value. A bucket with more than `block` fingerprints is cut into
    blocks, and each pair of blocks is a group of its own; all buckets are compared in full. From
    each group at most one link per fingerprint comes back.
    """
    width, extra = divmod(64, radius + 1)
    segments, at = [], 0
    for s in range(radius + 1):
        n = width + (s < extra)
        value = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1))
        segments.append(F.struct(F.lit(s).alias("segment"), value.alias("value")))
        at += n
    dealt = fps.select("fp", F.inline(F.array(*segments)))
    counted = dealt.groupBy("segment", "value").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = written(counted.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "large-buckets")
    sided = dealt.join(large, ["segment", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    sided = sided.withColumn("side", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = sided.select(
        "fp", "segment", "value", "side",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).select(
        "fp", "segment", "value", "side",
        F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"),
    )
    keys = ["segment", "value", "i", "j"]
    grouped = pairs.repartition(partitions(fps.sparkSession), *keys).sortWithinPartitions(*keys)
    return grouped.mapInPandas(_compare(radius, TOGETHER), "a long, b long")


def near_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS
) -> DataFrame:
    """Each row's identifier with `fingerprint` (16 hex digits) and `component_id`, the smallest
    identifier reachable over links.

    Defined results: a text that is null, empty or without words has fingerprint zero and is linked
    like any other; a text of fewer words than a shingle is one shingle; rows with a null identifier
    take part, and a group of only such rows has a null `component_id`; repeated rows are each
    returned; an empty table gives no rows. Only the two named columns are read.
    """
    ids = df.select(F.col(id_col).alias("doc_id"), _fingerprints(F.col(text_col)).alias("fp"))
    ids = written(ids, "fingerprints")
    least = ids.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = written(least, "distinct-fingerprints")
    roots = components(fingerprint_links(found.select("fp"), radius))
    rooted = found.join(roots, found["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(groups, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return ids.join(named, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """`df` without near-duplicates: of each group the row with the smallest identifier stays.

    Rows with a null identifier can't be told apart and stay. Rows that repeat an identifier stay
    or go together.
    """
    dropped = near_groups(df, id_col, text_col, radius).where("doc_id <> component_id").select(
        F.col("doc_id").alias(id_col)
    )
    return df.join(dropped.distinct(), id_col, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
