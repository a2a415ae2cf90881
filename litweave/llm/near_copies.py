"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash links are the first candidates. Those it misses are found by a prefix filter, which is exact:
in any fixed order of shingles, two sets of that similarity share one among the first
n - ceil(0.8 n) + 1 of each. All candidates are confirmed on the full sets, which are made once from the
texts; they meet in blocks of similar texts, so that a set moves once per pair of blocks and not per candidate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litweave.functions.batches import grouped

from .common import components, marked, partitions, released, seeded_rank, written
from .simhash import _folded, fingerprint_links, shingle_hashes

SHINGLE = 5
#: A shingle is known by so many bytes of its hash.
WIDTH = 6
#: One text in EVERY (of small tables so many that SAMPLE are left) is looked at for shingles of several
#: texts, and how many of these are kept with their counts; a bit map has the others. The share is the same at every
#: size, as a passage's number of texts grows with the corpus. This only decides the order of the prefix filter, not what it finds.
EVERY, SAMPLE, FREQUENT = 16, 2_000, 50_000
#: Slots of the parities that rule out candidates before their sets move, at least and by size; powers of two.
PARITIES = 1024
#: Bytes of the sets (or parities) of one block, and nodes of a block of parities.
BLOCK_BYTES, BLOCK_NODES = 1 << 23, 2048
#: Nodes of a shingle whose pairs are listed; those of commoner shingles are compared in blocks.
COMMON = 256
#: Texts whose sets are made together.
TOGETHER = 256

#: Similar sets: 9 · overlap >= 4 · (both sizes), which is overlap / union >= 0.8.
_SIZES = "5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)"
_PLACES = "9 * (least(a.pos, b.pos) + least(a.n - a.pos, b.n - b.pos)) >= 4 * (a.n + b.n)"
_MASK = np.uint64((1 << 8 * WIDTH) - 1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted different shingle hashes; texts without words have one and the same shingle."""
    return _set(shingle_hashes(text, SHINGLE))


def _set(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes & _MASK) if len(hashes) else np.zeros(1, np.uint64)


def _packed(found: np.ndarray) -> bytes:
    return np.ascontiguousarray(found.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH]).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(packed, np.uint8).reshape(-1, WIDTH)
    return out.view("<u8").ravel()


def _parities(found: np.ndarray) -> bytes:
    """One bit per slot: whether an odd number of shingles fall into it. Two sets differ in at least as
    many shingles as their parities differ in bits; large sets have more slots."""
    slots = max(PARITIES, 1 << (2 * len(found) - 1).bit_length())
    return np.packbits(np.bincount((found % np.uint64(slots)).astype(np.int64), minlength=slots).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folds(odd: bytes, slots: int) -> np.ndarray:
    """Parities for fewer slots."""
    words = np.frombuffer(odd, np.uint64)
    return np.bitwise_xor.reduce(words.reshape(-1, slots // 64), axis=0)


_NODE = "node long, fp long, n long, odd binary, packed binary"


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts → their set, its digest, SimHash, size and parities."""
    for batch in batches:
        for at in range(0, len(batch), TOGETHER):
            part = batch.iloc[at : at + TOGETHER]
            hashes = [shingle_hashes(t, SHINGLE) for t in part["text"]]
            fps = np.fromiter((_folded(h) for h in hashes), np.uint64, len(hashes))
            sets = [_set(h) for h in hashes]
            packed = [_packed(x) for x in sets]
            yield pd.DataFrame(
                {
                    "doc_id": part["doc_id"].to_numpy(),
                    "node": np.fromiter(map(xxhash.xxh64_intdigest, packed), np.uint64, len(packed)).view(np.int64),
                    "fp": fps.view(np.int64), "n": [len(x) for x in sets], "odd": [_parities(x) for x in sets], "packed": packed,
                }
            )


def _shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for packed in batch["packed"]:
            yield pd.DataFrame({"h": _unpacked(packed).view(np.int64)})


def _prefixes(
    frequent: np.ndarray, counts: np.ndarray, bits: np.ndarray, slots: int
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Sets → the first shingles of each, rare ones first; copies in a task are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                parts = [np.empty((4, 0), np.int64)]
                for node, packed in zip(batch["node"].iloc[at : at + TOGETHER].tolist(), batch["packed"].iloc[at : at + TOGETHER]):
                    if node in seen:
                        continue
                    seen.add(node)
                    found = _unpacked(packed)
                    n, slot = len(found), (found % np.uint64(slots)).astype(np.int64)
                    often = (bits[slot >> 3] >> (slot & 7) & 1).astype(np.int64)
                    if len(frequent):
                        place = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
                        often = np.where(frequent[place] == found, counts[place], often)
                    first = found[np.argsort(often, kind="stable")[: n - -(-4 * n // 5) + 1]].view(np.int64)
                    k = len(first)
                    parts.append(np.stack([first, np.full(k, node), np.full(k, n), np.arange(k)]))
                h, node, n, pos = np.concatenate(parts, axis=1)
                yield pd.DataFrame({"h": h, "node": node, "n": n.astype(np.int32), "pos": pos.astype(np.int32)})

    return run


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by shingle and node → those of shingles in several nodes, with the first node, or
    the row's own where sizes and places rule out that the two are similar. Of the shingle that may go on
    only the first and the last row are held."""
    first: pd.DataFrame | None = None  # of the open shingle
    last, several = None, False
    for batch in batches:
        if not len(batch):
            continue
        joins = first is not None and batch["h"].iloc[0] == first["h"].iloc[0]
        rows = pd.concat([first, batch], ignore_index=True) if joins else batch
        h, node = rows["h"].to_numpy(), rows["node"].to_numpy()
        begins = np.append(True, h[1:] != h[:-1])
        new = np.append(True, begins[1:] | (node[1:] != node[:-1]))
        if joins and len(rows) > 1:
            new[1] = node[1] != last
        start = np.flatnonzero(begins)
        size = np.diff(np.append(start, len(h)))
        many = np.add.reduceat(new.astype(np.int64), start) > 1
        own = np.repeat(many, size) & new
        if joins and several:
            # The first row has been given already; the rows after it belong to it in any case.
            own[: size[0]] = new[: size[0]]
            own[0] = False
        n, pos = rows["n"].to_numpy(np.int64), rows["pos"].to_numpy(np.int64)
        top, top_n, top_pos = (np.repeat(x[start], size) for x in (node, n, pos))
        fits = 5 * np.minimum(n, top_n) >= 4 * np.maximum(n, top_n)
        fits &= 9 * (np.minimum(pos, top_pos) + np.minimum(n - pos, top_n - top_pos)) >= 4 * (n + top_n)
        yield rows.assign(first=np.where(fits, top, node))[own]
        several = bool(many[-1]) or (joins and len(start) == 1 and several)
        first, last = rows.iloc[[start[-1]]], node[-1]


def _possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose sizes and parities don't rule out that they are similar: not more than a ninth of
    both sizes differs."""
    for batch in batches:
        good = [
            9 * int(np.bitwise_count(_folds(x, k) ^ _folds(y, k)).sum()) <= m + n and 5 * min(m, n) >= 4 * max(m, n)
            for x, y, m, n in zip(batch["odd_a"], batch["odd_b"], batch["n_a"].tolist(), batch["n_b"].tolist())
            for k in (8 * min(len(x), len(y)),)
        ]
        yield batch.loc[np.array(good, bool), ["a", "b"]]


def _cut_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes in order, with their bytes → their block: neighbours of bounded number and bytes."""
    block, count, held = TaskContext.get().partitionId() << 32, 0, 0
    for batch in batches:
        out = np.empty(len(batch), np.int64)
        for i, size in enumerate(batch["bytes"].tolist()):
            if count and (count >= BLOCK_NODES or held + size > BLOCK_BYTES):
                block, count, held = block + 1, 0, 0
            out[i], count, held = block, count + 1, held + size
        yield pd.DataFrame({"node": batch["node"], "block": out})


def _blocks(nodes: DataFrame, name: str) -> DataFrame:
    """nodes(node, bytes, label) → (node, block), neighbours by label together. Which ones do decides what
    moves, never what is found."""
    dealt = nodes.repartitionByRange(partitions(nodes.sparkSession), "label", "node").sortWithinPartitions("label", "node")
    return written(dealt.select("node", "bytes").mapInPandas(released(_cut_blocks), "node long, block long"), name)


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of block pairs, sets and candidate pairs → the pairs that are similar."""
    for frame in grouped(batches, ["x", "y"]):
        given = frame["packed"].notna()
        sets = {node: _unpacked(x) for node, x in zip(frame.loc[given, "a"].tolist(), frame.loc[given, "packed"])}
        pairs, good = frame.loc[~given, ["a", "b"]], []
        for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist()):
            x, y = sets[a], sets[b]
            good.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
        yield pairs[np.array(good, bool)]


def _of_marked(bits: np.ndarray, slots: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The sets whose node's slot is marked; copies in a task are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            node = batch["node"].to_numpy()
            slot = node % slots
            part = batch[(bits[slot >> 3] >> (slot & 7) & 1).astype(bool)].drop_duplicates("node")
            part = part[~part["node"].isin(seen)]
            seen.update(part["node"].tolist())
            yield part

    return run


def _confirmed(texts: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs(a, b) those that are similar; texts(node, packed), nodes(node, n, odd)."""
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = written(pairs.distinct(), "near-pairs")
    known = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node"), "near-known")
    for c in "ab":
        pairs = pairs.join(known.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}")), c)
    pairs = written(pairs.mapInPandas(released(_possible), "a long, b long"), "near-candidates")
    if pairs.isEmpty():
        return pairs
    both = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.col("a").alias("label"))
    used = both.groupBy("node").agg(F.min("label").alias("label")).join(known.select("node", (F.col("n") * WIDTH).alias("bytes")), "node")
    blocks = _blocks(used, "near-blocks")
    a, b = (blocks.select(F.col("node").alias(c), F.col("block").alias(f"block_{c}")) for c in "ab")
    met = [F.least("block_a", "block_b").alias("x"), F.greatest("block_a", "block_b").alias("y")]
    placed = written(pairs.join(a, "a").join(b, "b").select(*met, "a", "b"), "near-met")
    needed = placed.select("x", "y", F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = texts.mapInPandas(released(_of_marked(*marked(blocks, "node"))), "node long, packed binary")
    # Identifiers of 64 bits don't survive gaps in a pandas column, so a set's row names its node twice.
    rows = needed.join(sets, "node").select("x", "y", F.col("node").alias("a"), F.col("node").alias("b"), "packed")
    rows = rows.union(placed.select("x", "y", "a", "b", F.lit(None).cast("binary")))
    dealt = rows.repartition(partitions(texts.sparkSession), "x", "y").sortWithinPartitions("x", "y")
    return written(dealt.mapInPandas(released(_similar), "a long, b long"), "near-links")


def _open_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of block pairs (the parities and roots of their nodes) → pairs of nodes with different
    roots that sizes and parities don't rule out."""
    for frame in grouped(batches, ["x", "y"]):
        frame = frame.drop_duplicates(["block", "node"]).sort_values(["block", "n"], ignore_index=True)
        sides = [np.flatnonzero(frame["block"] == k) for k in frame["block"].unique()]
        one, two = sides[0], sides[-1]
        node, root, n = (frame[c].to_numpy(np.int64) for c in ("node", "root", "n"))
        odd = frame["odd"].tolist()
        slots = np.fromiter((8 * len(x) for x in odd), np.int64, len(odd))
        # Parities of each number of slots, of the nodes that have as many or more; sizes that fit are at most one doubling apart.
        folds, row = {}, {}
        for k in np.unique(slots).tolist():
            own = np.flatnonzero((slots == k) | (slots == 2 * k))
            folds[k] = np.stack([_folds(odd[i], k) for i in own])
            row[k] = np.full(len(odd), -1)
            row[k][own] = np.arange(len(own))
        low, high = np.searchsorted(n[two], -(-4 * n[one] // 5), "left"), np.searchsorted(n[two], 5 * n[one] // 4, "right")
        found = [np.empty((0, 2), np.int64)]
        for i, a, b in zip(one.tolist(), low.tolist(), high.tolist()):
            others = two[a:b]
            others = others[(root[others] != root[i]) & ((node[others] > node[i]) | (len(sides) > 1))]
            for k in np.unique(np.minimum(slots[others], slots[i])).tolist():
                j = others[np.minimum(slots[others], slots[i]) == k]
                differ = np.bitwise_count(folds[k][row[k][j]] ^ folds[k][row[k][i]]).sum(axis=1, dtype=np.int64)
                j = j[9 * differ <= n[i] + n[j]]
                found.append(np.stack([np.full(len(j), node[i]), node[j]], axis=1))
        a, b = np.concatenate(found).T
        yield pd.DataFrame({"a": a, "b": b})


def _across(mixed: DataFrame, nodes: DataFrame) -> DataFrame:
    """mixed(h, node, root, n, pos), rows of shingles that several roots share → candidate pairs (a, b) of
    different roots. A shingle of few nodes lists the pairs that sizes and places allow; its rows are bounded."""
    counted = mixed.groupBy("h").agg(F.count("*").alias("rows"))
    cold = mixed.join(counted.where(F.col("rows") <= COMMON), "h")
    listed = cold.alias("a").join(cold.alias("b"), F.expr(f"a.h = b.h and a.node < b.node and a.root <> b.root and {_SIZES} and {_PLACES}"))
    listed = listed.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    return listed.union(_across_blocks(mixed.join(counted.where(F.col("rows") > COMMON), "h").select("h", "node", "root"), nodes))


def _across_blocks(mixed: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same for common shingles, without listing their pairs. Nodes are put in blocks by size; two blocks
    meet if they share a shingle and their sizes can be similar. A block travels as parities, once per pair of blocks."""
    mixed = written(mixed, "near-common")
    rows = written(mixed.select("node", "root").distinct().join(nodes, "node"), "near-open")
    blocks = _blocks(rows.select("node", F.octet_length("odd").alias("bytes"), F.col("n").alias("label")), "near-parity-blocks")
    sizes = rows.select("node", "n").join(blocks, "node").groupBy("block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    touched = written(mixed.join(blocks, "node").select("h", "block").distinct().join(sizes, "block"), "near-touched")
    one, two = (touched.select("h", *[F.col(c).alias(f"{c}_{k}") for c in ("block", "low", "high")]) for k in "xy")
    met = one.join(two, "h").where("block_x <= block_y and 5 * high_x >= 4 * low_y and 5 * high_y >= 4 * low_x")
    met = met.select(F.col("block_x").alias("x"), F.col("block_y").alias("y")).distinct()
    met = met.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    sent = met.join(rows.join(blocks, "node"), "block").select("x", "y", "block", "node", "root", "n", "odd")
    dealt = sent.repartition(partitions(mixed.sparkSession), "x", "y").sortWithinPartitions("x", "y")
    return dealt.mapInPandas(released(_open_pairs), "a long, b long")


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Shingles found in several texts of a sample: the most frequent ones, sorted, and their counts; a bit
    map of all of them and its size."""
    every = max(1, min(EVERY, sets.count() // SAMPLE))
    sample = sets.where(F.pmod(seeded_rank(F.col("node"), 31), F.lit(every)) == 0).select("packed")
    counted = written(sample.mapInPandas(released(_shingles), "h long").groupBy("h").count().where("count > 1"), "near-frequent")
    top = counted.orderBy(F.desc("count"), "h").limit(FREQUENT).toPandas()
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], top["count"].to_numpy(np.int64)[order], *marked(counted, "h")


def near_copy_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's identifier with `component_id`, the smallest identifier reachable over similar texts.

    First the SimHash links and, for each shared shingle of the prefixes, the pairs with its first
    text are confirmed. A group of near copies is mostly connected by them, so that afterwards only
    pairs of texts in different components remain, and all of these are confirmed.

    Defined results: null, empty and wordless texts are equal; a text of fewer words than a shingle
    is one shingle; rows with a null identifier take part.
    """
    named = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    ids = written(named.mapInPandas(released(_nodes), f"doc_id {kind}, {_NODE}"), "near-nodes")
    nodes = ids.select("node", "fp").distinct()
    parities = ids.select("node", "n", "odd").dropDuplicates(["node"])
    texts = ids.select("node", "packed")

    least = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    least = written(least, "near-fingerprints")
    alike = nodes.join(least, "fp").select(F.col("node").alias("a"), F.col("least").alias("b"))
    a, b = (least.select(F.col("fp").alias(c), F.col("least").alias(f"node_{c}")) for c in "ab")
    links = fingerprint_links(least.select("fp")).join(a, "a").join(b, "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

    prefixes = texts.mapInPandas(released(_prefixes(*_frequent(texts))), "h long, node long, n int, pos int")
    dealt = prefixes.repartition(partitions(df.sparkSession), "h").sortWithinPartitions("h", "node")
    shared = written(dealt.mapInPandas(released(_shared), "h long, node long, n int, pos int, first long"), "near-shared")
    stars = shared.select(F.col("node").alias("a"), F.col("first").alias("b"))
    found = _confirmed(texts, parities, alike.union(links).union(stars))

    rooted = shared.drop("first").join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    left = written(rooted.join(mixed.select("h"), "h", "left_semi"), "near-mixed")
    found = found.union(_confirmed(texts, parities, _across(left, parities)))

    roots = components(found)
    held = ids.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    return held.join(held.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`df` without near copies: of each group the row with the smallest identifier stays.

    Rows with a null identifier can't be told apart and stay. Rows that repeat an identifier stay
    or go together.
    """
    dropped = near_copy_groups(df, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(id_col))
    return df.join(dropped.distinct(), id_col, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
