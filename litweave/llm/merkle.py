"""A Merkle manifest of a dataset, and proofs by octopus multiproof."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litweave.functions.batches import grouped

from .common import partitions, placed, written

#: Children of a node.
FAN = 16
#: Leaves of one leaf partition: neighbours in the order of the manifest, whichever tree they are in.
PART = 4096
#: The tree over the sources' roots; sources count from 0.
TOP = -1
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

_NODES = "tree long, level int, idx long, total long, digest string"


def _h(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column, kind: T.DataType) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value if isinstance(kind, T.StringType) else value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(df: DataFrame, fields: list[str], **instead: Column) -> Column:
    """Digest of a row; `instead` gives other values for some fields."""
    return F.sha2(F.concat(*[field(instead.get(c, F.col(f"`{c}`")), df.schema[c].dataType) for c in fields]), 256)


def tampered_text(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _level(level: int) -> Column:
    """Nodes of a level of a tree with `total` leaves."""
    return F.ceil(F.col("total") / F.lit(FAN**level)).cast("long")


def tree_nodes(leaves: DataFrame, largest: int, name: str) -> DataFrame:
    """leaves(tree, idx, total, digest) → the nodes above them (tree, level, idx, total, digest).

    `largest` is the size of the largest tree. A round takes two levels, 256 children at most to a
    group, and its nodes are written for the next; the number of rounds is a logarithm.
    """
    now, out, level = leaves.select("tree", F.lit(0).alias("level"), "idx", "total", "digest"), None, 0
    while FAN**level < largest:
        active = now.where(F.col("level") == level).where(_level(level) > 1)
        groups = active.groupBy("tree", "total", F.floor(F.col("idx") / FAN**2).cast("long").alias("idx")).agg(
            F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("met")
        )
        runs = F.transform(
            F.sequence(F.lit(0), F.ceil(F.size("met") / FAN).cast("int") - 1),
            lambda i: F.sha2(F.array_join(F.slice(F.col("met.digest"), i * FAN + 1, F.lit(FAN)), ""), 256),
        )
        groups = groups.withColumn("runs", runs)
        one = groups.select("tree", F.lit(level + 1).alias("level"), "idx", "total", F.posexplode("runs").alias("k", "digest"))
        one = one.select("tree", "level", (F.col("idx") * FAN + F.col("k")).alias("idx"), "total", "digest")
        two = groups.where(_level(level + 1) > 1).select(
            "tree", F.lit(level + 2).alias("level"), "idx", "total", F.sha2(F.array_join("runs", ""), 256).alias("digest")
        )
        now = written(one.union(two), name)
        out, level = now if out is None else out.union(now), level + 2
    return leaves.sparkSession.createDataFrame([], _NODES) if out is None else out


class Manifest:
    """`leaves` (tree, idx, total, digest, at and the rows' other columns), `nodes` of all trees, leaves
    included (tree, level, idx, total, digest), `sources` (tree, key) and `root`; no rows, no root."""

    def __init__(self, rows: DataFrame, key: str, order: list[str]) -> None:
        """rows(key, order…, digest): a tree for each key, ascending by `order`; the trees' roots in the
        keys' order are the leaves of the tree TOP. Keys are not null."""
        met = placed(rows, [key], [*order, "digest"])
        met = written(met, "manifest-places")
        keys = met.groupBy(key).agg(F.max("total").alias("size")).withColumn("one", F.lit(0))
        keys = written(placed(keys, ["one"], [key]).select(F.col(key).alias("_key"), "size", F.col("pos").alias("tree"), F.col("total").alias("trees")), "manifest-trees")
        # A key may hold a third of all leaves: Spark splits such a partition of the join.
        self.leaves = written(met.join(keys.drop("size", "trees"), met[key] == keys["_key"]).drop("_key").withColumnRenamed("pos", "idx"), "manifest-leaves")
        largest, trees = keys.agg(F.max("size"), F.max("trees")).first()
        base = self.leaves.select("tree", F.lit(0).alias("level"), "idx", "total", "digest")
        inner = tree_nodes(self.leaves, largest or 0, "manifest-nodes")
        tops = base.union(inner).where("idx = 0").where(F.expr(f"total <= power({FAN}, level) and (level = 0 or total > power({FAN}, level - 1))"))
        subroots = tops.select("tree", "digest").join(keys.select("tree", "trees"), "tree")
        subroots = written(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("trees").alias("total"), "digest"), "manifest-subroots")
        upper = tree_nodes(subroots, trees or 0, "manifest-top")
        self.nodes = base.union(inner).union(subroots.select("tree", F.lit(0).alias("level"), "idx", "total", "digest")).union(upper)
        top = subroots.select(F.lit(0).alias("level"), "total", "digest").union(upper.select("level", "total", "digest"))
        found = top.where(F.expr(f"total <= power({FAN}, level)")).orderBy("level").first()
        self.sources, self.root, self.trees = keys, found and found["digest"], trees or 0


def _runs(tree: np.ndarray, idx: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
    """Parents of nodes sorted by (tree, idx): tree, idx of the parent, its level's size, and where
    its known children begin."""
    up = idx // FAN
    begin = np.flatnonzero(np.append(True, (tree[1:] != tree[:-1]) | (up[1:] != up[:-1])))
    return tree[begin], up[begin], -(-total[begin] // FAN), begin


def missing(tree: np.ndarray, idx: np.ndarray, total: np.ndarray, trees: int) -> pd.DataFrame:
    """Coordinates (tree, level, idx) that, beside the given leaves, are needed to derive the root:
    the smallest such set. Leaves are sorted by (tree, idx) and each is given once.

    Level by level, of each run with a known node the others are needed, and its parent is known. A tree that has
    shrunk to one node gives a leaf of the tree over all trees.
    """
    out, tops, level = [], [], 0

    def needed(tree, idx, total, level):
        run = idx // FAN * FAN
        first = np.flatnonzero(np.append(True, (tree[1:] != tree[:-1]) | (run[1:] != run[:-1])))
        t, start, size = tree[first], run[first], np.minimum(FAN, total[first] - run[first])
        t, start = np.repeat(t, size), np.repeat(start, size)
        place = start + np.arange(len(start)) - np.repeat(np.cumsum(size) - size, size)
        wanted = pd.MultiIndex.from_arrays([t, place]).difference(pd.MultiIndex.from_arrays([tree, idx]), sort=False)
        if len(wanted):
            out.append(pd.DataFrame({"tree": wanted.get_level_values(0), "level": level, "idx": wanted.get_level_values(1)}))

    while len(tree):
        done = total == 1
        tops.append(tree[done])
        tree, idx, total = tree[~done], idx[~done], total[~done]
        if len(tree):
            needed(tree, idx, total, level)
            tree, idx, total, _ = _runs(tree, idx, total)
        level += 1
    idx, level = np.unique(np.concatenate(tops)), 0
    tree, total = np.full(len(idx), TOP), np.full(len(idx), trees)
    while len(idx) and total[0] > 1:
        needed(tree, idx, total, level)
        tree, idx, total, _ = _runs(tree, idx, total)
        level += 1
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"tree": [], "level": [], "idx": []}, dtype=np.int64)


def _coordinates(trees: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Leaves sorted by leaf partition → the coordinates each partition has to fetch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in grouped(batches, ["part"]):
            frame = frame.sort_values(["tree", "idx"]).drop_duplicates(["tree", "idx"])
            found = missing(*(frame[c].to_numpy(np.int64) for c in ("tree", "idx", "total")), trees)
            yield found.assign(part=frame["part"].iloc[0])[["part", "tree", "level", "idx"]]

    return run


class _Part:
    """What one leaf partition knows: its leaves and the nodes it fetched."""

    def __init__(self, known: dict[tuple[int, int, int], str], trees: int) -> None:
        self.known, self.trees = known, trees
        self.widths: dict[int, list[int]] = {}
        self.above: dict[tuple[int, int, int], tuple[str, str]] = {}

    def run(self, tree: int, level: int, idx: int) -> list[str]:
        """Digests of the run that holds a node."""
        first = idx // FAN * FAN
        return [self.digest(tree, level, k) for k in range(first, min(first + FAN, self.widths[tree][level]))]

    def digest(self, tree: int, level: int, idx: int) -> str:
        """A node's digest, derived once if it was not fetched."""
        found = self.known.get((tree, level, idx))
        if found is None:
            found = self.known[tree, level, idx] = _h(self.run(tree, level - 1, idx * FAN))
        return found

    def prepare(self, totals: dict[int, int]) -> None:
        """Sizes of all levels, then the roots of the trees that the partition knows leaves of."""
        for tree, total in [*totals.items(), (TOP, self.trees)]:
            widths = [total]
            while widths[-1] > 1:
                widths.append(-(-widths[-1] // FAN))
            self.widths[tree] = widths
        for tree in totals:
            top = len(self.widths[tree]) - 1
            self.known[TOP, 0, tree] = self.digest(tree, top, 0)

    def proof(self, tree: int, level: int, idx: int) -> tuple[str, str]:
        """Siblings from a node up to the root, left to right, as one text; and the root that the
        node's own digest folds to. Nodes of a run share what is above it."""
        found = self.above.get((tree, level, idx))
        if found is None:
            widths = self.widths[tree]
            if level + 1 == len(widths):
                found = ("", self.digest(tree, level, 0)) if tree == TOP else self.proof(TOP, 0, tree)
            else:
                run = self.run(tree, level, idx)
                upper, root = self.proof(tree, level + 1, idx // FAN)
                own = idx % FAN
                found = "".join(run[:own] + run[own + 1 :]) + upper, root
            if level:
                self.above[tree, level, idx] = found
        return found

    def fold(self, tree: int, idx: int, digest: str) -> str:
        """The root from a leaf's other digest and the original siblings."""
        for tree, idx in ((tree, idx), (TOP, tree)):
            for level in range(len(self.widths[tree]) - 1):
                run = self.run(tree, level, idx)
                run[idx % FAN] = digest
                digest, idx = _h(run), idx // FAN
        return digest


_PROOFS = "name string, leaf string, subroot string, proof string, folded string"


def _proofs(trees: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows sorted by leaf partition, its own leaves and what it fetched → proofs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in grouped(batches, ["part"]):
            keys = zip(frame["tree"].tolist(), frame["level"].tolist(), frame["idx"].tolist())
            part = _Part(dict(zip(keys, frame["digest"].tolist())), trees)
            own = frame[frame["own"]]
            part.prepare(dict(zip(own["tree"].tolist(), own["total"].tolist())))
            rows = []
            for name, tree, idx, digest, other in zip(own["name"], own["tree"].tolist(), own["idx"].tolist(), own["digest"], own["other"]):
                proof, folded = part.proof(tree, 0, idx)
                if isinstance(other, str):
                    folded = part.fold(tree, idx, other)
                rows.append((name, digest, part.known[TOP, 0, tree], hashlib.sha256(proof.encode()).hexdigest(), folded))
            yield pd.DataFrame(rows, columns=["name", "leaf", "subroot", "proof", "folded"])

    return run


def proofs(manifest: Manifest, wanted: DataFrame) -> DataFrame:
    """wanted(name, at, tree, idx, total, digest, other): some of the manifest's leaves, `other` a
    digest to fold instead of the leaf's own or null → (name, leaf, subroot, proof, folded), `proof` the digest of the
    siblings from the leaf to the root.

    Each leaf partition of PART neighbours computes the smallest set of coordinates it lacks, these are
    fetched by one join for all partitions, and the partition derives the shared interior nodes once and expands the
    proofs of its leaves.
    """
    n = partitions(wanted.sparkSession)
    dealt = wanted.withColumn("part", F.expr(f"at div {PART}"))
    slim = dealt.select("part", "tree", "idx", "total").repartition(n, "part").sortWithinPartitions("part")
    lacking = slim.mapInPandas(_coordinates(manifest.trees), "part long, tree long, level int, idx long")
    fetched = written(lacking, "coordinates").join(manifest.nodes.drop("total"), ["tree", "level", "idx"])
    zero, none = F.lit(0), F.lit(None).cast("string")
    own = dealt.select("part", "tree", zero.alias("level"), "idx", "digest", F.lit(True).alias("own"), "total", "name", "other")
    met = fetched.select("part", "tree", "level", "idx", "digest", F.lit(False), zero.cast("long"), none, none)
    both = own.union(met).repartition(n, "part").sortWithinPartitions("part")
    return both.mapInPandas(_proofs(manifest.trees), _PROOFS)


def verified(df: DataFrame, tampered: Column, fields: list[str] | None = None) -> DataFrame:
    """documents → (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified); where `tampered`
    holds, the text is lower-cased (A-Z) after the manifest was made.

    Defined results: a null source comes before the empty one and is a tree like any other; null identifiers come
    first; rows with the same identifier are ordered by their digest, and a row repeated whole is as many leaves; null or
    empty texts are not changed by tampering, so they are verified; other columns are not read; an empty table gives no rows.
    """
    fields = fields or FIELDS
    text = F.when(tampered, tampered_text(F.col("text"))).otherwise(F.col("text"))
    rows = df.select(
        F.col("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key"),
        leaf(df, fields).alias("digest"), F.when(text != F.col("text"), leaf(df, fields, text=text)).alias("other"),
    )
    manifest = Manifest(written(rows, "leaves"), "key", ["doc_id"])
    wanted = manifest.leaves.select(F.col("doc_id").cast("string").alias("name"), "at", "tree", "idx", "total", "digest", "other")
    root = F.lit(manifest.root).cast("string")
    return proofs(manifest, wanted).select(
        F.col("name").cast(df.schema["doc_id"].dataType).alias("doc_id"), "leaf", "subroot", root.alias("root"),
        F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"),
    )
