"""The prefix trie of conversations, aggregated by ROLLUP over positional columns of turn ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, placed, written

#: Positions of one column block, one column each.
WIDTH = 16
#: Hex digits of a turn id that are a digest; the other eight are the number of words of its text.
DIGEST = 24
#: Blocks of one conversation that are summed in one task; their sums are summed again.
STRETCH = 1024
#: Turns that a rebuilt conversation may take from the first of its group, and the group's size.
SHARED, GROUP = 3, 20
#: Identifiers that travel as one piece to the digest of a node's ends.
PIECE = 1024

_WORD = "[^\\x20\\x09-\\x0D]+"
_COLUMNS = [f"t{k}" for k in range(WIDTH)]
_SUM = "decimal(38,0)"


def turn_id(role: Column, text: Column) -> Column:
    """12 bytes of a digest of (role, text) and 4 of the number of words: equal for equal turns."""
    role, text = (F.coalesce(c, F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    count = F.lpad(F.hex(F.regexp_count(text, F.lit(_WORD)).cast("long")), 8, "0")
    return F.unhex(F.concat(F.substring(digest, 1, DIGEST), count))


def word_count(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, DIGEST // 2 + 1, 4)), 16, 10).cast("long")


def turns(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) → (conv_id, pos, t), turns numbered in order."""
    slim = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_id(F.col("role"), F.col("text")).alias("t")
    )
    return placed(written(slim, "turns"), ["conv_id"], ["turn", "t"]).select("conv_id", "pos", "t")


def rebuilt(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns → those of the rebuilt conversations (conv_id, pos, t), and the conversations
    without any (conv_id).

    A conversation c takes the first h turns of conversation c - c % 20 and goes on with its own after
    the first h, with h = crc32(c) % 4.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1)).alias("h")
    sizes = ordered.groupBy("conv_id").agg(F.count("*").alias("n"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    sizes = sizes.select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    k = F.least("h", F.coalesce("n_base", F.lit(0))).alias("k")
    sizes = written(sizes.join(bases, "base", "left").select("conv_id", "base", "n", "h", k), "conversations")
    heads = ordered.where((F.col("pos") < SHARED) & (F.col("conv_id") % GROUP == 0))
    taken = sizes.join(heads.withColumnRenamed("conv_id", "base"), "base").where("pos < k").select("conv_id", "pos", "t")
    own = ordered.join(sizes.select("conv_id", "h", "k"), "conv_id").where("pos >= h")
    own = own.select("conv_id", F.expr("pos - h + k").alias("pos"), "t")
    return taken.union(own), sizes.where("k = 0 and n <= h").select("conv_id")


def _link(block: Column, path: Column) -> Column:
    """What a full block adds to the identity of the nodes beyond it."""
    text = F.concat_ws(",", block.cast("string"), F.transform(path, F.hex))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast(_SUM) * F.lit(1 << 48).cast("decimal(15,0)") + F.conv(
        F.substring(F.sha2(text, 256), 13, 12), 16, 10
    ).cast(_SUM)


def members(turn_rows: DataFrame, turnless: DataFrame) -> DataFrame:
    """Turns (conv_id, pos, t) → a row per conversation and block of columns: `prior` stands for the
    node that the blocks before lead to and `before` for its words; `path` holds the block's turn ids, `len`
    and `total` the conversation's turns and words. `prior` is a sum of digests over those blocks, so all blocks are made
    at once, and sums of long conversations are put together from stretches."""
    block = F.floor(F.col("pos") / WIDTH).cast("long").alias("block")
    met = turn_rows.groupBy("conv_id", block).agg(F.sort_array(F.collect_list(F.struct("pos", "t"))).alias("met"))
    path = met.select("conv_id", "block", F.col("met.t").alias("path"))
    counted = F.aggregate(F.transform("path", word_count), F.lit(0).cast("long"), lambda s, x: s + x)
    own = path.withColumns({"words": counted, "link": _link(F.col("block"), F.col("path")).cast(_SUM), "stretch": F.floor(F.col("block") / STRETCH)})
    own = written(own, "turn-blocks")

    def before(name: str, window: W) -> Column:
        return F.coalesce(F.sum(name).over(window.rowsBetween(W.unboundedPreceding, -1)).cast(_SUM if name.startswith("link") else "long"), F.lit(0))

    every = W.partitionBy("conv_id")
    sums = own.groupBy("conv_id", "stretch").agg(
        F.sum("words").alias("words_s"), F.sum("link").cast(_SUM).alias("link_s"), F.sum(F.size("path")).alias("size_s")
    )
    stretches = sums.select(
        "conv_id", "stretch", before("words_s", every.orderBy("stretch")).alias("words_0"), before("link_s", every.orderBy("stretch")).alias("link_0"),
        F.sum("words_s").over(every).alias("total"), F.sum("size_s").over(every).alias("len"),
    )
    inside = W.partitionBy("conv_id", "stretch").orderBy("block")
    rows = own.withColumns({"words_i": before("words", inside), "link_i": before("link", inside)}).join(stretches, ["conv_id", "stretch"])
    rows = rows.select(
        "conv_id", "block", (F.col("link_0") + F.col("link_i")).cast(_SUM).alias("prior"), (F.col("words_0") + F.col("words_i")).alias("before"),
        "path", "len", "total",
    )
    zero = F.lit(0).cast("long")
    empty = turnless.select("conv_id", zero, F.lit(0).cast(_SUM), zero, F.array().cast("array<binary>"), zero, zero)
    return written(rows.union(empty), "members")


def _rollup(rows: DataFrame, aggregates: str) -> DataFrame:
    """`aggregates` over the members of every node: ROLLUP over the positional columns of a block,
    keyed by the node before it. Levels beyond the end of a path, and those that repeat the last level of the
    block before, are left out before rows are put together."""
    columns = ", ".join(_COLUMNS)
    level = f"{WIDTH} - bit_count(grouping_id())"
    filled = " + ".join(f"int({c} is not null)" for c in _COLUMNS)
    wide = rows.select("*", *[F.get("path", F.lit(k)).alias(c) for k, c in enumerate(_COLUMNS)])
    found = rows.sparkSession.sql(
        f"SELECT block, prior, {columns}, max(before) AS before, {aggregates} FROM {{wide}} "
        f"GROUP BY block, prior, ROLLUP ({columns}) HAVING {filled} = {level} AND ({level} > 0 OR block = 0)",
        wide=wide,
    )
    found = found.withColumn("path", F.filter(F.array(*_COLUMNS), lambda x: x.isNotNull())).drop(*_COLUMNS)
    words = F.aggregate(F.transform("path", word_count), F.col("before"), lambda s, x: s + x)
    last = F.coalesce(word_count(F.get("path", F.size("path") - 1)), F.lit(0))
    return found.withColumns({"depth": F.col("block") * WIDTH + F.size("path"), "before": words - last})


def _node(block: Column, prior: Column, path: Column) -> Column:
    """Identity of a node; the last one of a block is named as the one before the next."""
    full = F.size(path) == WIDTH
    place = F.when(full, prior + _link(block, path)).otherwise(prior).cast(_SUM)
    rest = F.when(full, F.array().cast("array<string>")).otherwise(F.transform(path, F.hex))
    text = F.concat_ws(",", F.when(full, block + 1).otherwise(block).cast("string"), place.cast("string"), rest)
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by node and identifier → pieces of the text that lists a node's identifiers."""
    for batch in batches:
        node, ids = batch["node"].to_numpy(), batch["conv_id"].to_numpy()
        cuts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(batch)]
        rows = [
            (node[i], ids[i], ",".join(map(str, ids[i : min(b, i + PIECE)].tolist())))
            for a, b in zip(cuts[:-1], cuts[1:])
            for i in range(a, b, PIECE)
        ]
        yield pd.DataFrame(rows, columns=["node", "first", "piece"])


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces sorted by node and identifier → SHA-256 of each node's list, a piece at a time."""
    now, state = None, None
    for batch in batches:
        done = []
        for node, piece in zip(batch["node"], batch["piece"]):
            if node != now:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = node, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.encode())
        yield pd.DataFrame(done, columns=["node", "ends_sha256"])
    if now is not None:
        yield pd.DataFrame([(now, state.hexdigest())], columns=["node", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """ends(node, conv_id) → (node, ends_sha256). A node may be the end of a third of all
    conversations, so its identifiers are sorted over many tasks and arrive as pieces in order."""
    n = partitions(ends.sparkSession)
    dealt = ends.repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = dealt.mapInPandas(_pieces, "node binary, first long, piece string")
    sorted_pieces = pieces.repartition(n, "node").sortWithinPartitions("node", "first")
    return sorted_pieces.mapInPandas(_hashed, "node binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) → one row per node of the prefix trie of the rebuilt
    conversations.

    The smallest member of a node owns it, and with it the rest of its own path. So a first ROLLUP
    finds the owners, and a second one sums what every member owns: distinct words and leaves are
    counted once although paths share nodes.

    Defined results: rows with a null conv_id belong to no conversation; null turns come first, equal turns
    (repeated rows too) are ordered by the digest of role and text; null role or text is the empty string; a conversation
    whose rebuilt form has no turn is a member of the root only; an empty table gives no rows. Other columns are not read.
    """
    rows = members(*rebuilt(turns(conversations)))
    first = _rollup(rows, "min(conv_id) AS conv_id, max(len) AS longest")
    owned = first.groupBy("conv_id").agg(
        F.min("depth").alias("own_from"), F.min("before").alias("q"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf")
    )
    owned = written(owned, "owners")
    zero = F.lit(0).cast("long")
    weighed = rows.join(owned, "conv_id", "left").withColumns(
        {"own": F.coalesce(F.col("total") - F.col("q"), zero), "leaf": F.coalesce("leaf", zero)}
    )
    nodes = _rollup(
        weighed, "min(conv_id) AS conv_id, count(*) AS n_convs, sum(total) AS total, sum(own) AS own, sum(leaf) AS n_leaves"
    ).join(owned.select("conv_id", "q"), "conv_id")
    path, node = F.col("path"), _node(F.col("block"), F.col("prior"), F.col("path"))
    parent = _node(F.col("block"), F.col("prior"), F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))))
    nodes = written(
        nodes.select(
            node.alias("node"), F.when(F.size(path) > 0, parent).alias("parent"), "conv_id", "depth", "n_convs", "n_leaves",
            F.expr("total - n_convs * before - own - q + before").alias("saved_tokens"),
        ),
        "trie-nodes",
    )
    children = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children"))
    children = children.withColumnRenamed("parent", "node")
    ends = rows.where(F.col("block") * WIDTH + F.size("path") == F.col("len")).select(node.alias("node"), "conv_id")
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(children, "node", "left").join(end_digests(ends), "node", "left").join(parents, "parent", "left")
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256"),
    )
