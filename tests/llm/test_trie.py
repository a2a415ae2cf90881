"""The prefix trie of conversations against brute force."""

import hashlib
import random
import zlib

import pytest

from litweave.llm import conversation_trie
from litweave.llm.conversation_trie import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, node string, path string, block int"


def digest(turn):
    role, text = (x.encode() for x in turn)
    return hashlib.sha256(str(len(role)).encode() + b":" + role + text).digest()[:12]


def brute_trie(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [r[2] for r in sorted(t, key=lambda r: (r[0], r[1], digest(r[2])))] for c, t in own.items()}
    paths = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rest = abs(c) % 20
        paths[c] = tuple(own.get(c - rest if c >= 0 else c + rest, [])[:h] + t[h:])
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        words = len(p[-1][1].encode().split()) if p else 0
        saved[p] = (len(nodes[p]) - 1) * words + sum(saved[k] for k in kids.get(p, []))
    return sorted(
        (
            min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if paths[c] == p).encode()).hexdigest(),
        )
        for p, m in nodes.items()
    )


def found(spark, rows):
    df = spark.createDataFrame([(*r, "n", "p", 1) for r in rows], SCHEMA)
    out = trie(df)
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()))


def conversations(seed, n, words=3, longest=7):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for k in range(rng.randrange(1, longest)):
            rows.append((c, k, rng.choice(["user", "assistant"]), " ".join(rng.choice("ab") for _ in range(rng.randrange(words)))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", ["1", "7"])
def test_nodes_match_brute_force(spark, parts):
    rows = conversations(1, 130)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert found(spark, rows) == brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_long_conversations_go_on_in_further_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "STRETCH", 2)
    rng = random.Random(2)
    long = [("user", f"w{k} x") for k in range(150)]
    rows = []
    for c, n in enumerate([16, 32, 48, 150, 150, 33, 17, 15, 1, 64, 100]):
        cut = rng.randrange(n + 1)
        path = long[:cut] + [("user", f"{c % 3} y")] * (n - cut)
        rows += [(c, k, *t) for k, t in enumerate(path)]
    rows += [(c, k, *t) for c in (40, 41, 43, 60, 63) for k, t in enumerate(long[: 32 + c % 2 * 64])]
    assert found(spark, rows) == brute_trie(rows)


def test_awkward_rows(spark):
    rows = [(None, 0, "user", "lost"), (3, 0, "user", "one turn"), (-7, 1, "a", "x"), (-7, None, "a", "first"), (-20, 0, "b", "base")]
    rows += [(20, 0, None, None), (20, 0, None, None), (21, 0, "", ""), (22, 5, "", None), (22, 5, None, ""), (22, 5, "user", "tie"), (22, 5, "user", "eit")]
    rows += [(c, 0, "user", "very long " * 40_000) for c in (40, 41, 45)] + [(c, k, "user", "copy   of\x0bwords") for c in range(60, 110) for k in range(3)]
    assert found(spark, rows) == brute_trie(rows)
    # turnless: alone in the root, whose list of ends names it
    turnless = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 1)
    assert found(spark, [(turnless, 0, "user", "gone")]) == brute_trie([(turnless, 0, "user", "gone")])
    assert found(spark, []) == []


def test_ends_of_a_node_arrive_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 3)
    rows = [(c, k, "user", "same") for c in range(0, 300) for k in range(4)]
    assert found(spark, rows) == brute_trie(rows)
