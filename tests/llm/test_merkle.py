"""The Merkle manifest, its proofs and the smallest sets of coordinates against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from litweave.llm import merkle
from litweave.llm.queries import QUERIES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, digest string, part int, at string"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return h(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def climb(tree, idx, digest):
    """Siblings up to the top of a tree, and what `digest` folds to."""
    proof = []
    for nodes in tree[:-1]:
        first = idx // 16 * 16
        before, after = nodes[first:idx], nodes[idx + 1 : first + 16]
        proof += before + after
        digest, idx = h([*before, digest, *after]), idx // 16
    return proof, digest


def brute_verified(rows):
    def order(row):
        return row[0] is not None, row[0] or 0, brute_leaf(row)

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted([r for r in rows if r[1] == s], key=order) for s in sources}
    trees = {s: levels([brute_leaf(r) for r in own[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, row in enumerate(own[s]):
            other = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                other = (*row[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4]))
            low, digest = climb(trees[s], i, brute_leaf(other))
            high, digest = climb(top, k, digest)
            root = top[-1][0]
            out.append((row[0], brute_leaf(row), trees[s][-1][0], root, h(low + high), digest, digest == root))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 5, "x", 6, "y") for r in rows], SCHEMA)
    out = merkle.verified(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("parts,size", [("1", 4096), ("5", 7)])
def test_proofs_match_brute_force(spark, monkeypatch, parts, size):
    rng = random.Random(3)
    sizes = {"hot": 300, None: 17, "": 1, "b": 16, "é": 2, "Z": 33, "a" * 200: 5} | {f"s{k}": 1 for k in range(20)}
    rows = [(rng.randrange(-(10**17), 10**17), s, rng.choice(["en", None]), k, rng.choice([None, "", "Text É A", "plain", "A" * 50_000])) for s, n in sizes.items() for k in range(n)]
    rows += [(None, "hot", None, None, None), (None, "b", None, None, "A")] + [(7, "hot", "x", 1, "Same")] * 20 + [(7, "hot", "x", 1, "other")]
    rng.shuffle(rows)
    monkeypatch.setattr(merkle, "PART", size)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert found(spark, rows) == brute_verified(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_small_manifests(spark):
    for rows in ([], [(1, None, None, None, None)], [(k, "one", "en", 1, "A") for k in range(17)]):
        assert found(spark, rows) == brute_verified(rows)


def test_coordinates_are_the_smallest_set():
    rng = random.Random(5)
    for _ in range(30):
        sizes = [rng.choice([1, 2, 16, 17, 300, 5000]) for _ in range(rng.randrange(1, 40))]
        leaves = sorted({(t, rng.randrange(sizes[t])) for t in rng.choices(range(len(sizes)), k=30)})
        want, known, top = set(), {}, set()
        for t, i in leaves:
            known.setdefault(t, set()).add(i)

        def climb_all(tree, have, size):
            level = 0
            while size > 1:
                for k in {i // 16 for i in have}:
                    want.update((tree, level, j) for j in range(16 * k, min(16 * k + 16, size)) if j not in have)
                have, size, level = {i // 16 for i in have}, -(-size // 16), level + 1

        for t, have in known.items():
            climb_all(t, have, sizes[t])
            top.add(t)
        climb_all(merkle.TOP, top, len(sizes))
        tree, idx = np.array(leaves).T
        got = merkle.missing(tree, idx, np.array(sizes)[tree], len(sizes))
        got = list(zip(got["tree"].astype(int), got["level"].astype(int), got["idx"].astype(int)))
        assert len(got) == len(set(got)) and set(got) == want


def test_proofs_of_some_leaves(spark):
    rows = [(k, f"s{k % 3}", "en", k, f"T{k}") for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    manifest = merkle.Manifest(df.select("doc_id", F.col("source").alias("key"), merkle.leaf(df, merkle.FIELDS).alias("digest")), "key", ["doc_id"])
    wanted = manifest.leaves.where("doc_id in (3, 4, 250, 499)")
    wanted = wanted.select(F.col("doc_id").cast("string").alias("name"), "at", "tree", "idx", "total", "digest", F.lit(None).cast("string").alias("other"))
    got = {int(r["name"]): (r["proof"], r["folded"] == manifest.root) for r in merkle.proofs(manifest, wanted).collect()}
    want = {r[0]: r[4] for r in brute_verified(rows)}
    assert got == {i: (want[i], True) for i in (3, 4, 250, 499)}


def test_query_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*merkle.FIELDS).collect()
    got = sorted(map(tuple, QUERIES["op13_merkle_manifest"](spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute_verified([tuple(r) for r in docs])
