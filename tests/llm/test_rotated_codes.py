"""Nearest vectors by one-bit codes against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from litweave.llm import rotated_codes
from litweave.llm.queries import QUERIES


def brute(rows, every, k):
    rows = {(i, tuple(float(x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for i, q in rows:
        if i % every:
            continue
        near = []
        for j, v in rows:
            if j != i and len(v) == len(q):
                a, b = np.array(q) / np.abs(q).max(), np.array(v) / np.abs(v).max()
                near.append((-round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 14), j))
        out += [(i, r, j, round(-s, 9)) for r, (s, j) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


def found(spark, rows, every=5, k=5, kind="float"):
    schema = f"vec_id long, embedding array<{kind}>, entry int, ids string, best int"
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], schema)
    got = rotated_codes.neighbours(df, F.col("vec_id") % every == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((q, r, v, round(s, 9)) for q, r, v, s in got.collect())


def vectors(seed, n, width, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    return (centres[rng.integers(6, size=n)] + spread * rng.normal(size=(n, width))).astype(np.float32)


@pytest.mark.parametrize("parts", ["1", "6"])
def test_neighbours_match_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(rotated_codes, "QUERY_BYTES", 2000)
    rows = list(enumerate(vectors(1, 400, 24).astype(float).tolist()))
    rows += [(1000 + k, rows[k % 3][1]) for k in range(60)]  # ties of equal vectors, queries among them
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert found(spark, rows) == brute(rows, 5, 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (5, [0.0, 0.0]), (10, None), (15, []), (20, [nan, 1.0]), (25, [inf, 1.0]), (30, [None, 1.0]), (None, [1.0, 1.0])]
    rows += [(35, [-1.0, 0.5]), (36, [-0.0, 3.0]), (37, [0.0, 3.0]), (38, [1.0, 0.0, 0.0]), (40, [0.5, 0.5, 1.0]), (45, [7.0] * 300), (41, [1e-30, 2e-30]), (42, [1e30, -1e30])]
    assert found(spark, rows) == brute(rows, 5, 5)
    big = [(0, [1e300, 1e290]), (1, [1e-300, 3e-300]), (2, [-1e300, 1e300]), (3, [1.0, 1.0])]
    assert found(spark, big, kind="double") == brute(big, 5, 5)
    assert found(spark, [(3, [1.0])]) == found(spark, [(5, [1.0])]) == found(spark, []) == []


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=32)
    rows = [(k, (base + 1e-3 * rng.normal(size=32)).astype(np.float32).astype(float).tolist()) for k in range(300)]
    rows += [(300 + k, v) for k, v in enumerate(vectors(4, 200, 32).astype(float).tolist())]
    assert found(spark, rows) == brute(rows, 5, 5)


def test_recall_and_what_is_compared():
    """Estimates stay within their bounds, and most vectors are ruled out by their codes."""
    data, asked = vectors(5, 6000, 64, 1.0), vectors(6, 100, 64, 1.0)
    code, scale = rotated_codes.codes(pd.Series(list(data)))
    queries = rotated_codes.Queries(pd.Series(list(asked)))
    about, error = queries.estimates(slice(None), code, scale)
    unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (asked.astype(float), data.astype(float))]
    true = unit[0] @ unit[1].T
    assert (np.abs(true - about) <= error).mean() > 0.9998
    best = rotated_codes.Nearest(queries, 5)
    best.add(pd.DataFrame({"embedding": list(data), "ids": [np.array([i]) for i in range(len(data))], "scale": scale, "code": [c.tobytes() for c in code]}))
    want = np.argsort(-true, axis=1)[:, :5]
    got = best.ids.reshape(100, 5)
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(got, want)]) > 0.99
    assert best.exact < 0.25 * true.size


def test_query_of_the_given_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = sorted((q, r, v, round(s, 9)) for q, r, v, s in QUERIES["op11_nearest_vectors"](spark, "/root/testdata/sf0.001").collect())
    assert got == brute(rows, 50, 5)
