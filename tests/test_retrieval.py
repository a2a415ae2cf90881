import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from litweave import schema
from litweave.operators import vectors as V
from litweave.operators.bm25 import bm25, term_statistics
from litweave.operators.candidates import (
    chunk_pool, expand_topics, leading_chunks, merge_candidates, named_papers, paper_rollup, topic_candidates,
)
from litweave.operators.fusion import fuse, fused_order, hybrid_search, mixed_search, paper_filter, rag_query
from litweave.operators.ranking import rank_all, top_n

CHUNK = "chunk_id string, paper_id string, text string, title string, year int, source string, section string, page int, start_page int, chunk_index int"


def chunks(spark, rows):
    """rows: (paper_id, chunk_index, text[, year])"""
    full = [
        (f"{p}_{i}", p, t, f"T {p}", (y[0] if y else 2020), "s", "_front", 0, 0, i)
        for p, i, t, *y in rows
    ]
    return spark.createDataFrame(full, CHUNK)


def queries(spark, rows, ddl="query_id string, text string"):
    return spark.createDataFrame(rows, ddl)


def plain_bm25(corpus, query, n):
    """Scores by the textbook formula; corpus: [(chunk_id, text)] in corpus order."""
    docs = [re.findall("[A-Za-z0-9]+", t) for _, t in corpus]
    docs = [[w.lower() for w in d] for d in docs]
    size = len(docs)
    avg = sum(map(len, docs)) / size
    df = {}
    for d in docs:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(size - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(idf.values()) / len(idf) if idf else 0
    idf = {w: (0.25 * mean if v < 0 else v) for w, v in idf.items()}
    scored = []
    for (cid, _), d in zip(corpus, docs):
        s = 0.0
        for w in (x.lower() for x in re.findall("[A-Za-z0-9]+", query)):
            tf = d.count(w)
            if tf:
                s += idf[w] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avg))
        scored.append((cid, s))
    order = sorted(range(size), key=lambda i: (-round(scored[i][1], 9), i))
    return [scored[i] for i in order[:n]]


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    return out


def assert_same(got, want):
    assert [c for c, _ in got] == [c for c, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want])


@pytest.mark.parametrize("seed,vocabulary", [(1, 30), (2, 4), (3, 2), (4, 300)])
def test_bm25_matches_the_formula(spark, seed, vocabulary):
    """Small vocabularies give negative idf, negative means and ties."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    rows = [
        (f"p{d:02d}", i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))))
        for d in range(8)
        for i in range(rng.randint(1, 5))
    ]
    qs = [(f"q{k}", " ".join(rng.choice(words + ["zzz"]) for _ in range(rng.randint(1, 6)))) for k in range(12)]
    qs.append(("none", "unknown words only"))
    store = chunks(spark, rows)
    corpus = [(f"{p}_{i}", t) for p, i, t in rows]
    for n in (3, None):
        got = ranked(bm25(store, queries(spark, qs), n))
        for qid, text in qs:
            assert_same(got[qid], plain_bm25(corpus, text, n or len(corpus)))


def test_bm25_inside_papers(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(6)]
    rows = [
        (f"p{d}", i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6))))
        for d in range(6)
        for i in range(d + 1)
    ]
    qs = [(f"q{d}{k}", f"p{d}", " ".join(rng.choice(words) for _ in range(3))) for d in range(6) for k in range(3)]
    asked = queries(spark, qs + [("gone", "px", "w1")], "query_id string, paper_id string, text string")
    got = ranked(bm25(chunks(spark, rows), asked, 2, ["paper_id"]))
    assert "gone" not in got
    for qid, pid, text in qs:
        corpus = [(f"{p}_{i}", t) for p, i, t in rows if p == pid]
        assert_same(got[qid], plain_bm25(corpus, text, 2))


def test_no_token_anywhere_is_filled_in_corpus_order(spark):
    store = chunks(spark, [("b", 0, "中文"), ("a", 1, "图"), ("a", 0, "！")])
    got = ranked(bm25(store, queries(spark, [("q", "x")]), 2))
    assert got["q"] == [("a_0", 0.0), ("a_1", 0.0)]


def test_stored_statistics_give_the_same_result(spark):
    store = chunks(spark, [("a", 0, "x y"), ("b", 0, "x z z")])
    q = queries(spark, [("q", "z x")])
    assert ranked(bm25(store, q, 2)) == ranked(bm25(store, q, 2, statistics=term_statistics(store)))


def test_scores_are_cut_before_the_shuffle(spark, sf, capsys):
    import driver_tables as inputs

    bm25(inputs.chunks(spark, sf), inputs.queries(spark, sf), 8).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin [term" in plan
    assert plan.count("row_number(), 8, Partial") >= 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def vector_rows(spark, seed, papers=30, dim=8):
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(papers):
        v = rng.normal(size=dim)
        v /= np.linalg.norm(v)
        rows.append((f"p{p:02d}_0", f"p{p:02d}", 0, [float(x) for x in v]))
    rows.append(("p99_0", "p99", 0, rows[0][3]))  # a copy: equal distance, later in order
    return rows


VEC = "chunk_id string, paper_id string, chunk_index int, embedding array<float>"


def plain_nearest(rows, query, n):
    q = np.asarray(query, dtype=np.float32).astype(float)
    scored = []
    for cid, pid, i, e in rows:
        e = np.asarray(e, dtype=np.float32).astype(float)
        scored.append((-round(1 - float(((q - e) ** 2).sum()), 9), pid, i, cid))
    return [(c, -s) for s, _, _, c in sorted(scored)[:n]]


@pytest.mark.parametrize("n", [5, None])
def test_nearest(spark, monkeypatch, n):
    monkeypatch.setattr(V, "SCORE_CELLS", 40)
    monkeypatch.setattr(V, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(V, "QUERY_BLOCK", 2)
    rows = vector_rows(spark, 1)
    qs = [(f"q{k}", rows[k * 3][3]) for k in range(5)]
    asked = queries(spark, qs + [("none", None)], "query_id string, embedding array<float>")
    stored = spark.createDataFrame(rows, VEC)
    got = ranked(V.nearest(stored, asked, n))
    assert set(got) == {q for q, _ in qs}
    for qid, e in qs:
        want = plain_nearest(rows, e, n or len(rows))
        assert_same(got[qid], want)


def test_nearest_with_a_hot_scope(spark, monkeypatch):
    monkeypatch.setattr(V, "VECTOR_BLOCK", 4)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        pid = "hot" if i < 40 else f"p{i}"
        rows.append((f"{pid}_{i}", pid, i, [float(x) for x in rng.normal(size=4)]))
    qs = [("a", "hot", rows[3][3]), ("b", "hot", rows[7][3]), ("c", "p45", rows[9][3])]
    asked = queries(spark, qs, "query_id string, paper_id string, embedding array<float>")
    got = ranked(V.nearest(spark.createDataFrame(rows, VEC), asked, 3, ["paper_id"]))
    for qid, pid, e in qs:
        assert_same(got[qid], plain_nearest([r for r in rows if r[1] == pid], e, 3))


def test_small_keys_are_scored_together(monkeypatch):
    pd = V.pd
    rng = np.random.default_rng(5)

    def rows(n, extra):
        keys = [f"p{i}" for i in rng.integers(0, 30, n)] + ["hot"] * extra + [None]
        return pd.DataFrame({"_key0": keys, "embedding": [np.round(rng.random(3), 1) for _ in keys]})

    v, q = rows(120, 90), rows(60, 50)
    v = v.assign(chunk_id=[f"c{i}" for i in range(len(v))], paper_id=v["_key0"], chunk_index=range(len(v)))
    q = q.assign(query_id=[f"q{i}" for i in range(len(q))])
    made = []
    monkeypatch.setattr(V, "_slice_best", lambda *of, f=V._slice_best: made.append(1) or f(*of))

    def best(n, v=v, q=q):
        made.clear()
        found = pd.concat(V._best_by_key(v, q, ["_key0"], n)).sort_values(["query_id", "score", "chunk_index"], ascending=[True, False, True])
        found = found if n is None else found.groupby("query_id").head(n)  # a slice gives its own best n
        return list(zip(*[found[c].tolist() for c in ("query_id", "score", "paper_id", "chunk_index", "chunk_id")]))

    for n in (1, 4, None):
        together = best(n)
        assert len(made) == 1  # the hot key's; before, one for each key
        with monkeypatch.context() as m:
            m.setattr(V, "SCORE_CELLS", 30)
            assert best(n) == together
            m.setattr(V, "KEY_PAIRS", 0)
            assert best(n) == together and len(made) > 20
    shorter = [df.assign(embedding=[e[:2] if k == "p1" else e for k, e in zip(df["_key0"], df["embedding"])]) for df in (v, q)]
    assert len(best(2, *shorter)) == len(best(2))
    assert V._best_by_key(v[:0], q, ["_key0"], 2) == V._best_by_key(v[v["_key0"] == "zz"], q, ["_key0"], 2) == []


def test_cells_find_most_neighbours(spark):
    rows = vector_rows(spark, 5, papers=200)
    stored = spark.createDataFrame(rows, VEC)
    asked = queries(spark, [(f"q{k}", rows[k][3]) for k in range(20)], "query_id string, embedding array<float>")
    centres = V.fit_cells(stored, 8)
    exact = V.nearest(stored, asked, 5).select("query_id", "chunk_id")
    near = V.nearest_by_cells(stored, asked, 5, centres, 4).select("query_id", "chunk_id")
    assert near.join(exact, ["query_id", "chunk_id"]).count() >= 70  # of 100
    full = V.nearest_by_cells(stored, asked, 5, centres, 8).select("query_id", "chunk_id")
    assert full.exceptAll(exact).count() == 0


@pytest.mark.parametrize("n", [1, 5, 5000])
def test_skipped_cells_hold_no_neighbour(spark, n):
    rows = vector_rows(spark, 5, papers=200)
    stored = spark.createDataFrame(rows, VEC)
    asked = queries(spark, [(f"q{k}", rows[k][3]) for k in range(20)], "query_id string, embedding array<float>")
    hits = V.nearest_in_cells(stored, asked, n, V.fit_cells(stored, 8))
    exact = V.nearest(stored, asked, n)
    assert hits.columns == exact.columns
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, exact.collect()))


def test_embed_batches_in_order(spark):
    def provider(texts):
        assert len(texts) <= 64
        return [[float(t)] for t in texts]

    df = spark.range(150).select(F.col("id").cast("string").alias("t")).coalesce(1)
    got = V.embed(df, "t", provider).collect()
    assert all(float(r.t) == r.embedding[0] for r in got) and len(got) == 150


def hits(spark, rows):
    ddl = "query_id string, chunk_id string, paper_id string, chunk_index int, score double, rank int"
    return spark.createDataFrame([("q", c, c, 0, 0.0, r) for c, r in rows], ddl)


def test_fusion_ties_prefer_the_vector_list(spark):
    fused = fuse(hits(spark, [("a", 0), ("b", 1), ("c", 2)]), hits(spark, [("d", 0), ("c", 1), ("b", 2)]))
    got = top_n(fused, ["query_id"], fused_order(), 10).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "c", "a", "d"]
    assert got[2].raw == 1 / 60


def test_hybrid_filters(spark):
    store = chunks(spark, [("a", 0, "graph model", 2010), ("b", 0, "graph data", 2020), ("c", 0, "graph", 0)])
    rows = [("a_0", [1.0, 0.0]), ("b_0", [0.0, 1.0]), ("c_0", [1.0, 0.0])]
    vec = spark.createDataFrame(rows, schema.VECTORS)
    asked = spark.createDataFrame([("q", "graph model", [1.0, 0.0])], schema.QUERIES)

    def ids(**kw):
        return [c for c, _ in ranked(hybrid_search(store, vec, asked, 8, **kw)).get("q", [])]

    assert ids() == ["a_0", "c_0", "b_0"]
    assert ids(year_min=2015) == ["b_0"]
    assert set(ids(year_min=1)) == {"a_0", "b_0"}
    assert ids(paper_id="c") == ["c_0"]
    assert ids(year_min=2015, paper_id="c") == []
    shown = rag_query(store, vec, asked, 2, year_min=0, paper_id="").orderBy("rank").collect()
    assert [(r.paper_id, r.score, r.meta.title) for r in shown] == [("a", 0.033, "T a"), ("c", 0.033, "T c")]
    only_words = ranked(hybrid_search(store, None, asked, 1))
    assert only_words["q"] == [("a_0", 0.016667)]


def test_paper_filter_without_conditions_keeps_all(spark):
    assert chunks(spark, [("a", 0, "x")]).where(paper_filter(None, "")).count() == 1


def test_rank_all_equals_row_number(spark):
    rng = random.Random(2)
    rows = [("q", i, round(rng.random() * 3, 1)) for i in range(500)]
    df = spark.createDataFrame(rows, "query_id string, i int, score double")
    got = rank_all(df, ["query_id"], [-F.floor("score")], [F.desc("score"), F.col("i")])
    want = {i: k for k, (_, i, _) in enumerate(sorted(rows, key=lambda r: (-r[2], r[1])))}
    assert {r.i: r.rank for r in got.collect()} == want


def test_named_papers_come_first(spark):
    ids = [f"{i:012x}" for i in range(20)]
    papers = spark.createDataFrame([(i,) for i in ids[:15]], "paper_id string")
    finals = spark.createDataFrame([("q", f"see {ids[3]}, x{ids[4]} and {ids[17]}")], "query_id string, final_text string")
    trace = spark.createDataFrame(
        [("q", 2, "observe", f"{ids[5]} {ids[3]}"), ("q", 1, "act", ids[6]), ("q", 3, "observe", None),
         ("q", 4, "observe", "." * 195 + ids[7])],
        "query_id string, seq int, type string, result_preview string",
    )
    named = named_papers(finals, trace, papers)
    assert {r.paper_id for r in named.collect()} == {ids[3], ids[5]}
    ddl = "query_id string, paper_id string, chunk_id string, score double, rank int"
    fused = spark.createDataFrame(
        [("q", ids[k], f"{k}", s, r) for r, (k, s) in enumerate([(1, 0.03), (5, 0.03), (2, 0.02), (1, 0.01)])]
        + [("q", "", "e", 0.5, 9), ("q", ids[8], "n", -1.0, 10)],
        ddl,
    )
    rolled = paper_rollup(fused)
    assert rolled.where(F.col("paper_id") == ids[8]).first().score == 0.0
    got = merge_candidates(named, rolled, 4).orderBy("rank").collect()
    assert [r.paper_id for r in got] == [ids[3], ids[5], ids[1], ids[2]]


def test_topic_candidates_pools_agree(spark):
    """With a pool wider than the corpus the cut and the growing pool rank the same."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(20)]
    rows = [(f"p{d:02d}", i, " ".join(rng.choice(words) for _ in range(8))) for d in range(12) for i in range(2)]
    store = chunks(spark, rows)
    vec = spark.createDataFrame(
        [(f"{p}_{i}", [rng.random(), rng.random()]) for p, i, _ in rows], schema.VECTORS
    )
    topics = spark.createDataFrame([("q1", "w1 w2 w3", [0.1, 0.9]), ("q2", "w4", [0.5, 0.5])], schema.QUERIES)
    none = spark.createDataFrame([], "query_id string, paper_id string, seq long, pos int")
    wide = merge_candidates(none, paper_rollup(chunk_pool(store, vec, topics, 1000))).collect()
    grown = topic_candidates(store, vec, topics, none).collect()
    assert sorted(wide) == sorted(grown) and len(wide) == 16


@pytest.mark.parametrize("seed", [1, 2])
def test_leading_papers_equal_the_full_ranking(spark, seed, monkeypatch):
    """Ties, blank papers, chunks without vectors, topics without one, and a hot paper that fills
    the first heads."""
    monkeypatch.setattr("litweave.operators.candidates.FIRST_DEPTH", 16)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    rows = [(f"p{d:02d}", i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))) for d in range(25) for i in range(4)]
    rows += [("hot", i, "w1 w1 w2") for i in range(90)] + [("", i, "w1 w3") for i in range(5)]
    store = chunks(spark, rows)
    vec = spark.createDataFrame(
        [(f"{p}_{i}", [rng.randint(0, 3) / 4, 0.5 if p == "hot" else rng.randint(0, 3) / 4]) for p, i, _ in rows if rng.random() < 0.9],
        schema.VECTORS,
    )
    topics = spark.createDataFrame(
        [("q1", "w1 w2 w3", [0.1, 0.5]), ("q2", "w4", [0.5, 0.5]), ("q3", "w5 w6", None), ("q4", "none", [0.0, 1.0]), ("q5", "", None)],
        schema.QUERIES,
    )
    named = spark.createDataFrame([("q2", "p03", 0, 0)], "query_id string, paper_id string, seq long, pos int")
    for limit in (3, 8):
        want = merge_candidates(named, paper_rollup(chunk_pool(store, vec, topics)), limit)
        got = merge_candidates(named, paper_rollup(leading_chunks(store, vec, topics, limit)), limit)
        assert sorted(got.collect()) == sorted(want.collect())


def test_expansion_is_the_identity_without_a_table(spark):
    topics = queries(spark, [("q", "graphs")])
    assert [tuple(r) for r in expand_topics(topics).collect()] == [("q", 0, "graphs")]
    more = spark.createDataFrame([("graphs", 0, "networks"), ("other", 0, "x")], "topic string, pos int, term string")
    got = expand_topics(topics, more).orderBy("pos").collect()
    assert [r.term for r in got] == ["graphs", "networks"]


# --- mixed filters ------------------------------------------------------------------


def _corpus(spark):
    rows = [
        (f"{p}_{i}", p, i, f"graph words number {i} of {p}", year)
        for p, year in (("a1", 2001), ("b2", 2010), ("c3", 2150))
        for i in range(4)
    ]
    return spark.createDataFrame(rows, "chunk_id string, paper_id string, chunk_index int, text string, year int")


def test_queries_without_year_or_paper_are_answered(spark):
    asked = spark.createDataFrame(
        [
            ("none", "graph words", None, None), ("blank", "graph words", None, "  "), ("year", "graph words", 2005, ""),
            ("late", "graph words", 2101, None), ("never", "graph words", 2200, None), ("paper", "graph words", None, "a1"),
            ("both", "graph words", 2005, "b2"), ("apart", "graph words", 2005, "a1"),
        ],
        "query_id string, text string, year_min int, paper_id string",
    )
    found = mixed_search(_corpus(spark), None, asked, 20).collect()
    papers = {}
    for r in found:
        papers.setdefault(r["query_id"], []).append(r["paper_id"])
    assert {q: sorted(set(p)) for q, p in papers.items()} == {
        "none": ["a1", "b2", "c3"], "blank": ["a1", "b2", "c3"], "year": ["b2", "c3"], "late": ["c3"],
        "paper": ["a1"], "both": ["b2"],
    }
    assert len(papers["none"]) == 12 and len(papers["paper"]) == 4


def test_exploded_texts_of_scoped_queries_are_not_broadcast(spark):
    from litweave.operators.bm25 import bm25_scores, postings, query_terms, term_statistics

    rows = [(f"p{i}_0", f"p{i}", 0, f"alpha beta w{i}") for i in range(8)]
    corpus = spark.createDataFrame(rows, "chunk_id string, paper_id string, chunk_index int, text string")
    asked = spark.createDataFrame([(f"q{i}", f"p{i}", "alpha w1") for i in range(8)], "query_id string, paper_id string, text string")
    terms = query_terms(asked, term_statistics(corpus, ["paper_id"]), ["paper_id"])
    scores = bm25_scores(postings(corpus, ["paper_id"]), terms, ["paper_id"])
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 2
    assert {r["query_id"] for r in scores.collect()} == {f"q{i}" for i in range(8)}


def test_scoped_chunks_list_asked_terms_only(spark, monkeypatch):
    from litweave.operators import bm25 as keyword

    rows = [(f"p{i}_{k}", f"p{i}", k, f"alpha beta gamma w{i} w{k}") for i in range(4) for k in range(3)]
    corpus = spark.createDataFrame(rows, "chunk_id string, paper_id string, chunk_index int, text string")
    asked = spark.createDataFrame([("a", "p1", "w1 w2 zzz"), ("b", "p2", "alpha w0"), ("c", "p9", "w1"), ("d", "p1", "w0")], "query_id string, paper_id string, text string")
    made = []
    monkeypatch.setattr(keyword, "bm25_scores", lambda posted, *more, f=keyword.bm25_scores: made.append(posted.where("term in ('beta', 'gamma')").count()) or f(posted, *more))
    few = ranking(keyword.bm25(corpus, asked, 2, ["paper_id"]))
    monkeypatch.setattr(keyword, "LISTED", 0)
    assert ranking(keyword.bm25(corpus, asked, 2, ["paper_id"])) == few
    assert made[0] == 0 < made[1] and {r[0] for r in few} == {"a", "b", "d"}


def ranking(hits):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in hits.collect())
