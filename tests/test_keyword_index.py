"""The stored keyword index against the scan, which reads the texts."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from litweave.functions.batches import grouped
from litweave.operators import keyword_index as ki
from litweave.operators.bm25 import bm25, corpus_stats, term_statistics
from litweave.operators.fusion import with_year_scopes

CHUNKS = "chunk_id string, paper_id string, chunk_index int, text string, year int, term string, doc long"


def words(rng, n, vocabulary=60):
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows = [(f"c{k}", f"p{k // 7}", k % 7, words(rng, rng.randrange(30)), rng.choice([None, 0, 1999, 2005, 2011, 2020]), "x", 1) for k in range(400)]
    rows += [(f"same{k}", "twins", k, "w1 w1 w50 Twin", 2030, "x", 1) for k in range(40)]
    rows += [("null", "p1", 90, None, 2005, "x", 1), ("empty", "", 0, "", 2005, "x", 1), ("other", "p1", 91, "ünïcode -- !", None, "x", 1), ("long", "p2", 99, "w3 " * 30_000, 2011, "x", 1)]
    return spark.createDataFrame(rows, CHUNKS)


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(2)
    rows = [(f"q{k}", words(rng, rng.randrange(1, 9)), rng.choice([None, 1990, 2005, 2006, 2025, 2031, -5])) for k in range(40)]
    return spark.createDataFrame(rows + [("none", "zzz !", None), ("blank", "", 2005), ("twin", "twin w1", 2020), ("null", None, None)], "query_id string, text string, year_min int")


def read(corpus):
    """The chunks as the store gives them: a null text is empty."""
    return corpus.withColumn("text", F.coalesce("text", F.lit("")))


def ranked(hits):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["paper_id"], r["chunk_index"], round(r["score"], 8)) for r in hits.collect())


@pytest.mark.parametrize("bits,together", [(12, 50_000), (3, 20)])
def test_search_equals_the_scan(spark, corpus, asked, monkeypatch, bits, together):
    monkeypatch.setattr(ki, "SHARD_BITS", bits)
    monkeypatch.setattr(ki, "_AT", (1 << bits) - 1)
    monkeypatch.setattr(ki, "QUERY_TERMS", together)
    index = ki.build_keyword_index(corpus)
    plain = asked.drop("year_min")
    for n in (6, 500):
        assert ranked(ki.search(index, plain, n)) == ranked(bm25(read(corpus), plain, n))
    free, dated = asked.where("year_min is null"), asked.where("year_min is not null")
    want = ranked(bm25(read(corpus), free, 6)) + ranked(bm25(with_year_scopes(read(corpus), dated), dated, 6, ["year_min"]))
    assert ranked(ki.search(index, asked, 6)) == sorted(want)
    by_paper = spark.createDataFrame([("a", "w1 w2", "p1"), ("b", "w1 twin", "twins"), ("c", "w1", "unknown")], "query_id string, text string, paper_id string")
    assert ranked(bm25(index.corpus, by_paper, 4, ["paper_id"])) == ranked(bm25(read(corpus), by_paper, 4, ["paper_id"]))


def test_places_equal_the_full_ranking(corpus, asked, monkeypatch):
    monkeypatch.setattr(ki, "SHARD_BITS", 4)
    monkeypatch.setattr(ki, "_AT", 15)
    index, plain = ki.build_keyword_index(corpus), asked.drop("year_min")
    full = {(r["query_id"], r["chunk_id"]): r["rank"] for r in bm25(read(corpus), plain, None).collect()}
    marks = [k for i, k in enumerate(sorted(full)) if i % 17 == 0]
    spark = corpus.sparkSession
    got = ki.ranks(index, plain, spark.createDataFrame(marks, "query_id string, chunk_id string")).collect()
    assert {(r["query_id"], r["chunk_id"]): r["rank"] for r in got} == {k: full[k] for k in marks}
    assert ki.ranks(index, plain, spark.createDataFrame([], "query_id string, chunk_id string")).count() == 0


def test_statistics_of_every_year(corpus):
    index = ki.build_keyword_index(corpus)
    for r in index.years.collect():
        own = corpus if r["year_from"] == ki.ANY_YEAR else corpus.where(F.col("year") >= r["year_from"])
        want = corpus_stats(term_statistics(read(own))).first()
        assert (r["n_chunks"], r["n_terms"]) == (want["n_chunks"], want["n_terms"])
        assert np.allclose([r["avgdl"], r["mean_idf"]], [want["avgdl"], want["mean_idf"]])


def test_an_empty_corpus_has_no_hits(spark, corpus, asked):
    index = ki.build_keyword_index(corpus.limit(0))
    assert ki.search(index, asked, 3).count() == 0
    assert ki.search(ki.build_keyword_index(corpus), asked.limit(0), 3).count() == 0


def test_a_search_reads_its_buckets_and_no_text(spark, corpus):
    index = ki.build_keyword_index(corpus)
    plan = ki.search(index, spark.createDataFrame([("q", "w1 w2")], "query_id string, text string"), 3)._jdf.queryExecution().executedPlan().toString()
    buckets = {r[0] for r in spark.createDataFrame([("w1",), ("w2",)], "t string").select(ki._bucket(F.col("t"))).collect()}
    read = re.search(r"PartitionFilters: \[bucket#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
    assert set(map(int, (read[1] or read[2]).split(","))) == buckets
    assert "text#" not in plan.split("Scan", 1)[1]


def test_terms_that_cannot_matter_are_skipped(spark, corpus, monkeypatch):
    """Blocks of common terms are left out once the n-th score is above what they could add."""
    monkeypatch.setattr(ki, "SHARD_BITS", 4)
    monkeypatch.setattr(ki, "_AT", 15)
    index = ki.build_keyword_index(corpus)
    queries = spark.createDataFrame([("q", "twin w0 w1 w2 w3")], "query_id string, text string")
    numbered, terms = ki._asked(index, queries)
    frames = list(grouped(iter([ki._met(index, numbered, terms).toPandas().sort_values(["block", "shard"])]), ["block", "shard"]))
    skipped, bar = 0, np.empty(0)
    for frame in frames[::-1]:  # the twins come last
        shard = ki._Shard(frame)
        for _, own in shard.queries():
            score, able = shard.scores(own, bar.min() if len(bar) == 3 else -np.inf)
            bar = np.sort(np.append(bar, score[able]))[-3:]
        skipped += shard.skipped
    assert skipped > 0


def test_posting_blocks_of_shards_that_cross_batches():
    import pyarrow as pa

    rng = random.Random(4)
    chunks = [(shard, at, sorted({words(rng, 1, 9): rng.randint(1, 5) for _ in range(rng.randrange(6))}.items())) for shard in (1, 2, 5) for at in range(40)]
    rows = [{"shard": s, "at": a, "dl": sum(n for _, n in t) + a, "terms": [{"term": w, "tf": n} for w, n in t] or None} for s, a, t in chunks]
    kind = pa.schema({"shard": pa.int64(), "at": pa.int16(), "dl": pa.int32(), "terms": pa.list_(pa.struct({"term": pa.string(), "tf": pa.int32()}))})
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 17], kind) for i in range(0, len(rows), 17)]
    batches += [pa.RecordBatch.from_pylist([], kind), pa.RecordBatch.from_pylist([{"shard": 9, "at": 0, "dl": 0, "terms": None}], kind)]
    want = {}
    for r in rows:
        for t in r["terms"] or []:
            want.setdefault((r["shard"], t["term"]), []).append((r["at"], t["tf"], r["dl"]))
    got = [r for b in ki._inverted(iter(batches)) for r in b.to_pylist()]
    assert len(got) == len(want)
    for r in got:
        at, tf, dl = zip(*want[r["shard"], r["term"]])
        assert (r["at"], r["tf"], r["max_tf"], r["min_dl"]) == (list(at), list(tf), max(tf), min(dl))


def test_a_shard_that_a_scan_cuts_is_put_together_again(spark, corpus, asked):
    index = ki.build_keyword_index(corpus)
    whole = ranked(ki.search(index, asked, 6))
    parts = index.postings.select("*", F.posexplode(F.arrays_zip("at", "tf")).alias("i", "x"))
    parts = parts.groupBy("bucket", "term", "shard", (F.col("i") % 2).alias("part")).agg(
        F.collect_list("x.at").alias("at"), F.collect_list("x.tf").alias("tf"), F.max("x.tf").alias("max_tf"), F.min("min_dl").alias("min_dl")
    )
    cut = parts.drop("part")
    assert cut.count() > index.postings.count()
    index.postings = cut
    assert ranked(ki.search(index, asked, 6)) == whole


def test_texts_are_sorted_and_terms_written_once(corpus, monkeypatch):
    names = []
    monkeypatch.setattr(ki, "written", lambda df, name, w=ki.written: names.append(name) or w(df, name))
    ki.build_keyword_index(corpus)
    assert "tokens" not in names
