"""URL rules, vector links and packing against brute force, with awkward rows."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from litweave.llm import packing, url_rules, vector_dedup

# --- urls -----------------------------------------------------------------------------


def brute_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    if not fit:
        return host, path, None, "allow"
    best = max(fit, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block"))
    return host, path, best[1] + best[2], best[0]


URLS = [
    None, "", "nothing", "://", "http://", "http:///x", "http://com", "http://com/", "http://COM/a", "http://a.com?x=/",
    "http://example.com/en/1", "http://www.Example.com/en/", "http://xexample.com/en/", "https://net/fr/", "http://a.net/es",
    "http://a.net/es/#f", "http://b.net/en/?q=1", "http://é.com/é", "http://a.com:80/en/", "http://a..com/x", "http://a.com./",
    "http://x://y.net/fr/", "http://line\nbreak.com/a\nb", "http://a-b.example.com/en/", "http://sub.www.example.com/en/z", "http://" + "a." * 3000 + "com/" + "p" * 20000,
]


@pytest.mark.parametrize("parts", ["1", "8", "40"])
def test_verdicts_match_brute_force(spark, parts):
    rng = random.Random(4)
    hosts = ["com", "a.com", "b.a.com", "ba.com", "net", "x.net", "a.x.net", "a-x.net"]
    rules = [*url_rules.RULES] + [(rng.choice(["allow", "block"]), h, p) for h in hosts for p in ("/", "/p/", "/p/q", "") if rng.random() < 0.6]
    rules = [r for k, r in enumerate(rules) if r[1:] not in [x[1:] for x in rules[:k]]]
    urls = URLS + [f"http://{rng.choice(['', 'm.', 'z.y.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/p', '/p/', '/p/q/r', '/other'])}" for _ in range(150)]
    urls += ["http://hot.example.com/en/"] * 100
    pages = spark.createDataFrame([(i, u, "k", 1, "r") for i, u in enumerate(urls)], "page_id long, url string, key string, part int, rule string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = url_rules.judged(pages, url_rules.rule_table(spark, rules)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(map(tuple, got), key=lambda r: r[0]) == [(i, *brute_verdict(u, rules)) for i, u in enumerate(urls)]


def test_no_urls_no_rules_and_null_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, None)], "page_id long, url string")
    rules = url_rules.rule_table(spark)
    assert url_rules.judged(pages.limit(0), rules).count() == 0
    got = url_rules.judged(pages, rules.limit(0)).collect()
    assert len(got) == 3 and {r["verdict"] for r in got} == {"allow"} and {r["rule"] for r in got} == {None}
    odd = spark.createDataFrame([("block", "com", None), (None, "com", "/"), ("block", None, "/")], "verdict string, host string, path string")
    assert {r["rule"] for r in url_rules.judged(pages, odd).collect()} == {None}
    both = spark.createDataFrame([("allow", "com", "/"), ("block", "com", "/")], "verdict string, host string, path string")
    assert {r["verdict"] for r in url_rules.judged(pages, both).where("host <> ''").collect()} == {"block"}


# --- vectors -----------------------------------------------------------------------------


def brute_vectors(rows, cosine=0.98):
    good = [
        (k, label, np.array(v, float))
        for k, (_, v, label) in enumerate(rows)
        if label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    links = {k: set() for k in range(len(rows))}
    for (i, a, x), (j, b, y) in itertools.combinations(good, 2):
        if a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
            links[i].add(j)
            links[j].add(i)
    out = []
    for k, (vec_id, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((vec_id, len(links[k]), component, vec_id is not None and vec_id == component))
    return sorted(out, key=str)


def vectors(spark, rows):
    df = spark.createDataFrame([(i, v, g) for i, v, g in rows], "vec_id long, embedding array<double>, label int")
    return df.withColumns({"node": F.lit("n"), "links": F.lit(1), "block": F.lit(2)})


@pytest.mark.parametrize("block", [4, 512])
def test_vector_groups_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    monkeypatch.setattr(vector_dedup, "LEAF", 3)
    rng = np.random.default_rng(7)
    rows = []
    for k in range(90):
        if rows and rng.random() < 0.6:
            v = np.array(rows[rng.integers(len(rows))][1]) * rng.choice([1.0, 3.0, 0.5]) + rng.choice([0, 0.02, 0.1]) * rng.normal(size=6)
        else:
            v = rng.normal(size=6)
        rows.append((k * 3, [float(x) for x in v], int(rng.integers(3))))
    rows += [(1000 + k, list(rows[0][1]), rows[0][2]) for k in range(20)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 6, 1), (2003, [float("nan")] * 6, 1), (2004, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1)]
    rows += [(2005, [float("inf")] + [0.0] * 5, 1), (2006, rows[3][1], None), (2007, [1.0, 2.0], 1), (2008, [2.0, 4.0], 1), (None, rows[5][1], rows[5][2]), (0, rows[0][1], rows[0][2])]
    rows += [(2009, [1e300] * 6, 2), (2010, [1e-300] * 6, 2), (2011, [-1.0] * 6, 2)]
    rng.shuffle(order := list(range(len(rows))))
    got = vector_dedup.vector_groups(vectors(spark, [rows[k] for k in order])).collect()
    want = [r for r in rows if r[0] not in (2009, 2010)]
    large = {2009, 2010}
    assert sorted((tuple(r) for r in got if r["vec_id"] not in large), key=str) == brute_vectors(want)
    assert {r["component_id"] for r in got if r["vec_id"] in large} == {2009}


def test_no_vectors(spark):
    assert vector_dedup.vector_groups(vectors(spark, [(1, [1.0], 1)]).limit(0)).count() == 0
    got = vector_dedup.vector_groups(vectors(spark, [(4, None, 1), (5, [1.0], None)])).collect()
    assert sorted(tuple(r) for r in got) == [(4, 0, 4, True), (5, 0, 5, True)]


def test_distant_blocks_are_skipped():
    axes = np.eye(4)[:2]
    one = np.array([[1, 0, 0, 0.01 * k] for k in range(40)])
    two = np.array([[0, 1, 0, 0.01 * k] for k in range(40)])
    a, b = (vector_dedup._Sequence(x.tobytes(), axes) for x in (one, two))
    assert not list(vector_dedup._join(a, b, False, 0.98, 0.2001))
    assert list(vector_dedup._join(a, a, True, 0.98, 0.2001))


# --- packing ---------------------------------------------------------------------------------


def test_boundaries_are_optimal():
    rng = random.Random(9)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 60), rng.randrange(1, 9))))
        counts = np.array([rng.randrange(1, 20) for _ in lengths])
        k = rng.randrange(1, 6)

        def cost(bounds):
            return sum(c * min(b for b in bounds if b >= n) for n, c in zip(lengths.tolist(), counts.tolist()))

        best = min(
            cost((*chosen, lengths[-1])) for size in range(k) for chosen in itertools.combinations(lengths[:-1].tolist(), min(size, len(lengths) - 1))
        )
        got = packing.best_boundaries(lengths, counts, k)
        assert len(got) <= k and got[-1] == lengths[-1] and cost(got) == best
    assert packing.best_boundaries(np.empty(0, int), np.empty(0, int)) == []


def test_batches_hold_the_budget_and_every_row(spark):
    rng = random.Random(10)
    rows = [(rng.randrange(50), rng.choice([3, 3, 3, 0, None, 7, 20, 400, 5000])) for _ in range(300)]
    rows += [(None, 3), (None, 3), (1, 3), (1, 3), (9, -4)]
    df = spark.createDataFrame([(i, n, 1, "b") for i, n in rows], "doc_id long, tokens long, place int, bucket string")
    out = packing.packed(df, F.col("tokens"), buckets=4, budget=100).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in out) == sorted((str(i), max(n or 0, 0)) for i, n in rows)
    buckets = {}
    for r in out:
        assert r["n_tokens"] <= r["bound"]
        buckets.setdefault(r["bucket"], []).append(r)
    for own in buckets.values():
        fit = max(1, 100 // max(1, own[0]["bound"]))
        assert len({r["bound"] for r in own}) == 1
        # rows in order of (length, identifier) fill the places one after the other
        places = sorted((r["batch"] * fit + r["slot"], r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]) for r in own)
        assert [p[0] for p in places] == list(range(len(own)))
        assert [p[1:] for p in places] == sorted(p[1:] for p in places)
        assert all(r["slot"] < fit for r in own)
    assert packing.packed(df.limit(0), F.col("tokens")).collect() == []


def test_lengths_are_counted_once(spark):
    counted = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def tokens(text):
        counted.add(1)
        return len(text)

    df = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(100)], "doc_id long, text string")
    got = packing.packed(df, tokens("text"), buckets=2, budget=20)
    assert {(r["doc_id"], r["n_tokens"]) for r in got.collect()} == {(i, i % 7) for i in range(100)}
    assert counted.value == 100  # ranges are sampled from all rows; that made it 200


def plain_boundaries(lengths, counts, k):
    """The dynamic programme as a double loop; ties take the smallest cut."""
    upto = np.concatenate(([0], np.cumsum(counts)))
    layers = [[(int(lengths[j] * upto[j + 1]), 0) for j in range(len(lengths))]]
    for _ in range(k - 1):
        before = [0, *[c for c, _ in layers[-1]]]
        layers.append([
            min((before[i] + int(lengths[j] * (upto[j + 1] - upto[i])), i) for i in range(j + 1)) for j in range(len(lengths))
        ])
    out, j = [], len(lengths)
    for layer in reversed(layers):
        if j:
            out.append(int(lengths[j - 1]))
            j = layer[j - 1][1]
    return sorted(out)


def test_long_lengths_are_boundaries_as_they_are(spark):
    rng = np.random.default_rng(3)
    for top in (40, 3_000, 200_000):
        lengths = np.unique(rng.integers(0, top, 150))
        counts = rng.integers(1, 4, len(lengths)) * np.where(rng.random(len(lengths)) < 0.02, 500, 1)
        assert packing.best_boundaries(lengths, counts) == plain_boundaries(lengths, counts, packing.BUCKETS)
    rows = [(i, int(n)) for i, n in enumerate(lengths)]
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, tokens long"), F.col("tokens")).collect()
    assert sorted({r["bound"] for r in out}) == plain_boundaries(lengths, np.ones(len(lengths), int), packing.BUCKETS)


def test_many_lengths_stay_cheap():
    lengths = np.arange(1, 300_001)
    got = packing.best_boundaries(lengths, np.ones(300_000, int))
    assert got == [round(300_000 * (k + 1) / 8) for k in range(8)]


def test_words_are_counted_as_defined(spark):
    texts = [None, "", "  ", "a", " a b\tc\n", "\x0ba\x0c", "a\u00a0b c", "x " * 50_000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(packing.word_count(F.col("t"))).collect()]
    assert got == [0, 0, 0, 1, 3, 1, 2, 50_000]
