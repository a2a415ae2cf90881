"""Exact, near and substring duplicates against brute force, with awkward rows."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from litweave.llm import exact_dedup, simhash, substring_dedup
from litweave.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, row string, keep_id long"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))


def documents(spark, texts, ids=None):
    """Texts as documents with extra columns whose names the operators also use."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", None, None, 1, "x", 7) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS)


def random_texts(n, seed, vocabulary=30, length=60):
    rng = random.Random(seed)
    vocab = [f"Wort{i}é" if i % 7 == 0 else f"w{i}" for i in range(vocabulary)]
    texts = []
    for k in range(n):
        if k and rng.random() < 0.4:
            found = texts[rng.randrange(k)].split(" ")
            for _ in range(rng.randrange(3)):
                if found:
                    found[rng.randrange(len(found))] = rng.choice(vocab)
            texts.append(" ".join(found))
        else:
            texts.append(" ".join(rng.choice(vocab) for _ in range(rng.randrange(length))))
    return texts


AWKWARD = [None, "", " ", "\t\n", "a", "A", "a  b", "a\nb", "a b", " a b", "a b", "é", "tie tie", "tie tie", LONG, LONG + " end"]


# --- exact -------------------------------------------------------------------------


def brute_exact(ids, texts):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    groups = {}
    for i, t in zip(ids, norm):
        groups.setdefault(t, []).append(i)
    return sorted(
        (i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest())
        for i, t in zip(ids, norm)
    )


@pytest.mark.parametrize("run_rows", [2, 4096])
def test_exact_groups_match_brute_force(spark, run_rows):
    texts = AWKWARD + random_texts(60, 1, 3, 4) + ["hot text"] * 40
    ids = list(range(len(texts)))
    random.Random(3).shuffle(ids)
    got = exact_dedup.exact_groups(documents(spark, texts, ids), run_rows=run_rows)
    rows = got.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, rows)) == brute_exact(ids, texts)


def test_exact_keeps_columns_nulls_and_one_of_repeated_rows(spark):
    df = documents(spark, ["x", "x", "y", "y", None, ""], [5, 5, None, None, None, 3])
    kept = exact_dedup.drop_exact(df)
    assert kept.columns == df.columns
    rows = sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect())
    assert rows == [(-1, "y"), (3, ""), (5, "x")]


def test_exact_of_an_empty_table(spark):
    assert exact_dedup.drop_exact(documents(spark, [])).count() == 0


def test_exact_runs_without_python(spark):
    plan = exact_dedup.exact_groups(documents(spark, ["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "hashpartitioning" not in plan and plan.count("rangepartitioning") == 1


# --- simhash -------------------------------------------------------------------------


def brute_fingerprint(text):
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints_match_brute_force():
    for text in AWKWARD[:-2] + random_texts(40, 2) + [" ".join(["again"] * 700)]:
        assert simhash.fingerprint(text) == brute_fingerprint(text), text


def test_near_finds_all_pairs_within_the_radius():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 90, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 9, 90)], np.uint64)
    values = np.concatenate([base, base ^ flips, np.array([0, 1, 2**64 - 1], np.uint64)])
    apart = np.array([[bin(int(a) ^ int(b)).count("1") for b in values] for a in values])
    for radius in (0, 1, 3, 4, 7):
        a, b = simhash.near(values, values, radius)
        assert set(zip(a.tolist(), b.tolist())) == set(zip(*map(list, np.nonzero(apart <= radius))))


@pytest.mark.parametrize("block", [3, 8192])
def test_links_connect_what_is_near(spark, block):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 12, dtype=np.uint64)
    values = {int(v) for v in base} | {0, 3}
    for v in list(values):
        for _ in range(6):
            v ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))
            values.add(v)
    values = sorted(values)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    fps = spark.createDataFrame([(s,) for s in signed], "fp long")
    links = [(signed.index(r["a"]), signed.index(r["b"])) for r in simhash.fingerprint_links(fps, block=block).collect()]
    near = [(i, j) for i in range(len(values)) for j in range(i) if bin(values[i] ^ values[j]).count("1") <= 4]
    assert brute_components(len(values), links) == brute_components(len(values), near)


def test_near_groups_match_brute_force(spark):
    texts = AWKWARD + random_texts(80, 4, 200, 80)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_groups(documents(spark, texts)).collect()}
    fps = [simhash.fingerprint(t) for t in texts]
    roots = brute_components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    assert got == {i: (f"{f:016x}", r) for i, (f, r) in enumerate(zip(fps, roots))}


def test_drop_near_keeps_one_of_each_group_and_all_columns(spark):
    df = documents(spark, ["one two three four five six", "One two three four five six", "other words here", None, ""], [9, 4, 1, 8, None])
    kept = simhash.drop_near(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 4, 8]
    assert simhash.drop_near(documents(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    order = list(range(60))
    rng.shuffle(order)
    links = list(zip(order, order[1:])) + [(100, k) for k in range(101, 140)] + [(200, 200), (7, order[3])]
    edges = spark.createDataFrame(links + [(None, 1)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    want = brute_components(201, links)
    assert got == {i: want[i] for i in [*range(60), *range(100, 140)]}
    assert components(edges.where("a > 500")).count() == 0


# --- substrings ------------------------------------------------------------------------


def brute_substring(ids, texts, window=13):
    cut = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    first = {}
    for i, w in zip(ids, cut):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in zip(ids, cut):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, b" ".join(x for k, x in enumerate(w) if k not in gone).decode(), len(w), len(gone)))
    return sorted(out)


def passages(seed):
    rng = random.Random(seed)
    shared = [" ".join(f"p{rng.randrange(50)}" for _ in range(rng.randrange(10, 40))) for _ in range(6)]
    texts = []
    for _ in range(70):
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(f"u{rng.randrange(9999)}" for _ in range(20)) for _ in range(4)]
        texts.append("\n".join(parts))
    return texts + ["the " * 60, "the " * 14, "Tab\there " * 20, *AWKWARD]


def test_substrings_match_brute_force(spark):
    texts = passages(6)
    ids = list(range(len(texts)))
    random.Random(8).shuffle(ids)
    got = substring_dedup.without_repeats(documents(spark, texts, ids))
    rows = got.select("row.doc_id", "kept_text", "n_words", "n_removed").collect()
    assert sorted(map(tuple, rows)) == brute_substring(ids, texts)


def test_small_packs_and_slices_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GATHERED", 900)
    monkeypatch.setattr(substring_dedup, "SLICE", 40)
    texts = passages(9) + ["x" * 500 + " " + "tail " * 30]
    rows = substring_dedup.without_repeats(documents(spark, texts)).select("row.doc_id", "kept_text", "n_words", "n_removed").collect()
    assert sorted(map(tuple, rows)) == brute_substring(range(len(texts)), texts)
    monkeypatch.setattr(substring_dedup, "_sampled", lambda docs, window, share: (np.arange(0, substring_dedup.CLASSES, 3, dtype=np.uint64), [b"a", b"the"]))
    rows = substring_dedup.without_repeats(documents(spark, texts)).select("row.doc_id", "kept_text", "n_words", "n_removed").collect()
    assert sorted(map(tuple, rows)) == brute_substring(range(len(texts)), texts)


def test_heavy_minimisers_give_the_same(spark, monkeypatch):
    texts = passages(7)
    monkeypatch.setattr(substring_dedup, "_sampled", lambda docs, window, share: (np.arange(0, substring_dedup.CLASSES, 2, dtype=np.uint64), [b"a", b"the"]))
    rows = substring_dedup.without_repeats(documents(spark, texts)).select("row.doc_id", "kept_text", "n_words", "n_removed").collect()
    assert sorted(map(tuple, rows)) == brute_substring(range(len(texts)), texts)


def test_different_windows_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring_dedup.xxhash, "xxh3_64_intdigest", lambda w: 1)
    windows, docs = [b"a", b"b", b"a", b"c", b"b", b"a"], np.array([3, 1, 2, 9, 1, 2])
    assert substring_dedup._repeated(docs, windows).tolist() == [True, False, False, False, False, False]


def test_substring_rows_with_null_or_repeated_identifiers(spark):
    text = " ".join(f"x{i}" for i in range(20))
    rows = substring_dedup.without_repeats(documents(spark, [text, text, text, text + " y", None], [2, 2, None, 2, 1])).collect()
    assert sorted(r["n_removed"] for r in rows) == [0, 0, 0, 0, 0]
    rows = substring_dedup.without_repeats(documents(spark, [text, text, text], [2, 2, 1])).collect()
    assert sorted((r["row"]["doc_id"], r["n_removed"]) for r in rows) == [(1, 0), (2, 20), (2, 20)]
    assert substring_dedup.without_repeats(documents(spark, [])).count() == 0


def test_super_kmers_are_packed_in_little_memory():
    import random
    import tracemalloc

    import numpy as np
    import pandas as pd

    from litweave.llm import substring_dedup

    rng = random.Random(1)
    known = [f"word{i}" for i in range(3000)]
    text = " ".join(rng.choices(known, k=20_000))
    docs = pd.DataFrame({"doc_id": range(100), "text_key": [0] * 100, "text": [text] * 100})
    pack = substring_dedup._super_kmers(64, np.empty(0, np.uint64), [w.encode() for w in known[:2000]], 13)
    tracemalloc.start()
    try:
        assert sum(len(rows) for rows in pack(iter([docs])))
        assert tracemalloc.get_traced_memory()[1] < 70e6
    finally:
        tracemalloc.stop()


def test_batches_are_python_objects_a_slice_at_a_time():
    import pyarrow as pa

    from litweave.llm import common

    text = "word " * 40_000
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "text": [text] * 99 + [None]})
    seen = []

    def run(frames):
        for frame in frames:
            seen.append(sum(len(t or "") for t in frame["text"]))
            yield frame[["doc_id"]]

    out = list(common.sliced(run, "doc_id long")(iter([batch, batch.slice(0, 0)])))
    assert [i for b in out for i in b["doc_id"].to_pylist()] == list(range(100))
    assert max(seen) <= common.AT_ONCE + len(text) and sum(seen) == 99 * len(text)


def test_texts_are_cut_a_slice_at_a_time(spark, monkeypatch):
    texts = passages(11)
    plan = substring_dedup.without_repeats(documents(spark, texts))._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan
    monkeypatch.setattr(substring_dedup, "slices", lambda rows, size: ((at, min(3, rows - at)) for at in range(0, rows, 3)))
    rows = substring_dedup.without_repeats(documents(spark, texts)).select("row.doc_id", "kept_text", "n_words", "n_removed").collect()
    assert sorted(map(tuple, rows)) == brute_substring(range(len(texts)), texts)


def test_tasks_give_memory_back_when_done(monkeypatch):
    import pyarrow as pa

    from litweave.llm import common

    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append("given back"))

    def run(batches):
        for b in batches:
            yield b
        seen.append("done")

    assert list(common.released(run)(iter([1, 2]))) == [1, 2] and seen == ["done", "given back"]
    early = common.released(run)(iter([1, 2]))
    next(early)
    early.close()  # as a limit does
    assert seen == ["done", "given back", "given back"]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2]})
    assert [b.num_rows for b in common.sliced(run, "doc_id long")(iter([batch]))] == [2]
    assert seen[3:] == ["done", "given back"]
    monkeypatch.undo()
    common.give_back()
