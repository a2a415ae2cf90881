"""Language, toxicity and quality models: gradients, held-out accuracy, awkward rows."""

import random
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from litweave.llm import language_id, quality_svm, toxicity
from litweave.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"
AWKWARD = [None, "", " ", "123 !?", "é", "\n", "x" * 5000, "a b " * 20000]


# --- language ----------------------------------------------------------------------------


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    net = language_id.Network.fresh(["a", "b", "c"], hidden=3)
    names = ("table", "inner", "out", "bias")
    for name in names:
        setattr(net, name, getattr(net, name).astype(np.float64))
    x, y = rng.integers(0, 257, (5, 4)), np.array([0, 1, 2, 1])
    x[3:, 1] = language_id.PAD

    def loss():
        runs = [net._forward(x, d)[0] for d in (0, 1)]
        z = np.matmul(net.out, np.concatenate(runs, 1)) + net.bias[:, None]
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        known = x != language_id.PAD
        return -(np.log(p[:, y, np.arange(4)]) * known).sum() / known.sum()

    grads = net._gradients(x, y)
    for name, grad in zip(names, grads):
        flat, wanted = getattr(net, name).reshape(-1), grad.reshape(-1)
        for i in rng.permutation(flat.size)[:30]:
            if abs(flat[i]) > 1e3:
                continue  # the closed gate of the padding byte
            old = flat[i]
            flat[i] = old + 1e-3
            high = loss()
            flat[i] = old - 1e-3
            low = loss()
            flat[i] = old
            assert (high - low) / 2e-3 == pytest.approx(wanted[i], abs=1e-3)


def test_pooling_reads_every_byte_and_ignores_batching():
    net = language_id.Network.fresh(["a", "b"])
    texts = [b"abc", b"", b"x" * 1000, bytes(range(256)) * 3, b"tail " * 77]
    together = net.pooled(texts)
    for text, row in zip(texts, together):
        assert net.pooled([text])[0] == pytest.approx(row, abs=1e-5)
        if text:
            assert row.sum() == pytest.approx(1, abs=1e-4)
            head = language_id.SPAN * (len(text) // language_id.SPAN)
            spans = [text[i : i + language_id.SPAN] for i in range(0, len(text), language_id.SPAN)]
            mean = sum(net.pooled([s])[0] * len(s) for s in spans) / len(text)
            assert head <= len(text) and mean == pytest.approx(row, abs=1e-5)


def test_languages_of_held_out_documents(spark):
    got = QUERIES["op1_language_id"](spark, DATA).toPandas()
    known = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(known, on="doc_id")
    assert len(both) == len(known)
    assert (both["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both["doc_id"]]).all()
    held = both[both["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert both["score"].between(0, 1).all()


def test_language_of_awkward_texts(spark):
    learn = spark.createDataFrame(
        [(i, t, g) for i, (t, g) in enumerate([("the cat and the dog " * 5, "en"), ("der hund und die katze " * 5, "de"), (None, "en"), ("x", None)] * 3)],
        "doc_id long, text string, lang string",
    )
    df = spark.createDataFrame([(i, t, "zz") for i, t in enumerate(AWKWARD)], "doc_id long, text string, lang_pred string")
    rows = language_id.with_language(df, learn, F.col("text")).orderBy("doc_id").collect()
    assert [r["language"]["lang_pred"] for r in rows[:4]] == ["und"] * 4 and rows[5]["language"]["lang_pred"] == "und"
    assert {rows[k]["language"]["lang_pred"] for k in (4, 6, 7)} <= {"de", "en"}
    nothing = language_id.with_language(df, learn.where("false"), F.col("text")).collect()
    assert {r["language"]["lang_pred"] for r in nothing} == {"und"}
    assert language_id.with_language(df.where("false"), learn.where("false"), F.col("text")).count() == 0


# --- toxicity ------------------------------------------------------------------------------


def brute_models(texts, labels):
    """The same probabilities from plain dictionaries."""
    seen = {}
    for text, y in zip(texts, labels):
        ids = toxicity.word_ids(text).tolist()
        for k, w in enumerate(ids):
            before = ids[k - 1] if k else toxicity.START
            second = ids[k - 2] if k > 1 else toxicity.START
            seen.setdefault((before, w), {0: set(), 1: set()})[y].add(second)
    words = {}
    for (h, w), by in seen.items():
        for y in (0, 1):
            if by[y]:
                words.setdefault(w, {0: set(), 1: set()})[y].add(h)
    total = {y: sum(len(c[y]) for c in words.values()) for y in (0, 1)}
    both = total[0] + total[1]

    def discount(e):
        return toxicity.DISCOUNT + toxicity.MARGIN * e + toxicity.DOUBT * e**0.5

    def own(y, w):
        c = words.get(w, {0: (), 1: ()})
        n = len(c[0]) + len(c[1])
        return max(len(c[y]) - discount(total[y] * n / both), 0) / max(total[y], 1) if n >= toxicity.LEAST else 0.0

    shared_sum = both + 0.5 * toxicity.WORDS
    spare = {y: 1 - sum(own(y, w) for w in words) for y in (0, 1)}

    def p_word(y, w):
        c = words.get(w, {0: (), 1: ()})
        return own(y, w) + spare[y] * (len(c[0]) + len(c[1]) + 0.5) / shared_sum

    context = {}
    for (h, w), by in seen.items():
        for y in (0, 1):
            context[h, y] = context.get((h, y), 0) + len(by[y])

    def mass(y, h, w):
        by = seen.get((h, w), {0: (), 1: ()})
        n = len(by[0]) + len(by[1])
        if n < toxicity.LEAST:
            return 0.0
        return max(len(by[y]) - discount(context[h, y] * n / (context[h, 0] + context[h, 1])), 0)

    kept = {}
    for h, w in seen:
        for y in (0, 1):
            kept[h, y] = kept.get((h, y), 0) + mass(y, h, w)

    def ratio(text):
        ids = toxicity.word_ids(text).tolist()
        if not ids:
            return 0.0
        each = []
        for k, w in enumerate(ids):
            h = ids[k - 1] if k else toxicity.START
            p = {}
            for y in (0, 1):
                n = max(context.get((h, y), 0), 1)
                rest = max(1 - kept.get((h, y), 0) / n, 1e-3)
                p[y] = mass(y, h, w) / n + rest * p_word(y, w)
            each.append(np.log(p[1]) - np.log(p[0]))
        n = min(len(ids), toxicity.STRETCH)
        return max(sum(each[i : i + n]) / n for i in range(len(each) - n + 1))

    return ratio


def test_ratios_match_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    texts, labels = [], []
    for k in range(300):
        bad = k % 4 == 0
        found = [rng.choice(words) for _ in range(rng.randrange(1, 50))]
        if bad:
            for at in range(0, len(found), 6):
                found[at] = "awful"
                found[at + 1 : at + 2] = ["thing"]
        texts.append(" ".join(found))
        labels.append(int(bad))
    df = spark.createDataFrame(list(zip(texts, labels)), "text string, toxic int").repartition(3)
    sums = df.mapInPandas(toxicity._gather, "part int, packed binary").repartition(2, "part").sortWithinPartitions("part")
    counts = sums.mapInPandas(toxicity._count, "kind string, at long, v0 double, v1 double, v2 double, v3 double")
    counts = counts.groupBy("kind", "at").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(4)])
    models, ratio = toxicity.Models.of(counts.toPandas()), brute_models(texts, labels)
    for text in [*texts[:40], *AWKWARD[:6], "awful thing " * 100]:
        assert models.ratio(text) == pytest.approx(ratio(text), abs=1e-3), text


def test_packets_of_a_group_are_not_merged_one_by_one():
    rng = np.random.default_rng(3)
    words = toxicity.WORDS

    def packet():
        h, w, b = rng.zipf(1.3, 20_000) % 256, rng.zipf(1.2, 20_000) % words, rng.zipf(1.2, 20_000) % words
        return np.unique(((h * words + w) * words + b) * 2 + rng.integers(0, 2, 20_000))

    found = [packet() for _ in range(80)]
    packed = [zlib.compress(np.diff(x, prepend=0).tobytes(), 1) for x in found]
    rows = pd.DataFrame({"part": 0, "packed": packed})
    begin = time.perf_counter()
    counts = pd.concat(toxicity._count(iter([rows.iloc[:50], rows.iloc[50:]])))
    assert time.perf_counter() - begin < 6  # when each was merged with all before it, 2 groups of 50 such packets took 30 s
    every = np.unique(np.concatenate(found))
    got = counts[counts["kind"] == "context"].set_index("at")
    for k, y in enumerate((1, 0)):
        n = np.bincount(every[every % 2 == y] // (2 * words * words), minlength=words)
        assert got[f"v{k}"].to_dict() == {h: n[h] for h in got.index}


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    ids = np.unique(rng.integers(0, toxicity.WORDS, 50))
    frame = {"kind": "word", "at": ids, "v0": rng.integers(0, 40, len(ids)), "v1": rng.integers(1, 90, len(ids)), "v2": 0.0, "v3": 0.0}
    models = toxicity.Models.of(__import__("pandas").DataFrame(frame))
    assert models.word.sum(1) == pytest.approx([1, 1], abs=1e-4)


def test_toxic_documents_are_found_and_clean_ones_left(spark):
    got = QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.1").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(both) == len(docs)
    insults = {"moron", "stupid", "trash", "idiot", "pathetic"}
    bad = both["text"].map(lambda t: len(insults & set(t.lower().split())) > 1)
    assert both.loc[bad, "predicted"].mean() > 0.97
    assert both.loc[~bad, "predicted"].mean() < 0.06
    assert (both["predicted"] == (both["score"] >= 0.5)).all()


def test_toxicity_of_awkward_rows(spark):
    texts = (["you idiot fool " * 3, "a nice day " * 3] * 60) + AWKWARD
    df = spark.createDataFrame([(i if i % 50 else None, t, "x", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, toxicity string, ratio double")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(120)] * 2 + [(None, 1), (5, None), (6, 9)], "doc_id long, toxic int")
    scored = toxicity.with_toxicity(df, labels, F.lit(True))
    rows = scored.collect()
    assert len(rows) == len(texts) and all(0 <= r["toxicity"] <= 1 for r in rows)
    for none in (labels.where("toxic = 1"), labels.where("false")):
        assert len({round(r["toxicity"], 9) for r in toxicity.with_toxicity(df.limit(0), none, F.lit(True)).collect()}) == 0
        assert toxicity.with_toxicity(df, none, F.lit(True)).count() == len(texts)


def test_nothing_is_rejected_without_labels_of_both_classes(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["you idiot fool", "a nice day", "", None] * 5)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(20)], "doc_id long, toxic int")
    elsewhere = labels.withColumn("doc_id", F.col("doc_id") + 100)
    for none in (labels.where("false"), labels.where("toxic = 1"), labels.where("toxic = 0"), elsewhere):
        assert all(r["toxicity"] < 0.5 for r in toxicity.with_toxicity(df, none, F.lit(True)).collect())


def test_few_labels_of_both_classes_do_not_reject_clean_texts(spark):
    texts = ["you idiot fool " * 9 if i % 4 == 0 else f"a nice day number{i} " * 9 for i in range(40)] + ["", None, "plain words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (2, 3, 5, 8):
        labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(size)], "doc_id long, toxic int")
        both = toxicity.fitted(df, labels)
        assert both is not None and both[1] > 0
        assert toxicity.with_toxicity(df, labels, F.lit(True)).where("toxicity < 0.5").count() > 0


def test_all_labelled_texts_but_the_calibration_sample_are_counted(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 4)
    df = spark.createDataFrame([(i, f"only{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    counted = []
    of = toxicity.Models.of
    monkeypatch.setattr(toxicity.Models, "of", lambda counts: counted.append(counts) or of(counts))
    toxicity.fitted(df, labels)
    word = counted[0][counted[0]["kind"] == "word"]
    assert word["v0"].sum() + word["v1"].sum() == 196


def test_the_cut_ignores_wrong_labels_far_away():
    x = np.concatenate([np.linspace(-0.01, 0.01, 90), np.linspace(0.05, 0.3, 20)])
    y = np.concatenate([np.zeros(90), np.ones(20)])
    y[[3, 40, 70]] = 1
    slope, offset = toxicity.calibrated(x, y)
    assert 0.01 < -offset / slope < 0.05


# --- quality ---------------------------------------------------------------------------------


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    y = np.array([int(len({1, 2, 3} & set(r.tolist())) > 0) for r in rows])
    ratio = quality_svm.log_count_ratios(rows, y)
    w, bias = quality_svm.dual_coordinate_descent(rows, y, ratio, epochs=400)
    values = [ratio[r] / np.sqrt(ratio[r] @ ratio[r]) for r in rows]
    limit = len(y) / (2 * np.bincount(y))[y]

    def objective(w, bias):
        margin = np.array([(w[r] @ v + bias) for r, v in zip(rows, values)]) * np.where(y == 1, 1, -1)
        return 0.5 * (w @ w + bias * bias) + (limit * np.maximum(0, 1 - margin)).sum()

    best = objective(w, bias)
    for _ in range(200):
        v = w.copy()
        v[:30] += rng.normal(0, 0.05, 30)
        assert objective(v, bias + rng.normal(0, 0.05)) >= best - 0.02


def test_ratios_of_features():
    rows = [np.array([1, 2]), np.array([1]), np.array([2]), np.array([3])]
    ratio = quality_svm.log_count_ratios(rows, np.array([1, 1, 0, 0]))
    assert ratio[1] == pytest.approx(np.log(3)) and ratio[2] == 0 and ratio[3] == pytest.approx(-np.log(2)) and ratio[9] == 0


def test_quality_of_held_out_documents(spark):
    got = QUERIES["op9_quality"](spark, DATA).toPandas()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    held = both[both["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.93
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_quality_of_awkward_rows(spark):
    texts = (["good plain words here", "*** !! $$$ ***"] * 40) + AWKWARD
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, None, None)], "doc_id long, text string, quality_score string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)] * 2 + [(None, 1), (5, None), (6, 9)], "doc_id long, quality int")
    rows = quality_svm.with_quality(df, labels, F.lit(True)).collect()
    assert len(rows) == len(texts) + 1 and all(0 <= r["quality_score"] <= 1 for r in rows)
    by = {r["text"]: r["quality_score"] for r in rows}
    assert by["good plain words here"] > 0.5 > by["*** !! $$$ ***"]
    assert {r["quality_score"] for r in quality_svm.with_quality(df, labels.where("false"), F.lit(True)).collect()} == {0.5}
    assert quality_svm.with_quality(df.limit(0), labels, F.lit(True)).count() == 0
