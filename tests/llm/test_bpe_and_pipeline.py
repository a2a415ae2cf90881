"""BPE against the tokenizers library; the pipeline against its stages by brute force."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from litweave.llm import bpe
from litweave.llm.queries import QUERIES

from .test_dedup import brute_components, brute_exact, brute_substring
from .test_near_copies import brute_set, similar

FILE = public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def random_texts():
    rng = random.Random(1)
    alphabet = [*"aaabcdetrs  \n\t'0123!?é漢字", "<|endoftext|>", "'ll", "\x1c", "\x85", "　", "😀", "ing", "tion"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(500)]
    every = [chr(c) for c in range(1, 0x3000)] + [chr(c) for c in range(0x10000, 0x10200)]
    texts += [" a".join(c + "b" + c for c in every[i : i + 300]) for i in range(0, len(every), 300)]
    return texts + ["", " ", "a" * 30_000, "ab" * 20_000, " " * 3000, "<|endoftext|>" * 3, "<|endoftext", "\u0000"]


def test_ids_and_texts_equal_the_library(spark, library):
    texts = random_texts()
    df = spark.createDataFrame([(i, t, "i", 1) for i, t in enumerate(texts)] + [(-1, None, None, None)], "doc_id long, text string, ids string, n int")
    file = bpe.shipped(spark, FILE)
    coded = df.select("doc_id", bpe.encoder(file)("text").alias("ids"))
    rows = {r["doc_id"]: r for r in coded.select("*", bpe.decoder(file)("ids").alias("back")).collect()}
    assert rows[-1]["ids"] == [] and rows[-1]["back"] == ""
    for i, found in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert rows[i]["ids"] == found.ids, texts[i]
        assert rows[i]["back"] == library.decode(found.ids, skip_special_tokens=False)


def test_ids_that_cut_a_character(spark, library):
    ids = library.encode("漢字é", add_special_tokens=False).ids
    lists = [ids[:k] for k in range(len(ids) + 1)] + [ids[1:], [50256], None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, ids array<int>")
    got = [r[1] for r in sorted(df.select("k", bpe.decoder(bpe.shipped(spark, FILE))("ids")).collect())]
    assert got == [library.decode(x or [], skip_special_tokens=False) for x in lists]


def test_an_encoder_that_forgets_gives_the_same(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    tool = bpe.Encoder(bpe.Vocabulary(FILE))
    for text in random_texts()[:60]:
        ids, sizes = tool.encode([text, None, text])
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want * 2 and sizes.tolist() == [len(want), 0, len(want)]


def test_digests_of_the_query(spark, library):
    got = {r["doc_id"]: r for r in QUERIES["op10_bpe"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc in docs:
        ids = library.encode(doc["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert tuple(got[doc["doc_id"]])[1:] == want


# --- pipeline ------------------------------------------------------------------------------


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact_dedup", "simhash_near_dedup", "substring_dedup", "packing",
    ]


def test_stages_match_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        seen.append({r["doc_id"]: r.asDict() for r in out.collect()})
        if name != "packing":
            assert out.columns == columns
        docs = out
    raw = {r["doc_id"]: r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    clean, exact, near, cut, packed = seen
    insults = {"moron", "stupid", "trash", "idiot", "pathetic", "worthless", "disgusting"}
    gone = set(raw) - set(clean)
    plain = [i for i in raw if not insults & set(re.findall(r"\w+", raw[i]["text"].lower()))]
    assert len(gone & set(plain)) < 0.1 * len(plain)
    ids = sorted(clean)
    assert set(exact) == {r[0] for r in brute_exact(ids, [clean[i]["text"] for i in ids]) if r[3]}
    ids = sorted(exact)
    sets = [brute_set(exact[i]["text"]) for i in ids]
    roots = brute_components(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if similar(sets[a], sets[b])])
    assert set(near) == {i for k, i in enumerate(ids) if roots[k] == k}
    ids = sorted(near)
    for i, kept, n, lost in brute_substring(ids, [near[i]["text"] for i in ids]):
        assert cut[i]["text"] == (kept if lost else near[i]["text"])
        assert cut[i]["n_chars"] == (len(kept) if lost else near[i]["n_chars"])
        assert packed[i]["n_tokens"] == n - lost
    assert set(packed) == set(cut)


def test_stages_survive_awkward_documents(spark, tmp_path):
    texts = [None, "", "\t ", "same text here", "same text here", "w " * 30_000, "x" * 200_000, "you stupid trash idiot " * 9]
    rows = [(i if i != 4 else None, t, None, "s", i, "k", 0) for i, t in enumerate(texts)] + [(3, "same text here", None, "s", 3, "k", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, part int"
    for k, docs in enumerate((spark.createDataFrame(rows, schema), spark.createDataFrame([], schema))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            if name != "packing":
                assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"{k}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}-{name}"))
        assert (docs.count() > 0) == (k == 0)


def test_no_labels_drop_no_document(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").where("false").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count()
