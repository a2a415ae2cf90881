import pytest
from pyspark.sql import functions as F

from litweave import schema
from litweave.operators import quality, review
from litweave.operators.cards import card_briefs, parse_cards, task_briefs
from litweave.operators.gaps import detect_gaps
from litweave.operators.graph import build_graph, cluster_cards, graph_totals, with_strength
from litweave.operators import matching
from litweave.operators.matching import first_match


def card(task, pos, pid, title="", family="", opposes=(), limits=(), quotes=(), year=0, **kw):
    return (
        task, pos, pid, title, [], year, None, kw.get("claim", ""), kw.get("method", ""), family,
        list(kw.get("results", [])), [], list(opposes), list(limits),
        [(q, None, None) for q in quotes],
    )


def cards(spark, rows):
    return spark.createDataFrame(rows, schema.CARDS)


def golden_a(spark):
    rows = [
        card("t", i, f"p{i}", f"Title {'ABCD'[i]}", f"fam {'wxyz'[i]}", [f"view {k}" for k in range(2 * i, 2 * i + 2)] if i < 3 else [], [f"limit {i}"])
        for i in range(4)
    ]
    return cards(spark, rows)


def golden_b(spark):
    return cards(
        spark,
        [
            card("t", 0, "p0", "Deep Recommenders", "RQ VAE", ["  SASREC ", "rq vae", "deep"], ["cost", " cost"], ["own words"]),
            card("t", 1, "p1", "SASRec revisited", "rq-vae", ["", "semantic ids for all"], ["x"], []),
            card("t", 2, "p2", "Semantic IDs", "", [], ["x", "y", "z"]),
            card("t", 3, "p3", "semantic ids", "Other", ["nothing alike"], ["y", "z", ""]),
            card("t", 4, "p4", "", "Other", ["NOTHING alike!"], []),
        ],
    )


def test_golden_sizes(spark):
    g = build_graph(golden_a(spark))
    tasks = spark.createDataFrame([("t",), ("none",)], "task_id string")
    got = {r.task_id: (r.nodes, r.edges, r.gaps) for r in graph_totals(tasks, g).collect()}
    assert got == {"t": (14, 10, 5), "none": (0, 0, 0)}


def test_clusters_go_by_slug_and_gaps_by_label(spark):
    df = golden_b(spark)
    got = {r.cluster_id: (r.label, r.n_members) for r in cluster_cards(df).collect()}
    assert got == {"family::rq_vae": ("RQ VAE", 2), "family::未分类": ("未分类", 1), "family::other": ("Other", 2)}
    gaps = detect_gaps(df).orderBy("part", "pos").collect()
    singles = [g.gap for g in gaps if g.part == 1]
    assert len(singles) == 2 and "RQ VAE" in singles[0] and "rq-vae" in singles[1]
    limits = [g.gap.split(": ")[1] for g in gaps if g.part == 2]
    assert limits == ["cost", "x", "y"]  # z is tied at 2 but fourth
    assert [g.part for g in gaps][-1] == 3


def test_cluster_subset_orders_and_selects(spark):
    got = cluster_cards(golden_b(spark), ["p1", "p0"]).collect()
    assert [(r.label, r.n_members, r.first_pos) for r in got] == [("rq-vae", 2, 0)]


def test_opposition_targets(spark):
    g = build_graph(golden_b(spark))
    edges = g.edges.where("relation = 'opposes'").orderBy("p1", "p2").collect()
    assert [(e.source, e.target) for e in edges] == [
        ("p0", "p1"), ("p0", "family::rq_vae"), ("p0", "p0"),
        ("p1", "viewpoint::unknown"), ("p1", "p3"),
        ("p3", "viewpoint::nothing_alike"), ("p4", "viewpoint::nothing_alike"),
    ]
    assert [list(e.evidence) for e in edges][:4] == [["own words"]] * 3 + [[]]
    views = g.nodes.where("type = 'viewpoint'").orderBy("p1").collect()
    assert [(v.id, v.label) for v in views] == [
        ("viewpoint::unknown", ""), ("viewpoint::nothing_alike", "nothing alike"),
    ]
    weak = with_strength(g.edges).where("strength = 'possibly_related'").count()
    assert weak == quality.edges_without_evidence(g.edges).count() == 4


def test_edge_ends_are_nodes(spark, sf):
    import driver_tables as inputs

    g = inputs.graph(spark, sf)
    ends = g.edges.select("task_id", F.explode(F.array("source", "target")).alias("id"))
    assert ends.join(g.nodes, ["task_id", "id"], "left_anti").count() == 0


def test_first_match_equals_all_pairs(spark):
    import random

    rng = random.Random(6)
    names = sorted({"".join(rng.choice("ab ") for _ in range(rng.randint(1, 7))) for _ in range(60)} - {""})
    texts = [(k, "".join(rng.choice("ab ") for _ in range(rng.randint(1, 9)))) for k in range(40)]
    texts = list({t: (k, t) for k, t in texts}.values())
    targets = [("t", k % 2, k, t, f"id{k}") for k, t in texts]
    got = first_match(
        spark.createDataFrame([("t", n) for n in names] + [("other", "a")], "task_id string, name string"),
        spark.createDataFrame(targets, "task_id string, kind int, pos int, text string, target string"),
    )
    want = {}
    for n in names:
        hits = [(kind, k, i) for _, kind, k, t, i in targets if n in t or t in n]
        if hits:
            want[n] = min(hits)[2]
    assert {r.name: r.target for r in got.collect()} == want


def test_no_oppositions_and_no_gaps(spark):
    df = cards(spark, [card("t", 0, "a"), card("t", 1, "b")])
    assert [(r.part, r.gap[:4]) for r in detect_gaps(df).collect()] == [(4, "卡片信息")]


RAW = [
    ("t", 0, "a", '```json\n{"title":"","year":"2024","opposes":"x","paper_id":"evil"}\n```'),
    ("t", 1, "b", 'Card: {"title":"Own","year":"n/a","authors":["X"],"junk":1} end'),
    ("t", 2, "c", "```json\n{oops}\n``` {\"title\":\"late\"}"),
    ("t", 3, "d", '["list"]'),
]


def test_cards_from_text(spark):
    raw = spark.createDataFrame(RAW, schema.CARD_RAW)
    papers = spark.createDataFrame([("a", "Known A", 1999), ("b", "Known B", 2001), ("c", "Known C", 2002)], "paper_id string, title string, year int")
    got = {r.paper_id: r for r in parse_cards(raw, papers).collect()}
    assert (got["a"].title, got["a"].year, got["a"].opposes) == ("Known A", 2024, ["x"])
    assert (got["b"].title, got["b"].year, got["b"].authors) == ("Own", 2001, ["X"])
    assert (got["c"].title, got["c"].opposes, got["c"].venue) == ("Known C", [], None)
    assert (got["d"].title, got["d"].year) == ("", 0)


def test_briefs(spark):
    df = cards(spark, [card("t", 0, "p", "T", "F", ["a", "b"], year=2020, claim="C"), card("t", 1, "q")])
    tasks = spark.createDataFrame([("t",), ("u",)], "task_id string")
    got = [r.brief for r in task_briefs(tasks, card_briefs(df)).orderBy("task_id", "pos").collect()]
    assert got == [
        "- [p] T (2020) | 流派: F | 核心主张: C | 对立: a, b",
        "- [q] ? (?) | 流派: ? | 核心主张: ? | 对立: 无",
        "(无卡片)",
    ]


SOURCE = "the quick brown fox jumps over the lazy dog near the river bank"


def gate(spark):
    quotes = [
        "quick brown fox", "lazy dog purple cow", "short", "entirely different words here",
        "also not from this paper at all",
    ]
    df = cards(
        spark,
        [
            card("t", 0, "a", "A", "F", ["nothing"], [], quotes[:4]),
            card("t", 1, "b", "B", "F", [], [], [quotes[0], quotes[4]]),
            card("u", 0, "a", "A", "F", [], [], [quotes[0]]),
        ],
    )
    chunk_rows = [("a_0", "a", SOURCE, 0), ("a_1", "a", "unrelated text", 1), ("b_0", "b", "other words", 0)]
    chunks = spark.createDataFrame(chunk_rows, "chunk_id string, paper_id string, text string, chunk_index int")
    return df, chunks.withColumn("year", F.lit(2020))


def test_quotes_are_checked_in_their_paper(spark):
    df, chunks = gate(spark)
    checked = {(r.task_id, r.paper_id, r.quote_pos): r.verified for r in quality.check_quotes(df, chunks).collect()}
    assert checked == {
        ("t", "a", 0): True, ("t", "a", 1): True,  # half of the words is enough
        ("t", "b", 0): False, ("t", "b", 1): False, ("u", "a", 0): True,
    }


def test_vectors_of_chunks_and_quotes_are_made_once(spark):
    df, chunks = gate(spark)

    def made(frame, schema):
        calls = spark.sparkContext.accumulator(0)

        def run(batches):
            for batch in batches:
                calls.add(len(batch))
                yield batch.assign(embedding=[[1.0, 0.0]] * len(batch))

        return calls, frame.mapInPandas(run, schema)

    quotes = quality.quotes_to_check(df).select("quote").distinct()
    of_quotes, quote_vectors = made(quotes, "quote string, embedding array<float>")
    of_chunks, vectors = made(chunks.select("chunk_id"), "chunk_id string, embedding array<float>")
    checked = quality.check_quotes(df, chunks, vectors, quote_vectors)
    got = {(r.task_id, r.paper_id, r.quote_pos): r.verified for r in checked.collect()}
    assert got == {(r.task_id, r.paper_id, r.quote_pos): r.verified for r in quality.check_quotes(df, chunks).collect()}
    assert (of_quotes.value, of_chunks.value) == (quotes.count(), 3)


def test_quote_without_any_chunk_is_bad(spark):
    df, chunks = gate(spark)
    checked = quality.check_quotes(df, chunks.where("paper_id = 'b'"))
    assert checked.where("verified").count() == 0


def test_verdicts_and_rework(spark):
    df, chunks = gate(spark)
    tasks = spark.createDataFrame([("t", "T"), ("u", "U"), ("v", "V"), ("w", "W")], "task_id string, topic string")
    candidates = spark.createDataFrame(
        [("t", "a", 0), ("t", "b", 1), ("u", "a", 0), ("v", "x", 1), ("v", "y", 0)],
        "task_id string, paper_id string, rank int",
    )
    g = build_graph(df)
    missing = quality.missing_cards(candidates, df)
    bad = quality.unverified_quotes(quality.check_quotes(df, chunks))
    rows = quality.verdicts(tasks, quality.issues(tasks, missing, bad, g.nodes, g.edges))
    got = {r.task_id: r for r in rows.collect()}
    assert [got[t].passed for t in "tuvw"] == [False, True, False, False]
    assert got["t"].issues == [
        "引用真实性: 2 条 evidence_spans 无法在原文中回溯 (疑似幻觉): "
        "['quick brown fox', 'also not from this paper at all']",
    ]
    assert got["v"].issues[0] == "完整性: 2 篇候选论文缺少精读卡片: ['y', 'x']"
    assert len(got["v"].suggestions) == 2
    actions = sorted((r.task_id, r.action, r.paper_id or "") for r in quality.rework(rows, missing, g.nodes).collect())
    assert actions == [
        ("t", "stop", ""), ("v", "read", "x"), ("v", "read", "y"), ("v", "synthesize", ""),
        ("w", "synthesize", ""),
    ]


def test_opposition_without_evidence_is_an_issue(spark):
    df = cards(spark, [card("t", 0, "a", "A", "F", ["b", "c"])])
    g = build_graph(df)
    tasks = spark.createDataFrame([("t", "T")], "task_id string, topic string")
    none = spark.createDataFrame([], "task_id string, paper_id string, rank int")
    bad = spark.createDataFrame([], "task_id string, pos int, paper_id string, quote_pos int, quote string")
    got = quality.issues(tasks, none, bad, g.nodes, g.edges).collect()
    assert [r.issue for r in got] == ["关系证据: 2 条 opposes 边缺少 evidence 支撑。"]


def test_review_text(spark):
    df = cards(
        spark,
        [
            card("t", 0, "a", "A", "Fam", ["unseen"], [], ["q"], year=2020, claim="C", method="M", results=["1", "2", "3", "4"]),
            card("t", 1, "b", "", "fam"),
        ],
    )
    tasks = spark.createDataFrame([("t", "T"), ("e", "Empty")], "task_id string, topic string")
    pieces = review.review_pieces(tasks, df, build_graph(df))
    got = {r.task_id: r.review for r in review.review_text(pieces).collect()}
    assert got["t"] == "\n".join(
        [
            "# 综述初稿：T\n", "## 1. 方法流派概览\n", "- **Fam**：A, b",
            "\n## 2. 论文要点\n",
            "### A (2020)", "- 核心主张：C", "- 方法：M", "- 关键结果：1; 2; 3", "",
            "### b (?)", "- 核心主张：（未提取）", "- 方法：（未提取）", "",
            "## 3. 观点分歧与立场对立\n", "- A ↔ unseen：A 在卡片中声明与「unseen」对立",
            "\n## 4. 研究空白\n",
            "- 方法流派「Fam」仅有单篇代表, 缺乏横向对比与复现验证。",
            "- 方法流派「fam」仅有单篇代表, 缺乏横向对比与复现验证。",
            "- 存在方法/观点对立, 但卡片中尚无明确的演进 (evolves_to) 路径衔接, 是潜在的研究空白。",
        ]
    )
    assert got["e"].startswith("# 综述初稿：Empty\n\n## 1.") and got["e"].endswith("## 4. 研究空白\n")


@pytest.mark.parametrize(
    "final,stored,want",
    [("x" * 300, "y" * 300, "x" * 300), ("x" * 300, "y" * 301, "y" * 301), ("x" * 10, None, "R"), ("x" * 300 + "todo", None, "R"), (None, None, "R")],
)
def test_choice(spark, final, stored, want):
    reviews = spark.createDataFrame([("t", "R")], "task_id string, review string")
    finals = spark.createDataFrame([("t", final)], "task_id string, final_text string")
    existing = spark.createDataFrame([("t", stored)], "task_id string, stored_text string")
    assert review.choose_review(reviews, finals, existing).first().review == want


def test_lists_in_issues_are_quoted(spark):
    items = ["plain", "it's", 'say "x"', "it's \"x\"", "back\\slash", "line\nbreak"]
    df = spark.createDataFrame([(items,)], "a array<string>")
    assert df.select(quality._quoted(F.col("a"))).first()[0] == repr(items)


def test_first_match_by_pairs_and_by_grams(spark, monkeypatch):
    names = [(f"t{t}", n) for t in range(3) for n in ("a", "view a", "ab c", "study 1", "xyz", "", None)[: 3 + 2 * t]]
    targets = [
        (f"t{t}", kind, pos, text, f"{kind}-{pos}")
        for t in range(3)
        for kind, pos, text in ((1, 0, "ab"), (0, 2, "study 12 of"), (0, 1, "the study 1"), (1, 3, "view"), (1, 4, ""))
    ]
    asked = spark.createDataFrame(names, "task_id string, name string")
    given = spark.createDataFrame(targets, "task_id string, kind int, pos int, text string, target string")
    want = set()
    for task, name in names:
        near = [r for r in targets if r[0] == task and name and r[3] and (name in r[3] or r[3] in name)]
        if near:
            want.add((task, name, min(near, key=lambda r: r[1:3])[4]))
    for most in (0, 20, matching.PAIRS):
        monkeypatch.setattr(matching, "PAIRS", most)
        found = first_match(asked, given)
        assert {tuple(r) for r in found.select("task_id", "name", "target").collect()} == want
        # Rows of grams are far more than Spark's estimate, so no side may be sent whole to every task.
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
