import datetime as dt

import pytest
from pyspark.sql import functions as F

from litweave import schema
from litweave.functions.text import new_task_id
from litweave.plans.ingest import chunk_rows, parse_papers
from litweave.plans.topic_map import map_topics
from litweave.session import new_folder, shared_folder, written
from litweave.sources import exports, state
from litweave.sources.store import all_chunks, read_table
from litweave.streaming.incremental import ingest_stream

T0 = dt.datetime(2024, 1, 1)


def log(spark):
    rows = [
        ("a", "A", "planning", '{"task_id":"a","topic":"A"}', T0),
        ("a", "A", "reading", '{"task_id":"a","topic":"A","status":"reading"}', T0 + dt.timedelta(1)),
        ("a", "A", "done", '{"task_id":"a","topic":"A","status":"done","artifacts":["x.md"],'
         '"cards":{"p":{"paper_id":"p","title":"T","year":3}}}', T0 + dt.timedelta(2)),
        ("b", "B", "planning", '{"task_id":"b","topic":"B"}', T0 + dt.timedelta(3)),
    ]
    return spark.createDataFrame(rows, schema.TASKS)


def test_latest_and_lists(spark):
    newest = state.latest(log(spark), ["task_id"], ["updated_at"])
    assert [tuple(r) for r in state.list_tasks(newest).collect()] == [("b", "B", "planning"), ("a", "A", "done")]
    summary = {r.task_id: r for r in state.task_summary(newest).collect()}
    assert (summary["a"].cards, summary["a"].artifacts) == (1, ["x.md"])
    assert (summary["b"].cards, summary["b"].artifacts, summary["b"].status) == (0, [], "planning")
    assert state.load_task(newest, "nope").count() == 0
    board = state.load_task(newest, "a").first()
    assert board.cards["p"].title == "T" and board.plan == [] and board.graph is None


def test_boards_survive_the_round_trip(spark, tmp_path):
    boards = state.read_boards(log(spark)).where("status = 'done'")
    state.save_tasks(boards, str(tmp_path / "tasks"))
    state.save_tasks(boards.withColumn("status", F.lit("failed")), str(tmp_path / "tasks"))
    stored = read_table(spark, str(tmp_path / "tasks"), schema.TASKS)
    assert stored.count() == 2
    back = state.load_task(state.latest(stored, ["task_id"], ["updated_at"]), "a").first()
    want = boards.first()
    assert back.status == "failed" and back.cards == want.cards and back.artifacts == want.artifacts


def test_card_memory(spark, tmp_path):
    path = str(tmp_path / "memory")
    for text in ("old", "new"):
        cards = spark.createDataFrame([("p", text)], "paper_id string, card_json string")
        state.remember_cards(cards, path)
    memory = read_table(spark, path, schema.MEMORY_CARDS)
    wanted = spark.createDataFrame([("p",), ("q",)], "paper_id string")
    got = dict(state.recall_cards(wanted, memory).collect())
    assert got == {"p": "new", "q": None}


def test_stringify(spark):
    df = spark.createDataFrame([("text", ["a"])], "s string, l array<string>")
    row = df.select(state.stringify(df, "s").alias("s"), state.stringify(df, "l").alias("l")).first()
    assert tuple(row) == ("text", '["a"]')


@pytest.mark.parametrize("n,spilled", [(4000, False), (4001, True)])
def test_spill_boundary(spark, n, spilled):
    df = spark.createDataFrame([("x" * n,)], "c string")
    got = exports.spill_large(df, "c", F.lit("/p/x.txt")).first().c
    assert got.startswith("[大输出已落盘: /p/x.txt]\n摘要(前500字):\n" + "x" * 500) == spilled
    assert exports.spilled_texts(df, "c").count() == int(spilled)


def test_reviews_and_graphs_are_exported(spark, tmp_path):
    reviews = spark.createDataFrame(
        [("a", "review_Deep  Nets!", "line 1\nline 2"), ("b", "!!", "other")],
        "task_id string, title string, content string",
    )
    paths = exports.export_md(reviews, str(tmp_path / "md"))
    boards = state.read_boards(log(spark)).where("status in ('done', 'planning')").dropDuplicates(["task_id"])
    once = exports.register_artifacts(boards, paths)
    twice = exports.register_artifacts(once, paths)
    got = {r.task_id: r.artifacts for r in twice.collect()}
    assert got["b"] == [f"{tmp_path}/md/slug=unknown"]
    assert spark.read.text(got["b"][0], wholetext=True).first()[0] == "other\n"
    assert spark.read.text(f"{tmp_path}/md/slug=review_deep_nets").count() == 2


def test_of_equal_slugs_the_last_is_written(spark, tmp_path):
    reviews = spark.createDataFrame([("a", "Deep Nets", "AAA"), ("b", "deep nets!", "BBB")], "task_id string, title string, content string")
    paths = exports.export_md(reviews, str(tmp_path / "md"))
    assert paths.select("path").distinct().count() == 1
    assert spark.read.text(str(tmp_path / "md"), wholetext=True).first()[0] == "BBB\n"


def test_spilled_texts_are_stored(spark, tmp_path):
    df = spark.createDataFrame([(1, "x" * 5000), (2, "short")], "i int, c string")
    kept = exports.spill(df, "c", F.concat(F.lit("/p/"), F.col("i").cast("string")), str(tmp_path / "side"))
    assert kept.where("i = 2").first().c == "short" and kept.where("i = 1").first().c != "x" * 5000
    assert spark.read.parquet(str(tmp_path / "side")).collect() == [("/p/1", "x" * 5000)]


def test_graph_export(spark, sf, tmp_path):
    import driver_tables as inputs

    g = inputs.graph(spark, sf)
    exports.export_graph(g, str(tmp_path / "graph"))
    lines = spark.read.text(str(tmp_path / "graph")).count()
    assert lines == g.nodes.count() + g.members.count() + g.edges.count() + g.gaps.count()


def test_task_ids(spark):
    ids = written(spark.range(50).select(new_task_id().alias("i")), "ids")
    got = [r.i for r in ids.collect()]
    assert len(set(got)) == 50 and all(len(i) == 8 and int(i, 16) >= 0 for i in got)


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named
    assert new_folder(spark, "x") != new_folder(spark, "x")


def test_stream_equals_batch_and_repeats_add_nothing(spark, sf, tmp_path):
    import driver_tables as inputs

    documents = spark.read.parquet(f"{sf}/documents.parquet")
    source = str(tmp_path / "in")
    path = str(tmp_path / "chunks")
    documents.where("doc_id < 20").coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint):
        stream = spark.readStream.schema(documents.schema).parquet(source)
        ingest_stream(inputs.papers_of(stream), path, str(tmp_path / checkpoint)).awaitTermination()
        return all_chunks(spark, path)

    first = run("c1").count()
    documents.where("doc_id between 10 and 40").coalesce(1).write.mode("append").parquet(source)
    second = run("c1")
    batch = chunk_rows(parse_papers(inputs.papers_of(documents.where("doc_id <= 40"))))
    assert first < second.count() == batch.count()
    assert batch.select(*second.columns).exceptAll(second).count() == 0
    assert run("c2").count() == batch.count()


def test_topics_are_mapped(spark, sf):
    import driver_tables as inputs

    topics = inputs.queries(spark, sf).where("query_id in ('q0', 'q1', 'q2')").withColumnsRenamed(
        {"query_id": "task_id", "text": "topic"}
    )
    empty = spark.createDataFrame([], "task_id string, seq long, type string, result_preview string")
    finals = spark.createDataFrame([], "task_id string, final_text string")
    mapped = map_topics(
        topics, inputs.doc_chunks(spark, sf), inputs.vectors(spark, sf), empty, finals,
        inputs.card_raw(spark, sf).select("paper_id", "final_text"), finals,
    )
    assert mapped.candidates.count() == 24
    missing = mapped.candidates.join(mapped.cards, ["task_id", "paper_id"], "left_anti").count()
    assert mapped.cards.count() == 24 - missing
    assert {r.status for r in mapped.tasks.collect()} == {"done"}
    assert mapped.reviews.count() == mapped.verdicts.count() == 3
    reread = mapped.rework.where("action = 'read'").count()
    assert reread == missing
