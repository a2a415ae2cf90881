"""Inputs for the registered queries, derived by Spark from the given tables.

The tables hold no fonts, dates, citations or model output, so those are computed from columns of
`documents`, `benchmark`, `labels`, `embeddings` and `conversations`. `driver_sql.py` states the
same rules in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litweave.operators.cards import parse_cards
from litweave.operators.graph import Graph, build_graph
from litweave.operators.keyword_index import KeywordIndex, build_keyword_index
from litweave.operators.quality import check_quotes
from litweave.plans.ingest import chunk_rows, parse_papers
from litweave.session import written
from litweave.sources.papers import lines_of_text
from litweave.sources.store import list_papers

PAGE_LINES = 20
SHORT_LINE = 35


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paper_id(doc_id: Column) -> Column:
    return F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 12)


def dated_text(doc_id: Column, text: Column) -> Column:
    """The document text, every second one with a line that tells its year."""
    year = 2000 + doc_id % 25
    stamp = F.format_string("\narXiv:%02d05.01234", doc_id % 25)
    return (
        F.when(doc_id % 4 == 1, F.concat(text, stamp))
        .when(doc_id % 4 == 2, F.concat(text, F.lit("\nPublished in "), year.cast("string")))
        .otherwise(text)
    )


def papers_of(documents: DataFrame) -> DataFrame:
    """documents → papers(paper_id, source, stem, creation_date, lines)."""
    doc_id = F.col("doc_id")
    lines = lines_of_text(
        dated_text(doc_id, F.col("text")),
        page=lambda i: F.floor(i / PAGE_LINES),
        size=lambda t: F.when(F.length(t) <= SHORT_LINE, 14.0).otherwise(10.0),
    )
    created = F.concat(F.lit("D:"), (1980 + doc_id % 45).cast("string"), F.lit("0101"))
    return documents.select(
        paper_id(doc_id).alias("paper_id"),
        "source",
        F.concat(F.lit("doc"), doc_id.cast("string")).alias("stem"),
        F.when(doc_id % 4 == 0, created).alias("creation_date"),
        lines.alias("lines"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table. One small file would be one task, so it is spread over the cores; a
    table of many files is read in parallel as it is."""
    found = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    if len(found.inputFiles()) < cores:
        found = found.repartition(cores, "doc_id")
    return found


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers_of(documents(spark, sf_dir))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_papers(papers(spark, sf_dir))


_stored: dict[tuple[str, str, str], DataFrame] = {}


def stored(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """A derived table, written to the shared folder once per session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = written(build(), name)
    return _stored[key]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table of all documents."""
    return stored(spark, sf_dir, "chunks", lambda: chunk_rows(parsed(spark, sf_dir)))


_indexes: dict[tuple[str, str, str], KeywordIndex] = {}


def chunk_index(spark: SparkSession, sf_dir: str) -> KeywordIndex:
    """The keyword index of the chunk table, built once per session and data folder."""
    return _index(spark, sf_dir, "chunks", lambda: chunks(spark, sf_dir))


def doc_index(spark: SparkSession, sf_dir: str) -> KeywordIndex:
    """The keyword index of whole documents."""
    return _index(spark, sf_dir, "documents", lambda: doc_chunks(spark, sf_dir))


def _index(spark: SparkSession, sf_dir: str, name: str, corpus: Callable[[], DataFrame]) -> KeywordIndex:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _indexes:
        _indexes[key] = build_keyword_index(corpus())
    return _indexes[key]


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per benchmark passage; its vector is the embedding with the same number."""
    items = table(spark, sf_dir, "benchmark")
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), "embedding"
    )
    return items.join(vectors, "item_id", "left").select(
        F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"),
        "text",
        "embedding",
    )


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as one chunk each, the level at which vectors exist."""
    pid = paper_id(F.col("doc_id"))
    return documents(spark, sf_dir).select(
        F.concat(pid, F.lit("_0")).alias("chunk_id"),
        pid.alias("paper_id"),
        F.col("text"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.when(F.col("doc_id") % 4 == 3, 0).otherwise(2000 + F.col("doc_id") % 25).cast("int").alias("year"),
        "source",
        F.lit("_front").alias("section"),
        F.lit(0).alias("page"),
        F.lit(0).alias("start_page"),
        F.lit(0).alias("chunk_index"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.concat(paper_id(F.col("vec_id")), F.lit("_0")).alias("chunk_id"), "embedding"
    )


def paper_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_papers(chunks(spark, sf_dir))


def passages(spark: SparkSession, sf_dir: str) -> Column:
    """How many benchmark passages there are."""
    return table(spark, sf_dir, "benchmark").select(F.count("*")).scalar()


def with_passage(spark: SparkSession, sf_dir: str, df: DataFrame, number: str, items: DataFrame) -> DataFrame:
    """Each row with the passage of items(item_id, …) that its number falls to."""
    numbered = df.withColumn("item_id", F.col(number) % passages(spark, sf_dir))
    return numbered.join(items, "item_id")


def paper_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per document, to be answered inside that document."""
    documents = table(spark, sf_dir, "documents").select("doc_id")
    items = table(spark, sf_dir, "benchmark")
    return with_passage(spark, sf_dir, documents, "doc_id", items).select(
        F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("query_id"),
        paper_id(F.col("doc_id")).alias("paper_id"),
        "text",
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per embedding, to be answered inside the document of the same number."""
    items = table(spark, sf_dir, "benchmark")
    own = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return with_passage(spark, sf_dir, own, "vec_id", items).select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("query_id"),
        paper_id(F.col("vec_id")).alias("paper_id"),
        "text",
        "embedding",
    )


def finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final text of a retrieval run per benchmark passage, naming known and unknown ids."""
    item = F.col("item_id")
    named = F.concat(
        F.lit("Candidates: "), paper_id(item * 2), F.lit(", xx"), paper_id(item), F.lit("\n"),
        paper_id(item + 3),
    )
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("q"), item.cast("string")).alias("query_id"), named.alias("final_text")
    )


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool trace from the conversations; some observations name a paper id."""
    conv, turn = F.col("conv_id"), F.col("turn")
    preview = F.when(
        (conv % 3 == 0) & (turn == 1),
        F.concat(paper_id(conv * 5), F.lit(" "), F.col("text")),
    ).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("q"), (conv % passages(spark, sf_dir)).cast("string")).alias("query_id"),
        (conv * 1000 + turn).alias("seq"),
        F.when(F.col("role") == "assistant", "observe").otherwise("act").alias("type"),
        preview.alias("result_preview"),
    )


def _clean(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]+", " ")


def card_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON card per document, with the irregularities of model output."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    rated = table(spark, sf_dir, "labels").dropDuplicates(["doc_id"])
    rows = with_passage(spark, sf_dir, documents, "doc_id", items).join(rated, "doc_id", "left")
    doc = F.col("doc_id")

    def s(c: Column) -> Column:
        return c.cast("string")

    def case(n: int, *values, last) -> Column:
        out = F.when(doc % n == 0, values[0])
        for i, value in enumerate(values[1:], 1):
            out = out.when(doc % n == i, value)
        return out.otherwise(last)

    own_quote = _clean(F.coalesce(F.get(F.split("text", "\n"), (doc % 3).cast("int")), F.lit("")))
    rating = F.when(F.col("quality").isNull(), F.lit("not labelled")).otherwise(
        F.concat(F.lit("quality "), s(F.col("quality")), F.lit(" toxic "), s(F.col("toxic")))
    )
    parts = [
        F.lit('{"paper_id":"evil","foo":{"a":[1]},"title":"'),
        F.when(doc % 5 == 0, "").otherwise(F.concat(F.lit("Study "), s(doc), F.lit(" of "), F.col("lang"))),
        F.lit('","year":'),
        case(6, F.lit("2024"), F.lit('" 2023 "'), F.lit("2022.9"), F.lit('"n/a"'), F.lit("null"), last=F.lit('"2021.5"')),
        F.lit(',"core_claim":"Claim '), s(doc), F.lit('"'),
        F.when(doc % 3 == 1, "").otherwise(F.concat(F.lit(',"method":"Method '), s(doc % 9), F.lit('"'))),
        F.lit(',"method_family":"'),
        case(
            4,
            F.concat(F.lit("Graph Method "), s(doc % 3)),
            F.concat(F.lit("graph-method "), s(doc % 3)),
            F.concat(F.col("lang"), F.lit(" survey")),
            last=F.lit(""),
        ),
        F.lit('","key_results":'),
        case(3, F.lit('["a","b","c","d"]'), F.lit('"single"'), last=F.lit("[]")),
        F.lit(',"opposes":'),
        case(
            3,
            F.concat(
                F.lit('["study '), s(doc + 1), F.lit(' of"," GRAPH method '), s((doc + 1) % 3),
                F.lit('","unseen view '), s(doc % 5), F.lit('"]'),
            ),
            F.concat(F.lit('"Unseen View '), s(doc % 5), F.lit('"')),
            last=F.when(doc % 2 == 0, '""').otherwise("null"),
        ),
        F.lit(',"limitations":["small data"," small data ","'), rating, F.lit('"]'),
        F.lit(',"evidence_spans":'),
        case(
            7,
            F.lit("[]"),
            F.concat(F.lit('"'), own_quote, F.lit('"')),
            last=F.concat(
                F.lit('[{"quote":"'), own_quote, F.lit('","page":'), s(doc % 3), F.lit('},"'),
                _clean(F.col("passage")), F.lit('",{"page":1},"tiny"]'),
            ),
        ),
        F.lit("}"),
    ]
    return rows.select(
        F.concat(F.lit("t"), s(F.floor(doc / 8))).alias("task_id"),
        (doc % 8).cast("int").alias("pos"),
        "doc_id",
        paper_id(doc).alias("paper_id"),
        F.concat(*parts).alias("body"),
    )


def card_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model text around each card: fenced, bare, chatty or broken; some cards are missing."""
    doc, body = F.col("doc_id"), F.col("body")
    text = (
        F.when(doc % 16 == 3, F.concat(F.lit("```json\n{bad}\n``` then "), body))
        .when(doc % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(doc % 4 == 1, F.concat(F.lit("Here is the card: "), body, F.lit(" Done.")))
        .when(doc % 4 == 2, body)
        .otherwise(F.concat(F.lit("``` "), body, F.lit(" ``` and more")))
    )
    cards = card_json(spark, sf_dir).where(doc % 11 != 5)
    return cards.select("task_id", "pos", "paper_id", text.alias("final_text"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed cards, parsed once per session and data folder."""
    return stored(
        spark, sf_dir, "cards",
        lambda: parse_cards(card_raw(spark, sf_dir), paper_list(spark, sf_dir)),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of eight documents each."""
    number = F.floor(F.col("doc_id") / 8).cast("string")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("t"), number).alias("task_id"),
        F.concat(F.lit("Topic "), number).alias("topic"),
    ).distinct()


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("t"), F.floor(doc / 8).cast("string")).alias("task_id"),
        paper_id(doc).alias("paper_id"),
        (doc % 8).cast("int").alias("rank"),
    )


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review text a model wrote last for each task, some with placeholders."""
    doc = F.col("doc_id")
    text = F.when(doc % 3 == 0, F.concat("text", F.lit(" TODO"))).otherwise(F.col("text"))
    written_by = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("t"), F.floor(doc / 8).cast("string")).alias("task_id"), "doc_id", text.alias("final_text")
    )
    return written_by.groupBy("task_id").agg(F.max_by("final_text", "doc_id").alias("final_text"))


def first_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review text that each task stored first."""
    task = F.concat(F.lit("t"), F.floor(F.col("doc_id") / 8).cast("string"))
    return table(spark, sf_dir, "documents").groupBy(task.alias("task_id")).agg(F.min_by(F.coalesce("text", F.lit("")), "doc_id").alias("stored_text"))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of all tasks, each of its tables written once per session and data folder."""
    built = build_graph(cards(spark, sf_dir))
    return Graph(
        *[stored(spark, sf_dir, f"graph-{name}", lambda df=df: df) for name, df in zip(Graph._fields, built)]
    )


def checked_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(
        spark, sf_dir, "checked-quotes",
        lambda: check_quotes(cards(spark, sf_dir), chunks(spark, sf_dir)),
    )


def task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of task states from the event stream, one task per user."""
    user = F.col("user_id").cast("string")
    board = F.when(
        F.col("event_id") % 2 == 0,
        F.concat(
            F.lit('{"task_id":"u'), user, F.lit('","topic":"user '), user,
            F.lit('","status":"done","cards":{"p1":{"paper_id":"p1","title":"'), F.col("event_type"),
            F.lit('"}},"artifacts":["'), F.col("event_type"), F.lit('.md"]}'),
        ),
    ).otherwise(F.concat(F.lit('{"task_id":"u'), user, F.lit('","topic":"user '), user, F.lit('"}')))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), user).alias("task_id"),
        F.concat(F.lit("user "), user).alias("topic"),
        F.when(F.col("event_id") % 2 == 0, "done").otherwise("planning").alias("status"),
        board.alias("blackboard"),
        F.col("ts").alias("updated_at"),
        "event_id",
    )
