
from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import driver_sql as sql  # noqa: E402
import litweave  # noqa: E402
import driver_tables as inputs  # noqa: E402
from litweave import fixed, schema  # noqa: E402
from litweave.functions import json_text, text  # noqa: E402
from litweave.operators import (  # noqa: E402
    bm25 as keyword, candidates, cards as card_ops, fusion, gaps, graph as graph_ops, keyword_index, quality,
    review, structure, vectors,
)
from litweave.plans import ingest  # noqa: E402
from litweave.plans.topic_map import map_topics  # noqa: E402
from litweave.session import new_folder  # noqa: E402
from litweave.sources import exports, papers as paper_source, state, state_log, store  # noqa: E402
from litweave.sources.buckets import BucketStore  # noqa: E402
from litweave.sources.vector_cache import VectorCache  # noqa: E402
from litweave.streaming.incremental import ingest_stream  # noqa: E402

# Python functions travel to the workers by value, so these need no copy of the package and the
# queries run from any working directory.
cloudpickle.register_pickle_by_value(litweave)
if __name__ in sys.modules:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        _QUERIES[name] = run
        if oracle is not None:
            _ORACLES[name] = sql.select(oracle)
        return run

    return register


def _score(name: str = "score"):
    return F.round(name, 6).alias(name)


HITS = "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM {}"


# --- ingest ---------------------------------------------------------------------


@query("text_lines", "SELECT paper_id, page, line_no, text, size FROM doc_lines")
def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    return paper_source.line_rows(inputs.papers(spark, sf))


_SPANS = """
  SELECT paper_id, page, line_no, x AS text, size FROM (
    SELECT l.paper_id, page, line_no, {strip} AS x, CAST(round(9.96 + len(string_split(t, ' ')) % 3, 1) AS DOUBLE) AS size
    FROM (SELECT *, line_no // 20 AS page FROM raw_lines) l) WHERE x <> ''"""


@query("span_lines", _SPANS.format(strip=sql.strip("t")))
def span_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines put together again from word spans; the first span has the largest font."""

    def words(line):
        parts = F.split(line, " ")
        largest = 9.96 + F.size(parts) % 3
        return F.transform(
            parts,
            lambda w, i: F.struct(
                F.when(i == 0, w).otherwise(F.concat(F.lit(" "), w)).alias("text"),
                F.when(i == 0, largest).otherwise(F.lit(8.0)).alias("size"),
            ),
        )

    documents = inputs.table(spark, sf, "documents")
    doc_id = F.col("doc_id")
    lines = F.transform(
        F.split(inputs.dated_text(doc_id, F.col("text")), "\n"),
        lambda line, i: F.struct(F.floor(i / 20).cast("int").alias("page"), words(line).alias("spans")),
    )
    return documents.select(
        inputs.paper_id(doc_id).alias("paper_id"), F.inline(paper_source.lines_of_spans(lines))
    )


@query(
    "span_row_lines",
    f"""SELECT paper_id, page, line_no, {sql.strip("t")} AS text, CAST(10 AS DOUBLE) AS size
    FROM (SELECT *, line_no // 20 AS page FROM raw_lines) WHERE {sql.strip("t")} <> ''""",
)
def span_row_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a table of span rows."""
    documents = inputs.table(spark, sf, "documents")
    doc_id = F.col("doc_id")
    lines = documents.select(
        inputs.paper_id(doc_id).alias("paper_id"),
        F.posexplode(F.split(inputs.dated_text(doc_id, F.col("text")), "\n")).alias("line", "t"),
    )
    spans = lines.select(
        "paper_id",
        F.floor(F.col("line") / 20).cast("int").alias("page"),
        F.lit(0).alias("block"),
        "line",
        F.posexplode(F.split("t", "(?= )")).alias("span", "text"),
        F.lit(9.96).alias("size"),
    )
    rows = paper_source.lines_of_span_rows(spans)
    return rows.withColumn("line_no", F.col("line_no.line"))


def _plain_text(content: bytes) -> dict:
    lines = content.decode().split("\n")
    return {"lines": [{"page": i // 20, "spans": [{"text": t, "size": 10.0}]} for i, t in enumerate(lines)]}


@query(
    "file_volumes",
    f"""SELECT volume, count(*) AS n_lines, count(DISTINCT line_no // 20) AS n_pages,
      md5(string_agg(x, chr(10) ORDER BY line_no)) AS digest, 0 AS errors FROM (
        SELECT volume, line_no, {sql.strip("t")} AS x FROM (
          SELECT volume, unnest(string_split(body, chr(10))) AS t,
            generate_subscripts(string_split(body, chr(10)), 1) - 1 AS line_no
          FROM (SELECT doc_id // 64 AS volume, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) AS body
            FROM documents GROUP BY doc_id // 64)))
    WHERE x <> '' GROUP BY volume""",
)
def file_volumes(spark: SparkSession, sf: str) -> DataFrame:
    """All documents written as files of 64, then found, decoded and read back as papers."""
    folder = new_folder(spark, "volumes")
    documents = inputs.table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 64).alias("volume"), "doc_id", "text")
    rows = documents.repartition("volume").sortWithinPartitions("volume", "doc_id")
    rows.select("volume", "text").write.partitionBy("volume").text(folder)
    papers = paper_source.decode_files(paper_source.pdf_files(spark, folder, "*.txt"), _plain_text)
    return papers.select(
        F.regexp_extract("source", r"volume=(\d+)", 1).cast("long").alias("volume"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("lines.page")).cast("long").alias("n_pages"),
        F.md5(paper_source.full_text(F.col("lines")).cast("binary")).alias("digest"),
        F.col("error").isNotNull().cast("int").alias("errors"),
    )


@query(
    "full_texts",
    """SELECT paper_id, md5(t) AS digest, n FROM (
      SELECT paper_id, string_agg(text, chr(10) ORDER BY line_no) AS t,
        count(DISTINCT page) AS n FROM doc_lines GROUP BY paper_id)""",
)
def full_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Plain text of each paper: its page texts joined by line breaks."""
    pages = inputs.papers(spark, sf).where("size(lines) > 0").select(
        "paper_id", paper_source.page_texts(F.col("lines")).alias("pages")
    )
    return pages.select(
        "paper_id", F.md5(F.array_join("pages", "\n").cast("binary")).alias("digest"), F.size("pages").alias("n")
    )


@query(
    "body_size",
    "SELECT d.paper_id, coalesce(body, CAST(10 AS DOUBLE)) AS body_size FROM docs d LEFT JOIN body_sizes b USING (paper_id)",
)
def body_size(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.papers(spark, sf).select(
        "paper_id", structure.body_size(F.col("lines")).alias("body_size")
    )


@query("titles", "SELECT paper_id, title FROM paper_titles")
def titles(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.papers(spark, sf).select(
        "paper_id", structure.title(F.col("lines"), F.col("stem")).alias("title")
    )


@query("years", "SELECT paper_id, year FROM paper_years")
def years(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.parsed(spark, sf).select("paper_id", "year")


@query("headings", "SELECT paper_id, line_no, text FROM flagged WHERE heading")
def headings(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.col("lines")
    flagged = structure.flagged_lines(lines, structure.body_size(lines))
    found = F.filter(flagged, lambda l: l["heading"])
    return inputs.papers(spark, sf).select("paper_id", F.inline(found)).select(
        "paper_id", "line_no", "text"
    )


@query(
    "sections",
    """SELECT paper_id, section_no, any_value(section) AS section, count(*) AS lines,
      CAST(sum(length(text)) AS BIGINT) AS chars, min(line_no) AS first_line
    FROM body_lines GROUP BY paper_id, section_no""",
)
def sections(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.col("lines")
    found = inputs.papers(spark, sf).select(
        "paper_id",
        F.explode(structure.sections(lines, structure.body_size(lines))).alias("s"),
    )
    chars = F.aggregate(
        "s.lines", F.lit(0).cast("long"), lambda n, l: n + F.length(l["text"])
    )
    return found.select(
        "paper_id",
        F.col("s.section_no").alias("section_no"),
        F.col("s.section").alias("section"),
        F.size("s.lines").alias("lines"),
        chars.alias("chars"),
        F.get("s.lines", F.lit(0))["line_no"].alias("first_line"),
    )


_CHUNKS = """SELECT chunk_id, paper_id, text, title, year, source, section, page, start_page,
  chunk_index FROM chunk_table"""


@query("chunks", _CHUNKS)
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.chunk_rows(inputs.parsed(spark, sf))


_REPORT = """SELECT d.paper_id, t.title, y.year, count(c.chunk_id) AS chunks FROM docs d
  JOIN paper_titles t USING (paper_id) JOIN paper_years y USING (paper_id)
  LEFT JOIN chunk_table c ON c.paper_id = d.paper_id GROUP BY ALL"""


@query("ingest_report", _REPORT)
def ingest_report(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.ingest_report(inputs.parsed(spark, sf))


@query(
    "ingest_totals",
    "SELECT (SELECT count(*) FROM docs) AS papers, count(*) AS chunks FROM chunk_table",
)
def ingest_totals(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.ingest_totals(ingest.ingest_report(inputs.parsed(spark, sf)))


@query("paper_catalogue", "SELECT paper_id, title, year FROM paper_list")
def paper_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return store.list_papers(inputs.chunks(spark, sf))


@query("chunk_count", "SELECT count(*) AS chunks FROM chunk_table")
def chunk_count(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.chunks(spark, sf).agg(F.count("*").alias("chunks"))


@query(
    "chunks_since",
    "SELECT chunk_id, year, section, text FROM chunk_table WHERE year >= 2012",
)
def chunks_since(spark: SparkSession, sf: str) -> DataFrame:
    found = inputs.chunks(spark, sf).where(fusion.paper_filter(year_min=2012))
    return found.select("chunk_id", "year", "section", "text")


@query("incremental_ingest", _CHUNKS)
def incremental_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents streamed into a fresh chunk store, twice; the second run must add nothing."""
    documents = inputs.table(spark, sf, "documents")
    path = new_folder(spark, "chunk-store")
    for run in range(2):
        # A table may be one file or a directory of files; only as a pattern the path may be either.
        stream = spark.readStream.schema(documents.schema).parquet(f"{sf}/documents.parque[t]")
        papers = inputs.papers_of(stream)
        ingest_stream(papers, path, new_folder(spark, f"stream-{run}")).awaitTermination()
    return store.all_chunks(spark, path)


def _filled_store(spark: SparkSession, sf: str) -> BucketStore:
    """All chunks in a bucketed store: in batches that overlap, folded, then all of them once more."""
    chunks = inputs.chunks(spark, sf)
    kept = BucketStore(spark, new_folder(spark, "bucketed-chunks"), schema.CHUNKS)
    part = F.pmod(F.xxhash64("paper_id"), F.lit(3))
    for batch in (part == 0, part <= 1, part >= 1):
        kept.append(chunks.where(batch))
    kept.compact()
    kept.append(chunks)
    return kept


@query("stored_chunks", _CHUNKS)
def stored_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _filled_store(spark, sf).read()


@query("first_chunks", "SELECT chunk_id, text, year FROM chunk_table WHERE chunk_index = 0")
def first_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The first chunk of every paper by its key; papers without chunks are not found."""
    documents = inputs.table(spark, sf, "documents")
    keys = documents.select(F.concat(inputs.paper_id(F.col("doc_id")), F.lit("_0")).alias("chunk_id"))
    return _filled_store(spark, sf).look_up(keys).select("chunk_id", "text", "year")


def _count_provider(texts: list[str]) -> list[list[float]]:
    return [[len(t) / 1000, t.count("e") / 100, t.count("a") / 100] for t in texts]


@query(
    "embed_chunks",
    """SELECT chunk_id, round(length(text) / 1000, 3) AS e0,
      round((length(text) - length(replace(text, 'e', ''))) / 100, 3) AS e1,
      round((length(text) - length(replace(text, 'a', ''))) / 100, 3) AS e2 FROM chunk_table""",
)
def embed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    embedded = vectors.embed(
        inputs.chunks(spark, sf).select("chunk_id", "text"), "text", _count_provider
    )
    return embedded.select(
        "chunk_id",
        *[F.round(F.get("embedding", F.lit(i)).cast("double"), 3).alias(f"e{i}") for i in range(3)],
    )


# --- retrieval ------------------------------------------------------------------


@query(
    "search_tokens",
    """SELECT doc_id, term, count(*) AS tf FROM (
      SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS term FROM documents)
    GROUP BY doc_id, term""",
)
def search_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = inputs.documents(spark, sf).select(
        "doc_id", text.search_tokens(F.col("text")).alias("tokens")
    )
    counted = tokens.where("size(tokens) > 0").select("doc_id", text.term_counts(F.col("tokens")).alias("t"))
    return counted.select("doc_id", F.inline("t"))


@query(
    "corpus_stats",
    """SELECT n AS n_chunks, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM ck_idf) AS n_terms,
      round((SELECT mean_idf FROM ck_mean), 6) AS mean_idf FROM ck_tot""",
)
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = inputs.chunk_index(spark, sf).years.where(F.col("year_from") == keyword_index.ANY_YEAR)
    return stats.select("n_chunks", _score("avgdl"), "n_terms", _score("mean_idf"))


@query("bm25_topk", HITS.format("ck_ranked") + " WHERE rank < 8")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    hits = keyword_index.search(inputs.chunk_index(spark, sf), inputs.queries(spark, sf), 8)
    return hits.select("query_id", "chunk_id", _score(), "rank")


@query("bm25_scoped", HITS.format("sk_ranked") + " WHERE rank < 3")
def bm25_scoped(spark: SparkSession, sf: str) -> DataFrame:
    """One query per document, each with the statistics of that document alone."""
    hits = keyword.bm25(
        inputs.chunk_index(spark, sf).corpus, inputs.paper_queries(spark, sf), 3, ["paper_id"]
    )
    return hits.select("query_id", "chunk_id", _score(), "rank")


def _doc_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.located(inputs.vectors(spark, sf), inputs.doc_chunks(spark, sf))


@query("vector_topk", HITS.format("dv") + " WHERE rank < 8")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    hits = vectors.nearest(_doc_vectors(spark, sf), inputs.queries(spark, sf), 8)
    return hits.select("query_id", "chunk_id", _score(), "rank")


@query("vector_topk_joined", HITS.format("dv") + " WHERE rank < 8")
def vector_topk_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The same through the block join that serves large query sets."""
    hits = vectors.nearest(
        _doc_vectors(spark, sf), inputs.queries(spark, sf), 8
    )
    return hits.select("query_id", "chunk_id", _score(), "rank")


@query("vector_topk_cells", HITS.format("dv") + " WHERE rank < 8")
def vector_topk_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The same, skipping cells that can't hold a better vector."""
    stored = _doc_vectors(spark, sf)
    centres = vectors.fit_cells(stored, 16)
    hits = vectors.nearest_in_cells(stored, inputs.queries(spark, sf), 8, centres)
    return hits.select("query_id", "chunk_id", _score(), "rank")


@query("hybrid_topk", HITS.format("dh"))
def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    hits = fusion.hybrid_search(
        inputs.doc_chunks(spark, sf), inputs.vectors(spark, sf), inputs.queries(spark, sf), index=inputs.doc_index(spark, sf)
    )
    return hits.select("query_id", "chunk_id", _score(), "rank")


@query("hybrid_year_filter", HITS.format("yh"))
def hybrid_year_filter(spark: SparkSession, sf: str) -> DataFrame:
    hits = fusion.hybrid_search(
        inputs.doc_chunks(spark, sf), inputs.vectors(spark, sf), inputs.queries(spark, sf),
        year_min=2012, index=inputs.doc_index(spark, sf),
    )
    return hits.select("query_id", "chunk_id", _score(), "rank")


def _dated(spark: SparkSession, sf: str) -> DataFrame:
    number = F.substring("query_id", 2, 9).cast("int")
    return inputs.queries(spark, sf).withColumn("year_min", 2003 + number % 5 * 4)


@query("hybrid_year_scopes", HITS.format("zh"))
def hybrid_year_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Every query with a year limit of its own."""
    asked = _dated(spark, sf)
    hits = fusion.hybrid_search(
        inputs.doc_chunks(spark, sf), inputs.vectors(spark, sf), asked, scope=["year_min"], index=inputs.doc_index(spark, sf)
    )
    return hits.select("query_id", "chunk_id", _score(), "rank")


@query(
    "hybrid_mixed_filters",
    """SELECT 'n' || query_id AS query_id, chunk_id, round(score, 6) AS score, rank FROM dh
    UNION ALL SELECT 'y' || query_id, chunk_id, round(score, 6), rank FROM zh
    UNION ALL SELECT 'p' || query_id, chunk_id, round(score, 6), rank FROM vh""",
)
def hybrid_mixed_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Queries without a filter, with a year and with a paper in one call."""
    free = inputs.queries(spark, sf)
    none = {"year_min": F.lit(None).cast("int"), "paper_id": F.lit(" ")}
    in_paper = inputs.vector_queries(spark, sf)
    asked = (
        free.withColumns(none)
        .withColumn("query_id", F.concat(F.lit("n"), "query_id"))
        .unionByName(_dated(spark, sf).withColumns({"paper_id": F.lit(""), "query_id": F.concat(F.lit("y"), "query_id")}))
        .unionByName(in_paper.withColumns({"year_min": none["year_min"], "query_id": F.concat(F.lit("p"), "query_id")}))
    )
    hits = fusion.mixed_search(
        inputs.doc_chunks(spark, sf), inputs.vectors(spark, sf), asked, index=inputs.doc_index(spark, sf)
    )
    return hits.select("query_id", "chunk_id", _score(), "rank")


@query("hybrid_in_paper", HITS.format("vh"))
def hybrid_in_paper(spark: SparkSession, sf: str) -> DataFrame:
    hits = fusion.hybrid_search(
        inputs.doc_chunks(spark, sf), inputs.vectors(spark, sf), inputs.vector_queries(spark, sf),
        scope=["paper_id"], index=inputs.doc_index(spark, sf),
    )
    return hits.select("query_id", "chunk_id", _score(), "rank")


@query(
    "ask_hits",
    """SELECT query_id, rank, f.paper_id, substr(text, 1, 600) AS text, round(score, 3) AS score,
      title, year, source, section FROM da f JOIN doc_chunks USING (chunk_id)""",
)
def ask_hits(spark: SparkSession, sf: str) -> DataFrame:
    hits = fusion.ask(
        inputs.doc_chunks(spark, sf), inputs.vectors(spark, sf), inputs.queries(spark, sf), inputs.doc_index(spark, sf)
    )
    return hits.select(
        "query_id", "rank", "paper_id", "text", "score",
        "meta.title", "meta.year", "meta.source", "meta.section",
    )


@query("named_papers", "SELECT query_id, paper_id, seq, pos FROM named")
def named_papers(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.named_papers(
        inputs.finals(spark, sf), inputs.trace(spark, sf), inputs.doc_chunks(spark, sf)
    )


@query(
    "observation_pool",
    """SELECT query_id, seq, substr(coalesce(result_preview, ''), 1, 200) AS text FROM trace_rows
    WHERE type = 'observe'""",
)
def observation_pool(spark: SparkSession, sf: str) -> DataFrame:
    return candidates.observations(inputs.trace(spark, sf))


@query(
    "expanded_topics",
    """SELECT query_id, term, min(pos) AS pos FROM (
      SELECT query_id, 0 AS pos, text AS term FROM items
      UNION ALL SELECT i.query_id, 1 + d.doc_id % 3, d.source FROM items i
        JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = i.item_id) GROUP BY query_id, term""",
)
def expanded_topics(spark: SparkSession, sf: str) -> DataFrame:
    topics = inputs.queries(spark, sf)
    items = inputs.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("topic"))
    documents = inputs.table(spark, sf, "documents").select("doc_id", "source")
    expansions = inputs.with_passage(spark, sf, documents, "doc_id", items).select(
        "topic", (F.col("doc_id") % 3).cast("int").alias("pos"), F.col("source").alias("term")
    )
    return candidates.expand_topics(topics, expansions)


@query("topic_candidates", "SELECT query_id, paper_id, rank FROM candidate_rows")
def topic_candidates(spark: SparkSession, sf: str) -> DataFrame:
    stored = inputs.doc_chunks(spark, sf)
    named = candidates.named_papers(
        inputs.finals(spark, sf), inputs.trace(spark, sf), store.list_papers(stored)
    )
    return candidates.topic_candidates(
        stored, inputs.vectors(spark, sf), inputs.queries(spark, sf), named, index=inputs.doc_index(spark, sf)
    )


# --- cards ----------------------------------------------------------------------


@query(
    "json_extract",
    "SELECT paper_id, md5(c) AS digest, json_valid(c) AND left(c, 1) = '{' AS usable FROM ("
    + sql.CTES["card_objects"].split("FROM (", 1)[1].rstrip()[:-1]
    + ")",
)
def json_extract(spark: SparkSession, sf: str) -> DataFrame:
    found = inputs.card_raw(spark, sf).select(
        "paper_id", json_text.json_candidate(F.col("final_text")).alias("c")
    )
    parsed = F.try_parse_json("c")
    return found.select(
        "paper_id",
        F.md5(F.col("c").cast("binary")).alias("digest"),
        F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)).alias("usable"),
    )


@query(
    "cards_parsed",
    """SELECT task_id, pos, paper_id, title, year, core_claim, method, method_family,
      array_to_string(key_results, '|') AS key_results, array_to_string(opposes, '|') AS opposes,
      array_to_string(limitations, '|') AS limitations, array_to_string(quotes, '|') AS quotes
    FROM cards""",
)
def cards_parsed(spark: SparkSession, sf: str) -> DataFrame:
    parsed = card_ops.parse_cards(inputs.card_raw(spark, sf), inputs.paper_list(spark, sf))
    return parsed.select(
        "task_id", "pos", "paper_id", "title", "year", "core_claim", "method", "method_family",
        *[F.array_join(c, "|").alias(c) for c in ("key_results", "opposes", "limitations")],
        F.array_join(json_text.quotes(F.col("evidence_spans")), "|").alias("quotes"),
    )


@query(
    "card_briefs",
    """SELECT t.task_id, coalesce(pos, 0) AS pos, CASE WHEN paper_id IS NULL THEN '(无卡片)' ELSE
      '- [' || paper_id || '] ' || coalesce(nullif(title, ''), '?') || ' (' ||
      coalesce(CAST(nullif(year, 0) AS VARCHAR), '?') || ') | 流派: ' ||
      coalesce(nullif(method_family, ''), '?') || ' | 核心主张: ' ||
      coalesce(nullif(core_claim, ''), '?') || ' | 对立: ' ||
      coalesce(nullif(array_to_string(opposes, ', '), ''), '无') END AS brief
    FROM task_list t LEFT JOIN cards USING (task_id)""",
)
def card_briefs(spark: SparkSession, sf: str) -> DataFrame:
    briefs = card_ops.card_briefs(inputs.cards(spark, sf))
    return card_ops.task_briefs(inputs.tasks(spark, sf), briefs)


# --- graph ----------------------------------------------------------------------


@query("clusters", "SELECT task_id, cluster_id, label, first_pos, n_members FROM clusters")
def clusters(spark: SparkSession, sf: str) -> DataFrame:
    return graph_ops.cluster_cards(inputs.cards(spark, sf))


@query("cluster_members", "SELECT task_id, cluster_id, pos, paper_id FROM families")
def cluster_members(spark: SparkSession, sf: str) -> DataFrame:
    return graph_ops.cluster_members(inputs.cards(spark, sf))


@query("graph_nodes", "SELECT task_id, id, label, type, part, p1, p2 FROM nodes")
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph_ops.build_graph(inputs.cards(spark, sf)).nodes


@query(
    "graph_edges",
    """SELECT task_id, part, p1, p2, source, target, relation, rationale,
      array_to_string(evidence, '|') AS evidence,
      CASE WHEN relation = 'opposes' AND len(evidence) = 0 THEN 'possibly_related'
        ELSE 'asserted' END AS strength FROM edges""",
)
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    edges = graph_ops.with_strength(graph_ops.build_graph(inputs.cards(spark, sf)).edges)
    return edges.withColumn("evidence", F.array_join("evidence", "|"))


@query("gaps", "SELECT task_id, part, pos, gap FROM gap_rows")
def research_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return gaps.detect_gaps(inputs.cards(spark, sf))


@query(
    "graph_totals",
    """SELECT task_id, (SELECT count(*) FROM nodes n WHERE n.task_id = t.task_id) AS nodes,
      (SELECT count(*) FROM edges n WHERE n.task_id = t.task_id) AS edges,
      (SELECT count(*) FROM gap_rows n WHERE n.task_id = t.task_id) AS gaps FROM task_list t""",
)
def graph_totals(spark: SparkSession, sf: str) -> DataFrame:
    return graph_ops.graph_totals(inputs.tasks(spark, sf), inputs.graph(spark, sf))


@query(
    "graph_export",
    """SELECT task_id, 'node' AS kind, part, p1, p2,
      CAST(to_json({'id': id, 'label': label, 'type': type}) AS VARCHAR) AS record FROM nodes
    UNION ALL SELECT task_id, 'member', 0, pos, 0,
      CAST(to_json({'cluster_id': cluster_id, 'paper_id': paper_id}) AS VARCHAR) FROM families
    UNION ALL SELECT task_id, 'edge', part, p1, p2, CAST(to_json({'source': source, 'target': target,
      'relation': relation, 'rationale': rationale, 'evidence': evidence}) AS VARCHAR) FROM edges
    UNION ALL SELECT task_id, 'gap', part, pos, 0, CAST(to_json({'gap': gap}) AS VARCHAR) FROM gap_rows""",
)
def graph_export(spark: SparkSession, sf: str) -> DataFrame:
    return exports.graph_records(inputs.graph(spark, sf))


# --- quality gate -----------------------------------------------------------------


@query("missing_cards", "SELECT task_id, paper_id, rank FROM missing")
def missing_cards(spark: SparkSession, sf: str) -> DataFrame:
    return quality.missing_cards(inputs.candidates(spark, sf), inputs.cards(spark, sf))


@query(
    "quote_overlap",
    """SELECT d.doc_id, coalesce(len(qt) > 0 AND
      CAST(len(list_intersect(qt, st)) AS DOUBLE) / len(qt) >= 0.5, false) AS ok
    FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9一-鿿]+')) AS st
      FROM documents) d
    JOIN (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9一-鿿]+')) AS qt
      FROM benchmark) b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)""",
)
def quote_overlap(spark: SparkSession, sf: str) -> DataFrame:
    items = inputs.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote"))
    documents = inputs.table(spark, sf, "documents").select("doc_id", "text")
    pairs = inputs.with_passage(spark, sf, documents, "doc_id", items)
    return pairs.select("doc_id", text.overlap_ok(F.col("quote"), F.col("text")).alias("ok"))


@query("quotes_checked", "SELECT task_id, pos, paper_id, quote_pos, quote, verified FROM checked")
def quotes_checked(spark: SparkSession, sf: str) -> DataFrame:
    return quality.check_quotes(inputs.cards(spark, sf), inputs.chunks(spark, sf))


@query("quotes_checked_hybrid", "SELECT task_id, pos, paper_id, quote_pos, quote, verified FROM checked_hybrid")
def quotes_checked_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes looked up by both lists; vectors of chunks and quotes come from one cache."""
    cache = VectorCache(spark, new_folder(spark, "vector-cache"), _count_provider, "letters")
    chunks, cards = inputs.chunks(spark, sf), inputs.cards(spark, sf)
    vectors = cache.with_vectors(chunks.select("chunk_id", "text")).select("chunk_id", "embedding")
    return quality.check_quotes(cards, chunks, vectors, quality.quote_vectors(cards, cache))


@query("unverified_quotes", "SELECT task_id, pos, paper_id, quote_pos, quote FROM unverified")
def unverified_quotes(spark: SparkSession, sf: str) -> DataFrame:
    return quality.unverified_quotes(inputs.checked_quotes(spark, sf))


@query("edges_without_evidence", "SELECT task_id, source, target, p1, p2 FROM bare_edges")
def edges_without_evidence(spark: SparkSession, sf: str) -> DataFrame:
    bare = quality.edges_without_evidence(inputs.graph(spark, sf).edges)
    return bare.select("task_id", "source", "target", "p1", "p2")


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    graph = inputs.graph(spark, sf)
    missing = quality.missing_cards(inputs.candidates(spark, sf), inputs.cards(spark, sf))
    bad = quality.unverified_quotes(inputs.checked_quotes(spark, sf))
    tasks = inputs.tasks(spark, sf)
    return quality.verdicts(tasks, quality.issues(tasks, missing, bad, graph.nodes, graph.edges))


@query(
    "verdicts",
    """SELECT t.task_id, 1 AS round, count(issue) = 0 AS passed,
      coalesce(string_agg(issue, '|' ORDER BY ck), '') AS issues,
      coalesce(string_agg(suggestion, '|' ORDER BY ck), '') AS suggestions, 'deterministic' AS method
    FROM task_list t LEFT JOIN issue_rows USING (task_id) GROUP BY t.task_id""",
)
def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    joined = {c: F.array_join(c, "|") for c in ("issues", "suggestions")}
    return _verdicts(spark, sf).withColumns(joined)


@query(
    "rework",
    """SELECT task_id, 'read' AS action, paper_id FROM missing WHERE task_id IN (SELECT task_id FROM failed)
    UNION ALL SELECT task_id, CASE WHEN task_id IN (SELECT task_id FROM missing) THEN 'synthesize'
      WHEN task_id NOT IN (SELECT task_id FROM nodes) THEN 'synthesize' ELSE 'stop' END, NULL
    FROM failed""",
)
def rework(spark: SparkSession, sf: str) -> DataFrame:
    missing = quality.missing_cards(inputs.candidates(spark, sf), inputs.cards(spark, sf))
    return quality.rework(_verdicts(spark, sf), missing, inputs.graph(spark, sf).nodes)


# --- reviews ------------------------------------------------------------------------


@query("review_pieces", "SELECT task_id, part, p1, p2, glue, text FROM pieces")
def review_pieces(spark: SparkSession, sf: str) -> DataFrame:
    pieces = review.review_pieces(
        inputs.tasks(spark, sf), inputs.cards(spark, sf), inputs.graph(spark, sf)
    )
    return pieces.drop("p3")


def _reviews(spark: SparkSession, sf: str) -> DataFrame:
    pieces = review.review_pieces(
        inputs.tasks(spark, sf), inputs.cards(spark, sf), inputs.graph(spark, sf)
    )
    return review.review_text(pieces)


@query("review_doc", "SELECT task_id, review FROM reviews")
def review_doc(spark: SparkSession, sf: str) -> DataFrame:
    return _reviews(spark, sf)


@query("review_choice", "SELECT task_id, review, supplied FROM chosen")
def review_choice(spark: SparkSession, sf: str) -> DataFrame:
    return review.choose_review(_reviews(spark, sf), inputs.drafts(spark, sf))


@query("review_choice_stored", "SELECT task_id, review, supplied FROM chosen_stored")
def review_choice_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks whose first draft lies in a file already: the longer of that and the last one counts."""
    tasks = inputs.tasks(spark, sf)
    folder = new_folder(spark, "stored-reviews")
    named = inputs.first_drafts(spark, sf).select("task_id", F.col("task_id").alias("title"), F.col("stored_text").alias("content"))
    exports.export_md(named, folder)
    files = spark.read.text(folder, wholetext=True).select("slug", F.col("value").alias("stored_text"))
    existing = tasks.select("task_id", text.file_slug(F.col("task_id")).alias("slug")).join(files, "slug").drop("slug")
    return review.choose_review(_reviews(spark, sf), inputs.drafts(spark, sf), existing)


@query(
    "printed_lines",
    f"""SELECT doc_id, {sql.printed("string_split(text, chr(10) || chr(10))")} AS printed FROM documents WHERE text IS NOT NULL""",
)
def printed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The paragraphs of every document as the gate prints lists of quotes."""
    paragraphs = inputs.table(spark, sf, "documents").where("text IS NOT NULL")
    return paragraphs.select("doc_id", quality.quoted_list(F.split("text", "\n\n")).alias("printed"))


@query(
    "exported_reviews",
    "SELECT 'review_topic_' || substr(task_id, 2) AS slug, md5(review) AS digest FROM chosen",
)
def exported_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews written as Markdown files and read back."""
    chosen = review.choose_review(_reviews(spark, sf), inputs.drafts(spark, sf))
    named = chosen.join(inputs.tasks(spark, sf), "task_id").select(
        "task_id", F.concat(F.lit("review_"), "topic").alias("title"), F.col("review").alias("content")
    )
    folder = new_folder(spark, "reviews")
    exports.export_md(named, folder)
    files = spark.read.text(folder, wholetext=True)
    content = F.regexp_replace("value", r"\n\z", "")
    return files.select("slug", F.md5(content.cast("binary")).alias("digest"))


# --- state ----------------------------------------------------------------------------


_LATEST_EVENT = """SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"""


@query(
    "latest_state",
    f"""SELECT 'u' || user_id AS task_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'done'
      ELSE 'planning' END AS status FROM ({_LATEST_EVENT})""",
)
def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    log = inputs.task_log(spark, sf)
    return state.latest(log, ["task_id"], ["updated_at", "event_id"]).select(
        "task_id", "event_id", "status"
    )


def _latest_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return state.latest(inputs.task_log(spark, sf), ["task_id"], ["updated_at", "event_id"])


@query(
    "recent_tasks",
    f"""SELECT 'u' || user_id AS task_id, 'user ' || user_id AS topic,
      CASE WHEN event_id % 2 = 0 THEN 'done' ELSE 'planning' END AS status FROM ({_LATEST_EVENT})""",
)
def recent_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return state.list_tasks(_latest_tasks(spark, sf))


@query(
    "task_summary",
    f"""SELECT 'u' || user_id AS task_id, 'user ' || user_id AS topic,
      CASE WHEN event_id % 2 = 0 THEN 'done' ELSE 'planning' END AS status,
      CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS cards,
      CASE WHEN event_id % 2 = 0 THEN event_type || '.md' ELSE '' END AS artifacts
    FROM ({_LATEST_EVENT})""",
)
def task_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = state.task_summary(_latest_tasks(spark, sf))
    return summary.withColumn("artifacts", F.array_join("artifacts", "|"))


@query(
    "task_lookup",
    f"""SELECT 'u' || user_id AS task_id, CASE WHEN event_id % 2 = 0 THEN 'done' ELSE 'planning' END
      AS status FROM ({_LATEST_EVENT}) WHERE user_id = 7""",
)
def task_lookup(spark: SparkSession, sf: str) -> DataFrame:
    log = inputs.task_log(spark, sf).where("task_id = 'u7'")
    newest = state.latest(log, ["task_id"], ["updated_at", "event_id"])
    return state.load_task(newest, "u7").select("task_id", "status")


@query(
    "state_round_trip",
    """SELECT 'b' || paper_id AS task_id, title, year, array_to_string(opposes, '|') AS opposes,
      'planning' AS status, 0 AS feedback FROM cards""",
)
def state_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Boards written as JSON and read back; what the JSON lacks takes its default."""
    fields = [c for c in card_ops.CARD_COLUMNS if c not in ("task_id", "pos")]
    boards = inputs.cards(spark, sf).select(
        F.concat(F.lit("b"), "paper_id").alias("task_id"),
        F.col("task_id").alias("topic"),
        F.create_map("paper_id", F.struct(*fields)).alias("cards"),
        F.lit(None).cast("string").alias("status"),
        "paper_id",
    )
    back = state.read_boards(state.board_json(boards))
    card = F.get(F.map_values("cards"), F.lit(0))
    return back.select(
        "task_id",
        card["title"].alias("title"),
        card["year"].alias("year"),
        F.array_join(card["opposes"], "|").alias("opposes"),
        "status",
        F.size("critic_feedback").alias("feedback"),
    )


@query(
    "card_cache",
    f"""SELECT d.paper_id, e.props AS card_json FROM docs d
    LEFT JOIN ({_LATEST_EVENT}) e ON e.user_id = d.doc_id""",
)
def card_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Remembered cards for every paper; the memory holds one log row per event."""
    memory = inputs.table(spark, sf, "events").select(
        inputs.paper_id(F.col("user_id")).alias("paper_id"),
        F.col("props").alias("card_json"),
        F.struct("ts", "event_id").alias("updated_at"),
    )
    wanted = inputs.table(spark, sf, "documents").select(inputs.paper_id(F.col("doc_id")).alias("paper_id"))
    return state.recall_cards(wanted, memory)


@query(
    "saved_tasks",
    """SELECT DISTINCT 't' || (doc_id // 8) AS task_id, 'Topic ' || (doc_id // 8) AS topic,
      CASE WHEN (doc_id // 8) % 2 = 0 THEN 'done' WHEN (doc_id // 8) % 3 = 0 THEN 'failed' ELSE 'planning' END AS status,
      true AS stamped FROM documents""",
)
def saved_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Boards saved, folded into a snapshot, saved again before and after a second one, and read back."""
    order = ["updated_at", "blackboard"]
    log = state_log.StateLog(spark, new_folder(spark, "tasks"), schema.TASKS, ["task_id"], order)
    number = F.substring("task_id", 2, 20).cast("long")
    boards = inputs.tasks(spark, sf).withColumn("status", F.lit("planning"))
    for rows, fold in (
        (boards, True),
        (boards.where(number % 3 == 0).withColumn("status", F.lit("failed")), True),
        (boards.where(number % 2 == 0).withColumn("status", F.lit("done")), False),
    ):
        log.append(state.board_json(rows).withColumn("updated_at", F.current_timestamp()))
        if fold:
            log.compact()
    newest = log.read()
    stamped = newest.select("task_id", F.col("updated_at").isNotNull().alias("stamped"))
    return state.read_boards(newest).select("task_id", "topic", "status").join(stamped, "task_id")


@query(
    "remembered_cards",
    """SELECT paper_id, '{"source":"' || d.source || '","version":' || CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END || '}' AS card_json
    FROM docs JOIN documents d USING (doc_id) WHERE doc_id % 5 <> 0
    UNION ALL SELECT paper_id, NULL FROM docs WHERE doc_id % 5 = 0""",
)
def remembered_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Cards remembered for four of five papers, every third again after a compaction; all papers asked for."""
    memory = state_log.StateLog(spark, new_folder(spark, "cards"), schema.MEMORY_CARDS, ["paper_id"], ["updated_at", "card_json"])
    doc = F.col("doc_id")
    documents = inputs.table(spark, sf, "documents").withColumn("paper_id", inputs.paper_id(doc))
    known = documents.where(doc % 5 != 0)
    for version, rows in ((1, known), (2, known.where(doc % 3 == 0))):
        card = F.to_json(F.struct("source", F.lit(version).alias("version")))
        memory.append(rows.select("paper_id", card.alias("card_json"), F.current_timestamp().alias("updated_at")))
        memory.compact()
    return state.recall_cards(documents.select("paper_id"), memory.read())


@query(
    "spill_preview",
    """SELECT doc_id, CASE WHEN length(text) > 4000 THEN '[大输出已落盘: spill/' || doc_id || '.txt]' ||
      chr(10) || '摘要(前500字):' || chr(10) || substr(text, 1, 500) ELSE text END AS text
    FROM documents""",
)
def spill_preview(spark: SparkSession, sf: str) -> DataFrame:
    documents = inputs.table(spark, sf, "documents").select("doc_id", "text")
    path = F.concat(F.lit("spill/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return exports.spill_large(documents, "text", path)


@query(
    "page_slugs",
    f"""SELECT page_id, {sql.pid('url')} AS paper_id, coalesce(nullif(substr({sql.slug('h')}, 1, 80), ''),
      'review') AS slug FROM (SELECT page_id, url, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS h FROM pages)""",
)
def page_slugs(spark: SparkSession, sf: str) -> DataFrame:
    """Hash ids of page addresses and file slugs of their headings."""
    heading = F.regexp_extract("html", "<h1>(.*?)</h1>", 1)
    return inputs.table(spark, sf, "pages").select(
        "page_id", text.hash_id(F.col("url")).alias("paper_id"), text.file_slug(heading).alias("slug")
    )


# --- all stages -------------------------------------------------------------------------


@query(
    "topic_map",
    """SELECT query_id AS task_id, 'done' AS status, count(*) AS candidates,
      count(f.paper_id) AS cards, CAST(coalesce(sum(1 + len(opposes)), 0) AS BIGINT) AS edges,
      count(*) - count(f.paper_id) AS to_read
    FROM candidate_rows c LEFT JOIN card_fields f ON f.paper_id = c.paper_id GROUP BY query_id""",
)
def topic_map(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark passage as a topic, from retrieval to the gate."""
    topics = inputs.queries(spark, sf).withColumnsRenamed({"query_id": "task_id", "text": "topic"})
    rename = {"query_id": "task_id"}
    mapped = map_topics(
        topics,
        inputs.doc_chunks(spark, sf),
        inputs.vectors(spark, sf),
        inputs.trace(spark, sf).withColumnsRenamed(rename),
        inputs.finals(spark, sf).withColumnsRenamed(rename),
        inputs.card_raw(spark, sf).select("paper_id", "final_text"),
        inputs.drafts(spark, sf).withColumn("task_id", F.regexp_replace("task_id", "^t", "q")),
    )

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("task_id").agg(F.count("*").alias(name))

    counts = mapped.tasks.select("task_id", "status")
    for part, name in (
        (mapped.candidates, "candidates"),
        (mapped.cards, "cards"),
        (mapped.graph.edges, "edges"),
        (mapped.rework.where("action = 'read'"), "to_read"),
    ):
        counts = counts.join(count(part, name), "task_id", "left")
    return counts.na.fill(0)


# --- contract ------------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """BM25 over the chunks of all documents, the eight best per benchmark passage."""
    return bm25_topk(spark, "/root/testdata/sf0.001")


def _training_data() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and oracles of the subpackage for training data; none if it can't be imported."""
    try:
        from litweave.llm.queries import ORACLES, QUERIES
    except ImportError:
        return {}, {}
    found, oracles = dict(QUERIES), dict(ORACLES)
    try:
        import corpus_pipeline
    except ImportError:
        return found, oracles
    cloudpickle.register_pickle_by_value(corpus_pipeline)
    found["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        oracles["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, oracles


def queries() -> dict[str, Query]:
    return _QUERIES | _training_data()[0]


def oracle_sql() -> dict[str, str]:
    return _ORACLES | _training_data()[1]
