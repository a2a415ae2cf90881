"""Papers as rows: one row per file or document, its lines in an array.

A paper arrives whole in one row (a file, a text cell), so everything that is local to a paper is
an expression over that row. Reading and structuring papers therefore needs no shuffle at all and
one paper can never pull the rows of others into its task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.readwriter import DataFrameReader
from pyspark.sql.streaming import DataStreamReader

from litweave.functions.arrays import let
from litweave.functions.numbers import round_exact
from litweave.functions.text import hash_id, strip

DECODED = (
    "source string, creation_date string, "
    "span_lines array<struct<page:int,spans:array<struct<text:string,size:double>>>>, error string"
)
BINARY_FILES = "path string, modificationTime timestamp, length long, content binary"
BATCH_BYTES = 16 << 20
ERROR_CHARS = 300


def pdf_files(spark: SparkSession, directory: str, pattern: str = "*.pdf") -> DataFrame:
    """All files of a pattern below a directory, with their bytes.

    The scan cuts its partitions by bytes (`spark.sql.files.maxPartitionBytes`); a file is never cut.
    """
    return _files(spark.read, directory, pattern)


def pdf_stream(spark: SparkSession, directory: str, pattern: str = "*.pdf", **limits) -> DataFrame:
    """The same as a stream of files as they arrive; `limits` are options such as maxFilesPerTrigger."""
    return _files(spark.readStream.schema(BINARY_FILES).options(**limits), directory, pattern)


def _files(reader: DataFrameReader | DataStreamReader, directory: str, pattern: str) -> DataFrame:
    found = reader.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return found.load(directory).select(F.col("path").alias("source"), "content")


def _slices(contents: Iterable[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours of at most `limit` bytes together; a larger one is alone."""
    start, held, i = 0, 0, -1
    for i, content in enumerate(contents):
        size = len(content or b"")
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if i >= start:
        yield start, i + 1


def decode_files(files: DataFrame, decode: Callable[[bytes], dict], batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Run a user-supplied decoder over file bytes: papers with their lines, and `error`.

    `decode(content)` returns `{"creation_date": str | None, "lines": [{"page": int, "spans":
    [{"text": str, "size": float}]}]}`. A file on which it fails is a paper without lines whose `error`
    says why; other files are not affected. Decoded files leave the worker in batches of
    `batch_bytes` of content. What enters is bounded by Spark's `spark.sql.execution.arrow.maxBytesPerBatch`.
    """

    def one(content: bytes) -> tuple[str | None, list[dict], str | None]:
        try:
            found = decode(bytes(content))
            return found.get("creation_date"), found["lines"], None
        except Exception as error:  # whatever a damaged file does to the decoder
            return None, [], f"{type(error).__name__}: {error}"[:ERROR_CHARS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, end in _slices(batch["content"], batch_bytes):
                part = batch.iloc[start:end]
                dates, lines, errors = zip(*[one(content) for content in part["content"]])
                yield pd.DataFrame({"source": part["source"].tolist(), "creation_date": dates, "span_lines": lines, "error": errors})

    decoded = files.mapInPandas(run, DECODED)
    return decoded.select(
        hash_id(F.col("source")).alias("paper_id"),
        "source",
        file_stem(F.col("source")).alias("stem"),
        "creation_date",
        lines_of_spans(F.col("span_lines")).alias("lines"),
        "error",
    )


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def lines_of_spans(span_lines: Column) -> Column:
    """Join the spans of each line; keep trimmed, non-empty lines with the largest span size."""

    def line(entry: Column, i: Column) -> Column:
        spans = entry["spans"]
        return F.struct(
            entry["page"].cast("int").alias("page"),
            i.cast("int").alias("line_no"),
            strip(F.array_join(F.transform(spans, lambda s: s["text"]), "")).alias("text"),
            round_exact(F.array_max(F.transform(spans, lambda s: s["size"])), 1).alias("size"),
        )

    return F.filter(F.transform(span_lines, line), lambda l: l["text"] != "")


def lines_of_text(
    text: Column,
    page: Callable[[Column], Column],
    size: Callable[[Column], Column],
) -> Column:
    """Lines of plain text; `page` maps a 0-based line number, `size` the trimmed line text."""

    def line(raw: Column, i: Column) -> Column:
        return let(
            strip(raw),
            lambda t: F.struct(
                page(i).cast("int").alias("page"),
                i.cast("int").alias("line_no"),
                t.alias("text"),
                size(t).cast("double").alias("size"),
            ),
        )

    return F.filter(F.transform(F.split(text, "\n"), line), lambda l: l["text"] != "")


_LINE = ["paper_id", "page", "block", "line"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Span rows → neighbouring rows of one line, of one size and with consecutive numbers as one row."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        opens = np.zeros(rows, bool)
        opens[0] = True
        for name in [*_LINE, "size", "span"]:
            values = batch.column(name)
            expected = values.slice(0, rows - 1)
            if name == "span":
                expected = pc.add(expected, pa.scalar(1, values.type))
            opens[1:] |= pc.fill_null(pc.not_equal(values.slice(1), expected), True).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(opens)
        texts = pa.ListArray.from_arrays(pa.array(np.append(at, rows), pa.int32()), batch.column("text"))
        first = batch.select([*_LINE, "size", "span"]).take(pa.array(at))
        yield pa.RecordBatch.from_arrays([*first.columns, texts], [*first.schema.names, "texts"])


def lines_of_span_rows(spans: DataFrame) -> DataFrame:
    """Line rows from span rows (paper_id, page, block, line, span, text, size).

    One group is one printed line. `line_no` orders the lines of a paper and may have gaps. Spans may come in
    any order; those that lie side by side travel as one row.
    """
    runs = T.StructType([T.StructField(c, spans.schema[c].dataType) for c in (*_LINE, "size", "span")]).add("texts", T.ArrayType(T.StringType()))
    pieces = spans.select(*_LINE, "size", "span", "text").mapInArrow(_runs, runs)
    grouped = pieces.groupBy(*_LINE).agg(
        F.collect_list(F.struct("span", "texts")).alias("pieces"), round_exact(F.max("size"), 1).alias("size")
    )

    def numbered(piece: Column) -> Column:
        return F.transform(piece["texts"], lambda t, i: F.struct((piece["span"] + i).alias("span"), t.alias("text")))

    in_order = F.transform(F.array_sort(F.flatten(F.transform("pieces", numbered))), lambda s: s["text"])
    # A line of one piece is in order.
    texts = F.when(F.size("pieces") == 1, F.get("pieces", F.lit(0))["texts"]).otherwise(in_order)
    return grouped.select(
        "paper_id",
        F.col("page").cast("int").alias("page"),
        F.struct("page", "block", "line").alias("line_no"),
        strip(F.array_join(texts, "")).alias("text"),
        "size",
    ).where("text <> ''")


def line_rows(papers: DataFrame) -> DataFrame:
    """Explode papers into (paper_id, page, line_no, text, size)."""
    return papers.select("paper_id", F.inline("lines"))


def full_text(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda l: l["text"]), "\n")


def page_texts(lines: Column) -> Column:
    """Text per page in page order, as an array; lines come ordered by page."""

    def opens(l: Column, i: Column) -> Column:
        return F.when((i == 0) | (l["page"] != F.get(lines, i - 1)["page"]), i)

    def texts(starts: Column) -> Column:
        def page(start: Column, j: Column) -> Column:
            end = F.coalesce(F.get(starts, j + 1), F.size(lines))
            return full_text(F.slice(lines, start + 1, end - start))

        return F.transform(starts, page)

    return let(F.filter(F.transform(lines, opens), lambda i: i.isNotNull()), texts)
