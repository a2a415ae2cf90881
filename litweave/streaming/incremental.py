"""Incremental ingest: a stream of papers is structured and appended to the chunk store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from litweave.plans.ingest import chunk_rows, parse_papers
from litweave.sources.store import add_chunks


def ingest_stream(
    papers: DataFrame,
    chunk_path: str,
    checkpoint: str,
    vector_path: str | None = None,
    provider: Callable[[list[str]], list[list[float]]] | None = None,
    **trigger,
) -> StreamingQuery:
    """Start ingesting a streaming `papers` frame.

    Papers do not depend on each other, so the stream keeps no state. A batch that is replayed
    after a failure meets its own chunk ids and adds nothing.
    """

    def run(batch: DataFrame, _batch_id: int) -> None:
        add_chunks(chunk_rows(parse_papers(batch)), chunk_path, vector_path, provider)

    writer = papers.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
