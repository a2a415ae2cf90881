"""Literature corpora as Spark tables: ingest, retrieval, cards, graph, gate, reviews."""

from litweave.operators.bm25 import bm25
from litweave.operators.candidates import expand_topics as expand_query
from litweave.operators.candidates import topic_candidates
from litweave.operators.cards import parse_cards
from litweave.operators.fusion import ask, hybrid_search, rag_query
from litweave.operators.gaps import detect_gaps
from litweave.operators.graph import build_graph, cluster_cards
from litweave.operators.vectors import embed, nearest
from litweave.plans.ingest import chunk_rows, parse_papers
from litweave.plans.topic_map import map_topics
from litweave.sources.exports import export_graph, export_md
from litweave.streaming.incremental import ingest_stream

__all__ = [
    "ask", "bm25", "build_graph", "chunk_rows", "cluster_cards", "detect_gaps", "embed",
    "expand_query", "export_graph", "export_md", "hybrid_search", "ingest_stream", "map_topics",
    "nearest", "parse_cards", "parse_papers", "rag_query", "topic_candidates",
]
