"""Schemas of the tables the engine exchanges."""

from __future__ import annotations

LINE = "struct<page:int,line_no:int,text:string,size:double>"
PAPERS = f"paper_id string, source string, stem string, creation_date string, lines array<{LINE}>"
SPANS = (
    "paper_id string, page int, block int, line int, span int, text string, size double"
)
CHUNKS = (
    "chunk_id string, paper_id string, text string, title string, year int, source string, "
    "section string, page int, start_page int, chunk_index int"
)
VECTORS = "chunk_id string, embedding array<float>"
QUERIES = "query_id string, text string, embedding array<float>"
CARD_RAW = "task_id string, pos int, paper_id string, final_text string"
EVIDENCE = "array<struct<quote:string,page:int,char_range:array<int>>>"
_CARD = (
    ("paper_id", "string"), ("title", "string"), ("authors", "array<string>"), ("year", "int"),
    ("venue", "string"), ("core_claim", "string"), ("method", "string"),
    ("method_family", "string"), ("key_results", "array<string>"),
    ("stance_tags", "array<string>"), ("opposes", "array<string>"),
    ("limitations", "array<string>"), ("evidence_spans", EVIDENCE),
)
CARD_FIELDS = ",".join(f"{name}:{kind}" for name, kind in _CARD)
CARDS = "task_id string, pos int, " + ", ".join(f"{name} {kind}" for name, kind in _CARD)
TASKS = "task_id string, topic string, status string, blackboard string, updated_at timestamp"
MEMORY_CARDS = "paper_id string, card_json string, updated_at timestamp"
STATUSES = (
    "planning", "retrieving", "reading", "synthesizing", "reviewing", "done", "failed",
)

_NODE = "struct<id:string,label:string,type:string,members:array<string>>"
_EDGE = (
    "struct<source:string,target:string,relation:string,rationale:string,evidence:array<string>>"
)
# The stored state of a task.
BOARD = (
    "task_id string, topic string, plan array<struct<name:string,status:string,note:string>>, "
    f"candidates array<string>, cards map<string,struct<{CARD_FIELDS}>>, "
    f"graph struct<topic:string,nodes:array<{_NODE}>,edges:array<{_EDGE}>,gaps:array<string>>, "
    "critic_feedback array<struct<passed:boolean,issues:array<string>,"
    "suggestions:array<string>,method:string>>, "
    "status string, artifacts array<string>, created_at double, updated_at double"
)
