"""Fixed values of the data contract.

Everything in this module must equal the values other tools write and read:
patterns, limits and the literal sentences of the generated texts.
"""

# --- layout -----------------------------------------------------------------
DEFAULT_BODY_SIZE = 10.0
HEADING_SCALE = 1.15
HEADING_MAX_CHARS = 60
KEYWORD_HEADING_MAX_CHARS = 35
FRONT_SECTION = "_front"
TITLE_MAX_CHARS = 300
CHUNK_CHARS = 800
CHUNK_OVERLAP = 120

# Java regular expressions. (?U) switches to Unicode character classes.
NOISE_LINE = r"(?iU)@|[∗*†‡]\s*$|arXiv:\d"
NUMBERED_HEADING = r"(?U)^\d{1,2}(\.\d{1,2})*\.?\s+\S"
SECTION_KEYWORDS = (
    r"(?i)^(abstract|introduction|related work|background|preliminaries|"
    r"method(s|ology)?|approach|model|framework|experiment(s)?|evaluation|"
    r"result(s)?|analysis|discussion|conclusion(s)?|references|appendix|acknowledg)"
)
HEADING_NUMBER_CHARS = "0123456789. "

# --- publication year -------------------------------------------------------
CREATION_YEAR = r"(?U)D:(\d{4})"
ARXIV_YEAR = r"(?U)arXiv:(\d{2})\d{2}\."
TEXT_YEAR = r"(?U)\b((?:19|20)\d{2})\b"
MIN_CREATION_YEAR = 1990
MAX_CREATION_YEAR = 2100

# --- tokens and ids ---------------------------------------------------------
SEARCH_TOKEN = "[A-Za-z0-9]+"
OVERLAP_TOKEN = "[a-zA-Z0-9一-鿿]+"
SLUG_BREAK = "[^0-9a-zA-Z一-鿿]+"
PAPER_ID = r"(?U)\b[0-9a-f]{12}\b"
PAPER_ID_CHARS = 12

# --- retrieval --------------------------------------------------------------
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
RRF_K = 60
OVERFETCH = 3
DEFAULT_TOP_K = 8
ASK_TOP_K = 5
HIT_TEXT_CHARS = 600
MAX_CANDIDATES = 8
POOL_PER_PAPER = 30
MIN_POOL = 60

# --- cards ------------------------------------------------------------------
JSON_FENCE = r"(?sU)```(?:json)?\s*(\{.*?\})\s*```"
LIST_FIELDS = (
    "authors", "key_results", "stance_tags", "opposes", "limitations", "evidence_spans",
)
TEXT_FIELDS = ("title", "venue", "core_claim", "method", "method_family")

# --- gate, documents, state -------------------------------------------------
QUOTES_PER_CARD = 3
MIN_QUOTE_CHARS = 8
QUOTE_REPORT_CHARS = 50
OVERLAP_RATIO = 0.5
REVIEW_MIN_CHARS = 300
PLACEHOLDER_WORDS = ("待撰写", "待补充", "todo", "占位", "placeholder", "待完成")
RESULTS_PER_PAPER = 3
TOP_LIMITATIONS = 3
SLUG_FILE_CHARS = 80
SPILL_THRESHOLD = 4000
SPILL_SUMMARY_CHARS = 500
PREVIEW_CHARS = 200
EMBED_BATCH = 64

# --- literal sentences ------------------------------------------------------
# `%s` / `%d` places are filled in order by format_string.
MESSAGES = {
    "zh": {
        "unclassified": "未分类",
        "supports": "%s 属于 %s 流派",
        "opposes": "%s 在卡片中声明与「%s」对立",
        "gap_single": "方法流派「%s」仅有单篇代表, 缺乏横向对比与复现验证。",
        "gap_limitation": "多篇论文共同指出但未解决的局限: %s",
        "gap_opposition": "存在方法/观点对立, 但卡片中尚无明确的演进 (evolves_to) 路径衔接, 是潜在的研究空白。",
        "gap_none": "卡片信息有限, 未能自动识别明确研究空白。",
        "issue_missing": "完整性: %d 篇候选论文缺少精读卡片: %s",
        "hint_missing": "对缺失论文重新运行 Reader 精读。",
        "issue_quotes": "引用真实性: %d 条 evidence_spans 无法在原文中回溯 (疑似幻觉): %s%s",
        "hint_quotes": "对无法回溯引用的论文重新精读, 要求 quote 必须摘自原文。",
        "issue_relations": "关系证据: %d 条 opposes 边缺少 evidence 支撑。",
        "hint_relations": "为对立关系补充来自 evidence_spans 的引用, 否则降级为'可能相关'。",
        "issue_no_graph": "完整性: 尚未生成立场图谱。",
        "hint_no_graph": "运行 Synthesizer 的 build_graph。",
        "review_title": "# 综述初稿：%s",
        "review_families": "## 1. 方法流派概览",
        "review_family": "- **%s**：",
        "review_papers": "## 2. 论文要点",
        "review_paper": "### %s (%s)",
        "review_claim": "- 核心主张：%s",
        "review_method": "- 方法：%s",
        "review_results": "- 关键结果：%s",
        "not_extracted": "（未提取）",
        "review_oppositions": "## 3. 观点分歧与立场对立",
        "review_opposition": "- %s ↔ %s：%s",
        "review_gaps": "## 4. 研究空白",
        "review_gap": "- %s",
        "brief": "- [%s] %s (%s) | 流派: %s | 核心主张: %s | 对立: %s",
        "brief_none": "无",
        "brief_empty": "(无卡片)",
        "spilled": "[大输出已落盘: %s]\n摘要(前500字):\n%s",
    },
}


def messages(language: str = "zh") -> dict:
    return MESSAGES[language]
# Characters that a printed list spells as codes: all without a glyph of their own but the space.
UNSEEN_CHARS = r"[\p{C}\p{Z}&&[^ ]]"
