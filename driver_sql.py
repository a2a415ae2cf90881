"""Oracle SQL: the registered queries in plain SQL over the same tables.

Common table expressions are kept by name; `select` prepends those a statement needs. The derived
inputs follow the rules of `driver_tables.py`.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body


def select(body: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.append(name)
                visit(CTES[name])

    visit(body)
    order: list[str] = []

    def place(name: str) -> None:
        if name in order:
            return
        for other in needed:
            if other != name and re.search(rf"\b{other}\b", CTES[name]):
                place(other)
        order.append(name)

    for name in needed:
        place(name)
    if not order:
        return body
    # The recursive one cannot be marked.
    parts = ",\n".join(
        f"{name} AS {'' if name == 'fold' else 'MATERIALIZED '}({CTES[name]})" for name in order
    )
    return f"WITH RECURSIVE {parts}\n{body}"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def slug(x: str) -> str:
    s = f"trim(regexp_replace(lower({strip(x)}), '[^0-9a-zA-Z一-鿿]+', '_', 'g'), '_')"
    return f"coalesce(nullif({s}, ''), 'unknown')"


def pid(x: str) -> str:
    return f"substr(md5(CAST({x} AS VARCHAR)), 1, 12)"


NOISE = r"(?i)@|[∗*†‡]\s*$|arXiv:\d"
KEYWORDS = (
    "(?i)^(abstract|introduction|related work|background|preliminaries|"
    "method(s|ology)?|approach|model|framework|experiment(s)?|evaluation|"
    "result(s)?|analysis|discussion|conclusion(s)?|references|appendix|acknowledg)"
)

# --- papers, lines, sections, chunks -----------------------------------------
cte("docs", f"""
  SELECT doc_id, {pid('doc_id')} AS paper_id, source, lang, 'doc' || doc_id AS stem,
    CASE WHEN doc_id % 4 = 1 THEN text || chr(10) || 'arXiv:' ||
           lpad(CAST(doc_id % 25 AS VARCHAR), 2, '0') || '05.01234'
         WHEN doc_id % 4 = 2 THEN text || chr(10) || 'Published in ' || (2000 + doc_id % 25)
         ELSE text END AS dated,
    CASE WHEN doc_id % 4 = 0 THEN 'D:' || (1980 + doc_id % 45) || '0101' END AS created,
    text
  FROM documents""")
cte("raw_lines", """
  SELECT paper_id, unnest(string_split(dated, chr(10))) AS t,
    generate_subscripts(string_split(dated, chr(10)), 1) - 1 AS line_no
  FROM docs""")
cte("doc_lines", f"""
  SELECT paper_id, line_no // 20 AS page, line_no, x AS text,
    CAST(CASE WHEN length(x) <= 35 THEN 14.0 ELSE 10.0 END AS DOUBLE) AS size
  FROM (SELECT paper_id, line_no, {strip('t')} AS x FROM raw_lines) WHERE x <> ''""")
cte("body_sizes", """
  SELECT paper_id, size AS body FROM (
    SELECT paper_id, size, row_number() OVER (PARTITION BY paper_id
      ORDER BY sum(length(text)) DESC, min(line_no)) AS r
    FROM doc_lines GROUP BY paper_id, size) WHERE r = 1""")
cte("paper_titles", f"""
  SELECT d.paper_id, coalesce(nullif(substr({strip('s.t')}, 1, 300), ''), d.stem) AS title
  FROM docs d LEFT JOIN (
    SELECT paper_id, string_agg(text, ' ' ORDER BY line_no) AS t FROM (
      SELECT *, max(size) OVER (PARTITION BY paper_id) AS top FROM doc_lines
      WHERE page = 0 AND NOT regexp_matches(text, '{NOISE}')) WHERE size = top
    GROUP BY paper_id) s ON s.paper_id = d.paper_id""")
cte("paper_years", r"""
  SELECT d.paper_id, CASE WHEN x.t IS NULL THEN 0
    WHEN TRY_CAST(regexp_extract(created, 'D:(\d{4})', 1) AS INT) BETWEEN 1990 AND 2100
      THEN CAST(regexp_extract(created, 'D:(\d{4})', 1) AS INT)
    WHEN regexp_extract(x.t, 'arXiv:(\d{2})\d{2}\.', 1) <> ''
      THEN 2000 + CAST(regexp_extract(x.t, 'arXiv:(\d{2})\d{2}\.', 1) AS INT)
    WHEN regexp_extract(x.t, '\b((?:19|20)\d{2})\b', 1) <> ''
      THEN CAST(regexp_extract(x.t, '\b((?:19|20)\d{2})\b', 1) AS INT)
    ELSE 0 END AS year
  FROM docs d LEFT JOIN (SELECT paper_id, string_agg(text, chr(10) ORDER BY line_no) AS t
    FROM doc_lines GROUP BY paper_id) x ON x.paper_id = d.paper_id""")
cte("flagged", rf"""
  SELECT l.paper_id, page, line_no, text, size, (
      length(text) <= 60 AND regexp_matches(text, '[A-Za-z]')
      AND NOT regexp_matches(text, '{NOISE}')
      AND (size >= body * 1.15
        OR (regexp_matches(text, '^\d{{1,2}}(\.\d{{1,2}})*\.?\s+\S')
            AND regexp_matches(ltrim(text, '0123456789. '), '{KEYWORDS}'))
        OR (regexp_matches(ltrim(text, '0123456789. '), '{KEYWORDS}') AND length(text) <= 35)
      )) AS heading
  FROM doc_lines l JOIN body_sizes b ON b.paper_id = l.paper_id""")
cte("sectioned", """
  SELECT *, CAST(sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (
    PARTITION BY paper_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section_no
  FROM flagged""")
cte("body_lines", """
  SELECT s.paper_id, s.section_no, s.page, s.text, s.line_no,
    coalesce(h.text, '_front') AS section,
    row_number() OVER (PARTITION BY s.paper_id, s.section_no ORDER BY s.line_no) AS i,
    count(*) OVER (PARTITION BY s.paper_id, s.section_no) AS n
  FROM sectioned s LEFT JOIN sectioned h
    ON h.paper_id = s.paper_id AND h.section_no = s.section_no AND h.heading
  WHERE NOT s.heading""")
cte("fold", """
  SELECT paper_id, section_no, i, 1 AS k,
    CASE WHEN length(text) + 1 >= 800 THEN 120 ELSE length(text) + 1 END AS buf,
    CASE WHEN length(text) + 1 >= 800 THEN 2 ELSE 1 END AS next_k
  FROM body_lines WHERE i = 1
  UNION ALL
  SELECT b.paper_id, b.section_no, b.i, f.next_k,
    CASE WHEN f.buf + length(b.text) + 1 >= 800 THEN 120 ELSE f.buf + length(b.text) + 1 END,
    CASE WHEN f.buf + length(b.text) + 1 >= 800 THEN f.next_k + 1 ELSE f.next_k END
  FROM fold f JOIN body_lines b
    ON b.paper_id = f.paper_id AND b.section_no = f.section_no AND b.i = f.i + 1""")
cte("new_text", """
  SELECT b.paper_id, b.section_no, f.k, string_agg(text, chr(10) ORDER BY b.i) || chr(10) AS raw,
    arg_min(page, b.i) AS start_page
  FROM fold f JOIN body_lines b
    ON b.paper_id = f.paper_id AND b.section_no = f.section_no AND b.i = f.i
  GROUP BY b.paper_id, b.section_no, f.k""")
cte("slots", """
  SELECT paper_id, section_no, unnest(generate_series(1, last_k)) AS k FROM (
    SELECT paper_id, section_no, max(next_k) AS last_k FROM fold GROUP BY 1, 2)""")
cte("section_info", """
  SELECT paper_id, section_no, any_value(section) AS section, arg_min(page, i) AS page,
    arg_max(page, i) AS last_page FROM body_lines GROUP BY 1, 2""")
cte("chunk_table", f"""
  SELECT c.paper_id || '_' || chunk_index AS chunk_id, c.paper_id, c.text, t.title, y.year,
    d.source, section, page, start_page, chunk_index
  FROM (
    SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY section_no, k) - 1 AS chunk_index
    FROM (
      SELECT s.paper_id, s.section_no, s.k, i.section, i.page,
        coalesce(n.start_page, i.last_page) AS start_page,
        {strip("coalesce(right(p.raw, 120), '') || coalesce(n.raw, '')")} AS text
      FROM slots s
      JOIN section_info i ON i.paper_id = s.paper_id AND i.section_no = s.section_no
      LEFT JOIN new_text n ON n.paper_id = s.paper_id AND n.section_no = s.section_no AND n.k = s.k
      LEFT JOIN new_text p
        ON p.paper_id = s.paper_id AND p.section_no = s.section_no AND p.k = s.k - 1)
    WHERE text <> '') c
  JOIN docs d ON d.paper_id = c.paper_id
  JOIN paper_titles t ON t.paper_id = c.paper_id
  JOIN paper_years y ON y.paper_id = c.paper_id""")
cte("paper_list", """
  SELECT paper_id, arg_min(title, chunk_index) AS title, arg_min(year, chunk_index) AS year
  FROM chunk_table GROUP BY paper_id""")

# --- retrieval ----------------------------------------------------------------
cte("items", """
  SELECT 'q' || item_id AS query_id, item_id, text, CAST(embedding AS DOUBLE[]) AS embedding
  FROM benchmark LEFT JOIN embeddings ON vec_id = item_id""")
cte("doc_chunks", f"""
  SELECT {pid('doc_id')} || '_0' AS chunk_id, {pid('doc_id')} AS paper_id, text,
    'Document ' || doc_id AS title, CASE WHEN doc_id % 4 = 3 THEN 0 ELSE 2000 + doc_id % 25 END AS year,
    source, '_front' AS section, 0 AS page, 0 AS chunk_index
  FROM documents""")
cte("doc_vectors", f"""
  SELECT {pid('vec_id')} || '_0' AS chunk_id, CAST(embedding AS DOUBLE[]) AS embedding
  FROM embeddings""")


def bm25(prefix: str, corpus: str, queries: str, scope: str = "") -> str:
    """Register the CTEs of one BM25 ranking; returns the name of the one with all ranks."""
    s = f"{scope}, " if scope else ""
    p = prefix

    def on(a: str, b: str) -> str:
        return f" AND {a}.{scope} = {b}.{scope}" if scope else ""

    def using(cols: str) -> str:
        return f"USING ({cols})" if cols else "ON true"

    cte(f"{p}_tf", f"""
      SELECT {s}chunk_id, term, count(*) AS tf FROM (
        SELECT {s}chunk_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS term
        FROM {corpus}) GROUP BY ALL""")
    cte(f"{p}_dl", f"""
      SELECT {s}chunk_id, {'' if scope == 'paper_id' else 'paper_id, '}chunk_index,
        len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS dl FROM {corpus}""")
    cte(f"{p}_tot", f"""
      SELECT {s}count(*) AS n, CAST(sum(dl) AS DOUBLE) / count(*) AS avgdl
      FROM {p}_dl {'GROUP BY ' + scope if scope else ''}""")
    cte(f"{p}_idf", f"""
      SELECT {s}term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (
        SELECT {s}term, count(*) AS df FROM {p}_tf GROUP BY {s}term)
      JOIN {p}_tot {using(scope)}""")
    cte(f"{p}_mean", f"""
      SELECT {s}avg(idf) AS mean_idf FROM {p}_idf {'GROUP BY ' + scope if scope else ''}""")
    cte(f"{p}_weights", f"""
      SELECT query_id, {s}term, times, CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END AS idf
      FROM (SELECT query_id, {s}term, count(*) AS times FROM (
          SELECT query_id, {s}lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS term
          FROM {queries}) GROUP BY ALL)
      JOIN {p}_idf USING ({s}term) JOIN {p}_mean {using(scope)}""")
    cte(f"{p}_scores", f"""
      SELECT w.query_id, t.chunk_id,
        sum(w.idf * w.times * t.tf * 2.5 / (t.tf + 1.5 * (0.25 + 0.75 * d.dl / o.avgdl))) AS score
      FROM {p}_weights w JOIN {p}_tf t ON t.term = w.term{on('t', 'w')}
      JOIN {p}_dl d ON d.chunk_id = t.chunk_id{on('d', 't')}
      JOIN {p}_tot o ON true{on('o', 'w')}
      GROUP BY w.query_id, t.chunk_id""")
    cte(f"{p}_ranked", f"""
      SELECT q.query_id, d.chunk_id, d.paper_id, d.chunk_index,
        coalesce(s.score, CAST(0 AS DOUBLE)) AS score,
        row_number() OVER (PARTITION BY q.query_id
          ORDER BY round(coalesce(s.score, 0), 9) DESC, d.paper_id, d.chunk_index) - 1 AS rank
      FROM {queries} q JOIN {p}_dl d ON true{on('d', 'q')}
      LEFT JOIN {p}_scores s ON s.query_id = q.query_id AND s.chunk_id = d.chunk_id""")
    return f"{p}_ranked"


def nearest(name: str, corpus: str, queries: str, scope: str = "", vectors: str = "doc_vectors") -> str:
    on = f"c.{scope} = q.{scope}" if scope else "true"
    cte(name, f"""
      SELECT query_id, chunk_id, paper_id, chunk_index, score, row_number() OVER (
        PARTITION BY query_id ORDER BY score DESC, paper_id, chunk_index) - 1 AS rank
      FROM (SELECT q.query_id, c.chunk_id, c.paper_id, c.chunk_index,
          round(1 - list_distance(q.embedding, v.embedding) ** 2, 9) AS score
        FROM {queries} q JOIN {corpus} c ON {on} JOIN {vectors} v ON v.chunk_id = c.chunk_id
        WHERE q.embedding IS NOT NULL)""")
    return name


def fused(name: str, vector: str, keyword: str, fetch: str, top: str) -> str:
    cte(f"{name}_all", f"""
      SELECT query_id, chunk_id, paper_id, chunk_index, v.rank AS v_rank, k.rank AS k_rank,
        coalesce(CAST(1 AS DOUBLE) / (60 + v.rank), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + k.rank), 0) AS raw
      FROM (SELECT * FROM {vector} WHERE rank < {fetch}) v
      FULL OUTER JOIN (SELECT * FROM {keyword} WHERE rank < {fetch}) k
      USING (query_id, chunk_id, paper_id, chunk_index)""")
    cte(name, f"""
      SELECT query_id, chunk_id, paper_id, chunk_index, round(raw, 6) AS score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id
          ORDER BY raw DESC, v_rank NULLS LAST, k_rank NULLS LAST) - 1 AS rank FROM {name}_all)
      WHERE rank < {top}""")
    return name


bm25("ck", "chunk_table", "items")
bm25("dk", "doc_chunks", "items")
nearest("dv", "doc_chunks", "items")
fused("dh", "dv", "dk_ranked", "24", "8")
fused("da", "dv", "dk_ranked", "15", "5")
cte("late_chunks", "SELECT * FROM doc_chunks WHERE year >= 2012")
bm25("yk", "late_chunks", "items")
nearest("yv", "late_chunks", "items")
fused("yh", "yv", "yk_ranked", "24", "8")

cte("dated_items", "SELECT *, 2003 + item_id % 5 * 4 AS year_min FROM items")
cte("dated_chunks", """
  SELECT c.*, year_min FROM doc_chunks c
  JOIN (SELECT DISTINCT year_min FROM dated_items) ON year >= year_min""")
bm25("zk", "dated_chunks", "dated_items", "year_min")
nearest("zv", "dated_chunks", "dated_items", "year_min")
fused("zh", "zv", "zk_ranked", "24", "8")

cte("paper_items", f"""
  SELECT 'p' || doc_id AS query_id, {pid('doc_id')} AS paper_id, b.text
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)""")
bm25("sk", "chunk_table", "paper_items", "paper_id")
cte("vector_items", f"""
  SELECT 'v' || vec_id AS query_id, {pid('vec_id')} AS paper_id, b.text,
    CAST(embedding AS DOUBLE[]) AS embedding
  FROM embeddings JOIN benchmark b ON b.item_id = vec_id % (SELECT count(*) FROM benchmark)""")
bm25("vk", "doc_chunks", "vector_items", "paper_id")
nearest("vv", "doc_chunks", "vector_items", "paper_id")
fused("vh", "vv", "vk_ranked", "24", "8")

# --- named papers and candidates ------------------------------------------------
cte("final_texts", f"""
  SELECT 'q' || item_id AS query_id, 'Candidates: ' || {pid('item_id * 2')} || ', xx' ||
    {pid('item_id')} || chr(10) || {pid('item_id + 3')} AS final_text FROM benchmark""")
cte("trace_rows", f"""
  SELECT 'q' || (conv_id % (SELECT count(*) FROM benchmark)) AS query_id, conv_id * 1000 + turn AS seq,
    CASE WHEN role = 'assistant' THEN 'observe' ELSE 'act' END AS type,
    CASE WHEN conv_id % 3 = 0 AND turn = 1
      THEN {pid('conv_id * 5')} || ' ' || text ELSE text END AS result_preview
  FROM conversations""")
cte("named_ids", r"""
  SELECT query_id, seq, unnest(regexp_extract_all(t, '\b[0-9a-f]{12}\b')) AS paper_id,
    generate_subscripts(regexp_extract_all(t, '\b[0-9a-f]{12}\b'), 1) - 1 AS pos
  FROM (SELECT query_id, -1 AS seq, final_text AS t FROM final_texts
    UNION ALL SELECT query_id, seq, substr(coalesce(result_preview, ''), 1, 200) FROM trace_rows
    WHERE type = 'observe')""")
cte("named", """
  SELECT query_id, paper_id, seq, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY seq, pos) AS r
    FROM named_ids WHERE paper_id IN (SELECT paper_id FROM doc_chunks)) WHERE r = 1""")
cte("pool_size", "SELECT greatest(30 * count(DISTINCT paper_id), 60) AS n FROM doc_chunks")
fused("tp", "dv", "dk_ranked", "(SELECT 3 * n FROM pool_size)", "(SELECT n FROM pool_size)")
cte("candidate_rows", """
  SELECT query_id, paper_id, rank FROM (
    SELECT query_id, paper_id, row_number() OVER (
      PARTITION BY query_id ORDER BY source, a, b) - 1 AS rank
    FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY source, a, b) AS r
      FROM (
        SELECT query_id, paper_id, 0 AS source, CAST(seq AS DOUBLE) AS a, pos AS b FROM named
        UNION ALL
        SELECT query_id, paper_id, 1, -greatest(0, max(score)), min(rank)
        FROM tp GROUP BY query_id, paper_id))
    WHERE r = 1) WHERE rank < 8""")

# --- cards ------------------------------------------------------------------------
CLEAN = "regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g')"
cte("card_json", f"""
  SELECT 't' || (d.doc_id // 8) AS task_id, CAST(d.doc_id % 8 AS INT) AS pos, d.doc_id,
    {pid('d.doc_id')} AS paper_id,
    '{{"paper_id":"evil","foo":{{"a":[1]}},"title":"' ||
    CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE 'Study ' || d.doc_id || ' of ' || lang END ||
    '","year":' || CASE d.doc_id % 6 WHEN 0 THEN '2024' WHEN 1 THEN '" 2023 "'
      WHEN 2 THEN '2022.9' WHEN 3 THEN '"n/a"' WHEN 4 THEN 'null' ELSE '"2021.5"' END ||
    ',"core_claim":"Claim ' || d.doc_id || '"' ||
    CASE WHEN d.doc_id % 3 = 1 THEN '' ELSE ',"method":"Method ' || (d.doc_id % 9) || '"' END ||
    ',"method_family":"' || CASE d.doc_id % 4 WHEN 0 THEN 'Graph Method ' || (d.doc_id % 3)
      WHEN 1 THEN 'graph-method ' || (d.doc_id % 3) WHEN 2 THEN lang || ' survey' ELSE '' END ||
    '","key_results":' || CASE d.doc_id % 3 WHEN 0 THEN '["a","b","c","d"]'
      WHEN 1 THEN '"single"' ELSE '[]' END ||
    ',"opposes":' || CASE d.doc_id % 3
      WHEN 0 THEN '["study ' || (d.doc_id + 1) || ' of"," GRAPH method ' || ((d.doc_id + 1) % 3) ||
        '","unseen view ' || (d.doc_id % 5) || '"]'
      WHEN 1 THEN '"Unseen View ' || (d.doc_id % 5) || '"'
      ELSE CASE d.doc_id % 2 WHEN 0 THEN '""' ELSE 'null' END END ||
    ',"limitations":["small data"," small data ","' || CASE WHEN l.quality IS NULL
      THEN 'not labelled' ELSE 'quality ' || l.quality || ' toxic ' || l.toxic END || '"]' ||
    ',"evidence_spans":' || CASE d.doc_id % 7 WHEN 0 THEN '[]'
      WHEN 1 THEN '"' || {CLEAN.format("coalesce(string_split(d.text, chr(10))[d.doc_id % 3 + 1], '')")} || '"'
      ELSE '[{{"quote":"' || {CLEAN.format("coalesce(string_split(d.text, chr(10))[d.doc_id % 3 + 1], '')")} ||
        '","page":' || (d.doc_id % 3) || '}},"' || {CLEAN.format("b.text")} ||
        '",{{"page":1}},"tiny"]' END || '}}' AS body
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
  LEFT JOIN labels l ON l.doc_id = d.doc_id""")
cte("card_raw", """
  SELECT task_id, pos, paper_id, doc_id, CASE
    WHEN doc_id % 16 = 3 THEN '```json' || chr(10) || '{bad}' || chr(10) || '``` then ' || body
    WHEN doc_id % 4 = 0 THEN '```json' || chr(10) || body || chr(10) || '```'
    WHEN doc_id % 4 = 1 THEN 'Here is the card: ' || body || ' Done.'
    WHEN doc_id % 4 = 2 THEN body
    ELSE '``` ' || body || ' ``` and more' END AS final_text
  FROM card_json WHERE doc_id % 11 <> 5""")
cte("card_objects", r"""
  SELECT task_id, pos, paper_id, doc_id,
    CASE WHEN json_valid(c) AND left(c, 1) = '{' THEN CAST(c AS JSON) ELSE CAST('{}' AS JSON) END AS v
  FROM (SELECT *, CASE WHEN fenced <> '' THEN fenced
      WHEN strpos(final_text, '{') > 0 AND length(final_text) - strpos(reverse(final_text), '}') + 1
        > strpos(final_text, '{') AND strpos(final_text, '}') > 0
      THEN substr(final_text, strpos(final_text, '{'), length(final_text)
        - strpos(reverse(final_text), '}') + 2 - strpos(final_text, '{')) ELSE '' END AS c
    FROM (SELECT *, regexp_extract(final_text, '(?s)```(?:json)?\s*(\{.*?\})\s*```', 1) AS fenced
      FROM card_raw))""")


def as_list(field: str) -> str:
    """List of strings of a JSON field: lists as they are, one value as a list, falsy as []."""
    return f"""CASE coalesce(json_type(v, '$.{field}'), 'NULL')
      WHEN 'ARRAY' THEN CAST(json_extract_string(v, '$.{field}[*]') AS VARCHAR[])
      WHEN 'NULL' THEN CAST([] AS VARCHAR[])
      ELSE CASE WHEN json_extract_string(v, '$.{field}') = '' THEN CAST([] AS VARCHAR[])
        ELSE [json_extract_string(v, '$.{field}')] END END"""


cte("card_fields", f"""
  SELECT task_id, pos, paper_id,
    coalesce(json_extract_string(v, '$.title'), '') AS title,
    CASE json_type(v, '$.year')
      WHEN 'VARCHAR' THEN CASE WHEN regexp_matches(json_extract_string(v, '$.year'), '^\\s*[+-]?\\d+\\s*$')
        THEN CAST(trim(json_extract_string(v, '$.year')) AS INT) ELSE 0 END
      WHEN 'DOUBLE' THEN CAST(trunc(CAST(json_extract_string(v, '$.year') AS DOUBLE)) AS INT)
      WHEN 'UBIGINT' THEN CAST(json_extract_string(v, '$.year') AS INT)
      ELSE 0 END AS year,
    coalesce(json_extract_string(v, '$.core_claim'), '') AS core_claim,
    coalesce(json_extract_string(v, '$.method'), '') AS method,
    coalesce(json_extract_string(v, '$.method_family'), '') AS method_family,
    {as_list('key_results')} AS key_results,
    {as_list('opposes')} AS opposes,
    {as_list('limitations')} AS limitations,
    list_filter(list_transform(
      CASE coalesce(json_type(v, '$.evidence_spans'), 'NULL')
        WHEN 'ARRAY' THEN CAST(json_extract(v, '$.evidence_spans[*]') AS JSON[])
        WHEN 'NULL' THEN CAST([] AS JSON[]) ELSE [json_extract(v, '$.evidence_spans')] END,
      lambda s: trim(coalesce(CASE WHEN json_type(s) = 'OBJECT' THEN json_extract_string(s, '$.quote')
        ELSE json_extract_string(s, '$') END, ''))), lambda q: q <> '') AS quotes
  FROM card_objects""")
cte("cards", """
  SELECT task_id, pos, paper_id, coalesce(nullif(c.title, ''), p.title, '') AS title,
    coalesce(nullif(c.year, 0), p.year, 0) AS year, core_claim, method, method_family,
    key_results, opposes, limitations, quotes
  FROM card_fields c LEFT JOIN paper_list p USING (paper_id)""")
cte("task_list", """
  SELECT DISTINCT 't' || (doc_id // 8) AS task_id, 'Topic ' || (doc_id // 8) AS topic FROM documents""")
cte("task_candidates", f"""
  SELECT 't' || (doc_id // 8) AS task_id, {pid('doc_id')} AS paper_id,
    CAST(doc_id % 8 AS INT) AS rank FROM documents""")

# --- graph --------------------------------------------------------------------------
cte("families", f"""
  SELECT *, 'family::' || {slug('family')} AS cluster_id,
    coalesce(nullif(title, ''), paper_id) AS name
  FROM (SELECT *, coalesce(nullif(method_family, ''), '未分类') AS family FROM cards)""")
cte("clusters", """
  SELECT task_id, cluster_id, arg_min(family, pos) AS label, min(pos) AS first_pos,
    count(*) AS n_members FROM families GROUP BY task_id, cluster_id""")
cte("opposed", f"""
  SELECT task_id, pos, paper_id, name, quotes[1:1] AS evidence, opp, opp_pos,
    {strip('lower(opp)')} AS key
  FROM (SELECT *, unnest(opposes) AS opp, generate_subscripts(opposes, 1) - 1 AS opp_pos
    FROM families)""")
cte("targets", """
  SELECT task_id, 0 AS kind, lower(title) AS text, min(pos) AS tpos, arg_max(paper_id, pos) AS target
  FROM cards WHERE title <> '' GROUP BY task_id, lower(title)
  UNION ALL
  SELECT task_id, 1, lower(label), first_pos, cluster_id FROM clusters""")
cte("resolved", f"""
  SELECT o.*, r.target AS hit, coalesce(r.target, 'viewpoint::' || {slug('o.opp')}) AS target
  FROM opposed o LEFT JOIN (
    SELECT task_id, pos, opp_pos, target, row_number() OVER (
      PARTITION BY task_id, pos, opp_pos ORDER BY kind, tpos) AS r
    FROM opposed o JOIN targets t USING (task_id)
    WHERE key <> '' AND (contains(t.text, o.key) OR contains(o.key, t.text))) r
  ON r.task_id = o.task_id AND r.pos = o.pos AND r.opp_pos = o.opp_pos AND r.r = 1""")
cte("nodes", f"""
  SELECT task_id, id, label, type, part, p1, p2 FROM (
    SELECT *, row_number() OVER (PARTITION BY task_id, id ORDER BY part, p1, p2) AS r FROM (
      SELECT task_id, cluster_id AS id, label, 'method_family' AS type, 0 AS part,
        first_pos AS p1, 0 AS p2 FROM clusters
      UNION ALL SELECT task_id, paper_id, name, 'paper', 1, pos, 0 FROM families
      UNION ALL SELECT task_id, target, opp, 'viewpoint', 2, pos, opp_pos FROM resolved
      WHERE hit IS NULL)) WHERE r = 1""")
cte("edges", """
  SELECT task_id, 0 AS part, first_pos AS p1, pos AS p2, paper_id AS source, cluster_id AS target,
    'supports' AS relation, name || ' 属于 ' || label || ' 流派' AS rationale,
    CAST([] AS VARCHAR[]) AS evidence
  FROM families JOIN clusters USING (task_id, cluster_id)
  UNION ALL
  SELECT task_id, 1, pos, opp_pos, paper_id, target, 'opposes',
    name || ' 在卡片中声明与「' || opp || '」对立', evidence FROM resolved""")
cte("limits", f"""
  SELECT task_id, limitation, n, rank FROM (
    SELECT task_id, limitation, n, row_number() OVER (
      PARTITION BY task_id ORDER BY n DESC, p, lp) - 1 AS rank
    FROM (SELECT task_id, limitation, count(*) AS n, min(pos) AS p,
        min(pos * 1000 + lim_pos) AS lp
      FROM (SELECT task_id, pos, lim_pos, {strip('l')} AS limitation FROM (
        SELECT task_id, pos, unnest(limitations) AS l,
          generate_subscripts(limitations, 1) - 1 AS lim_pos FROM cards))
      GROUP BY task_id, limitation)) WHERE rank < 3 AND n >= 2 AND limitation <> ''""")
cte("found_gaps", """
  SELECT task_id, 1 AS part, min(pos) AS pos,
    '方法流派「' || family || '」仅有单篇代表, 缺乏横向对比与复现验证。' AS gap
  FROM families WHERE family <> '未分类' GROUP BY task_id, family HAVING count(*) = 1
  UNION ALL SELECT task_id, 2, rank, '多篇论文共同指出但未解决的局限: ' || limitation FROM limits
  UNION ALL SELECT DISTINCT task_id, 3, 0,
    '存在方法/观点对立, 但卡片中尚无明确的演进 (evolves_to) 路径衔接, 是潜在的研究空白。'
  FROM cards WHERE len(opposes) > 0""")
cte("gap_rows", """
  SELECT * FROM found_gaps
  UNION ALL SELECT DISTINCT task_id, 4, 0, '卡片信息有限, 未能自动识别明确研究空白。' FROM cards
  WHERE task_id NOT IN (SELECT task_id FROM found_gaps)""")

# --- quality gate ---------------------------------------------------------------------
cte("missing", """
  SELECT task_id, paper_id, rank FROM task_candidates
  WHERE (task_id, paper_id) NOT IN (SELECT (task_id, paper_id) FROM cards)""")
cte("quote_rows", """
  SELECT task_id, pos, paper_id, quote, quote_pos,
    paper_id || '#' || pos || '#' || quote_pos || '#' || task_id AS query_id, quote AS text
  FROM (SELECT task_id, pos, paper_id, unnest(quotes[1:3]) AS quote,
      generate_subscripts(quotes[1:3], 1) - 1 AS quote_pos FROM cards)
  WHERE length(quote) >= 8""")
bm25("qk", "chunk_table", "quote_rows", "paper_id")


def judged(name: str, best: str) -> None:
    """Quotes held against the first hit of their search."""
    cte(name, f"""
  SELECT q.task_id, q.pos, q.paper_id, q.quote_pos, q.quote, coalesce(len(qt) > 0 AND
    CAST(len(list_intersect(qt, st)) AS DOUBLE) / len(qt) >= 0.5, false) AS verified
  FROM (SELECT *, list_distinct(regexp_extract_all(lower(quote), '[a-zA-Z0-9一-鿿]+')) AS qt
    FROM quote_rows) q
  LEFT JOIN (SELECT query_id, list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9一-鿿]+')) AS st
    FROM {best} JOIN chunk_table USING (chunk_id) WHERE rank = 0) s USING (query_id)""")


def letter_counts(text: str) -> str:
    """The vector that the queries' provider makes of a text, in single precision."""
    shares = [f"length({text}) / 1000", *[f"(length({text}) - length(replace({text}, '{c}', ''))) / 100" for c in "ea"]]
    return f"[{', '.join(f'CAST(CAST({x} AS FLOAT) AS DOUBLE)' for x in shares)}]"


judged("checked", "qk_ranked")
cte("counted_quotes", f"SELECT *, {letter_counts('text')} AS embedding FROM quote_rows")
cte("counted_chunks", f"SELECT chunk_id, {letter_counts('text')} AS embedding FROM chunk_table")
nearest("qv", "chunk_table", "counted_quotes", "paper_id", "counted_chunks")
fused("qh", "qv", "qk_ranked", "3", "1")
judged("checked_hybrid", "qh")
cte("unverified", """
  SELECT task_id, pos, paper_id, quote_pos, substr(quote, 1, 50) AS quote
  FROM checked WHERE NOT verified""")
cte("bare_edges", "SELECT * FROM edges WHERE relation = 'opposes' AND len(evidence) = 0")
cte("issue_rows", """
  SELECT task_id, 1 AS ck, '完整性: ' || count(*) || ' 篇候选论文缺少精读卡片: [''' ||
    string_agg(paper_id, ''', ''' ORDER BY rank) || ''']' AS issue,
    '对缺失论文重新运行 Reader 精读。' AS suggestion
  FROM missing GROUP BY task_id
  UNION ALL
  SELECT task_id, 2, '引用真实性: ' || max(n) || ' 条 evidence_spans 无法在原文中回溯 (疑似幻觉): [''' ||
    string_agg(quote, ''', ''' ORDER BY r) || ''']' || CASE WHEN max(n) > 3 THEN '...' ELSE '' END,
    '对无法回溯引用的论文重新精读, 要求 quote 必须摘自原文。'
  FROM (SELECT *, count(*) OVER (PARTITION BY task_id) AS n, row_number() OVER (
      PARTITION BY task_id ORDER BY pos, quote_pos) AS r FROM unverified)
  WHERE r <= 3 GROUP BY task_id
  UNION ALL
  SELECT task_id, 3, '关系证据: ' || count(*) || ' 条 opposes 边缺少 evidence 支撑。',
    '为对立关系补充来自 evidence_spans 的引用, 否则降级为''可能相关''。'
  FROM bare_edges GROUP BY task_id
  UNION ALL
  SELECT task_id, 3, '完整性: 尚未生成立场图谱。', '运行 Synthesizer 的 build_graph。'
  FROM task_list WHERE task_id NOT IN (SELECT task_id FROM nodes)""")
cte("failed", "SELECT DISTINCT task_id FROM issue_rows")

# --- review -----------------------------------------------------------------------------
cte("pieces", """
  SELECT task_id, 0 AS part, 0 AS p1, 0 AS p2, '' AS glue,
    '# 综述初稿：' || topic || chr(10) || chr(10) || '## 1. 方法流派概览' || chr(10) AS text FROM task_list
  UNION ALL SELECT task_id, 1, p1, -1, chr(10), '- **' || label || '**：' FROM nodes
    WHERE type = 'method_family'
  UNION ALL SELECT task_id, 1, first_pos, pos, CASE WHEN pos = first_pos THEN '' ELSE ', ' END, name
    FROM families JOIN clusters USING (task_id, cluster_id)
  UNION ALL SELECT task_id, 2, 0, 0, chr(10) || chr(10), '## 2. 论文要点' || chr(10) FROM task_list
  UNION ALL SELECT task_id, 3, pos, 0, chr(10),
    '### ' || name || ' (' || coalesce(CAST(nullif(year, 0) AS VARCHAR), '?') || ')' FROM families
  UNION ALL SELECT task_id, 3, pos, 1, chr(10),
    '- 核心主张：' || coalesce(nullif(core_claim, ''), '（未提取）') FROM families
  UNION ALL SELECT task_id, 3, pos, 2, chr(10),
    '- 方法：' || coalesce(nullif(method, ''), '（未提取）') FROM families
  UNION ALL SELECT task_id, 3, pos, 3, chr(10),
    '- 关键结果：' || array_to_string(key_results[1:3], '; ') FROM families WHERE len(key_results) > 0
  UNION ALL SELECT task_id, 3, pos, 4, chr(10), '' FROM families
  UNION ALL SELECT task_id, 4, 0, 0, chr(10), '## 3. 观点分歧与立场对立' || chr(10) FROM task_list
  UNION ALL SELECT e.task_id, 5, e.p1, e.p2, chr(10), '- ' || coalesce(s.label, e.source) || ' ↔ ' ||
    coalesce(t.label, e.target) || '：' || rationale
    FROM edges e LEFT JOIN nodes s ON s.task_id = e.task_id AND s.id = e.source
    LEFT JOIN nodes t ON t.task_id = e.task_id AND t.id = e.target WHERE relation = 'opposes'
  UNION ALL SELECT task_id, 6, 0, 0, chr(10) || chr(10), '## 4. 研究空白' || chr(10) FROM task_list
  UNION ALL SELECT task_id, 7, part, pos, chr(10), '- ' || gap FROM gap_rows""")
cte("reviews", """
  SELECT task_id, string_agg(glue || text, '' ORDER BY part, p1, p2) AS review
  FROM pieces GROUP BY task_id""")
cte("drafts", """
  SELECT 't' || (doc_id // 8) AS task_id,
    arg_max(CASE WHEN doc_id % 3 = 0 THEN text || ' TODO' ELSE text END, doc_id) AS final_text
  FROM documents GROUP BY doc_id // 8""")
def chosen(name: str, best: str, stored: str) -> None:
    cte(name, f"""
  SELECT r.task_id, CASE WHEN ok THEN best ELSE review END AS review, ok AS supplied FROM (
    SELECT task_id, review, best, length(best) >= 300 AND NOT regexp_matches(lower(best),
      '待撰写|待补充|todo|占位|placeholder|待完成') AS ok
    FROM (SELECT r.task_id, r.review, {best} AS best
      FROM reviews r LEFT JOIN drafts USING (task_id) {stored})) r""")


LAST = strip("coalesce(final_text, '')")
FIRST = strip("coalesce(stored_text, '')")
chosen("chosen", LAST, "")
cte("first_drafts", "SELECT 't' || (doc_id // 8) AS task_id, arg_min(coalesce(text, ''), doc_id) AS stored_text FROM documents GROUP BY doc_id // 8")
chosen("chosen_stored", f"CASE WHEN length({FIRST}) > length({LAST}) THEN {FIRST} ELSE {LAST} END", "LEFT JOIN first_drafts USING (task_id)")


def printed(items: str) -> str:
    """A list of strings as the issue sentence prints it."""
    char = """CASE WHEN c = chr(92) THEN '\\\\' WHEN c = chr(10) THEN '\\n' WHEN c = chr(13) THEN '\\r' WHEN c = chr(9) THEN '\\t'
      WHEN c <> ' ' AND regexp_matches(c, '[\\p{C}\\p{Z}]') THEN CASE WHEN unicode(c) < 256 THEN format('\\x{:02x}', unicode(c))
        WHEN unicode(c) < 65536 THEN format('\\u{:04x}', unicode(c)) ELSE format('\\U{:08x}', unicode(c)) END
      WHEN c = chr(39) AND q = chr(39) THEN '\\' || chr(39) ELSE c END"""
    quote = "CASE WHEN contains(s, chr(39)) AND NOT contains(s, chr(34)) THEN chr(34) ELSE chr(39) END"
    one = f"""list_transform([{quote}], lambda q:
      q || array_to_string(list_transform(regexp_extract_all(s, '(?s).'), lambda c: {char}), '') || q)[1]"""
    return f"'[' || array_to_string(list_transform({items}, lambda s: {one}), ', ') || ']'"

