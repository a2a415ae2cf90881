"""Oracle SQL (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from .packing import BUCKETS, BUDGET

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def _packing() -> str:
    """Layered dynamic programming, dp1 … dpK over the histogram of lengths, and the way back, at K … at1."""
    layers = ["dp1 AS MATERIALIZED (SELECT j, {'cost': bound * upto, 'i': 0} AS m FROM hist)"]
    for k in range(2, BUCKETS + 1):
        layers.append(
            f"dp{k} AS MATERIALIZED (SELECT h.j, min({{'cost': p.cost + h.bound * (h.upto - p.upto), 'i': p.i}}) AS m "
            f"FROM hist h JOIN (SELECT d.j AS i, d.m.cost AS cost, g.upto FROM dp{k - 1} d JOIN hist g ON g.j = d.j "
            f"UNION ALL SELECT 0, 0, 0) p ON p.i < h.j GROUP BY h.j)"
        )
    back = [f"at{BUCKETS} AS (SELECT j, m.i AS i FROM dp{BUCKETS} WHERE j = (SELECT max(j) FROM hist))"]
    for k in range(BUCKETS - 1, 0, -1):
        back.append(f"at{k} AS (SELECT j, m.i AS i FROM dp{k} WHERE j = (SELECT i FROM at{k + 1}))")
    ends = " UNION ".join(f"SELECT j FROM at{k}" for k in range(1, BUCKETS + 1))
    return f"""
WITH words AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS n FROM documents),
hist AS MATERIALIZED (SELECT bound, c, row_number() OVER (ORDER BY bound) AS j, CAST(sum(c) OVER (ORDER BY bound) AS BIGINT) AS upto
  FROM (SELECT n AS bound, count(*) AS c FROM words GROUP BY n)),
{", ".join(layers)},
{", ".join(back)},
numbered AS (SELECT bound, CAST(row_number() OVER (ORDER BY bound) - 1 AS INTEGER) AS bucket FROM hist WHERE j IN ({ends})),
owned AS (SELECT doc_id, n, (SELECT min(bound) FROM numbered b WHERE b.bound >= words.n) AS bound FROM words),
placed AS (SELECT o.doc_id, n, bucket, b.bound, row_number() OVER (PARTITION BY bucket ORDER BY n, doc_id) - 1 AS nth,
  greatest(1, {BUDGET} // greatest(b.bound, 1)) AS fit FROM owned o JOIN numbered b ON b.bound = o.bound)
SELECT doc_id, n AS n_tokens, bucket, bound, nth // fit AS batch, nth % fit AS slot FROM placed"""


_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, c AS component_id, vec_id = c AS kept
FROM v JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) ON a = vec_id"""

_RULES = """(VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')) r(verdict, rhost, rpath)"""

_URLS = rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
best AS (SELECT page_id, arg_max(rhost || rpath, length(rhost) * 1000 + length(rhost || rpath) * 1000000) AS rule,
  arg_max(verdict, length(rhost) * 1000 + length(rhost || rpath) * 1000000) AS verdict
  FROM u JOIN {_RULES} ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (page_id)"""

_EXACT = rf"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{GAP}', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256 FROM t"""

_SUBSTRING = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS k FROM (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
least AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (k) WHERE doc_id > d),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)"""



#: The exact search; the error bounds are wide enough to find the same rows.
_NEAREST = """
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pair AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pair)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


def _crc32(number: str) -> str:
    """Unsigned CRC-32 of a decimal number: bytes are xor-ed in, and after each the register is
    shifted eight times."""
    steps = f"flatten([[4294967295]] || list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda b: [CAST(ascii(b) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce({steps}, lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"


_TRIE = rf"""
WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
keyed AS (SELECT conv_id, turn, sha256(strlen(role) || ':' || role || text) AS k, len(regexp_extract_all(text, '{WORD}')) AS w FROM given),
own AS (SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(w ORDER BY turn NULLS FIRST, k) AS ws FROM keyed GROUP BY conv_id),
part AS (SELECT conv_id, ks, ws, {_crc32("conv_id")} % 4 AS h, conv_id - conv_id % 20 AS base FROM own),
built AS (SELECT p.conv_id, list_concat(coalesce(b.ks[1 : p.h], []), p.ks[p.h + 1 :]) AS ks, list_concat(coalesce(b.ws[1 : p.h], []), p.ws[p.h + 1 :]) AS ws
  FROM part p LEFT JOIN own b ON b.conv_id = p.base),
pre AS (SELECT conv_id, ks, ws, unnest(range(0, len(ks) + 1)) AS d FROM built),
member AS (SELECT conv_id, d, ks[1 : d] AS p, CASE WHEN d = 0 THEN 0 ELSE ws[d] END AS w, len(ks) = d AS ends FROM pre),
node AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, max(w) AS w,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM member GROUP BY p, d),
child AS (SELECT p[1 : d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
up AS (SELECT n.p, n.n, n.w, c.n IS NULL AS leaf, unnest(range(0, n.d + 1)) AS e FROM node n LEFT JOIN child c ON c.p = n.p),
sub AS (SELECT p[1 : e] AS p, CAST(sum((n - 1) * w) AS BIGINT) AS saved, count(*) FILTER (WHERE leaf) AS leaves FROM up GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(c.n, 0) AS n_children, s.leaves AS n_leaves,
  s.saved AS saved_tokens, n.ends_sha256
FROM node n JOIN sub s ON s.p = n.p LEFT JOIN child c ON c.p = n.p LEFT JOIN node u ON n.d > 0 AND u.d = n.d - 1 AND u.p = n.p[1 : n.d - 1]"""


def _fields(text: str) -> str:
    def one(value: str) -> str:
        return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"

    return " || ".join(one(v) for v in ("doc_id", "source", "lang", "n_chars", text))


#: `level`: nodes of all levels with the digests and the siblings of each node; the proof of a leaf is folded upwards.
_MERKLE = f"""
WITH RECURSIVE doc AS (SELECT doc_id, source, sha256({_fields("text")}) AS leaf,
  sha256({_fields("CASE WHEN changed THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")}) AS other
  FROM (SELECT *, coalesce({_crc32("doc_id")} % 5 = 0, false) AS changed FROM documents)),
tree AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS size FROM doc),
low(tree, lvl, idx, size, digest) AS (SELECT tree, 0, idx, size, leaf FROM tree UNION ALL
  SELECT tree, lvl + 1, idx // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM low WHERE size > 1 GROUP BY tree, lvl, idx // 16, size),
subroot AS (SELECT tree, digest, count(*) OVER () AS size FROM low WHERE size = 1),
high(lvl, idx, size, digest) AS (SELECT 0, tree, size, digest FROM subroot UNION ALL
  SELECT lvl + 1, idx // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM high WHERE size > 1 GROUP BY lvl, idx // 16, size),
root AS (SELECT digest AS root FROM high WHERE size = 1),
run AS (SELECT tree, lvl, idx // 16 AS up, list(digest ORDER BY idx) AS met FROM low WHERE size > 1 GROUP BY tree, lvl, idx // 16
  UNION ALL SELECT -1, lvl, idx // 16, list(digest ORDER BY idx) FROM high WHERE size > 1 GROUP BY lvl, idx // 16),
step(k, tree, lvl, idx, proof, folded, own) AS (SELECT k, tree, 0, idx, '', other, tree FROM (SELECT *, row_number() OVER (ORDER BY tree, idx) AS k FROM tree) UNION ALL
  SELECT k, CASE WHEN r.met IS NULL THEN -1 ELSE s.tree END, CASE WHEN r.met IS NULL THEN 0 ELSE s.lvl + 1 END, CASE WHEN r.met IS NULL THEN own ELSE s.idx // 16 END,
    CASE WHEN r.met IS NULL THEN proof ELSE proof || array_to_string(met[1 : s.idx % 16] || met[s.idx % 16 + 2 :], '') END,
    CASE WHEN r.met IS NULL THEN folded ELSE sha256(array_to_string(met[1 : s.idx % 16] || [folded] || met[s.idx % 16 + 2 :], '')) END, own
  FROM step s LEFT JOIN run r ON r.tree = s.tree AND r.lvl = s.lvl AND r.up = s.idx // 16 WHERE s.tree >= 0 OR r.met IS NOT NULL),
done AS (SELECT k, arg_max(proof, lvl) AS proof, arg_max(folded, lvl) AS folded FROM step WHERE tree = -1 GROUP BY k)
SELECT doc_id, leaf, s.digest AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM (SELECT *, row_number() OVER (ORDER BY tree, idx) AS k FROM tree) t JOIN done USING (k) JOIN subroot s ON s.tree = t.tree, root"""

ORACLES = {
    "op2_packing": _packing(),
    "op3_vector_dedup": _VECTORS,
    "op5_url_rules": _URLS,
    "op6_exact_dedup": _EXACT,
    "op7_substring_dedup": _SUBSTRING,
    "op11_nearest_vectors": _NEAREST,
    "op12_conversation_trie": _TRIE,
    "op13_merkle_manifest": _MERKLE,
}
