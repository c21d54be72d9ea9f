"""What SQL (DuckDB) says of the operators that it can express, by plain exhaustive plans."""

from __future__ import annotations

from .url_filter import OP8_SQL

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

#: From links e (x, y) and nodes v (id): the smallest node reachable.
_REACH = """both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y),
least AS (SELECT x AS id, least(x, min(y)) AS component FROM reach GROUP BY x)"""

OP1_SQL = f"""WITH l AS (SELECT doc_id, k - 1 AS line, ls[k] AS said, doc_id * 1000000 + k AS place, len(ls) AS n_lines FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS k FROM documents)),
w AS (SELECT *, len(ws) AS n, hash(array_to_string(ws, ' ')) AS h FROM (SELECT *, regexp_extract_all({_LOWER.replace("text", "said")}, {_SPACED}) AS ws FROM l)),
v AS (SELECT place, n, i, hash(array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), ' ')) AS h FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM w WHERE n >= 10)),
same AS (SELECT h, min(place) AS p FROM w WHERE n >= 5 GROUP BY h), whole AS (SELECT h, min(place) AS p FROM w WHERE n >= 10 GROUP BY h),
swapped AS (SELECT n, i, h, min(place) AS p FROM v GROUP BY ALL), longer AS (SELECT h, min(place) AS p FROM v GROUP BY h),
gone AS (SELECT place FROM w JOIN same USING (h) WHERE n >= 5 AND place > p UNION SELECT place FROM v JOIN swapped USING (n, i, h) WHERE place > p
  UNION SELECT place FROM v JOIN whole USING (h) WHERE place > p UNION SELECT place FROM w JOIN longer USING (h) WHERE n >= 10 AND place > p)
SELECT doc_id, any_value(n_lines)::BIGINT AS n_lines, count(g.place) AS n_removed, sha256(coalesce(string_agg(CASE WHEN g.place IS NULL THEN said END, chr(10) ORDER BY line), '')) AS kept_sha256 FROM l LEFT JOIN gone g USING (place) GROUP BY doc_id"""

OP4_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda z: z IS NULL OR isnan(z) OR isinf(z))) = 0 AND len(list_filter(embedding, lambda z: z <> 0)) > 0),
e AS (SELECT p.id AS x, q.id AS y FROM v p JOIN v q ON p.id < q.id AND len(p.a) = len(q.a) AND list_cosine_similarity(p.a, q.a) >= 0.95), {_REACH}
SELECT vec_id, (SELECT count(*) FROM both_ways b WHERE b.x = vec_id) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN least ON id = vec_id"""

OP5_SQL = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM documents), b AS (SELECT item_id, ws, least(10, len(ws)) AS m FROM (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM benchmark) WHERE len(ws) > 0),
bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, m, array_to_string(ws[i:i + m - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS i FROM b)),
dw AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw))),
h AS (SELECT doc_id, m, i, item FROM dw JOIN bw USING (m, g)), p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP6_SQL = """WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, array_slice(b, p + 1, p + 100) AS g FROM (SELECT doc_id, b, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM later)) GROUP BY doc_id, r),
cuts AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM runs UNION ALL SELECT doc_id, max(z), NULL FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, sha256(unhex(string_agg(hex(array_slice(b, s + 1, coalesce(e, n))), '' ORDER BY s))) AS h FROM cuts JOIN d USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(h, sha256(b)) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP7_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages), m AS (SELECT sha1(h) AS s, max(page_id) AS r FROM p WHERE n >= 1000 GROUP BY 1),
j AS (SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN r IS NOT NULL AND page_id IS DISTINCT FROM r THEN r END AS refers_to FROM p LEFT JOIN m ON n >= 1000 AND s = sha1(h))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM j"""

OP9_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(g) AS g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)), {_REACH}
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON id = w.doc_id"""

#: CRC-32 (polynomial 0xEDB88320), byte by byte from a table of its 256 steps.
_CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(range(8), lambda c, _: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), b))"


def _crc(text: str) -> str:
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295)"


def _more(way: str, cost: str, edit: str) -> str:
    """A way (nine digits of cost, then the audit) with one edit more."""
    return f"lpad((substr({way}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({way}, 10) || '{edit}'"


_WHITE11 = r"'^[\x20\x09-\x0D]*$'"
_KEEP = "3 * cut::INT"
#: The state-by-state dynamic programme over all edits: n, s, u, a are the best ways to end with nothing, a system turn, a user's, an assistant's.
OP11_SQL = f"""WITH RECURSIVE crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS steps),
src AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
hit AS MATERIALIZED (SELECT conv_id, turn, role, text, {_crc("place")} % 20 AS h FROM src, crc),
dam AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM (SELECT *, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) FROM hit WHERE h > 0)),
num AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS r FROM dam),
flt AS MATERIALIZED (SELECT *, blank OR again AS lost, NOT blank AND NOT again AND NOT ends AS cut FROM (SELECT *, regexp_matches(text, {_WHITE11}) AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS ends, lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM num)),
k AS MATERIALIZED (SELECT DISTINCT conv_id FROM conversations),
way(conv_id, i, n, s, u, a) AS (SELECT conv_id, 0, '000000000', NULL::VARCHAR, '000000003I', '000000006II' FROM k UNION ALL
  SELECT conv_id, i, n, s, u2, least(a1, {_more("u2", "3", "I")}) FROM (SELECT *, least(u1, {_more("n", "3", "I")}, {_more("s", "3", "I")}, {_more("a1", "3", "I")}) AS u2 FROM (
  SELECT f.conv_id, f.i, {_more("n", "4", "D")} AS n, least({_more("s", "4", "D")}, CASE WHEN NOT lost AND r = 's' THEN {_more("n", _KEEP, "K")} END) AS s,
    least({_more("u", "4", "D")}, CASE WHEN NOT lost THEN {_more("least(n, s, a)", f"{_KEEP} + 3", "R")} END, CASE WHEN NOT lost AND r = 'u' THEN {_more("least(n, s, a)", _KEEP, "K")} END) AS u1,
    least({_more("a", "4", "D")}, CASE WHEN NOT lost THEN {_more("u", f"{_KEEP} + 3", "R")} END, CASE WHEN NOT lost AND r = 'a' THEN {_more("u", _KEEP, "K")} END) AS a1
  FROM way w JOIN flt f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1))),
best AS MATERIALIZED (SELECT conv_id, substr(w, 1, 9)::BIGINT AS cost, substr(w, 10) AS audit FROM (SELECT conv_id, least(n, a) AS w FROM way w WHERE i = coalesce((SELECT max(f.i) FROM flt f WHERE f.conv_id IS NOT DISTINCT FROM w.conv_id), 0))),
step AS MATERIALIZED (SELECT conv_id, j, e, sum((e <> 'I')::INT) OVER w AS i, sum((e <> 'D')::INT) OVER w AS p, count(*) FILTER (e <> 'D') OVER w AS o FROM (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS j, unnest(string_split(audit, '')) AS e FROM best WHERE audit <> '') WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
said AS (SELECT s.conv_id, s.p, CASE WHEN e = 'K' THEN f.role ELSE CASE WHEN (s.p - first_kept) % 2 = 0 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN e = 'I' THEN '' ELSE f.text END AS line
  FROM (SELECT s.*, 1 + max(CASE WHEN s.p = 1 AND s.e = 'K' AND f.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id) AS first_kept FROM step s LEFT JOIN flt f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i AND s.e <> 'I') s LEFT JOIN flt f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i AND s.e <> 'I' WHERE e <> 'D'),
hashed AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY p)) AS h FROM said GROUP BY conv_id),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY conv_id)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, coalesce(h, sha256('')) AS repaired_sha256
FROM k LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN hashed ON hashed.conv_id IS NOT DISTINCT FROM k.conv_id"""

_TERM13 = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
OP13_SQL = f"""WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, {_TERM13}) AS ws FROM documents),
p AS MATERIALIZED (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY ALL),
c AS MATERIALIZED (SELECT count(*) FILTER (len(ws) > 0) AS n, sum(len(ws))::BIGINT AS l FROM d),
q AS MATERIALIZED (SELECT item_id, row_number() OVER () AS k, list_distinct(regexp_extract_all({_LOWER}, {_TERM13})) AS ws FROM benchmark),
f AS (SELECT w, floor(1000 * ln((2.0 * (SELECT n FROM c) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p GROUP BY w),
s AS (SELECT k, r, sum(weight * (1000000000 * tf // (1000 * tf + 8 * (10 + 90 * len(ws) * (SELECT n FROM c) // (SELECT l FROM c)))))::BIGINT AS score FROM (SELECT k, unnest(ws) AS w FROM q) JOIN f USING (w) JOIN p USING (w) JOIN d USING (r) GROUP BY k, r)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s JOIN d USING (r) WHERE score > 0) JOIN q USING (k) WHERE rank <= 10"""

SQL = {"op1_line_dedup": OP1_SQL, "op4_embedding_dedup": OP4_SQL, "op5_decontaminate": OP5_SQL, "op6_suffix_array_dedup": OP6_SQL, "op7_warc_normalise": OP7_SQL, "op8_url_filter": OP8_SQL, "op9_jaccard_join": OP9_SQL, "op11_conversation_repair": OP11_SQL, "op13_ranked_search": OP13_SQL}
