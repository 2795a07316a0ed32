"""SQL that gives the same rows as a query, where SQL can."""

from . import licenses

_WORDS = r"regexp_extract_all(lower(text), '(?:[a-z0-9]|[^\x00-\x7F])+')"
_SHINGLES = "unnest(list_distinct(list_transform(range(1, (len(w) - n + 2)::BIGINT), lambda i: array_to_string(w[i:i + n - 1], ' '))))"

DECONTAM = f"""
WITH item AS (SELECT item_id, w, least(5, len(w)) AS n FROM (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
wanted AS (SELECT item_id, w, n, {_SHINGLES} AS s FROM item),
total AS (SELECT item_id, w, count(*) AS m FROM wanted GROUP BY item_id, w),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
held AS (SELECT doc_id, n, {_SHINGLES} AS s FROM doc, (SELECT DISTINCT n FROM item) WHERE len(w) >= n)
SELECT doc_id, i.item_id, count(*)::INTEGER AS shared, any_value(m)::INTEGER AS item_shingles, count(*) / any_value(m)::DOUBLE AS containment
FROM held h JOIN wanted i ON h.n = i.n AND h.s = i.s JOIN total t ON t.item_id = i.item_id AND t.w = i.w
GROUP BY doc_id, i.item_id, i.w HAVING count(*) >= 0.8 * any_value(m) - 1e-9
"""

WARC = """
WITH page AS (SELECT page_id, url, coalesce(html, '') AS payload, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
best AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS last FROM page)
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest, CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to, url FROM best
"""

FIM = """
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
drawn AS (SELECT doc_id, t, n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS h FROM doc),
cut AS (SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS z,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
part AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, z - a) AS middle, substring(t, z + 1) AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN z - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM part
"""

TRIE = """
WITH turn AS (SELECT conv_id AS c, {'r': r, 'x': x} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(r) || ':' || r || x)) AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
conv AS (SELECT c, list(t ORDER BY i) AS s FROM turn GROUP BY c),
byte AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS crc FROM range(256) t(i)),
hashed AS (SELECT c, s, xor(list_reduce([4294967295] || list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
  lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h FROM conv, byte),
built AS (SELECT a.c, coalesce(b.s[1:a.h], []) || a.s[a.h + 1:] AS s FROM hashed a LEFT JOIN conv b ON b.c = a.c - a.c % 5),
member AS (SELECT c, s[1:d] AS p, d, d = len(s) AS ends FROM built, unnest(range(0, len(s) + 1)) AS u(d)),
node AS (SELECT p, d, min(c) AS c, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS e FROM member GROUP BY p, d),
child AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
own AS (SELECT node.*, coalesce(child.n, 0) AS kids, CASE WHEN d = 0 THEN 0 ELSE (node.n - 1) * strlen(p[d].x) END AS gain FROM node LEFT JOIN child USING (p)),
below AS (SELECT p[1:u.e] AS p, sum((kids = 0)::BIGINT)::BIGINT AS leaves, sum(gain)::BIGINT AS saved FROM own, unnest(range(0, d + 1)) AS u(e) GROUP BY 1)
SELECT own.c AS conv_id, own.d AS depth, up.c AS parent_conv_id, own.n AS n_convs, own.kids AS n_children, leaves AS n_leaves, saved AS saved_tokens, own.e AS ends_sha256
FROM own JOIN below USING (p) LEFT JOIN node up ON own.d > 0 AND up.p = own.p[1:own.d - 1]
"""

SQL = {"op1_decontam": DECONTAM, "op5_warc": WARC, "op6_licenses": licenses.ORACLE_SQL, "op12_trie": TRIE, "op13_fim": FIM}
