"""The queries of the text operators in SQL, where SQL can express them.

The others are compared with brute force on small tables in ``tests/llm``.
"""

from __future__ import annotations

SUBSTRING = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[ \t\r\n]*(?:[^ \t\r\n.!?。！？।؟…]+[.!?。！？।؟…]*|[.!?。！？।؟…]+)') AS p
  FROM documents
), pieces AS (
  SELECT doc_id, unnest(p) AS piece, unnest(range(0, len(p))) AS pos FROM texts
), words AS (
  SELECT *, ltrim(piece, chr(32) || chr(9) || chr(13) || chr(10)) AS word FROM pieces
), begins AS (
  SELECT *, CASE WHEN contains(piece, chr(10)) OR regexp_matches(before, '[.!?。！？।؟…]$') OR md5(before) < '2b'
    THEN 1 ELSE 0 END AS new
  FROM (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM words)
), numbered AS (
  SELECT *, sum(CASE WHEN pos = 0 THEN 0 ELSE new END)
    OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS n FROM begins
), sentences AS (
  SELECT doc_id, n, string_agg(piece, '' ORDER BY pos) AS raw, string_agg(word, ' ' ORDER BY pos) AS s
  FROM numbered GROUP BY doc_id, n
), lists AS (
  SELECT doc_id, list(s ORDER BY n) AS s FROM sentences GROUP BY doc_id
), starts AS (
  SELECT doc_id, s, unnest(range(0, greatest(1, len(s) - 5))) AS i FROM lists
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, array_to_string(s[i + 1 : i + 6], ' ') AS span FROM starts)
  QUALIFY row_number() OVER (PARTITION BY span ORDER BY doc_id, i) > 1
), dropped AS (
  SELECT DISTINCT doc_id, i + k AS n FROM later, (SELECT unnest(range(0, 6)) AS k)
), cleaned AS (
  SELECT c.doc_id, string_agg(CASE WHEN d.n IS NULL THEN raw ELSE '' END, '' ORDER BY c.n) AS text,
    count(*) AS n_sentences, count(d.n) AS n_removed
  FROM sentences c LEFT JOIN dropped d ON d.doc_id = c.doc_id AND d.n = c.n GROUP BY c.doc_id
)
SELECT d.doc_id, coalesce(c.text, '') || regexp_extract(t, '[ \t\r\n]*$') AS text,
  coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed
FROM texts d LEFT JOIN cleaned c USING (doc_id)
"""

URLS = r"""
WITH split AS (
  SELECT page_id, url,
    CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), hosts AS (
  SELECT page_id, url, rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM split
), parted AS (
  SELECT page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(coalesce(rest, ''), length(raw) + 1), '^[^?#]*') AS path
  FROM hosts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parted
), words AS (
  SELECT page_id, url, host, path, rule, list_distinct(list_filter(list_concat(
    list_transform(string_split(host, '.'), lambda w: 'h:' || w),
    list_transform(regexp_split_to_array(regexp_replace(lower(path), '[0-9]+', '#', 'g'), '[^a-z#]+'),
      lambda w: 'p:' || w)), lambda w: length(w) > 2)) AS items
  FROM ruled
), asked AS (
  SELECT row_number() OVER () AS t, items,
    CASE WHEN toxic = 1 OR quality = 0 THEN 'block' ELSE 'allow' END AS label
  FROM words JOIN labels ON labels.doc_id = words.page_id
), total AS (SELECT count(*) AS n FROM asked
), flat AS (SELECT t, label, unnest(items) AS w FROM asked
), sets AS (
  SELECT t, label, [w] AS s FROM flat
  UNION ALL SELECT a.t, a.label, [a.w, b.w] FROM flat a JOIN flat b ON a.t = b.t AND a.w < b.w
  UNION ALL SELECT a.t, a.label, [a.w, b.w, c.w] FROM flat a JOIN flat b ON a.t = b.t AND a.w < b.w
    JOIN flat c ON b.t = c.t AND b.w < c.w
), counts AS (SELECT s, label, count(*) AS c FROM sets GROUP BY ALL
), alls AS (SELECT s, sum(c) AS a FROM counts GROUP BY s
), shares AS (SELECT label, count(*) AS m FROM asked GROUP BY label
), rules AS (
  SELECT s, label, c / a AS confidence, c / n AS support, (c / a) / (m / n) AS lift
  FROM counts JOIN alls USING (s) JOIN shares USING (label), total
  WHERE c >= greatest(1, least(ceil(0.02 * n), 3)) AND c / a >= 0.6 AND (c / a) / (m / n) > 1
), kept AS (
  SELECT * FROM rules r WHERE NOT EXISTS (
    SELECT 1 FROM rules f WHERE f.label = r.label AND len(f.s) < len(r.s)
      AND list_has_all(r.s, f.s) AND f.confidence >= r.confidence)
), hits AS (
  SELECT url, confidence, support, lift, label FROM (SELECT DISTINCT url, items FROM words WHERE rule IS NULL) u
  JOIN kept ON list_has_all(u.items, kept.s)
), best AS (
  SELECT url, label, confidence FROM hits
  QUALIFY row_number() OVER (PARTITION BY url
    ORDER BY lift DESC, support DESC, label DESC, confidence DESC) = 1
)
SELECT page_id, host, path, rule,
  CASE WHEN rule = 'net/' OR rule = 'example.com/de/' THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    ELSE coalesce(label, 'allow') END AS verdict, confidence
FROM words LEFT JOIN best ON best.url = words.url
"""

NEAREST = """
WITH codes AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END) AS c
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
strings AS (SELECT vec_id, CAST(array_to_string(c, '') AS BIT) AS b FROM codes),
pairs AS (SELECT q.vec_id AS query_id, x.vec_id, bit_count(xor(q.b, x.b)) AS distance
  FROM strings q JOIN strings x ON q.vec_id <> x.vec_id OR q.b <> x.b WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER)
  AS rank, vec_id, CAST(distance AS INTEGER) AS distance FROM pairs)
SELECT * FROM ranked WHERE rank <= 10
"""

LINKS = """
WITH RECURSIVE usable AS (
  SELECT row_number() OVER () AS n, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.n AS u, b.n AS v, a.vec_id AS from_id, b.vec_id AS to_id
  FROM usable a JOIN usable b ON a.label = b.label AND a.n <> b.n AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT u, v, to_id FROM links
  UNION SELECT r.u, l.v, l.to_id FROM reach r JOIN links l ON l.u = r.v
), groups AS (SELECT u, min(to_id) AS least FROM reach GROUP BY u),
counts AS (SELECT u, count(*) AS n_links FROM links GROUP BY u),
answers AS (SELECT vec_id, n_links, least(vec_id, least) AS component_id
  FROM usable LEFT JOIN groups ON groups.u = usable.n LEFT JOIN counts ON counts.u = usable.n)
SELECT e.vec_id, coalesce(a.n_links, 0) AS n_links, coalesce(a.component_id, e.vec_id) AS component_id,
  coalesce(a.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN answers a ON a.vec_id = e.vec_id
"""


def statements() -> dict[str, str]:
    return {
        "op1_sentence_spans": SUBSTRING,
        "op2_url_rules": URLS,
        "op8_nearest_codes": NEAREST,
        "op12_descent_links": LINKS,
    }
