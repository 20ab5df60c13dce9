"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {}

ORACLES["op5_substring_dedup"] = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
win AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(w[i:i+49], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT win.doc_id, i FROM win JOIN least USING (s) WHERE m < win.doc_id), (SELECT unnest(range(50)) AS k)),
lost AS (SELECT doc_id, list(p) AS places, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)
"""

ORACLES["op9_decontamination"] = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce({_ITEM_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_ITEM_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
q AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(w[i:i+n-1], ' ') AS s
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
win AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM q))),
hit AS MATERIALIZED (SELECT doc_id, i, win.n, item FROM win JOIN q USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLES["op8_jaccard_join"] = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, hash(s) AS s FROM (
  SELECT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0))),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, coalesce(l, 0)::BIGINT AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS l FROM edge GROUP BY a) USING (doc_id)
"""

ORACLES["op2_suffix_dedup"] = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
hit AS (SELECT win.doc_id, i FROM win JOIN least USING (s) WHERE m < win.doc_id),
run AS (SELECT doc_id, i, sum(CASE WHEN i > before + 50 OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hit)),
span AS MATERIALIZED (SELECT doc_id, min(i) AS a, max(i) + 50 AS b, lag(max(i) + 50, 1, 0) OVER (PARTITION BY doc_id ORDER BY min(i)) AS done FROM run GROUP BY doc_id, g),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * done + 1, 2 * (a - done)), '' ORDER BY a) AS head, max(b) AS last, sum(b - a) AS n_removed, count(*) AS n_spans FROM span JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN head IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLES["op6_fixity_audit"] = r"""
WITH p AS (SELECT page_id, page_id // 4096 AS archive,
  strlen('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:' || repeat('0', 36) || '>' || chr(13) || chr(10) || 'WARC-Date: ' || repeat('0', 20) || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10)) + strlen(html) + 4 AS length FROM pages),
r AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM p)
SELECT page_id, CASE WHEN page_id % 101 = 17 THEN 'missing' WHEN page_id % 97 = 13 THEN 'changed' ELSE 'moved' END AS status, archive::BIGINT AS archive, o::BIGINT AS "offset", length::BIGINT AS length
FROM r WHERE page_id % 101 = 17 OR page_id % 97 = 13 OR page_id % 89 = 5
"""

