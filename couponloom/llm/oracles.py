"""Reference SQL of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

from couponloom.llm.license_scan import NOTICES, SHINGLE
from couponloom.llm.url_filter import RULES

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: str) -> str:
    return f"translate({text}, '{_CAPITALS}', '{_SMALL}')"


_WARC = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM f
"""

_FOLDED = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_WU_MANBER = f"""
WITH d AS (
  SELECT doc_id, {_FOLDED.format(text=_lower("coalesce(text, '')"))} AS w FROM documents),
i AS (
  SELECT item_id, {_FOLDED.format(text=_lower("coalesce(text, '')"))} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_SUBSTRINGS = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, s, array_to_string(w[s:s + 34], ' ') AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
again AS (SELECT words FROM win GROUP BY words HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT doc_id, unnest(range(s, s + 35)) AS p FROM win WHERE words IN (SELECT words FROM again))),
lost AS (SELECT doc_id, list(p) AS places FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(places), 0) AS n_removed,
       sha256(CASE WHEN places IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(places, i)), ' ') END) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)
"""

_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_NOTICES = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in sorted(NOTICES.items()))
_LICENSES = f"""
WITH t AS (
  SELECT license, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM (VALUES {_NOTICES}) n(license, text)),
ts AS (
  SELECT license, k, len(w) - k + 1 AS size, unnest(list_distinct(list_transform(
           range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))) AS shingle
  FROM (SELECT *, least(len(w), {SHINGLE}) AS k FROM t)),
tn AS (SELECT license, k, size, count(*) AS n FROM ts GROUP BY ALL),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
ds AS (
  SELECT doc_id, k, i - 1 AS i, array_to_string(w[i:i + k - 1], ' ') AS shingle
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM d, (SELECT DISTINCT k FROM ts) WHERE len(w) >= k)),
hit AS (SELECT doc_id, license, size, i, shingle FROM ds JOIN ts USING (k, shingle)),
win AS (
  SELECT a.doc_id, a.license, a.i AS first, count(DISTINCT b.shingle) AS n
  FROM hit a JOIN hit b ON a.doc_id = b.doc_id AND a.license = b.license AND b.i >= a.i AND b.i < a.i + 2 * a.size
  GROUP BY ALL),
ok AS (SELECT doc_id, license, first, win.n / CAST(tn.n AS DOUBLE) AS containment
       FROM win JOIN tn USING (license) WHERE win.n / CAST(tn.n AS DOUBLE) >= 0.8)
SELECT doc_id, license, containment, first AS first_word FROM ok
QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, first) = 1
"""

_SEARCH = f"""
WITH d AS (
  SELECT doc_id, {_FOLDED.format(text=_lower("coalesce(text, '')"))} AS terms FROM documents),
n AS (SELECT doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS all_terms FROM n),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM n) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * documents + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
m AS (SELECT doc_id, 100 - 25 + ((25 * n * documents) // all_terms) AS m FROM n, total),
i AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest({_FOLDED.format(text=_lower("coalesce(text, '')"))}) AS term FROM benchmark) GROUP BY ALL),
s AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""

_RULES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in RULES)
_URLS = f"""
WITH r(rule_host, rule_path, verdict) AS (VALUES {_RULES}),
p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, {_lower("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
f AS (
  SELECT *, (SELECT max([lpad(CAST(length(rule_host || rule_path) AS VARCHAR), 4, '0'), rule_host || rule_path, verdict]) FROM r
             WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS found
  FROM u)
SELECT page_id, host, path, found[2] AS rule, coalesce(found[3], 'allow') AS verdict FROM f
"""

_HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
neg AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM pos JOIN s USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5
"""


def statements() -> dict[str, str]:
    return {
        "op2_super_kmers": _SUBSTRINGS,
        "op3_branch_and_bound": _TOP_K,
        "op10_license_scan": _LICENSES,
        "op7_warc_bundles": _WARC,
        "op8_wu_manber": _WU_MANBER,
        "op11_shared_terms": _SEARCH,
        "op12_bloom_cascade": _URLS,
        "op13_kronecker": _HARD_NEGATIVES,
    }
