"""SQL, for an engine with DuckDB's functions, of the operators that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT item, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS t FROM (SELECT item, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM k)),
at_ AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS t FROM (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
occ AS (SELECT r, i, at_.k, item FROM at_ JOIN win ON at_.k = win.k AND at_.t = win.t),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS p FROM occ) GROUP BY r),
pos AS (SELECT row_number() OVER (ORDER BY item, txt) AS e, item, k, i AS j, array_to_string(w[i:i + k - 1], ' ') AS t, nth FROM (SELECT item, w, k, txt, nth, unnest(generate_series(1, len(w) - k + 1)) AS i FROM (SELECT *, array_to_string(w, ' ') AS txt, row_number() OVER () AS nth FROM k))),
diag AS (SELECT r, i, at_.k, pos.item, pos.nth, i - row_number() OVER (PARTITION BY r, pos.nth, i - j ORDER BY i) AS island, i - j AS d FROM at_ JOIN pos ON at_.k = pos.k AND at_.t = pos.t),
stretch AS (SELECT r, item, nth, count(*) + max(k) - 1 AS reach, min(i) - 1 AS place FROM diag GROUP BY r, item, nth, d, island),
top AS (SELECT r, first(reach ORDER BY reach DESC, place, item) AS longest, first(place ORDER BY reach DESC, place, item) AS longest_at, first(item ORDER BY reach DESC, place, item) AS longest_item FROM stretch GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest, CAST(longest_at AS BIGINT) AS longest_at, longest_item
FROM d LEFT JOIN hit ON d.r = hit.r LEFT JOIN its ON d.r = its.r LEFT JOIN top ON d.r = top.r
"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS t FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
both_ AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.r < b.r GROUP BY a.r, b.r),
link AS (SELECT x, y FROM both_ JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, edge.y FROM reach JOIN edge ON reach.b = edge.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id FROM d LEFT JOIN n ON d.r = n.r JOIN (SELECT a, min(o.doc_id) AS component_id FROM reach JOIN d o ON o.r = reach.b GROUP BY a) m ON m.a = d.r
"""

RULES = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", True), "access": (r"AKIA[A-Z0-9]+", True), "hex": (r"[0-9a-f]{16,}", True),
    "pem": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", False), "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", False), "forge": (r"gh[pousr]_[A-Za-z0-9]{30,}", False),
}
PASSES = {"assign": "length(regexp_extract(m, '{p}', 2)) >= 12", "access": "length(m) >= 18"}



def spans_sql(keys: str, rows: str, passes: dict[str, str]) -> str:
    """Common table expressions d (rows with a number r and a text t), f, s and g: the spans of each row of `rows`."""
    one = lambda k, p, base, i: f"SELECT r, '{k}' AS kind, {i} AS rank, {base} AS base, ms[i] AS m, coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS a, {passes.get(k, 'true').replace('{p}', p)} AS ok FROM (SELECT r, ms, ps, ms[i] AS m, i FROM (SELECT r, ms, ps, unnest(generate_series(1, len(ms))) AS i FROM (SELECT r, regexp_extract_all(t, '{p}', 0) AS ms, string_split_regex(t, '{p}') AS ps FROM d)))"
    return (
        f"d AS (SELECT row_number() OVER () AS r, {keys}, coalesce(text, '') AS t FROM {rows}), f AS ("
        + " UNION ALL ".join(one(k, p, base, i) for i, (k, (p, base)) in enumerate(RULES.items()))
        + "), s AS (SELECT *, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + length(m) AS BIGINT) AS span FROM f WHERE ok), g AS (SELECT r, count(*) FILTER (kind = 'assign') AS na, count(*) FILTER (kind = 'access') AS nc, count(*) FILTER (kind = 'hex') AS nh, count(*) FILTER (NOT base) AS nx, string_agg(span, ',' ORDER BY a, rank) FILTER (base) AS base, string_agg(span, ',' ORDER BY a, rank) AS spans FROM s GROUP BY r)"
    )


COUNTS = "CAST(coalesce(na, 0) AS BIGINT) AS n_assign, CAST(coalesce(nc, 0) AS BIGINT) AS n_access, CAST(coalesce(nh, 0) AS BIGINT) AS n_hex"

SECRETS = f"WITH {spans_sql('doc_id', 'documents', PASSES)} SELECT doc_id, {COUNTS}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob, CAST(coalesce(nx, 0) AS BIGINT) AS n_added FROM d LEFT JOIN g ON d.r = g.r"

RESCAN = f"""
WITH one AS (SELECT doc_id, text, 'main/' || coalesce(CAST(doc_id AS VARCHAR), '') AS path, 1 AS version FROM documents
  UNION ALL SELECT doc_id, text, 'mirror/' || doc_id, 1 FROM documents WHERE doc_id % 5 = 0),
every AS (SELECT * FROM one UNION ALL SELECT doc_id, coalesce(text, '') || chr(10) || 'token = ' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 14), 'main/' || doc_id, 2 FROM documents WHERE doc_id % 3 = 0),
{spans_sql('doc_id, path, version', 'every', PASSES | {'assign': PASSES['assign'].replace('12', '16')})}
SELECT path, version, doc_id, {COUNTS}, coalesce(spans, '') AS spans, sha256(t) AS blob, CAST(coalesce(nx, 0) AS BIGINT) AS n_added, CAST(CASE WHEN t IN (SELECT coalesce(text, '') FROM one) THEN 1 ELSE 6 END AS BIGINT) AS pairs
FROM d LEFT JOIN g ON d.r = g.r
"""

REVISITS = r"""
WITH a AS (SELECT *, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS bare FROM pages),
b AS (SELECT *, regexp_replace(bare, '\?.*$', '') AS place, regexp_extract(bare, '\?(.*)$', 1) AS query FROM a),
c AS (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda f: f <> '' AND NOT regexp_matches(f, '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)'))) AS fields FROM b),
p AS (SELECT page_id, CASE WHEN url IS NOT NULL THEN regexp_replace(regexp_replace(lower(regexp_extract(place, '^[^/]*')), ':(80|443)$', ''), '^www\.', '') || regexp_replace(regexp_extract(place, '^[^/]*(.*)$', 1), '/+$', '') || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END END AS canonical,
             regexp_extract(coalesce(html, ''), '<html lang="([a-z]*)"', 1) AS lang, regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1) AS title, CAST(length(coalesce(html, '')) AS VARCHAR) AS size FROM c),
full_ AS (SELECT page_id, canonical, page_id * 20 AS at_, lang, size, CASE WHEN page_id % 3 <> 0 THEN md5(title || lang) END AS etag, md5(title) AS digest FROM p),
q AS (SELECT page_id, visit, canonical, page_id * 20 + later AS at_,
             CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 13 = 0 THEN md5('other ' || title) WHEN page_id % 3 <> 0 THEN md5(title || lang) END AS etag,
             CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 11 = 0 THEN md5('other ' || title) ELSE md5(title) END AS digest FROM p, (VALUES (1, 1), (2, 700), (3, -5)) v(visit, later)),
s AS (SELECT q.*, o.page_id AS base_id, o.lang AS o_lang, o.size AS o_size,
             CASE WHEN o.page_id IS NULL THEN 'missing' WHEN q.etag IS NOT NULL AND o.etag IS NOT NULL THEN CASE WHEN q.etag = o.etag THEN 'resolved' ELSE 'changed' END
                  WHEN q.digest IS NOT NULL AND o.digest IS NOT NULL THEN CASE WHEN q.digest = o.digest THEN 'resolved' ELSE 'changed' END ELSE 'unchecked' END AS status
      FROM q ASOF LEFT JOIN full_ o ON q.canonical = o.canonical AND q.at_ > o.at_)
SELECT page_id, visit, canonical, base_id AS base_page_id, status, CAST(at_ AS VARCHAR) AS date, CASE WHEN status = 'resolved' THEN o_size ELSE '0' END AS content_length,
       CASE WHEN status = 'resolved' THEN o_lang END AS content_language, CASE WHEN status = 'resolved' THEN 'max-age=60' END AS cache_control, coalesce(etag, '-') AS etag FROM s
"""

PHRASES = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM p, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 10),
cuts AS (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM c),
s AS (SELECT cuts.lang, cuts.phrase, cuts.k, a, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score FROM cuts JOIN g x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:cuts.k], ' ') JOIN g y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[cuts.k + 1:], ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
covered AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS longest FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE size = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN covered v ON b.lang = v.lang AND b.phrase = v.phrase WHERE longest IS NULL OR 100 * longest < 50 * a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= 2000
"""

RANKING = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
stats AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
q AS (SELECT item_id, term, count(*) AS reps FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT r, doc_id, size, term, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS size, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS weight FROM p, stats GROUP BY term, n),
s AS (SELECT item_id, r, doc_id, CAST(sum(reps * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * n) // l)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN weight USING (term), stats GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""

ORACLE = {"op5_contamination": CONTAMINATION, "op6_jaccard_join": JACCARD, "op9_revisits": REVISITS, "op10_secrets": SECRETS, "op11_phrases": PHRASES, "op12_ranked_search": RANKING, "secrets_rescan": RESCAN}
