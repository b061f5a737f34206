"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

LINE_DEDUP = r"""
WITH pages AS (SELECT doc_id, coalesce('=' || source, '') AS host, text, string_split(text, chr(10)) AS lines FROM documents),
distinct_pages AS (SELECT DISTINCT host, text, lines FROM pages),
totals AS (SELECT host, count(*) AS host_pages FROM distinct_pages GROUP BY host),
held AS (SELECT host, unnest(list_distinct(lines)) AS line FROM distinct_pages),
boiler AS (
  SELECT h.host, h.line FROM held h JOIN totals t ON h.host = t.host
  WHERE regexp_matches(h.line, '[^ \t-\r]') GROUP BY h.host, h.line, t.host_pages HAVING count(*) >= 5 AND count(*) > 0.08::DOUBLE * t.host_pages),
per_host AS (SELECT host, list(line) AS gone FROM boiler GROUP BY host),
kept AS (SELECT p.*, CASE WHEN b.gone IS NULL THEN p.lines ELSE list_filter(p.lines, lambda x: NOT list_contains(b.gone, x)) END AS left_over FROM pages p LEFT JOIN per_host b ON p.host = b.host)
SELECT doc_id, CASE WHEN kept.host = '' THEN NULL ELSE kept.host[2:] END AS source, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(left_over, chr(10)), '') END AS text,
  coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(left_over), 0)::BIGINT AS n_dropped
FROM kept
"""

SECRETS = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS (
  SELECT doc_id, 'assign' AS kind, 0 AS o, 6 AS least, regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS found,
    regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS part,
    string_split_regex(text, '(?i:(?:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?(?:[A-Za-z0-9+/_.=-]+)') AS gaps FROM docs
  UNION ALL SELECT doc_id, 'access', 1, 20, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), string_split_regex(text, 'AKIA[A-Z0-9]+') FROM docs
  UNION ALL SELECT doc_id, 'hex', 2, 24, regexp_extract_all(text, '[0-9a-f]{24,}'), regexp_extract_all(text, '[0-9a-f]{24,}'), string_split_regex(text, '[0-9a-f]{24,}') FROM docs),
each AS (SELECT doc_id, kind, o, least, unnest(range(1, len(found) + 1)) AS nth, unnest(list_transform(found, lambda x: length(x))) AS n, unnest(list_transform(part, lambda x: length(x))) AS g, unnest(list_transform(gaps[:len(found)], lambda x: length(x))) AS gap FROM raw WHERE len(found) > 0),
placed AS (SELECT *, (sum(gap + n) OVER (PARTITION BY doc_id, kind ORDER BY nth))::BIGINT AS fin FROM each),
spans AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || (fin - n) || ':' || fin, ',' ORDER BY fin - n, o) AS spans
  FROM placed WHERE g >= least GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN spans s ON d.doc_id = s.doc_id
"""

MIXING = r"""
WITH docs AS (SELECT doc_id, coalesce('=' || source, '~') AS source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
units AS (SELECT doc_id, source, size, sum(size)::BIGINT AS words FROM docs GROUP BY doc_id, source, size),
sizes AS (SELECT source, sum(words)::BIGINT AS source_size FROM units GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sizes),
caps AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight AS ratio FROM weighed),
shares AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS share FROM caps),
levels AS (SELECT *, max(CASE WHEN share <= ratio THEN share END) OVER () AS level FROM shares),
plan AS (SELECT source, source_size, CASE WHEN ratio <= level THEN cap::DOUBLE ELSE coalesce(weight * level, 0) END AS target FROM levels),
done AS (SELECT u.*, source_size, target, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS digest,
    (sum(words) OVER (PARTITION BY source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING))::BIGINT AS done FROM units u JOIN plan USING (source)),
copies AS (SELECT d.*, copy, (done + copy * source_size)::DOUBLE / target AS finish FROM done d, (VALUES (0), (1), (2)) AS c(copy) WHERE words > 0 AND target > 0 AND done - words + copy * source_size <= target),
queue AS (SELECT *, sum(words) OVER (ORDER BY finish, source, copy, digest, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS total FROM copies),
taken AS (SELECT source, done, count(*) AS n FROM queue WHERE total <= (SELECT sum(source_size) FROM sizes) GROUP BY source, done)
SELECT o.doc_id, o.size, d.source_size, d.target, (o.size * coalesce(t.n, 0))::BIGINT AS taken
FROM docs o JOIN done d ON o.doc_id IS NOT DISTINCT FROM d.doc_id AND o.source = d.source AND o.size = d.size
LEFT JOIN taken t ON d.words > 0 AND t.source = d.source AND t.done = d.done
"""

WARC = r"""
WITH rows AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
sized AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM rows),
first AS (SELECT payload_digest, min(page_id) AS first FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, s.payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR first = page_id THEN NULL ELSE first END AS refers_to
FROM sized s LEFT JOIN first f ON s.payload_digest = f.payload_digest
"""

NGRAM_JOIN = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS grams FROM docs),
each AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.gram = b.gram AND a.doc_id <> b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.grams)::BIGINT AS n_shingles, (SELECT min(b) FROM reach r WHERE r.a = s.doc_id) AS component_id FROM sets s
"""

HARD_NEGATIVES = r"""
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, r.vec_id AS other, r.label = a.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id AND len(a.v) = len(r.v)),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS rank, s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""

SOURCE_DIVERGENCE = r"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
words AS (SELECT lang, source, row, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term),
sizes AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY lang, source),
rated AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS held,
    (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * l.v))::HUGEINT AS p, (1 + (1000000000::HUGEINT * (k.total + 2)) // (l.lang_n + 2 * l.v))::HUGEINT AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM rated a JOIN rated b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM rated WHERE held > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found QUALIFY part = 'pair' OR rank <= 10
"""

ORACLE = {
    "op3_line_dedup": LINE_DEDUP, "op4_secret_scan": SECRETS, "op7_mixing": MIXING, "op8_warc": WARC,
    "op11_ngram_join": NGRAM_JOIN, "op12_hard_negatives": HARD_NEGATIVES, "op13_source_divergence": SOURCE_DIVERGENCE,
}
