WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
raw AS (
    SELECT doc_id, source, 0 AS rank, 'assign' AS kind, 6 AS fewest,
           regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS m,
           regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) AS v,
           string_split_regex(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS g
    FROM docs
    UNION ALL SELECT doc_id, source, 1, 'access', 20, regexp_extract_all(t, 'AKIA[A-Z0-9]{16,}'), regexp_extract_all(t, 'AKIA[A-Z0-9]{16,}'), string_split_regex(t, 'AKIA[A-Z0-9]{16,}') FROM docs
    UNION ALL SELECT doc_id, source, 2, 'hex', 24, regexp_extract_all(t, '[0-9a-f]{24,}'), regexp_extract_all(t, '[0-9a-f]{24,}'), string_split_regex(t, '[0-9a-f]{24,}') FROM docs
    UNION ALL SELECT doc_id, source, 3, 'github', 40, regexp_extract_all(t, 'gh[pousr]_[A-Za-z0-9]{36,}'), regexp_extract_all(t, 'gh[pousr]_[A-Za-z0-9]{36,}'), string_split_regex(t, 'gh[pousr]_[A-Za-z0-9]{36,}') FROM docs
    UNION ALL SELECT doc_id, source, 4, 'slack', 15, regexp_extract_all(t, 'xox[abprs]-[A-Za-z0-9-]{10,}'), regexp_extract_all(t, 'xox[abprs]-[A-Za-z0-9-]{10,}'), string_split_regex(t, 'xox[abprs]-[A-Za-z0-9-]{10,}') FROM docs
    UNION ALL SELECT doc_id, source, 5, 'jwt', 20, regexp_extract_all(t, 'eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}'), regexp_extract_all(t, 'eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}'), string_split_regex(t, 'eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}') FROM docs
    UNION ALL SELECT doc_id, source, 6, 'pem', 20, regexp_extract_all(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----'), regexp_extract_all(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----'), string_split_regex(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----') FROM docs),
pieces AS (
    SELECT doc_id, source, rank, kind, fewest, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(v) AS v,
           unnest(g[1:len(m)]) AS g
    FROM raw WHERE len(m) > 0),
placed AS (
    SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop FROM pieces),
spans AS MATERIALIZED (
    SELECT doc_id, source, rank, kind, v, (stop - length(m))::BIGINT AS start, stop::BIGINT AS stop
    FROM placed WHERE length(v) >= fewest),
owners AS (
    SELECT sha256(v) AS h, count(DISTINCT source) AS owners,
           any_value(len(list_distinct(string_split(v, ''))) >= 8 AND regexp_matches(v, '[0-9]')
                     AND NOT regexp_matches(v, '(?i)example|sample|dummy|changeme|placeholder|your|test|xxxx|\*\*|12345|abcdef')) AS is_real
    FROM spans GROUP BY 1),
judged AS (
    SELECT doc_id, count(*) FILTER (owners < 10 AND is_real) AS n_live, count(*) FILTER (owners >= 10) AS n_shared
    FROM (SELECT DISTINCT doc_id, sha256(v) AS h FROM spans) JOIN owners USING (h) GROUP BY 1),
lists AS (
    SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
           coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3), '') AS base,
           string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
    FROM spans GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared
FROM documents LEFT JOIN lists USING (doc_id) LEFT JOIN judged USING (doc_id)
