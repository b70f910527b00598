WITH RECURSIVE
words AS (
    SELECT doc_id,
           list_filter(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
sets AS (
    SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
                                                lambda i: array_to_string(w[i:i + 4], ' '))) AS s
    FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(array_to_string(list_sort(s), chr(10)))) AS rep FROM sets),
shingles AS MATERIALIZED (
    SELECT doc_id, md5_number(x) AS h FROM (SELECT doc_id, unnest(s) AS x FROM sets)
    WHERE doc_id IN (SELECT rep FROM classes)),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
comps AS (SELECT a, least(a, min(b)) AS comp FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles,
       coalesce(m.comp, c.rep, d.doc_id) AS component_id,
       coalesce(m.comp, c.rep, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes z USING (doc_id) LEFT JOIN classes c USING (doc_id) LEFT JOIN comps m ON m.a = c.rep
