"""SQL of the operators that SQL can express, for DuckDB."""

#: Words are [^\x20\x09-\x0D]+; only A-Z is lower-cased.
NEAR_DEDUP = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(a[i:i + 4], ' ') AS g FROM (SELECT doc_id, a, unnest(generate_series(1, greatest(len(a) - 4, 1))) AS i FROM w WHERE len(a) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), e AS (
    SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), pairs AS (
    SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
    SELECT doc_id, doc_id AS c FROM w UNION SELECT pairs.b, r.c FROM r JOIN pairs ON r.doc_id = pairs.a
), m AS (
    SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""

SUBSTRING_DEDUP = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents
), x AS (
    SELECT doc_id, i, array_to_string(a[i:i + 12], ' ') AS g FROM (SELECT doc_id, a, unnest(generate_series(1, len(a) - 12)) AS i FROM w WHERE len(a) >= 13)
), f AS (
    SELECT g, min(doc_id) AS d FROM x GROUP BY g
), c AS (
    SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i FROM x JOIN f USING (g) WHERE d < doc_id
), each AS (
    SELECT doc_id, unnest(generate_series(1, len(a))) AS i, unnest(a) AS word FROM w
), t AS (
    SELECT each.doc_id, count(*) AS n_words, count(c.i) AS n_removed, string_agg(word, ' ' ORDER BY each.i) FILTER (c.i IS NULL) AS kept FROM each LEFT JOIN c ON c.doc_id = each.doc_id AND c.i = each.i GROUP BY each.doc_id
)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN t ON w.doc_id = t.doc_id
"""

PARITY_JOIN = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(a[i:i + 2], ' ') AS g FROM (SELECT doc_id, a, unnest(generate_series(1, greatest(len(a) - 2, 1))) AS i FROM w WHERE len(a) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), e AS (
    SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)
), pairs AS (
    SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
    SELECT doc_id, doc_id AS c FROM w UNION SELECT pairs.b, r.c FROM r JOIN pairs ON r.doc_id = pairs.a
), m AS (
    SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM m LEFT JOIN n USING (doc_id)
"""

TOOL_CALLS = r"""
WITH RECURSIVE u AS (
    SELECT conv_id, turn, 'c' || conv_id || '-' || turn AS call_id, text, length(text) AS n_chars FROM conversations WHERE role = 'user'
), level AS (
    SELECT conv_id, turn, 0 AS level FROM u WHERE turn = 0 OR NOT EXISTS (SELECT 1 FROM u AS p WHERE p.conv_id = u.conv_id AND p.turn = u.turn // 2)
    UNION ALL
    SELECT u.conv_id, u.turn, level.level + 1 FROM level JOIN u ON u.conv_id = level.conv_id AND u.turn // 2 = level.turn AND u.turn <> level.turn
), a AS (
    SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'
), calls AS (
    SELECT u.conv_id, u.turn, u.call_id, 'ask' AS name, level.level, a.turn IS NOT NULL AS linked, n_chars BETWEEN 1 AND 400 AS valid,
        CASE WHEN n_chars < 1 THEN '$.n_chars: too small' WHEN n_chars > 400 THEN '$.text: too long' END AS fault, u.text, n_chars, a.text AS result,
        CASE WHEN u.turn = 0 THEN CAST([] AS VARCHAR[]) ELSE ['c' || u.conv_id || '-' || u.turn // 2] END AS depends_on
    FROM u JOIN level ON level.conv_id = u.conv_id AND level.turn = u.turn LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
)
SELECT conv_id, turn, call_id, name, level, linked, valid, fault,
    CASE WHEN valid THEN CAST(to_json({'arguments': {'n_chars': n_chars, 'text': text}, 'depends_on': depends_on, 'id': call_id, 'name': name, 'result': result}) AS VARCHAR)
    ELSE CAST(to_json({'arguments': CAST(to_json({'text': text, 'n_chars': n_chars}) AS VARCHAR), 'depends_on': depends_on, 'id': call_id, 'name': name, 'result': result}) AS VARCHAR) END AS message
FROM calls
UNION ALL
SELECT conv_id, turn, 'c' || conv_id || '-' || (turn - 1), NULL, NULL, false, false, '$: no schema',
    CAST(to_json({'arguments': NULL, 'depends_on': CAST([] AS VARCHAR[]), 'id': 'c' || conv_id || '-' || (turn - 1), 'name': NULL, 'result': text}) AS VARCHAR)
FROM a WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.conv_id = a.conv_id AND u.turn = a.turn - 1)
"""
