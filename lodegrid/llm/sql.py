"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH labelled AS (
  SELECT doc_id AS label_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((CAST('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
      / CASE WHEN quality >= 1 THEN 2.0::DOUBLE WHEN quality <= 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM documents LEFT JOIN labelled ON doc_id = label_id
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 2 * source_size AS cap, sum(source_size) OVER () AS total,
    coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (ORDER BY 2 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after,
    row_number() OVER (ORDER BY 2 * source_size / w::DOUBLE, source NULLS LAST) AS pos
  FROM s
), l AS (
  SELECT *, (total::DOUBLE * 1.5::DOUBLE - before::DOUBLE) / after::DOUBLE AS level FROM r
), c AS (
  SELECT *, level > cap::DOUBLE / w::DOUBLE AS capped FROM l
), t AS (
  SELECT source, source_size, CASE WHEN capped OR the_level IS NULL THEN cap::DOUBLE ELSE least(the_level * w, cap::DOUBLE) END AS target
  FROM (SELECT *, (SELECT arg_min(level, pos) FROM c WHERE NOT capped) AS the_level FROM c)
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE)::BIGINT ELSE 0 END AS epochs FROM t
), p AS (
  SELECT d.doc_id, d.size, d.source, d.key, g.source_size, g.target, g.epochs, g.target - (g.epochs * g.source_size)::DOUBLE AS rest
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), i AS (
  SELECT source, key, doc_id, rest, sum(size)::BIGINT AS size FROM p GROUP BY ALL
), m AS (
  SELECT source, key, doc_id, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + size::DOUBLE / 2 <= rest AND rest > 0 AS more
  FROM i
)
SELECT p.doc_id, p.size, p.source_size, p.target, (p.size * (p.epochs + CASE WHEN m.more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p JOIN m ON p.source IS NOT DISTINCT FROM m.source AND p.key = m.key AND p.doc_id IS NOT DISTINCT FROM m.doc_id
"""

OP10 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f AS (
  SELECT *, 4 + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '<\/turn>'), ':', '\:')) + 2
    + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '<\/turn>')) + 8 AS chars
  FROM t
), e AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM f
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  (count(*) FILTER (WHERE role = 'assistant'))::BIGINT AS n_examples,
  coalesce(sum(upto) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS example_chars
FROM e GROUP BY conv_id
"""

OP7 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), ns AS (
  SELECT DISTINCT n FROM iw
), dw AS (
  SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, ns WHERE len(ws) >= n)
), hits AS (
  SELECT doc_id, i, iw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n
), gaps AS (
  SELECT doc_id, n, array_to_string(list_concat(ws[i : i + p - 1], ws[i + p + 1 : i + n]), ' ') AS win
  FROM (SELECT doc_id, ws, n, i, unnest(range(1, n)) AS p FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 1)) AS i FROM w, ns WHERE len(ws) > n))
), near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (
    SELECT doc_id, item_id FROM hits UNION ALL SELECT doc_id, item_id FROM gaps JOIN iw ON gaps.win = iw.win AND gaps.n = iw.n
  ) GROUP BY 1
), per AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY 1
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near_items
FROM w LEFT JOIN per USING (doc_id) LEFT JOIN pos USING (doc_id) LEFT JOIN near USING (doc_id)
"""

OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), r AS (
  SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, b FROM r JOIN links ON r.other = a
)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY 1
"""

OP13 = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), l AS (
  SELECT doc_id AS label_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, map(['A', 'B', 'C', 'D', 'E'], [
    len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)]) AS fails
  FROM w LEFT JOIN l ON doc_id = label_id
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS c, string_split(substr(filter_order, 1, step - 1), '') AS before FROM o, (SELECT unnest(range(1, 6)) AS step)
), g AS (
  SELECT part, good, bad, fails, count(*) AS n, len(list_filter(map_values(fails), lambda v: v)) AS n_fails FROM f GROUP BY ALL
), t AS (
  SELECT part, filter_order, step, c, n, good, bad, n_fails, fails[c] AS fail, len(list_filter(before, lambda k: k <> '' AND fails[k])) > 0 AS earlier FROM g, s
), r AS (
  SELECT part, filter_order, step, c, coalesce(sum(n) FILTER (WHERE NOT earlier AND NOT fail), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE NOT earlier AND fail), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE earlier AND fail), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fail AND n_fails = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (WHERE NOT earlier AND fail AND good = 1), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (WHERE NOT earlier AND fail AND bad = 1), 0)::BIGINT AS toxic_lost
  FROM t GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM r
"""
