"""DuckDB SQL for the registered queries of the engine's own operators."""

from __future__ import annotations

_FILES = r"""files AS (
  SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id AS file_path, string_split(coalesce(text, ''), chr(10)) AS ls, coalesce(text, '') AS text, source FROM documents
), lines AS (
  SELECT doc_id, file_path, unnest(ls) AS line, generate_subscripts(ls, 1)::BIGINT AS line_no FROM files
)"""
_NODES = _FILES + r""", units AS (
  SELECT doc_id, file_path, ls, len(ls) AS n, 'file' AS node_type, 1 AS s, len(ls) AS e, 0 AS ord FROM files
  UNION ALL SELECT doc_id, file_path, ls, len(ls), 'class', 1, (len(ls) + 1) // 2, 1 FROM files WHERE len(ls) >= 4
  UNION ALL SELECT doc_id, file_path, ls, len(ls), CASE WHEN b % 2 = 0 THEN 'function' ELSE 'method' END, b * 5 + 1, least(b * 5 + 5, len(ls)), b + 2
    FROM (SELECT *, unnest(range(0, (len(ls) - 1) // 5 + 1)) AS b FROM files)
), toks AS (
  SELECT *, regexp_extract_all(ls[s], '[\p{L}\p{N}_]+') AS ts FROM units
), named AS (
  SELECT *, CASE WHEN node_type = 'file' THEN doc_id::VARCHAR ELSE (SELECT max(row(length(t), t)) FROM (SELECT unnest(ts) AS t))[2] END AS name FROM toks
), nodes AS (
  SELECT file_path || '::' || node_type || '::' || q || '::' || s AS id, file_path, node_type, name, q AS qualified_name, s, e, ord
  FROM (SELECT *, CASE WHEN node_type = 'file' THEN file_path WHEN node_type = 'method' THEN doc_id || '.' || name ELSE name END AS q FROM named WHERE name IS NOT NULL)
)"""
_EDGES = _NODES + r""", words AS (
  SELECT DISTINCT file_path, line_no, t AS name FROM (SELECT file_path, line_no, unnest(regexp_extract_all(line, '[\p{L}\p{N}_]+')) AS t FROM lines) WHERE t IN (SELECT name FROM nodes WHERE node_type <> 'file')
), src AS (
  SELECT w.file_path, w.line_no, w.name, arg_min(nodes.id, row(e - s, ord)) AS id FROM words w JOIN nodes ON nodes.file_path = w.file_path AND w.line_no BETWEEN s AND e GROUP BY 1, 2, 3
), edges AS (
  SELECT DISTINCT a.id AS source_id, b.id AS target_id, CASE
    WHEN a.node_type = 'file' THEN 'imports'
    WHEN a.node_type = 'method' AND b.node_type = 'method' AND a.name = b.name AND a.qualified_name <> b.qualified_name THEN 'overrides'
    WHEN a.node_type IN ('class', 'interface') AND b.node_type IN ('class', 'interface') THEN 'inherits'
    WHEN a.node_type IN ('function', 'method') AND b.node_type = 'class' THEN 'instantiates'
    WHEN b.node_type IN ('function', 'method') THEN 'calls' ELSE 'references' END AS edge_type, src.line_no AS call_site_line
  FROM src JOIN nodes a ON a.id = src.id JOIN nodes b ON b.name = src.name AND b.node_type <> 'file' WHERE a.id <> b.id
)"""
_INDEX = r"""tok AS (
  SELECT doc_id, c, t, pos FROM (
    SELECT doc_id, c, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM (
      SELECT doc_id, c, list_filter(regexp_split_to_array(strip_accents(lower(coalesce(x, ''))), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS ts
      FROM (SELECT doc_id, 0 AS c, text AS x FROM documents UNION ALL SELECT doc_id, 1, source FROM documents))
  )
), dl AS (SELECT doc_id, count(*) AS len FROM tok GROUP BY 1
), st AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n_docs, (SELECT sum(len) FROM dl)::DOUBLE / (SELECT count(*) FROM documents) AS avgdl
)"""


def _score(terms: list[str]) -> str:
    union = " UNION ALL ".join(f"SELECT {i} AS k, '{t}' AS term" for i, t in enumerate(terms))
    return _INDEX + f""", q AS ({union}
), tf AS (SELECT k, doc_id, count(*)::DOUBLE AS tf FROM tok JOIN q ON t = term GROUP BY 1, 2
), idf AS (SELECT k, CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - n + 0.5) / (n + 0.5)) END AS idf FROM (SELECT k, count(*)::DOUBLE AS n FROM tf GROUP BY 1), st
), sc AS (SELECT doc_id, sum(idf * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl))) AS score, count(*) AS n FROM tf JOIN idf USING (k) JOIN dl USING (doc_id), st GROUP BY 1
)"""


_GRAPH = r"""edges AS (
  SELECT 'c' || c_custkey AS source_id, 'n' || c_nationkey AS target_id, 'references' AS edge_type FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'calls' FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'imports' FROM nation
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'inherits' FROM orders
)"""


def _reach(depth: int, direction: str = "both", kinds: str = "") -> str:
    where = f" WHERE edge_type IN ({kinds})" if kinds else ""
    out, back = f"SELECT source_id AS a, target_id AS b FROM edges{where}", f"SELECT target_id, source_id FROM edges{where}"
    steps = {"outbound": out, "inbound": back.replace("target_id, source_id", "target_id AS a, source_id AS b")}.get(direction, f"{out} UNION ALL {back}")
    return f"""WITH RECURSIVE {_GRAPH}, steps AS ({steps}), w AS (
  SELECT 'n7' AS id, 0 AS hop UNION SELECT b, hop + 1 FROM w JOIN steps ON a = id WHERE hop < {depth}
), near AS (SELECT id, min(hop)::BIGINT AS hop FROM w GROUP BY 1 ORDER BY 2, 1 LIMIT 1000)"""


_PATHS = r"paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/?([?#].*)?$', '') AS path FROM pages)"
_PARENT = "CASE WHEN {0} = '.' THEN NULL ELSE coalesce(nullif(regexp_extract({0}, '^(.*)/[^/]*$', 1), ''), '.') END"
_DIRS = _PATHS + r""", anc AS (
  SELECT page_id, path, '.' AS dir_path FROM paths
  UNION ALL SELECT page_id, path, array_to_string(p[1:i], '/') FROM (SELECT page_id, path, p, unnest(range(1, len(p))) AS i FROM (SELECT page_id, path, string_split(path, '/') AS p FROM paths))
)"""


_CONTENTS = f"""WITH {_NODES}, told AS (SELECT f.file_path, 'quality ' || quality AS x FROM files f JOIN labels USING (doc_id)
), ls2 AS (
  SELECT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir_path, 0 AS leg, file_path AS key, 0 AS ord, 'File ' || file_path || ': ' || x AS line FROM told
  UNION ALL SELECT regexp_extract(file_path, '^(.*)/[^/]*$', 1), 1, file_path, ord, node_type || ' ' || qualified_name FROM nodes WHERE node_type <> 'file' AND file_path NOT IN (SELECT file_path FROM told)
), d AS (SELECT DISTINCT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir_path FROM files)
"""


def _hit(word: str) -> str:
    return rf"regexp_matches(line, '(^|[^\p{{L}}\p{{N}}_]){word}($|[^\p{{L}}\p{{N}}_])')"


_SNAPSHOTS = r"""now AS (SELECT doc_id AS path, sha256(text) AS content_hash FROM documents
), before AS (SELECT CASE WHEN doc_id % 11 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN 'old ' || text ELSE text END) AS content_hash FROM documents)"""
_LINES = r"le AS (SELECT 'o' || l_orderkey AS source_id, 'p' || l_partkey AS target_id FROM lineitem), pn AS (SELECT 'p' || p_partkey AS id FROM part WHERE p_size <= 40)"



def _parts_scored(terms: list[str], pair: tuple[str, str] | None = None) -> str:
    """CTEs up to sc (id, score, n): BM25 of parts by name, brand and type, for terms and one phrase of two; n: how many of them a part has."""
    tf = [f"SELECT {k} AS k, id, count(*)::DOUBLE AS tf FROM tok WHERE t = '{t}' GROUP BY id" for k, t in enumerate(terms)]
    if pair:
        tf.append(f"SELECT {len(terms)}, a.id, count(*) FROM tok a JOIN tok b ON a.id = b.id AND a.c = b.c AND b.pos = a.pos + 1 WHERE a.t = '{pair[0]}' AND b.t = '{pair[1]}' GROUP BY a.id")
    return rf"""tok AS (
  SELECT id, c, t, pos FROM (SELECT id, c, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM (SELECT id, c, list_filter(regexp_split_to_array(lower(x), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '') AS ts
    FROM (SELECT p_partkey AS id, 0 AS c, p_name AS x FROM part UNION ALL SELECT p_partkey, 1, p_brand FROM part UNION ALL SELECT p_partkey, 2, p_type FROM part)))
), dl AS (SELECT id, count(*) AS len FROM tok GROUP BY 1), st AS (SELECT (SELECT count(*) FROM part)::DOUBLE AS n_docs, (SELECT sum(len) FROM dl)::DOUBLE / (SELECT count(*) FROM part) AS avgdl
), tf AS ({" UNION ALL ".join(tf)}
), idf AS (SELECT k, CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - n + 0.5) / (n + 0.5)) END AS idf FROM (SELECT k, count(*)::DOUBLE AS n FROM tf GROUP BY 1), st
), sc AS (SELECT id, round(sum(idf * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl))), 9) AS score, count(*) AS n FROM tf JOIN idf USING (k) JOIN dl USING (id), st GROUP BY 1)"""


def queries() -> dict[str, str]:
    hit = _hit("License")
    out = {
        "lexical_search": f"""WITH {_NODES}, m AS (SELECT file_path, line_no FROM lines WHERE {hit}
), w AS (SELECT count(*)::DOUBLE AS wm, count(DISTINCT file_path)::DOUBLE AS wf FROM m
), near AS (SELECT m.file_path, m.line_no, arg_min(nodes.id, row(e - s, ord)) AS id FROM m JOIN nodes ON nodes.file_path = m.file_path AND m.line_no BETWEEN s AND e GROUP BY 1, 2
), h AS (SELECT id, count(*) AS hits FROM near GROUP BY 1
), sc AS (SELECT h.id, n.file_path, n.s, ((CASE WHEN n.name = 'License' THEN 10.0 ELSE 0.0 END) + 1.0 / wm + 0.5 * hits) * greatest(ln((SELECT count(*) FROM documents)::DOUBLE / (1 + wf)), 0.1) AS score FROM h JOIN nodes n USING (id), w)
SELECT id, row_number() OVER (ORDER BY score DESC, file_path, s, id)::INT AS rank, round(score, 6) AS score FROM sc ORDER BY rank LIMIT 10""",
        "lexical_score_components": f"""WITH {_FILES}, h AS (SELECT file_path AS id, count(*) AS hits FROM lines WHERE {hit} GROUP BY 1), w AS (SELECT sum(hits)::BIGINT AS wm, count(*) AS wf FROM h)
SELECT id, hits, wm AS whole_matches, wf AS whole_files, round((1.0::DOUBLE / wm + 0.5::DOUBLE * hits) * greatest(ln((SELECT count(*) FROM documents)::DOUBLE / (1 + wf)), 0.1::DOUBLE), 6) AS score FROM h, w""",
        "multi_pattern_match": rf"""WITH {_FILES}, t AS (SELECT file_path, unnest(regexp_extract_all(line, '[\p{{L}}\p{{N}}_]+')) AS name FROM lines)
SELECT file_path, name, count(*) AS n_matches FROM t WHERE name IN ('License', 'MIT', 'the', 'und', 'Public', 'version') GROUP BY 1, 2""",
        "word_match_punctuated": f"WITH {_FILES} SELECT file_path, line_no FROM lines WHERE {_hit('License,')}",
        "trigram_grep": "SELECT 'example.c' AS pattern, page_id FROM pages WHERE contains(url, 'example.c') UNION ALL SELECT '(blog|news)[./].*[0-9]{2}[.]html', page_id FROM pages WHERE regexp_matches(url, '(blog|news)[./].*[0-9]{2}[.]html')",
        "innermost_enclosing": f"WITH {_NODES} SELECT l.file_path, l.line_no, arg_min(nodes.id, row(e - s, ord)) AS id FROM lines l JOIN nodes ON nodes.file_path = l.file_path AND l.line_no BETWEEN s AND e GROUP BY 1, 2",
        "name_reference_edges": f"WITH {_EDGES} SELECT source_id, target_id, edge_type, call_site_line FROM edges",
        "edge_type_histogram": f"WITH {_EDGES} SELECT edge_type, count(*) AS n_edges FROM edges GROUP BY 1",
        "edge_type_classify": """WITH k AS (SELECT unnest(['file', 'class', 'function', 'method', 'interface', 'object']) AS kind), b AS (SELECT DISTINCT p_brand FROM part)
SELECT p_brand, a.kind AS source_type, t.kind AS target_type, CASE WHEN a.kind = 'file' THEN 'imports'
  WHEN a.kind = 'method' AND t.kind = 'method' AND length(p_brand) % 2 = 0 THEN 'overrides'
  WHEN a.kind IN ('class', 'interface') AND t.kind IN ('class', 'interface') THEN 'inherits'
  WHEN a.kind IN ('function', 'method') AND t.kind = 'class' THEN 'instantiates' WHEN t.kind IN ('function', 'method') THEN 'calls' ELSE 'references' END AS edge_type
FROM b, k a, k t""",
        "dangling_edge_purge": f"WITH {_LINES} SELECT target_id, count(*) AS n_edges FROM le WHERE EXISTS (SELECT 1 FROM pn WHERE id = target_id) GROUP BY 1",
        "dangling_edges": f"WITH {_LINES} SELECT target_id, count(*) AS n_edges FROM le WHERE NOT EXISTS (SELECT 1 FROM pn WHERE id = target_id) GROUP BY 1",
        "delete_outbound": f"WITH {_LINES} SELECT source_id, count(*) AS n_edges FROM le WHERE source_id NOT IN (SELECT 'o' || o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
        "foreign_key_cascade": f"WITH {_LINES} SELECT source_id, count(*) AS n_edges FROM le WHERE target_id IN (SELECT id FROM pn) AND source_id IN (SELECT 'o' || o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1",
        "distinct_callers": f"WITH {_LINES} SELECT DISTINCT source_id AS id FROM le WHERE target_id IN (SELECT 'p' || p_partkey FROM part WHERE p_size = 1)",
        "callers_callees": f"""WITH {_GRAPH}, g AS (SELECT * FROM edges WHERE edge_type <> 'inherits'), i AS (SELECT source_id AS id FROM g UNION SELECT target_id FROM g)
SELECT id, coalesce((SELECT string_agg(source_id, ',' ORDER BY source_id) FROM g WHERE target_id = id), '') AS callers, coalesce((SELECT string_agg(target_id, ',' ORDER BY target_id) FROM g WHERE source_id = id), '') AS callees FROM i""",
        "parent_child_hierarchy": """SELECT 'conv/' || conv_id || '::c' || conv_id AS id, NULL AS parent, string_agg('c' || conv_id || '.t' || turn, ',' ORDER BY turn) AS children FROM conversations GROUP BY conv_id
UNION ALL SELECT 'conv/' || conv_id || '::c' || conv_id || '.t' || turn, 'c' || conv_id, '' FROM conversations""",
        "graph_both": _reach(3) + " SELECT id, hop FROM near",
        "graph_outbound": _reach(2, "outbound") + " SELECT id, hop FROM near",
        "graph_inbound": _reach(2, "inbound") + " SELECT id, hop FROM near",
        "graph_stored": _reach(3, "inbound", "'references', 'inherits'") + " SELECT id, hop FROM near",
        "graph_edge_type_filtered": _reach(2, "both", "'calls', 'imports'") + " SELECT id, hop FROM near",
        "graph_induced_edges": _reach(2, "both", "'calls', 'imports'") + " SELECT source_id, target_id, edge_type FROM edges WHERE source_id IN (SELECT id FROM near) AND target_id IN (SELECT id FROM near)",
        "bm25_single": f"WITH {_score(['license'])} SELECT doc_id, round(score, 6) AS score FROM sc",
        "bm25_and": f"WITH {_score(['public', 'license'])} SELECT doc_id, round(score, 6) AS score FROM sc WHERE n = 2",
        "bm25_or": f"WITH {_score(['public', 'license'])} SELECT doc_id, round(score, 6) AS score FROM sc",
        "bm25_and_then_or": f"WITH {_score(['public', 'license'])} SELECT doc_id, round(score, 6) AS score, (2 - n)::BIGINT AS leg, row_number() OVER (ORDER BY 2 - n, score DESC, doc_id) AS rank FROM sc ORDER BY rank LIMIT 10",
        "best_of_blocks": r"""WITH d AS (
  SELECT 'conv/' || coalesce(conv_id::VARCHAR, 'none') || '::' || coalesce(turn::VARCHAR, 'none') AS id, list_filter(regexp_split_to_array(strip_accents(lower(coalesce(text, ''))), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS ts FROM conversations
), tf AS (SELECT id, len(ts) + 2 AS len, q.t, len(list_filter(ts, lambda x: x = q.t))::DOUBLE AS tf FROM d, (SELECT unnest(['nicht', 'fur', 'sch']) AS t) q
), st AS (SELECT count(*)::DOUBLE AS n_docs, sum(len(ts) + 2)::DOUBLE / count(*) AS avgdl FROM d
), idf AS (SELECT t, CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - n + 0.5) / (n + 0.5)) END AS idf FROM (SELECT t, count(*)::DOUBLE AS n FROM tf WHERE tf > 0 GROUP BY 1), st
), sc AS (SELECT id, sum(idf * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl))) AS score FROM tf JOIN idf USING (t), st WHERE tf > 0 GROUP BY 1)
SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sc ORDER BY rank LIMIT 20""",
        "phrase_match": f"WITH {_INDEX} SELECT a.doc_id, count(*) AS n_matches FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.c = b.c AND b.pos = a.pos + 1 WHERE a.t = 'public' AND b.t = 'license' GROUP BY 1",
        "index_statistics": f"WITH {_INDEX} SELECT (SELECT count(*) FROM dl) AS n_docs, (SELECT sum(len)::BIGINT FROM dl) AS n_tokens, (SELECT count(DISTINCT t) FROM tok) AS n_terms",
        "semantic_search": r"""WITH tok AS (
  SELECT id, c, t, pos FROM (SELECT id, c, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM (SELECT id, c, list_filter(regexp_split_to_array(lower(x), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS ts
    FROM (SELECT p_partkey AS id, 0 AS c, p_name AS x FROM part UNION ALL SELECT p_partkey, 1, p_brand FROM part UNION ALL SELECT p_partkey, 2, p_type FROM part)))
), dl AS (SELECT id, count(*) AS len FROM tok GROUP BY 1), st AS (SELECT (SELECT count(*) FROM part)::DOUBLE AS n_docs, (SELECT sum(len) FROM dl)::DOUBLE / (SELECT count(*) FROM part) AS avgdl
), tf AS (
  SELECT 0 AS k, id, count(*)::DOUBLE AS tf FROM tok WHERE t = 'red' GROUP BY id UNION ALL SELECT 1, id, count(*) FROM tok WHERE t = 'widget' GROUP BY id
  UNION ALL SELECT 2, a.id, count(*) FROM tok a JOIN tok b ON a.id = b.id AND a.c = b.c AND b.pos = a.pos + 1 WHERE a.t = 'brand' AND b.t = '17' GROUP BY a.id
), idf AS (SELECT k, CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - n + 0.5) / (n + 0.5)) END AS idf FROM (SELECT k, count(*)::DOUBLE AS n FROM tf GROUP BY 1), st
), sc AS (SELECT id, round(sum(idf * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl))), 9) AS score, count(*) AS n FROM tf JOIN idf USING (k) JOIN dl USING (id), st GROUP BY 1)
SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY CASE WHEN n = 3 THEN 0 ELSE 1 END, score DESC, id) AS rank FROM sc ORDER BY rank LIMIT 25""",
        "hybrid_search": f"""WITH {_parts_scored(['red', 'widget'], ('brand', '17'))}, n AS (SELECT p_partkey AS id, 'p/' || p_partkey AS path, regexp_matches(p_name, '(^|\\W)red(\\W|$)') AS r, regexp_matches(p_name, '(^|\\W)widget(\\W|$)') AS w FROM part
), lex AS (SELECT 0 AS leg, id, path, (SELECT count(*) FROM n WHERE r) AS whole FROM n WHERE r UNION ALL SELECT 1, id, path, (SELECT count(*) FROM n WHERE w) FROM n WHERE w
), legs AS (SELECT id, leg, row_number() OVER (PARTITION BY leg ORDER BY path, id) AS place, (1.0::DOUBLE / whole + 0.5::DOUBLE) * greatest(ln((SELECT count(*) FROM part)::DOUBLE / (1 + whole)), 0.1::DOUBLE) AS score FROM lex
  UNION ALL SELECT id, 2, row_number() OVER (ORDER BY CASE WHEN n = 3 THEN 0 ELSE 1 END, score DESC, id), score FROM sc
), once AS (SELECT id, arg_min(score, row(leg, place)) AS score, min(row(leg, place)) AS spot FROM legs WHERE place <= 600 GROUP BY 1)
SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY spot, id) AS rank FROM once ORDER BY rank LIMIT 600""",
        "routed_search": f"""WITH {_parts_scored(['red', 'widget'])}
SELECT 'semantic' AS strategy, id, p_name AS name, p_brand AS qualified_name, round(score, 6) AS score, row_number() OVER (ORDER BY CASE WHEN n = 2 THEN 0 ELSE 1 END, score DESC, id) AS rank FROM sc JOIN part ON id = p_partkey ORDER BY rank LIMIT 20""",
        "fallback_search": f"""WITH {_parts_scored(['red'])}
SELECT 'lexical' AS strategy, id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sc ORDER BY rank LIMIT 20""",
        "hybrid_merge": f"""WITH {_FILES}, {_score(['public', 'license'])}, h AS (SELECT doc_id AS id, count(*) AS n FROM lines WHERE {_hit('MIT')} GROUP BY 1
), legs AS (SELECT * FROM (SELECT id, 0 AS leg, row_number() OVER (ORDER BY n DESC, id) AS place, n::DOUBLE AS score FROM h) WHERE place <= 20
  UNION ALL SELECT * FROM (SELECT doc_id, 1, row_number() OVER (ORDER BY 2 - n, score DESC, doc_id) AS place, round(score, 6) FROM sc) WHERE place <= 20
), once AS (SELECT id, arg_min(score, row(leg, place)) AS score, min(row(leg, place)) AS spot FROM legs GROUP BY 1)
SELECT id, row_number() OVER (ORDER BY spot, id) AS rank, score FROM once ORDER BY rank LIMIT 30""",
        "dir_ancestors": f"WITH {_DIRS} SELECT DISTINCT dir_path, CASE WHEN dir_path = '.' THEN -1 ELSE length(dir_path) - length(replace(dir_path, '/', '')) END::BIGINT AS depth FROM anc",
        "dir_child_dirs": f"WITH {_DIRS}, d AS (SELECT DISTINCT dir_path FROM anc WHERE dir_path <> '.') SELECT {_PARENT.format('dir_path')} AS dir_path, string_agg(d.dir_path, ',' ORDER BY d.dir_path) AS child_dirs FROM d GROUP BY 1".replace("SELECT CASE WHEN dir_path", "SELECT CASE WHEN d.dir_path").replace("extract(dir_path", "extract(d.dir_path"),
        "dir_counts": f"WITH {_DIRS} SELECT dir_path, count(DISTINCT path) AS file_count, count(*) AS node_count FROM anc GROUP BY 1",
        "dir_direct_files": f"WITH {_PATHS} SELECT {_PARENT.format('path')} AS dir_path, count(*) AS n_files FROM paths GROUP BY 1",
        "hierarchical_nodes_top3": f"""WITH {_DIRS}, best AS (SELECT dir_path, row_number() OVER (ORDER BY count(*) DESC, dir_path) AS place FROM anc WHERE dir_path <> '.' AND dir_path NOT LIKE '%/%' GROUP BY 1 ORDER BY 2 LIMIT 3)
SELECT dir_path, page_id, place, within FROM (SELECT dir_path, page_id, place, row_number() OVER (PARTITION BY dir_path ORDER BY path, page_id) AS within FROM anc JOIN best USING (dir_path)) WHERE within <= 10""",
        "dir_rollup_text": _CONTENTS + """SELECT dir_path, sha256(coalesce(string_agg(line, chr(10) ORDER BY leg, key, ord, line), '(empty directory)')) AS contents_sha256, greatest(count(line), 1)::BIGINT AS child_count FROM d LEFT JOIN ls2 USING (dir_path) GROUP BY 1""",
        "dir_rollup_first": _CONTENTS + """, ls3 AS (SELECT *, row_number() OVER (PARTITION BY dir_path ORDER BY leg, key, ord, line) AS place, count(*) OVER (PARTITION BY dir_path) AS n FROM ls2)
SELECT dir_path, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (place <= 50) || CASE WHEN max(n) > 50 THEN chr(10) || '(' || (max(n) - 50) || ' more)' ELSE '' END, '(empty directory)')) AS contents_sha256, coalesce(max(n), 1)::BIGINT AS child_count FROM d LEFT JOIN ls3 USING (dir_path) GROUP BY 1""",
        "needs_reenrichment": """WITH s AS (SELECT event_type, max(ts) AS stamp FROM events WHERE value < 5 GROUP BY 1), n AS (SELECT event_type, max(ts) AS newest FROM events GROUP BY 1)
SELECT event_type AS dir_path FROM n LEFT JOIN s USING (event_type) WHERE stamp IS NULL OR newest > stamp""",
        "unenriched_docs": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
        "hash_gate_changed": f"WITH {_SNAPSHOTS} SELECT n.path, n.content_hash FROM now n LEFT JOIN before b USING (path) WHERE n.content_hash IS DISTINCT FROM b.content_hash",
        "stale_delete": f"WITH {_SNAPSHOTS} SELECT path FROM before EXCEPT SELECT path FROM now",
        "incremental_upsert": "SELECT doc_id AS path, sha256(text) AS content_hash FROM documents",
        "last_wins_upsert": "SELECT user_id, event_type, arg_max(event_id, row(ts, event_id)) AS event_id, arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY 1, 2",
        "index_status": "SELECT (SELECT count(*) FROM documents) AS nodes, (SELECT count(*) FROM lineitem) AS edges, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unenriched, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS enriched",
        "meta_kv": "SELECT 'total_edges' AS key, (SELECT count(*) FROM lineitem)::VARCHAR AS value UNION ALL SELECT 'total_nodes', (SELECT count(*) FROM documents)::VARCHAR UNION ALL SELECT 'unenriched_nodes', (SELECT count(*) FROM labels)::VARCHAR",
        "key_violations": """WITH e AS (SELECT l_orderkey AS o, l_partkey AS p, CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'imports' ELSE 'returned' END AS k FROM lineitem), b AS (SELECT count(*) AS n FROM e WHERE k = 'returned'), d AS (SELECT coalesce(sum(n), 0)::BIGINT AS n FROM (SELECT count(*) AS n FROM e GROUP BY o, p, k HAVING count(*) > 1))
SELECT 'edge_type' AS problem, n AS n_rows FROM b WHERE n > 0 UNION ALL SELECT 'key', n FROM d WHERE n > 0""",
        "token_estimates": "SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS n_tokens FROM documents",
        "content_hashes": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
        "folded_text": "SELECT doc_id, sha256(strip_accents(lower(text))) AS folded_sha256 FROM documents",
        "path_functions": f"WITH {_PATHS} SELECT page_id, path, {_PARENT.format('path')} AS parent, array_to_string(list_concat(['.'], list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))), ',') AS ancestors, (length(path) - length(replace(path, '/', '')))::BIGINT AS depth FROM paths",
        "ignore_rules": f"WITH {_PATHS} SELECT page_id, path FROM paths WHERE NOT CASE WHEN regexp_matches(path, '^(.*/)?m[.][^/]*(/.*)?$') THEN true WHEN regexp_matches(path, '^(.*/)?[^/]*1[.]html(/.*)?$') THEN false WHEN regexp_matches(path, '^(.*/)?fr/.*$') THEN true WHEN regexp_matches(path, '^(.*/)?[^/]*[.]html(/.*)?$') THEN true ELSE false END",
        "language_detection": "SELECT p_partkey, (['python', 'kotlin', 'typescript', 'java', 'ruby', NULL, NULL, NULL])[(p_partkey % 8 + 1)::INT] AS language, CASE WHEN p_partkey % 8 = 5 THEN 'Go' END AS unsupported FROM part",
        "route_strategy": r"""WITH q AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN 'find ' || replace(p_name, ' ', '_') WHEN 2 THEN p_type || '.usage callers' WHEN 3 THEN lower(p_type) WHEN 4 THEN 'get' || upper(p_type[1]) || lower(p_type[2:]) || ' in directory' ELSE p_name END AS query FROM part)
SELECT p_partkey, query, CASE WHEN query NOT LIKE '% %' AND (regexp_matches(query, '^[A-Za-z_][A-Za-z0-9_]*([.][A-Za-z_][A-Za-z0-9_]*)*$') OR regexp_matches(query, '[a-z][A-Z]') OR regexp_matches(query, '[a-z]_[a-z]')) THEN 'lexical'
  WHEN len(string_split(query, ' ')) > 1 AND len(list_filter(string_split(query, ' '), lambda w: regexp_matches(w, '[a-z][A-Z]') OR regexp_matches(w, '[a-z]_[a-z]') OR (w LIKE '%.%' AND regexp_matches(w, '^[A-Za-z_][A-Za-z0-9_]*([.][A-Za-z_][A-Za-z0-9_]*)*$')))) > 0 THEN 'hybrid' ELSE 'semantic' END AS strategy FROM q""",
        "tags_json_decode": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, CASE WHEN event_id % 3 = 0 THEN event_type || '|x' ELSE '' END AS tags FROM events",
        "chunk_split": f"""WITH RECURSIVE {_FILES}, big AS (SELECT file_path, ls FROM files WHERE length(text) // 4 > 512
), st AS (
  SELECT file_path, 1 AS i, 0 AS chunk, length(ls[1]) AS n FROM big
  UNION ALL SELECT file_path, i + 1, CASE WHEN greatest(1, (n + 1 + length(ls[i + 1])) // 4) <= 512 THEN chunk ELSE chunk + 1 END,
    CASE WHEN greatest(1, (n + 1 + length(ls[i + 1])) // 4) <= 512 THEN n + 1 + length(ls[i + 1]) ELSE length(ls[i + 1]) END FROM st JOIN big USING (file_path) WHERE i < len(ls)
) SELECT file_path AS path, chunk::BIGINT AS chunk, min(i)::BIGINT AS start_line, max(i)::BIGINT AS end_line FROM st GROUP BY 1, 2""",
        "merge_siblings": """WITH RECURSIVE t AS (
  SELECT conv_id, turn, greatest(1, length(coalesce(text, '')) // 4) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations
), st AS (
  SELECT conv_id, turn, i, 1 AS run, CASE WHEN size < 100 THEN size END AS used FROM t WHERE i = 1
  UNION ALL SELECT t.conv_id, t.turn, t.i, CASE WHEN size < 100 AND used + size <= 300 THEN run ELSE run + 1 END,
    CASE WHEN size >= 100 THEN NULL WHEN used + size <= 300 THEN used + size ELSE size END FROM st JOIN t ON t.conv_id = st.conv_id AND t.i = st.i + 1
), runs AS (SELECT conv_id, run, min(turn) AS a, max(turn) AS b FROM st WHERE used IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY run) AS merged, a AS start_turn, b AS end_turn FROM runs""",
        "enrichment_parse": "SELECT c_custkey, CASE WHEN c_custkey % 5 < 2 THEN c_name END AS summary, CASE WHEN c_custkey % 5 < 2 THEN c_mktsegment END AS tags FROM customer",
        "format_json": """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS value FROM nation""",
        "format_text": f"WITH {_NODES} SELECT id, rpad(node_type, 10, ' ') || ' ' || qualified_name || '  (' || file_path || ':' || s || '-' || e || ')' AS line FROM nodes",
        "lines_of_files": f"WITH {_FILES} SELECT file_path, count(*) AS n_lines, max(length(line))::BIGINT AS longest FROM lines GROUP BY 1",
    }
    return out
