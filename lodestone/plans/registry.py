"""Queries over the driver tables, each with the same statement in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import queries as q

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: getattr(q, name) for name in q.NAMES}


EDGES = """
m AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS e FROM lineitem),
edges AS (SELECT a.e AS src_id, b.e AS dst_id, count(*) AS source_count, least(1.0, 0.6 + 0.08 * count(*))::DOUBLE AS strength
  FROM m a JOIN m b ON a.c = b.c AND a.e < b.e GROUP BY 1, 2),
ents AS (SELECT p_partkey AS entity_id, p_brand AS kind, p_name AS value, coalesce(n, 0) AS mention_count
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
deg AS (SELECT e AS entity_id, count(*) AS degree FROM (SELECT src_id AS e FROM edges UNION ALL SELECT dst_id FROM edges) GROUP BY 1),
top AS (SELECT entity_id, kind, coalesce(degree, 0) AS degree, mention_count FROM ents LEFT JOIN deg USING (entity_id)
  ORDER BY degree DESC, mention_count DESC, entity_id LIMIT 200)
"""

IOC = """
t AS (SELECT doc_id, text AS raw, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text,
  'hxxps', 'https'), 'hxxp', 'http'), '[.]', '.'), '(.)', '.'), '[dot]', '.'), '(dot)', '.'), '{dot}', '.'), '[:]', ':'), '[://]', '://'), '[@]', '@'), '(at)', '@'), '[at]', '@') AS x FROM documents),
found AS (
  SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(x, '\\b[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}\\b')) AS raw FROM t
  UNION ALL SELECT doc_id, 'sha1', unnest(regexp_extract_all(x, '\\b[A-Fa-f0-9]{40}\\b')) FROM t
  UNION ALL SELECT doc_id, 'md5', unnest(regexp_extract_all(x, '\\b[A-Fa-f0-9]{32}\\b')) FROM t
  UNION ALL SELECT doc_id, 'ip', unnest(regexp_extract_all(x, '\\b(?:(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)\\.){3}(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)\\b')) FROM t
  UNION ALL SELECT doc_id, 'domain', unnest(regexp_extract_all(x, '\\b(?:[A-Za-z0-9](?:[A-Za-z0-9\\-]{0,61}[A-Za-z0-9])?\\.)+[A-Za-z]{2,}\\b')) FROM t),
ioc AS (
  SELECT doc_id, kind, raw, CASE kind
    WHEN 'ip' THEN CASE WHEN regexp_matches(raw, '^(0|[1-9]\\d{0,2})(\\.(0|[1-9]\\d{0,2})){3}$') THEN raw END
    WHEN 'domain' THEN CASE WHEN list_last(string_split(lower(raw), '.')) IN ('com', 'org', 'net', 'de', 'fr', 'es', 'io', 'co', 'is', 'in', 'it', 'at') THEN array_to_string(string_split(lower(raw), '.')[-2:], '.') END
    ELSE lower(raw) END AS value FROM found)
"""

VEC = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"
KNN = VEC + """,
k AS (SELECT a.id, b.id AS neighbour, round(1 - list_cosine_similarity(a.e, b.e), 9) AS distance,
  row_number() OVER (PARTITION BY a.id ORDER BY round(1 - list_cosine_similarity(a.e, b.e), 9), b.id) AS r
  FROM v a JOIN v b ON a.id <> b.id QUALIFY r <= 6),
sim AS (SELECT least(id, neighbour) AS src_id, greatest(id, neighbour) AS dst_id, max(1 - distance) AS weight FROM k WHERE 1 - distance >= 0.3 GROUP BY 1, 2)
"""
TEMPORAL = """
ev AS (SELECT DISTINCT user_id AS id, epoch_us(ts) AS t FROM events),
pairs AS (SELECT a.id, b.id AS neighbour, min(abs(a.t - b.t)) / 1e6 AS d FROM ev a JOIN ev b ON a.id <> b.id AND b.t BETWEEN a.t - 1209600000000 AND a.t + 1209600000000 GROUP BY 1, 2),
near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbour) AS r FROM pairs QUALIFY r <= 6),
temporal AS (SELECT least(id, neighbour) AS src_id, greatest(id, neighbour) AS dst_id, max(exp(-d / 604800)) AS weight FROM near GROUP BY 1, 2)
"""
CENTERS = VEC + """,
pos AS (SELECT label::VARCHAR AS cluster_id, i - 1 AS pos, avg(e[i]) AS x FROM v, range(1, 65) r(i) GROUP BY 1, 2),
centers AS (SELECT cluster_id, list(x ORDER BY pos) AS c FROM pos GROUP BY 1)
"""
SIGNALS = VEC + """,
vec AS (SELECT id AS chunk_id, round(1 - list_cosine_similarity(e, (SELECT e FROM v WHERE id = 0)), 9) AS dist,
  row_number() OVER (ORDER BY round(1 - list_cosine_similarity(e, (SELECT e FROM v WHERE id = 0)), 9), id) AS rank FROM v),
w AS (SELECT doc_id AS chunk_id, list_filter(regexp_extract_all(lower(substr(text, 1, 100000)), '[\\p{L}\\p{N}]+(?:''[\\p{L}\\p{N}]+)?'), lambda x: x IN ('clown', 'clowns', 'clowned', 'clowning', 'clown''s', 'worthless', 'pathetic', 'pathetically')) AS w FROM documents),
kw AS (SELECT chunk_id, len(w) * 0.1 AS score, row_number() OVER (ORDER BY len(w) DESC, chunk_id) AS rank FROM w WHERE len(w) > 0),
u AS (SELECT chunk_id, rank, dist, true AS semantic FROM vec WHERE rank <= 80 UNION ALL SELECT chunk_id, rank, NULL, false FROM kw WHERE rank <= 80),
fused AS (SELECT chunk_id, sum(1.0 / (60 + rank)) AS score, bool_or(semantic) AS semantic, bool_or(NOT semantic) AS keyword, min(dist) AS distance FROM u GROUP BY 1 ORDER BY score DESC, chunk_id LIMIT 20)
"""
LINES = "CASE WHEN list_last(string_split(replace(x, chr(13) || chr(10), chr(10)), chr(10))) = '' THEN string_split(replace(x, chr(13) || chr(10), chr(10)), chr(10))[:-2] ELSE string_split(replace(x, chr(13) || chr(10), chr(10)), chr(10)) END"
SNIFF = f"""
s AS (SELECT 'documents' AS src, doc_id AS id, substr(text, 1, 8192) AS x FROM documents UNION ALL SELECT 'pages', page_id, substr(html, 1, 8192) FROM pages UNION ALL SELECT 'events', event_id, props FROM events),
l AS (SELECT src, id, x, ltrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS h, {LINES} AS lines FROM s),
f AS (SELECT *, list_filter(lines, lambda y: regexp_matches(y, '\\S')) AS filled FROM l),
c AS (SELECT *, list_transform(filled[:5], lambda y: length(y) - length(replace(y, ',', ''))) AS commas, len(list_filter(filled[:5], lambda y: json_valid(y))) AS parsed FROM f)
"""


def oracle_sql() -> dict[str, str]:
    strength = "round(strength, 6)"
    return {
        "doc_exact_dedup": "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) - 1 AS n_deduped FROM documents GROUP BY 1",
        "ingest_bulk": """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN NULL ELSE text END AS t FROM documents WHERE doc_id % 10 <> 7)
            SELECT count(DISTINCT t) FILTER (t <> '') AS accepted, count(t) FILTER (t <> '') - count(DISTINCT t) FILTER (t <> '') AS deduped, count(*) FILTER (t IS NULL OR t = '') AS failed FROM r""",
        "text_clean": r"""WITH r AS (SELECT doc_id, text, regexp_replace('a' || chr(10) || text, '[\x01-\x08\x0B-\x1F\x7F-\x{9F}]', '', 'g') AS c FROM documents)
            SELECT doc_id, length(c) AS clean_chars, md5(c) AS clean_md5, greatest(len(list_filter(regexp_split_to_array(text, '[\s\x0b\x{85}\p{Z}]+'), lambda w: w <> '')), length(text) // 4)::INT AS tokens, substr(text, 1, 300) AS excerpt FROM r""",
        "log_windows": f"""WITH r AS (SELECT doc_id, text AS x FROM documents), l AS (SELECT doc_id, {LINES} AS lines FROM r),
            w AS (SELECT doc_id, unnest(range(0, (len(lines) + 19) // 20)) AS w, lines FROM l),
            t AS (SELECT doc_id, w::INT AS "window", array_to_string(lines[w * 20 + 1 : w * 20 + 20], chr(10)) AS x FROM w)
            SELECT doc_id, "window", md5(x) AS text_md5, length(x) AS n_chars FROM t WHERE regexp_matches(x, '\\S')""",
        "sniff_labels": f"""WITH {SNIFF}
            SELECT src, id, CASE
              WHEN starts_with(lower(substr(h, 1, 256)), '<!doctype html') OR starts_with(lower(substr(h, 1, 256)), '<html') OR (contains(lower(substr(h, 1, 256)), '<html') AND contains(lower(substr(h, 1, 256)), '<body')) THEN 'html'
              WHEN substr(h, 1, 1) IN ('{{', '[') THEN CASE WHEN parsed >= 2 THEN 'ndjson' ELSE 'json' END
              WHEN len(commas) >= 2 AND commas[1] >= 1 AND list_unique(commas) = 1 THEN 'csv'
              WHEN len(list_filter(lines[:40], lambda y: regexp_matches(y, '^\\s*(# |## |- |\\* |```|> )'))) > 0 THEN 'markdown'
              WHEN len(filled[:10]) >= 3 AND 2 * len(list_filter(filled[:10], lambda y: regexp_matches(y, '^\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}}|\\[|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)'))) >= len(filled[:10]) THEN 'log'
              ELSE 'text' END AS label FROM c""",
        "record_text": """SELECT event_id, 0 AS seq, 'k: ' || json_extract_string(props, '$.k') AS text, greatest(2, length('k: ' || json_extract_string(props, '$.k')) // 4)::INT AS token_count FROM events""",
        "earliest_date": "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS found FROM events",
        "refang": "SELECT page_id, url FROM pages",
        "ioc_mentions": f"WITH {IOC} SELECT doc_id, kind, value, count(*) AS n FROM ioc WHERE value IS NOT NULL GROUP BY 1, 2, 3",
        "entity_rollup": f"WITH {IOC} SELECT kind, value, arg_min(raw, (doc_id, raw)) AS display_value, count(*) AS mention_count FROM ioc WHERE value IS NOT NULL GROUP BY 1, 2",
        "cooccurrence_docs": f"WITH {IOC}, e AS (SELECT DISTINCT doc_id, kind || ':' || value AS e FROM ioc WHERE value IS NOT NULL) SELECT a.e AS src_id, b.e AS dst_id, count(*) AS source_count FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.e < b.e GROUP BY 1, 2",
        "cooccurrence_orders": f"WITH {EDGES} SELECT src_id, dst_id, source_count FROM edges",
        "cooccurrence_touching": f"WITH {EDGES}, own AS (SELECT e FROM m WHERE c = 1) SELECT src_id, dst_id, source_count FROM edges WHERE src_id IN (SELECT e FROM own) OR dst_id IN (SELECT e FROM own)",
        "edge_strength": f"WITH {EDGES} SELECT src_id, dst_id, 'co_occurs' AS rel, source_count, {strength} AS strength FROM edges",
        "degree": f"WITH {EDGES} SELECT entity_id, degree FROM deg",
        "graph_nodes": f"WITH {EDGES} SELECT entity_id, kind, degree, mention_count FROM top",
        "graph_edges": f"WITH {EDGES} SELECT src_id, dst_id, 'co_occurs' AS rel, source_count, {strength} AS strength FROM edges WHERE src_id IN (SELECT entity_id FROM top) AND dst_id IN (SELECT entity_id FROM top)",
        "cluster_graph": f"""WITH {EDGES}, w AS (SELECT l_partkey AS entity_id, count(*) AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey IN (1, 4) GROUP BY 1 ORDER BY weight DESC, entity_id LIMIT 300)
            SELECT src_id, dst_id, source_count, {strength} AS strength FROM edges WHERE src_id IN (SELECT entity_id FROM w) AND dst_id IN (SELECT entity_id FROM w)""",
        "neighborhood": f"""WITH {EDGES}, nb AS (SELECT CASE WHEN src_id = 7 THEN dst_id ELSE src_id END AS entity_id, source_count, strength FROM edges WHERE 7 IN (src_id, dst_id))
            SELECT entity_id, 'co_occurs' AS rel, source_count, {strength} AS strength, round(told, 6) AS told FROM
            (SELECT entity_id, source_count, strength, source_count * ln(1 + (SELECT count(*) FROM ents) / greatest(mention_count, 1)) AS told FROM nb JOIN ents USING (entity_id)) ORDER BY strength DESC, told DESC, entity_id LIMIT 50""",
        "pair_links": f"WITH {KNN}, {TEMPORAL}, b AS (SELECT *, 'similar' AS method FROM sim UNION ALL SELECT *, 'temporal' FROM temporal) SELECT method, round(greatest(0, least(1, weight)), 6) AS strength FROM b WHERE (src_id, dst_id) = (SELECT min((src_id, dst_id)) FROM sim)",
        "common_neighbors": f"""WITH {EDGES}, a AS (SELECT CASE WHEN src_id = 1 THEN dst_id ELSE src_id END AS e, strength AS s FROM edges WHERE 1 IN (src_id, dst_id)),
            b AS (SELECT CASE WHEN src_id = 2 THEN dst_id ELSE src_id END AS e, strength AS s FROM edges WHERE 2 IN (src_id, dst_id))
            SELECT a.e AS entity_id, 'co_occurs' AS a_method, round(a.s, 6) AS a_strength, 'co_occurs' AS b_method, round(b.s, 6) AS b_strength FROM a JOIN b ON a.e = b.e WHERE a.e NOT IN (1, 2) ORDER BY a.s + b.s DESC, a.e LIMIT 50""",
        "shared_chunks": "WITH p AS (SELECT DISTINCT l_partkey AS e FROM lineitem WHERE l_orderkey = 1 ORDER BY e LIMIT 2) SELECT l_orderkey AS chunk_id FROM lineitem WHERE l_partkey IN (SELECT e FROM p) GROUP BY 1 HAVING count(DISTINCT l_partkey) = 2 ORDER BY 1 LIMIT 3",
        "temporal_edges": f"WITH {TEMPORAL} SELECT src_id, dst_id, 'temporal' AS rel, round(weight, 6) AS weight FROM temporal",
        "missing_embeddings": "SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) ORDER BY 1 LIMIT 1000",
        "embedding_progress": "SELECT source, count(*) AS total, count(vec_id) AS embedded FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1",
        "knn_topk": f"WITH {KNN} SELECT id, neighbour, round(distance, 6) AS distance FROM k",
        "similar_edges": f"WITH {KNN} SELECT src_id, dst_id, 'similar' AS rel, round(weight, 6) AS weight FROM sim",
        "entity_embeddings": f"WITH {VEC} SELECT user_id AS entity_id, (i - 1)::INT AS pos, round(avg(e[i]), 6) AS mean FROM events JOIN v ON id = event_id, range(1, 65) r(i) GROUP BY 1, 2",
        "mean_vectors": f"WITH {CENTERS} SELECT cluster_id, pos::INT AS pos, round(x, 6) AS mean FROM pos",
        "unit_vectors": f"WITH {VEC} SELECT id AS chunk_id, 1.0::DOUBLE AS norm, round(e[1] / sqrt(list_inner_product(e, e)), 6) AS first FROM v",
        "centroid_nearest": f"WITH {CENTERS} SELECT id AS chunk_id, cluster_id, round(d, 6) AS distance FROM (SELECT id, cluster_id, round(1 - list_cosine_similarity(e, c), 9) AS d FROM v, centers) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cluster_id) = 1",
        "representatives": f"WITH {CENTERS}, d AS (SELECT cluster_id, id AS chunk_id, round(1 - list_cosine_similarity(e, c), 9) AS d FROM v JOIN centers ON cluster_id = label::VARCHAR) SELECT cluster_id, chunk_id, (row_number() OVER (PARTITION BY cluster_id ORDER BY d, chunk_id))::INT AS place, round(d, 6) AS distance FROM d QUALIFY place <= 20",
        "cluster_list": "SELECT label::VARCHAR AS cluster_id, count(*) AS size FROM embeddings GROUP BY 1",
        "driving_pair": f"WITH {VEC}, a AS (SELECT * FROM v WHERE label = 1 ORDER BY id DESC LIMIT 25), b AS (SELECT * FROM v WHERE label = 2 ORDER BY id DESC LIMIT 25) SELECT a.id AS a_chunk, b.id AS b_chunk, round(1 - list_cosine_similarity(a.e, b.e), 6) AS distance FROM a, b WHERE a.id <> b.id ORDER BY round(1 - list_cosine_similarity(a.e, b.e), 9), 1, 2 LIMIT 1",
        "cluster_assign": "SELECT vec_id AS chunk_id, (min(vec_id) OVER (PARTITION BY label))::VARCHAR AS cluster_id FROM embeddings",
        "density_clusters": "SELECT vec_id AS chunk_id, min(vec_id) OVER (PARTITION BY label) AS first_chunk FROM embeddings",
        "stable_ids": "SELECT label::VARCHAR AS cluster_id, vec_id AS chunk_id, 1.0::DOUBLE AS similarity FROM embeddings",
        "louvain_communities": "SELECT event_id AS entity_id, event_id - event_id % 5 AS community_id FROM events",
        "community_weights": f"WITH {EDGES}, n AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem) SELECT src_id, dst_id, round(source_count * sqrt(ln(1 + n / greatest(a.mention_count, 1))) * sqrt(ln(1 + n / greatest(b.mention_count, 1))), 6) AS weight FROM edges JOIN ents a ON a.entity_id = src_id JOIN ents b ON b.entity_id = dst_id, n",
        "bridges": f"WITH {KNN} SELECT src_id, dst_id, a.label::VARCHAR AS a_community, b.label::VARCHAR AS b_community, round(weight, 6) AS weight FROM sim JOIN v a ON a.id = src_id JOIN v b ON b.id = dst_id WHERE a.label <> b.label ORDER BY round(weight, 6) DESC, 1, 2 LIMIT 20",
        "cluster_entities": "WITH c AS (SELECT o_orderpriority AS cluster_id, l_partkey AS value, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2) SELECT cluster_id, p_brand AS kind, value, n, (row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, p_brand, value))::INT AS place FROM c JOIN part ON p_partkey = value QUALIFY place <= 15",
        "vector_search": f"WITH {SIGNALS} SELECT chunk_id, rank::INT AS rank, round(dist, 6) AS distance, round(1 / (1 + dist), 6) AS score FROM vec WHERE rank <= 20",
        "keyword_search": f"WITH {SIGNALS} SELECT chunk_id, rank::INT AS rank, round(score, 6)::DOUBLE AS score FROM kw WHERE rank <= 20",
        "hybrid_search": f"WITH {SIGNALS} SELECT chunk_id, round(score, 6)::DOUBLE AS score, semantic, keyword, round(distance, 6) AS distance FROM fused",
        "ask_gate": f"WITH {SIGNALS} SELECT chunk_id, semantic, keyword FROM fused WHERE (keyword OR distance <= 0.55) AND (SELECT bool_or(keyword) OR coalesce(min(distance) <= 0.45, false) FROM fused)",
        "citation_leash": """WITH t AS (SELECT conv_id, turn, text, max(turn) OVER (PARTITION BY conv_id) + 1 AS most FROM conversations)
            SELECT conv_id AS answer_id, 'C' || (turn + 1) AS marker, turn AS chunk_id, substr(text, 1, 320) AS excerpt FROM t WHERE turn + 1 IN (1, 3, 99) AND turn + 1 <= most""",
        "insight_list": """WITH r AS (SELECT event_id, ts, CASE WHEN event_type <> 'error' THEN 4 ELSE (event_id % 5) END AS g FROM events)
            SELECT event_id AS insight_id, ['critical', 'high', 'medium', 'low', 'info'][g + 1] AS severity, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created FROM r ORDER BY g, ts DESC, event_id LIMIT 100""",
        "input_signatures": "SELECT label::VARCHAR AS cluster_id, sha256(label::VARCHAR || '|' || string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id::VARCHAR) || '|' || array_to_string(list_sort(list_distinct(list('vec:' || (vec_id % 3)))), ',')) AS input_hash FROM embeddings GROUP BY label",
        "keyset_page": "SELECT doc_id, source, n_chars FROM documents WHERE doc_id < 500 AND source = 'src3' ORDER BY doc_id DESC LIMIT 50",
        "substring_filter": f"WITH {EDGES} SELECT entity_id, value, mention_count FROM ents WHERE value ILIKE '%d_w%' ORDER BY mention_count DESC, entity_id LIMIT 200",
        "request_order": "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (42, 7, 99, 0)",
        "retry_backoff": "SELECT i AS attempts, least(5 * pow(2, least(least(greatest(i, 1), 20) - 1, 12)), 600)::BIGINT AS delay_secs FROM range(0, 31) r(i)",
        "document_chunks": "SELECT turn AS seq, role, md5(text) AS text_md5 FROM conversations WHERE conv_id = 1",
        "point_lookups": "SELECT 'document' AS what, doc_id AS id FROM documents WHERE doc_id = 42 UNION ALL SELECT 'entity', p_partkey FROM part WHERE p_partkey = 7",
        "chunk_cluster": "SELECT label::VARCHAR AS cluster_id FROM embeddings WHERE vec_id = 3",
        "space_vectors": "SELECT vec_id AS chunk_id, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings UNION ALL SELECT -5, round(embedding[1]::DOUBLE, 6) FROM embeddings WHERE vec_id = 5",
        "embedding_insert": "SELECT vec_id AS chunk_id, CASE WHEN vec_id % 2 = 0 THEN round(embedding[2]::DOUBLE, 6) ELSE 0.0 END AS second FROM embeddings",
        "member_arrays": "SELECT label::VARCHAR AS cluster_id, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS members FROM embeddings GROUP BY 1",
        "scalar_counts": "SELECT (SELECT count(*) FROM part WHERE p_brand = 'Brand#11') AS n_entities, (SELECT count(*) FROM embeddings) AS n_embedded, (SELECT count(*) FROM orders) AS n_chunks, (SELECT count(*) FROM events WHERE event_type = 'view') AS n_queued",
        "next_jobs": "SELECT event_id AS job_id, (user_id % 3)::INT AS priority FROM events WHERE event_type = 'view' AND ts <= TIMESTAMP '2024-01-15 00:00:00' ORDER BY user_id % 3 DESC, ts, event_id LIMIT 25",
        "debounced_jobs": """WITH j AS (SELECT event_id AS job_id, user_id::VARCHAR AS k, user_id % 3 AS p, ts, event_type IN ('view', 'click') AS busy FROM events),
            old AS (SELECT * FROM j WHERE ts < TIMESTAMP '2024-01-02 00:00:00'), new AS (SELECT job_id, k || CASE WHEN p = 0 THEN 'x' ELSE '' END AS k, ts FROM j WHERE ts >= TIMESTAMP '2024-01-02 00:00:00'),
            first AS (SELECT job_id, k FROM new QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts, job_id) = 1)
            SELECT job_id, k AS dedupe_key FROM old UNION ALL SELECT job_id, k FROM first WHERE k NOT IN (SELECT k FROM old WHERE busy)""",
        "backpressure": "SELECT count(*) AS n_queued, count(*) <= 200000 AS accepts FROM events WHERE event_type = 'view' UNION ALL SELECT count(*), count(*) <= 10 FROM events WHERE event_type = 'view'",
        "login_rate": "SELECT user_id % 10 AS key, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS \"window\", count(*) AS n, count(*) <= 2 AS allowed FROM events GROUP BY 1, 2",
        "ask_history": "SELECT conv_id AS question_id, '1' AS principal, md5(text) AS question_md5 FROM conversations WHERE role = 'user' AND turn = 0 AND conv_id % 3 = 1 ORDER BY conv_id % 2 DESC, conv_id DESC LIMIT 30",
        "entity_detail": f"""WITH {EDGES}, nb AS (SELECT CASE WHEN src_id = 11 THEN dst_id ELSE src_id END AS entity_id, source_count, strength FROM edges WHERE 11 IN (src_id, dst_id)),
            near AS (SELECT entity_id FROM nb JOIN ents USING (entity_id) ORDER BY strength DESC, source_count * ln(1 + (SELECT count(*) FROM ents) / greatest(mention_count, 1)) DESC, entity_id LIMIT 50),
            docs AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_partkey = 11 ORDER BY id DESC LIMIT 50)
            SELECT 'entity' AS what, 11::BIGINT AS id UNION ALL SELECT 'neighbour', entity_id FROM near UNION ALL SELECT 'document', id FROM docs""",
        "cluster_detail": "SELECT doc_id AS chunk_id, substr(text, 1, 200) AS excerpt FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 100)",
        "insight_detail": "SELECT conv_id * 1000 + turn AS chunk_id, turn AS seq, substr(text, 1, 400) AS excerpt FROM conversations WHERE conv_id = 2",
        "filtered_graph": f"WITH {EDGES}, shown AS (SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13')) SELECT src_id, dst_id, {strength} AS strength FROM edges WHERE strength >= 0.7 AND src_id IN (FROM shown) AND dst_id IN (FROM shown)",
        "shown_neighbours": f"WITH {EDGES} SELECT CASE WHEN src_id = 9 THEN dst_id ELSE src_id END AS neighbour, 'co_occurs' AS rel, {strength} AS strength FROM edges WHERE 9 IN (src_id, dst_id)",
        "cluster_graph_nodes": "SELECT l_partkey AS entity_id, count(*) AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey IN (1, 4) GROUP BY 1 ORDER BY weight DESC, entity_id LIMIT 300",
        "mention_recount": "SELECT p_partkey AS entity_id, count(l_partkey) AS mention_count FROM part LEFT JOIN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 2 = 0) ON l_partkey = p_partkey GROUP BY 1",
        "cluster_members": "SELECT vec_id AS chunk_id, (vec_id % 7)::DOUBLE AS similarity FROM embeddings WHERE label = 2 ORDER BY 2 DESC, 1 LIMIT 25",
        "declared_labels": "SELECT o_orderkey, ['text', 'json', 'csv', 'markdown', 'ndjson', 'text', 'html'][o_orderkey % 7 + 1] AS label FROM orders",
        "csv_records": "SELECT n_regionkey AS region, 'key: ' || n_nationkey || '; name: ' || n_name AS text FROM nation",
        "ndjson_records": "SELECT 'n: a=1, null, true, b=' || s_nationkey || '; s: ' || s_suppkey AS text FROM supplier",
        "markdown_titles": "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN trim(p_name) END AS title, 1 AS n_chunks FROM part",
        "unreadable_formats": """SELECT p_partkey, ['pdf', 'image', 'binary', 'image', 'text'][p_partkey % 5 + 1] AS label, ['application/pdf', 'image/png', 'application/zip', 'image/jpeg', 'text/plain'][p_partkey % 5 + 1] AS media_type,
            CASE WHEN p_partkey % 5 = 4 THEN 'ready' ELSE 'failed' END AS status FROM part""",
        "known_contents": "SELECT doc_id, CASE WHEN text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) OR doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'deduped' ELSE 'accepted' END AS outcome FROM documents",
        "stored_contents": "SELECT DISTINCT sha256(text) AS content_hash, strlen(text) AS n_bytes FROM documents",
        "processed_documents": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'untitled' END AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'ready' ELSE 'processing' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN '2024-03-01' END AS processed FROM orders",
        "collected_clusters": "SELECT label::VARCHAR AS cluster_id, avg((vec_id % 3 = 0 OR vec_id % 4 = 0)::INT) >= 0.5 AS collected FROM embeddings GROUP BY 1",
        "dirty_clusters": "SELECT label::VARCHAR AS cluster_id, 1 + count(*) FILTER (vec_id % 2 = 1) AS dirty_count FROM embeddings GROUP BY 1 HAVING 1 + count(*) FILTER (vec_id % 2 = 1) >= 20",
        "value_lookup": "SELECT p_name AS value FROM part ORDER BY p_partkey LIMIT 1",
        "hit_texts": f"WITH {SIGNALS} SELECT chunk_id, upper(source) AS title, round(1 / (1 + dist), 6) AS score, md5(text) AS text_md5 FROM vec JOIN documents ON doc_id = chunk_id WHERE rank <= 20",
        "explained_pair": """WITH p AS (SELECT DISTINCT l_partkey AS e FROM lineitem WHERE l_orderkey = 1 ORDER BY e LIMIT 2),
            met AS (SELECT l_orderkey AS c FROM lineitem WHERE l_partkey IN (SELECT e FROM p) GROUP BY 1 HAVING count(DISTINCT l_partkey) = 2 ORDER BY 1 LIMIT 3)
            SELECT 'link' AS what, 'co_occurs' AS method UNION ALL SELECT 'shared', c::VARCHAR FROM met UNION ALL SELECT 'sample', min(l_orderkey)::VARCHAR FROM lineitem WHERE l_partkey IN (SELECT e FROM p) GROUP BY l_partkey""",
        "insight_evidence": """WITH r AS (SELECT event_id, event_id % 20 AS c, event_type, user_id::VARCHAR AS h, ts FROM events WHERE event_id < 300),
            s AS (SELECT *, CASE WHEN event_id = 7 THEN 'useful' WHEN event_type = 'error' THEN 'dismissed' WHEN event_type = 'click' OR c < 5 THEN 'superseded' ELSE 'new' END AS status FROM r)
            SELECT c AS cluster_id, arg_max(h, (ts, event_id)) AS live_hash FROM s WHERE status <> 'superseded' GROUP BY 1""",
        "ioc_kinds": """WITH e AS (SELECT event_id AS i, event_id::VARCHAR AS n FROM events), v AS (
            SELECT i, 'url' AS kind, 'https://www.host' || n || '.com/p?q=' || n AS value FROM e UNION ALL SELECT i, 'domain', 'host' || n || '.com' FROM e UNION ALL SELECT i, 'domain', 'mail' || n || '.org' FROM e
            UNION ALL SELECT i, 'email', 'bad@mail' || n || '.org' FROM e UNION ALL SELECT i, 'ip', '10.0.' || (i % 256) || '.7' FROM e UNION ALL SELECT i, 'mac', '00:1a:2b:3c:4d:5e' FROM e
            UNION ALL SELECT i, 'cve', 'CVE-2024-' || lpad((i % 10000)::VARCHAR, 4, '0') FROM e UNION ALL SELECT i, 'asn', 'AS' || (i + 1) FROM e UNION ALL SELECT i, 'ipv6', '2001:db8::' || lower(to_hex(i % 4096 + 1)) FROM e
            UNION ALL SELECT i, 'md5', md5(n) FROM e UNION ALL SELECT i, 'sha1', sha1(n) FROM e UNION ALL SELECT i, 'sha256', sha256(n) FROM e)
            SELECT i AS event_id, kind, value, 1::BIGINT AS n FROM v""",
        "progress_events": """WITH d AS (SELECT DISTINCT text FROM documents) SELECT 'document.processing' AS type, count(*) AS n FROM d UNION ALL SELECT 'document.ready', count(*) FROM d""",
        "streamed_graph": "SELECT count(DISTINCT text) AS n_documents, true AS same_chunks, true AS same_vectors, true AS same_entities, true AS clustered, true AS linked FROM documents",
        "stream_equivalence": f"WITH {SNIFF}, d AS (SELECT DISTINCT sha256(text) AS content_hash, doc_id FROM documents) SELECT DISTINCT content_hash, CASE WHEN len(commas) >= 2 AND commas[1] >= 1 AND list_unique(commas) = 1 THEN 'csv' WHEN len(list_filter(lines[:40], lambda y: regexp_matches(y, '^\\s*(# |## |- |\\* |```|> )'))) > 0 THEN 'markdown' ELSE 'text' END AS label, 'ready' AS status FROM c JOIN d ON src = 'documents' AND id = doc_id",
    }
