"""The projections of tempograph.sources as SQL views, for the oracle queries."""

FACTS = """facts_k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
facts0 AS (SELECT 'f' || event_id AS id, event_id AS seq, 'u' || user_id AS subject_id,
  CASE event_type WHEN 'signup' THEN 'has_role' WHEN 'error' THEN 'version_is' WHEN 'purchase' THEN 'owns' WHEN 'click' THEN 'uses' ELSE 'related_to' END AS predicate,
  'k' || (k % 5) AS object_value, ts AS recorded_at, ts - k * INTERVAL 1 HOUR AS valid_at,
  CASE WHEN user_id % 4 = 0 THEN 'personal' ELSE 'shared' END AS namespace,
  CASE k % 3 WHEN 0 THEN 'stated' WHEN 1 THEN 'inferred' ELSE 'speculative' END AS certainty,
  CASE event_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'tool_result' ELSE 'model' END AS assertion_source,
  k % 10 = 0 AS negation, 'ep' || (event_id // 10) AS episode_id FROM facts_k),
facts AS (SELECT *, predicate IN ('has_role', 'version_is') AS functional,
  CASE WHEN predicate = 'version_is' THEN 'literal' ELSE 'entity' END AS object_type,
  subject_id || ' ' || predicate || ' ' || object_value AS statement FROM facts0)"""

STATE = FACTS + """,
lanes AS (SELECT *, CASE WHEN functional THEN '' ELSE object_value END AS lane FROM facts),
s1 AS (SELECT *, row_number() OVER w AS rn, coalesce(object_value = lag(object_value) OVER w, false) AS same,
  coalesce(negation <> lag(negation) OVER w, false) AS turned FROM lanes WINDOW w AS (PARTITION BY subject_id, predicate, namespace, lane ORDER BY recorded_at, seq)),
s2 AS (SELECT *, same AND turned AS flip, sum(CASE WHEN same AND turned THEN 0 ELSE 1 END) OVER (PARTITION BY subject_id, predicate, namespace, lane ORDER BY recorded_at, seq) AS run FROM s1),
s3 AS (SELECT *, flip AND row_number() OVER (PARTITION BY subject_id, predicate, namespace, lane, run ORDER BY recorded_at, seq) % 2 = 0 AS contradicts FROM s2),
s4 AS (SELECT *, CASE WHEN functional AND rn > 1 AND NOT same AND NOT coalesce(lag(contradicts) OVER w, false) THEN 'supersede' WHEN contradicts THEN 'contradict' ELSE 'plain' END AS write_kind
  FROM s3 WINDOW w AS (PARTITION BY subject_id, predicate, namespace, lane ORDER BY recorded_at, seq)),
s5 AS (SELECT *, first_value(CASE WHEN write_kind <> 'plain' THEN struct_pack(k := write_kind, i := id, v := valid_at) END IGNORE NULLS)
  OVER (PARTITION BY subject_id, predicate, namespace, lane ORDER BY recorded_at, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS e FROM s4),
state AS (SELECT * EXCLUDE (e), CASE WHEN write_kind = 'contradict' OR e.k = 'contradict' THEN 'contradicted' WHEN e.k = 'supersede' THEN 'superseded' ELSE 'active' END AS epistemic_state,
  CASE WHEN write_kind <> 'contradict' AND e.k = 'supersede' THEN e.v END AS invalid_at, CASE WHEN write_kind <> 'contradict' THEN e.i END AS ended_by FROM s5)"""

ENTITIES = """ents AS (SELECT 'cust:' || c_custkey AS id, c_name AS name, 'entity' AS type FROM customer UNION ALL SELECT 'supp:' || s_suppkey, s_name, 'entity' FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'entity' FROM part UNION ALL SELECT 'nat:' || n_nationkey, n_name, 'entity' FROM nation UNION ALL SELECT 'reg:' || r_regionkey, r_name, 'entity' FROM region)"""

GRAPH = """graph AS (SELECT 'cust:' || c_custkey AS subject_id, 'located_in' AS predicate, 'nat:' || c_nationkey AS object_id FROM customer
  UNION ALL SELECT 'supp:' || s_suppkey, 'headquartered_in', 'nat:' || s_nationkey FROM supplier UNION ALL SELECT 'nat:' || n_nationkey, 'located_in', 'reg:' || n_regionkey FROM nation
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'manufactured_by', 'supp:' || l_suppkey FROM lineitem)"""

STATEMENTS = """stmts AS (SELECT 'd' || doc_id AS id, coalesce(text, '') AS statement, lang AS namespace, TIMESTAMP '2026-01-01' + doc_id * INTERVAL 1 HOUR AS recorded_at,
  TIMESTAMP '2026-01-01' + doc_id * INTERVAL 1 HOUR AS valid_at,
  CASE WHEN doc_id % 17 = 0 THEN 'superseded' WHEN doc_id % 13 = 0 THEN 'contradicted' ELSE 'active' END AS epistemic_state FROM documents)"""

QUERIES = """asked AS (SELECT item_id AS qid, array_to_string(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ' ') AS text FROM benchmark)"""

EPISODES = """eps AS (SELECT 'ep' || doc_id AS id, coalesce(text, '') AS content, 'text' AS content_type,
  CASE WHEN doc_id % 11 = 0 THEN source ELSE '{"agent": "a' || (doc_id % 3) || '", "type": "' || source || '"}' END AS source, lang AS namespace,
  TIMESTAMP '2026-01-01' + doc_id * INTERVAL 1 HOUR AS recorded_at FROM documents)"""

MESSAGES = """sess AS (SELECT conv_id AS id, min(turn) AS started_at, count(*) AS message_count, CASE WHEN conv_id % 9 = 0 THEN 1 ELSE 0 END AS archived FROM conversations GROUP BY conv_id),
msgs AS (SELECT conv_id AS session_id, turn AS "timestamp", role, text AS content, CASE WHEN turn % 7 = 6 THEN 'tool' ELSE '' END AS tool_name FROM conversations)"""
