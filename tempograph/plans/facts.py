"""Queries of filters, joins, aggregates, ranks and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import can_consolidate, certainty_weight, cosine, disposition_text, normalize_answer, normalize_literal, normalize_name, overlap, pick, query_words, resolve_valid_at, source_rank, time_range, token_estimate
from ..operators import facts as O
from ..operators import temporal as T
from ..sources.vocabulary import PREDICATES
from ..sources import aliases, entities, episodes, event_facts, graph_facts, query_batch, statements, table, vocabulary
from .views import ENTITIES, EPISODES, FACTS, GRAPH, QUERIES as ASKED, STATE, STATEMENTS


def _state(spark, d):
    return T.with_state(event_facts(spark, d))


def _metrics(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("name"), F.create_map(F.lit("bucket"), (F.col("user_id") % 3).cast("string"), F.lit("app"), F.lit("x")).alias("tags"), "ts", "value")


def _requests(spark, d):
    e = table(spark, d, "events")
    status = F.when(F.col("event_id") % 50 == 0, 429).when(F.col("event_id") % 31 == 0, 500).otherwise(200)
    return e.select("event_id", F.col("event_type").alias("route"), status.alias("status"), F.col("value").alias("ms"))


def _keys(spark, d):
    """One access key for each nation."""
    n = table(spark, d, "nation")
    ns = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("shared"), F.lit("personal"))).when(F.col("n_nationkey") % 3 == 1, F.array(F.lit("shared"))).otherwise(F.array(F.lit("personal")))
    return n.select(F.col("n_nationkey").alias("key_id"), F.sha2(F.concat(F.lit("token-"), F.col("n_nationkey")).cast("binary"), 256).alias("key_hash"), ns.alias("namespaces"), F.array(F.lit("read")).alias("scopes"), (F.col("n_nationkey") % 5 != 0).alias("active"))


def a1_totals(spark, d):
    return O.totals(_state(spark, d), entities(spark, d))


def a2_top_predicates(spark, d):
    return O.top_predicates(event_facts(spark, d))


def a3_entity_page(spark, d):
    return O.entity_page(entities(spark, d), graph_facts(spark, d), 20, 40).select("id", "name", "n_facts", "total")


def a5_facts_per_episode(spark, d):
    return event_facts(spark, d).groupBy("episode_id").agg(F.count("*").alias("n"))


def a6_last_ingest(spark, d):
    return event_facts(spark, d).agg(F.unix_micros(F.max("recorded_at")).alias("last_us"), F.count("*").alias("n"))


def a7_distinct_objects(spark, d):
    return event_facts(spark, d).groupBy("subject_id", "predicate", "namespace").agg(F.countDistinct("object_value").alias("n_objects"), F.count("*").alias("n"))


def a9_counters(spark, d):
    return O.counters(_metrics(spark, d)).withColumn("total", F.round("total", 4))


def a10_gauges(spark, d):
    return O.gauges(_metrics(spark, d))


def a11_histograms(spark, d):
    return O.histograms(_metrics(spark, d)).withColumn("mean", F.round("mean", 6))


def a12_latency_summary(spark, d):
    return O.latency_summary(_requests(spark, d), "route").select("route", "n", "ok", "rate_limited", "errors", *(F.round(p, 5).alias(p) for p in ("p50", "p95", "p99")))


def a15_user_turns(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.when(F.col("role") == "user", 1)).alias("user_turns"))


def p1_namespace(spark, d):
    return O.in_namespaces(event_facts(spark, d), "personal").select("id", "statement")


def p2_allowed_namespaces(spark, d):
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("qid"), F.concat(F.lit("token-"), F.col("n_nationkey")).alias("token"))
    return O.allowed(event_facts(spark, d), _keys(spark, d), asked).groupBy("qid", "namespace").agg(F.count("*").alias("n"))


def p4_scope_membership(spark, d):
    return _keys(spark, d).select("key_id", F.array_contains("scopes", "read").alias("can_read"), F.array_contains("namespaces", "personal").alias("sees_personal"))


def p5_active(spark, d):
    return _state(spark, d).filter("epistemic_state = 'active'").select("id", "statement")


def p6_vocabulary(spark, d):
    f = event_facts(spark, d).withColumn("predicate", F.when(F.col("seq") % 7 == 0, "likes").otherwise(F.col("predicate")))
    return O.valid_vocabulary(f, vocabulary(spark)).select("id", "predicate")


def p8_vocabulary_list(spark, d):
    """All known predicates, with how many facts use each."""
    n = event_facts(spark, d).groupBy("predicate").agg(F.count("*").alias("n"))
    return vocabulary(spark).join(n.hint("shuffle_hash"), "predicate", "left").select("predicate", "functional", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def p9_gates(spark, d):
    f = event_facts(spark, d).withColumn("assertion_source", F.when(F.col("seq") % 11 == 0, F.lit(None)).when(F.col("seq") % 13 == 0, "rumour").otherwise(F.col("assertion_source")))
    return O.gated(f).select("id", can_consolidate("assertion_source").alias("consolidates"), source_rank("assertion_source").cast("long").alias("source_rank"), certainty_weight("certainty").alias("weight"))


def p14_valid_at(spark, d):
    f = event_facts(spark, d).withColumn("raw", F.when(F.col("seq") % 3 == 0, "soon").when(F.col("seq") % 3 == 1, F.date_format("valid_at", "yyyy-MM-dd'T'HH:mm:ss")))
    at, inferred = resolve_valid_at("raw", "recorded_at")
    return f.select("id", F.unix_micros(at).alias("valid_at_us"), inferred.alias("inferred"))


def p16_episode_list(spark, d):
    e = episodes(spark, d).filter(F.col("recorded_at") >= F.lit("2026-01-03 00:00:00").cast("timestamp"))
    return e.orderBy(F.desc("recorded_at"), "id").limit(50).select("id", F.substring("content", 1, 200).alias("preview"), F.unix_micros("recorded_at").alias("recorded_at_us"))


def p18_disposition(spark, d):
    """Defaults of two namespaces, one of which a user has changed in part; a third has none of its own."""
    f = event_facts(spark, d).select(F.when(F.col("seq") % 3 == 0, "other").otherwise(F.col("namespace")).alias("namespace"))
    rows = lambda data: spark.createDataFrame([(n, t, v) for n, values in data.items() for t, v in values.items()], "namespace string, trait string, value int")
    defaults = rows({"shared": {"skepticism": 3, "literalism": 3, "empathy": 3}, "personal": {"skepticism": 2, "literalism": 4, "empathy": 4}})
    found = O.dispositions(f, defaults, rows({"personal": {"skepticism": 5}, "other": {"empathy": 4}}))
    return found.select("namespace", disposition_text("skepticism", "literalism", "empathy").alias("stance"))


def f1_normalised_names(spark, d):
    e = entities(spark, d).withColumn("raw", F.concat(F.lit(" "), F.upper("name"), F.lit("--The/_Second!  ")))
    return e.select("id", normalize_name("raw").alias("norm"), normalize_literal(F.concat("raw", F.lit(" X.;!"))).alias("literal"), normalize_answer("raw").alias("answer"))


def f5_query_words(spark, d):
    return query_batch(spark, d).select("qid", F.array_join(query_words("text"), "|").alias("words"), token_estimate("text").alias("tokens"))


def f6_overlap(spark, d):
    """Each document with the query of its number."""
    q = query_batch(spark, d).select(F.concat(F.lit("d"), F.col("qid")).alias("id"), "text")
    return statements(spark, d).hint("merge").join(q, "id").select("id", F.round(overlap("text", "statement"), 6).alias("overlap"))


def f7_time_ranges(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    phrase = F.element_at(F.array(*map(F.lit, ("seen last spring", "Last Summer", "last autumn", "last winter", "in June", "in december", "last week", "yesterday", "last month", "on 2026-01-15", "2026-03", "2026-13-40", "never"))), (F.col("event_id") % 13 + 1).cast("int"))
    r = e.select("event_id", time_range(phrase, F.col("ts")).alias("r"))
    return r.select("event_id", F.unix_micros("r.start").alias("start_us"), F.unix_micros("r.end").alias("end_us"))


def j1_subject_object_names(spark, d):
    e = entities(spark, d)
    return O.with_object(O.with_subject(graph_facts(spark, d), e), e).select("subject_name", "predicate", "object")


def j3_roles(spark, d):
    return O.roles(graph_facts(spark, d)).select("entity_id", "role", "subject_id", "predicate", "object_id")


def j4_provenance(spark, d):
    f = event_facts(spark, d).select("id", F.concat(F.lit("ep"), F.floor(F.col("seq") / 10)).alias("episode_id"))
    return O.provenance(f, episodes(spark, d)).withColumn("step", F.col("step").cast("long"))


def j5_alias_lookup(spark, d):
    asked = entities(spark, d).select(F.col("id").alias("qid"), F.upper("name").alias("text"))
    return asked.withColumn("norm", normalize_name("text")).join(aliases(spark, d), "norm").select("qid", "entity_id")


def w2_newest_per_group(spark, d):
    return O.newest_per_group(event_facts(spark, d), ["subject_id", "predicate", "namespace"], 3).select("id", F.col("place").cast("long").alias("place"))


def w4_token_budget(spark, d):
    f = event_facts(spark, d)
    return O.within_budget(f, "subject_id", "seq", token_estimate("statement"), 40).select("id", "spent")


def l1_top_k(spark, d):
    return O.top_k(event_facts(spark, d).withColumn("w", certainty_weight("certainty")), 5, [F.desc("w"), F.col("seq")], "predicate").select("id", "predicate", F.col("place").cast("long").alias("place"))


def l5_state_priority(spark, d):
    order = F.when(F.col("epistemic_state") == "active", 0).otherwise(1)
    s = _state(spark, d).filter("epistemic_state <> 'superseded'")
    return O.top_k(s, 4, [order, F.desc("recorded_at"), F.col("seq")], "subject_id").select("id", "epistemic_state", F.col("place").cast("long").alias("place"))


def _lists(spark, d):
    f = event_facts(spark, d)
    one = lambda c: f.filter(c).select("id", "subject_id", "seq")
    return one("predicate = 'owns'"), one("certainty = 'stated'"), one("negation")


def u1_first_seen_union(spark, d):
    return O.first_seen_union(list(_lists(spark, d)), "id", "seq").select("id", F.col("list_no").cast("long").alias("list_no"))


def u3_priority(spark, d):
    return O.by_priority(list(_lists(spark, d)), "subject_id", "seq", 5).select("subject_id", "id", F.col("tier").cast("long").alias("tier"), F.col("place").cast("long").alias("place"))


def u6_fallback(spark, d):
    a, _, c = _lists(spark, d)
    return O.fallback(c.filter("seq % 5 = 0"), a, "subject_id").select("id", "subject_id")


def t9_entity_facts(spark, d):
    """Pages of suppliers and customers of a number divisible by 100, the former by name; a fact holds from the day that its subject's number says."""
    asked = entities(spark, d).filter("(id like 'supp:%' or id like 'cust:%') and cast(substring_index(id, ':', -1) as long) % 100 = 0")
    asked = asked.select(F.col("id").alias("qid"), F.when(F.col("id").startswith("supp:"), F.col("name")).otherwise(F.col("id")).alias("key"))
    since = F.timestamp_micros(F.lit(1767225600000000) + F.substring_index("subject_id", ":", -1).cast("long") % 50 * 86400000000)
    facts = graph_facts(spark, d).withColumn("id", F.concat_ws(">", "subject_id", "predicate", "object_id")).withColumn("valid_at", since)
    return O.entity_facts(asked, entities(spark, d), facts).select("qid", "entity_id", "name", "role", "id", "subject_name", "predicate", "object", F.col("place").cast("long").alias("place"))


_RENAME = "replace(replace(replace(lower(raw), '-', ' '), '_', ' '), '/', ' ')"
SQL = {
    "a1_totals": f"WITH {STATE}, {ENTITIES} SELECT (SELECT count(*) FROM ents) AS entities, count(*) AS facts, count(*) FILTER (epistemic_state = 'active') AS active, count(*) FILTER (epistemic_state = 'superseded') AS superseded, count(*) FILTER (epistemic_state = 'contradicted') AS contradicted, count(DISTINCT subject_id) AS subjects, count(DISTINCT episode_id) AS episodes, count(*) FILTER (object_type = 'literal') AS literals FROM state",
    "a2_top_predicates": f"WITH {FACTS} SELECT predicate, count(*) AS n FROM facts GROUP BY 1 ORDER BY n DESC, predicate LIMIT 10",
    "a3_entity_page": f"WITH {ENTITIES}, {GRAPH} SELECT e.id, e.name, coalesce(n, 0) AS n_facts, (SELECT count(*) FROM ents) AS total FROM ents e LEFT JOIN (SELECT subject_id, count(*) AS n FROM graph GROUP BY 1) g ON e.id = g.subject_id ORDER BY n_facts DESC, name, id LIMIT 20 OFFSET 40",
    "a5_facts_per_episode": f"WITH {FACTS} SELECT episode_id, count(*) AS n FROM facts GROUP BY 1",
    "a6_last_ingest": f"WITH {FACTS} SELECT epoch_us(max(recorded_at)) AS last_us, count(*) AS n FROM facts",
    "a7_distinct_objects": f"WITH {FACTS} SELECT subject_id, predicate, namespace, count(DISTINCT object_value) AS n_objects, count(*) AS n FROM facts GROUP BY ALL",
    "a9_counters": "SELECT event_type AS name, 'app=x,bucket=' || (user_id % 3) AS tags, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "a10_gauges": "SELECT event_type AS name, arg_max(value, ts) AS value FROM events GROUP BY 1",
    "a11_histograms": """WITH m AS (SELECT event_type AS name, value, ts, count(*) OVER (PARTITION BY event_type) AS c, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS r FROM events),
 k AS (SELECT * FROM m WHERE r <= CASE WHEN c <= 1000 THEN c ELSE 500 + (c - 1001) % 501 END) SELECT name, count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, arg_max(value, ts) AS last FROM k GROUP BY 1""",
    "a12_latency_summary": """WITH r AS (SELECT event_type AS route, value AS ms, CASE WHEN event_id % 50 = 0 THEN 429 WHEN event_id % 31 = 0 THEN 500 ELSE 200 END AS status FROM events),
 l AS (SELECT route, list_sort(list(ms)) AS v, count(*) AS m FROM r WHERE status = 200 GROUP BY 1),
 q AS (SELECT route, v, m, greatest(least(CAST(floor(.5 * (m + 1)) AS BIGINT), m - 1), 1) AS a, greatest(least(CAST(floor(.95 * (m + 1)) AS BIGINT), m - 1), 1) AS b, greatest(least(CAST(floor(.99 * (m + 1)) AS BIGINT), m - 1), 1) AS c FROM l),
 n AS (SELECT route, count(*) AS n, count(*) FILTER (status = 200) AS ok, count(*) FILTER (status = 429) AS rate_limited, count(*) FILTER (status NOT IN (200, 429)) AS errors FROM r GROUP BY 1)
 SELECT n.*, round(v[a] + (.5 * (m + 1) - a) * (v[a + 1] - v[a]), 5) AS p50, round(v[b] + (.95 * (m + 1) - b) * (v[b + 1] - v[b]), 5) AS p95, round(v[c] + (.99 * (m + 1) - c) * (v[c + 1] - v[c]), 5) AS p99 FROM n JOIN q USING (route)""",
    "a15_user_turns": "SELECT conv_id, count(*) FILTER (role = 'user') AS user_turns FROM conversations GROUP BY 1",
    "p1_namespace": f"WITH {FACTS} SELECT id, statement FROM facts WHERE namespace = 'personal'",
    "p2_allowed_namespaces": f"WITH {FACTS}, k AS (SELECT n_nationkey AS qid, unnest(CASE n_nationkey % 3 WHEN 0 THEN ['shared', 'personal'] WHEN 1 THEN ['shared'] ELSE ['personal'] END) AS namespace FROM nation WHERE n_nationkey % 5 <> 0) SELECT CAST(qid AS INTEGER) AS qid, namespace, count(*) AS n FROM k JOIN facts USING (namespace) GROUP BY ALL",
    "p4_scope_membership": "SELECT n_nationkey AS key_id, true AS can_read, n_nationkey % 3 <> 1 AS sees_personal FROM nation",
    "p5_active": f"WITH {STATE} SELECT id, statement FROM state WHERE epistemic_state = 'active'",
    "p6_vocabulary": f"WITH {FACTS} SELECT id, predicate FROM facts WHERE seq % 7 <> 0",
    "p8_vocabulary_list": f"WITH {FACTS}, v(predicate, functional) AS (VALUES {', '.join(map(str, PREDICATES))}) SELECT v.predicate, v.functional, count(id) AS n FROM v LEFT JOIN facts f ON f.predicate = v.predicate GROUP BY 1, 2",
    "p9_gates": f"""WITH {FACTS}, g AS (SELECT *, CASE WHEN seq % 11 = 0 THEN NULL WHEN seq % 13 = 0 THEN 'rumour' ELSE assertion_source END AS src FROM facts)
 SELECT id, coalesce(src, 'model') <> 'model' AS consolidates, CAST(CASE src WHEN 'user' THEN 0 WHEN 'tool_result' THEN 1 ELSE 2 END AS BIGINT) AS source_rank, CAST(CASE certainty WHEN 'stated' THEN 1.0 WHEN 'inferred' THEN 0.7 ELSE 0.4 END AS DOUBLE) AS weight FROM g WHERE coalesce(src, 'model') IN ('user', 'tool_result', 'model')""",
    "p14_valid_at": f"WITH {FACTS} SELECT id, epoch_us(CASE WHEN seq % 3 = 1 THEN date_trunc('second', valid_at) ELSE recorded_at END) AS valid_at_us, seq % 3 <> 1 AS inferred FROM facts",
    "p16_episode_list": f"WITH {EPISODES} SELECT id, substring(content, 1, 200) AS preview, epoch_us(recorded_at) AS recorded_at_us FROM eps WHERE recorded_at >= TIMESTAMP '2026-01-03' ORDER BY recorded_at DESC, id LIMIT 50",
    "p18_disposition": f"WITH {FACTS} SELECT DISTINCT CASE WHEN seq % 3 = 0 THEN 'other' ELSE namespace END AS namespace, CASE WHEN seq % 3 = 0 THEN 'moderate threshold; allow inference; preserve sentiment' WHEN namespace = 'personal' THEN 'require strong evidence; exact facts; preserve sentiment' ELSE 'moderate threshold; allow inference; factual focus' END AS stance FROM facts",
    "f1_normalised_names": f"""WITH {ENTITIES}, r AS (SELECT id, ' ' || upper(name) || '--The/_Second!  ' AS raw FROM ents) SELECT id, trim(regexp_replace(regexp_replace({_RENAME}, '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS norm,
 regexp_replace(trim(regexp_replace(lower(raw || ' X.;!'), ' +', ' ', 'g')), '[.,;:!?]+$', '') AS literal, trim(regexp_replace(lower(raw), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS answer FROM r""",
    "f5_query_words": f"WITH {ASKED} SELECT qid, array_to_string(regexp_extract_all(text, '[a-z0-9]+(?:[-_][a-z0-9]+)*'), '|') AS words, CAST(length(text) // 4 AS BIGINT) AS tokens FROM asked",
    "f6_overlap": f"""WITH {ASKED}, {STATEMENTS}, q AS (SELECT 'd' || qid AS id, list_distinct(list_filter(string_split(text, ' '), lambda x: x <> '')) AS w FROM asked),
 s AS (SELECT id, list_filter(regexp_split_to_array(lower(statement), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM stmts) SELECT id, round(len(list_intersect(q.w, s.w)) / greatest(len(q.w), 1), 6) AS overlap FROM q JOIN s USING (id)""",
    "f7_time_ranges": """WITH e AS (SELECT event_id, ts, event_id % 13 AS p, date_trunc('year', ts) AS y, date_trunc('month', ts) AS m, date_trunc('day', ts) AS d FROM events),
 r AS (SELECT event_id, CASE p WHEN 0 THEN y - INTERVAL 10 MONTH WHEN 1 THEN y - INTERVAL 7 MONTH WHEN 2 THEN y - INTERVAL 4 MONTH WHEN 3 THEN y - INTERVAL 1 MONTH
  WHEN 4 THEN y + INTERVAL 5 MONTH - CASE WHEN month(ts) < 6 THEN INTERVAL 1 YEAR ELSE INTERVAL 0 YEAR END WHEN 5 THEN y + INTERVAL 11 MONTH - CASE WHEN month(ts) < 12 THEN INTERVAL 1 YEAR ELSE INTERVAL 0 YEAR END
  WHEN 6 THEN d - INTERVAL 7 DAY WHEN 7 THEN d - INTERVAL 1 DAY WHEN 8 THEN m - INTERVAL 1 MONTH WHEN 9 THEN TIMESTAMP '2026-01-15' WHEN 10 THEN TIMESTAMP '2026-03-01' END AS a, p, ts, d, m FROM e)
 SELECT event_id, epoch_us(a) AS start_us, epoch_us(CASE WHEN p < 4 THEN a + INTERVAL 3 MONTH WHEN p < 6 THEN a + INTERVAL 1 MONTH - INTERVAL 1 SECOND WHEN p = 6 THEN ts WHEN p = 7 THEN d - INTERVAL 1 SECOND WHEN p = 8 THEN m
  WHEN p = 9 THEN TIMESTAMP '2026-01-15 23:59:59' WHEN p = 10 THEN TIMESTAMP '2026-03-31 23:59:59' END) AS end_us FROM r""",
    "j1_subject_object_names": f"WITH {ENTITIES}, {GRAPH} SELECT s.name AS subject_name, predicate, o.name AS object FROM graph JOIN ents s ON s.id = subject_id LEFT JOIN ents o ON o.id = object_id",
    "j3_roles": f"WITH {GRAPH} SELECT subject_id AS entity_id, 'subject' AS role, subject_id, predicate, object_id FROM graph UNION ALL SELECT object_id, 'object', subject_id, predicate, object_id FROM graph",
    "j4_provenance": f"""WITH {FACTS}, {EPISODES}, p AS (SELECT f.id AS fact_id, e.id AS ep, CASE WHEN source LIKE '{{%' THEN source END AS j FROM facts f JOIN eps e ON e.id = f.episode_id)
 SELECT fact_id, unnest([0, 1, 2, 3, 4])::BIGINT AS step, unnest(['agent', 'channel', 'session', 'episode', 'source']) AS level, unnest([coalesce(json_extract_string(j, '$.agent'), 'unknown'), 'unknown', 'unknown', ep, coalesce(json_extract_string(j, '$.type'), 'session_transcript')]) AS value FROM p""",
    "j5_alias_lookup": f"WITH {ENTITIES}, n AS (SELECT id, trim(regexp_replace(regexp_replace({_RENAME}, '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS norm FROM (SELECT id, name AS raw FROM ents)), a AS (SELECT norm, min(id) AS entity_id FROM n GROUP BY 1) SELECT n.id AS qid, entity_id FROM n JOIN a USING (norm)",
    "w2_newest_per_group": f"WITH {FACTS}, r AS (SELECT id, row_number() OVER (PARTITION BY subject_id, predicate, namespace ORDER BY recorded_at DESC, seq DESC) AS place FROM facts) SELECT * FROM r WHERE place <= 3",
    "w4_token_budget": f"WITH {FACTS}, r AS (SELECT id, CAST(sum(length(statement) // 4) OVER (PARTITION BY subject_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM facts) SELECT * FROM r WHERE spent <= 40",
    "l1_top_k": f"WITH {FACTS}, r AS (SELECT id, predicate, row_number() OVER (PARTITION BY predicate ORDER BY CASE certainty WHEN 'stated' THEN 0 WHEN 'inferred' THEN 1 ELSE 2 END, seq) AS place FROM facts) SELECT * FROM r WHERE place <= 5",
    "l5_state_priority": f"WITH {STATE}, r AS (SELECT id, epistemic_state, row_number() OVER (PARTITION BY subject_id ORDER BY epistemic_state, recorded_at DESC, seq) AS place FROM state WHERE epistemic_state <> 'superseded') SELECT * FROM r WHERE place <= 4",
    "u1_first_seen_union": f"WITH {FACTS} SELECT id, CAST(CASE WHEN predicate = 'owns' THEN 0 WHEN certainty = 'stated' THEN 1 ELSE 2 END AS BIGINT) AS list_no FROM facts WHERE predicate = 'owns' OR certainty = 'stated' OR negation",
    "u3_priority": f"""WITH {FACTS}, u AS (SELECT subject_id, id, seq, 0 AS tier FROM facts WHERE predicate = 'owns' UNION ALL SELECT subject_id, id, seq, 1 FROM facts WHERE certainty = 'stated' UNION ALL SELECT subject_id, id, seq, 2 FROM facts WHERE negation),
 r AS (SELECT subject_id, id, CAST(tier AS BIGINT) AS tier, row_number() OVER (PARTITION BY subject_id ORDER BY tier, seq) AS place FROM u) SELECT * FROM r WHERE place <= 5""",
    "u6_fallback": f"WITH {FACTS}, a AS (SELECT id, subject_id FROM facts WHERE negation AND seq % 5 = 0) SELECT * FROM a UNION ALL SELECT id, subject_id FROM facts WHERE predicate = 'owns' AND subject_id NOT IN (SELECT subject_id FROM a)",
    "t9_entity_facts": f"""WITH {GRAPH}, {ENTITIES}, g AS (SELECT *, subject_id || '>' || predicate || '>' || object_id AS id, CAST(split_part(subject_id, ':', 2) AS BIGINT) % 50 AS day FROM graph),
 a AS (SELECT id AS e, name FROM ents WHERE (id LIKE 'supp:%' OR id LIKE 'cust:%') AND CAST(split_part(id, ':', 2) AS BIGINT) % 100 = 0), r AS (SELECT a.*, 'subject' AS role, g.* FROM a JOIN g ON subject_id = e UNION ALL SELECT a.*, 'object', g.* FROM a JOIN g ON object_id = e)
 SELECT e AS qid, e AS entity_id, r.name, role, r.id, s.name AS subject_name, predicate, o.name AS object, row_number() OVER (PARTITION BY e ORDER BY day DESC, r.id, role) AS place FROM r LEFT JOIN ents s ON s.id = subject_id LEFT JOIN ents o ON o.id = object_id""",
}
QUERIES = {n: globals()[n] for n in SQL}
