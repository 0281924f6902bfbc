"""Queries of context, lookup by name, observations, models and evaluation of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consolidation as C
from ..operators import facts as O
from ..operators import quality as Q
from ..operators import retrieval as R
from ..operators import storage as S
from ..operators import temporal as T
from ..sources import aliases, entities, event_facts, graph_facts, query_batch, statements, table
from ..sources.scratch import scratch_path, written
from .retrieval import _FUSED, _rank, _V, LISTS, bm25_sql
from .views import ENTITIES, FACTS, GRAPH, QUERIES as ASKED, STATE, STATEMENTS


def _doc_facts(spark, d):
    """Each document as a fact from a nation to a region."""
    n = F.substring("id", 2, 20).cast("long")
    return statements(spark, d).select("id", F.concat(F.lit("nat:"), n % 25).alias("subject_id"), F.lit("located_in").alias("predicate"), F.concat(F.lit("reg:"), n % 5).alias("object_id"), "epistemic_state")


def _places(spark, d):
    return entities(spark, d).filter("id like 'nat:%' or id like 'reg:%'")  # the entities of those facts


def r9_five_lists(spark, d):
    """All five strategies. Every third query names a month, every other one a nation; query and statement vectors go by number."""
    names = F.broadcast(table(spark, d, "nation").select(F.col("n_nationkey").alias("_n"), F.lower("n_name").alias("_name")))  # 25 rows
    q = query_batch(spark, d).join(names, F.col("qid") % 25 == F.col("_n"))
    text = F.concat("text", F.when(F.col("qid") % 3 == 0, " in january").otherwise(""), F.when(F.col("qid") % 2 == 0, F.concat(F.lit(" "), F.col("_name"))).otherwise(""))
    v = table(spark, d, "embeddings")
    qv = v.hint("merge").join(q.select(F.col("qid").cast("long").alias("vec_id")), "vec_id").select(F.col("vec_id").cast("int").alias("qid"), "embedding")
    sv = v.select(F.concat(F.lit("d"), F.col("vec_id")).alias("id"), "embedding")
    asked = q.select(F.col("qid").cast("int").alias("qid"), text.alias("text"), "now")
    return _rank(R.search(asked, statements(spark, d), 10, _doc_facts(spark, d), _places(spark, d), qv, sv))


def _turns(spark, d):
    """Documents of a number divisible by 100 as what users said."""
    return table(spark, d, "documents").filter("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.coalesce("text", F.lit("")).alias("text"))


def _keywords(spark, d):
    """The first long word of each benchmark item, for a nation and a region."""
    word = F.get(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) >= 4), F.lit(0))
    k = table(spark, d, "benchmark").groupBy(word.alias("keyword")).agg(F.min("item_id").alias("n")).filter("keyword is not null")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    places = F.broadcast(n.crossJoin(F.broadcast(r)).select(F.col("n_nationkey").alias("_n"), F.col("r_regionkey").alias("_r"), F.array("n_name", "r_name").alias("names")))  # 25 x 5 rows
    return k.join(places, (F.col("n") % 25 == F.col("_n")) & (F.col("n") % 5 == F.col("_r"))).select("keyword", "names")


def j14_keyword_entities(spark, d):
    return R.keyword_entities(_turns(spark, d), _keywords(spark, d))


def r14_injected(spark, d):
    t = _turns(spark, d)
    found = R.name_injection(t, R.keyword_entities(t, _keywords(spark, d)), _places(spark, d), aliases(spark, d), _doc_facts(spark, d), statements(spark, d))
    return found.select("qid", "id", F.col("source").cast("long").alias("source"))


def p17_entities_found(spark, d):
    """By id or name in turn."""
    n = table(spark, d, "supplier").select(F.col("s_suppkey").alias("qid"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(F.concat(F.lit("supp:"), F.col("s_suppkey"))).alias("key"))
    return R.find_entities(n, entities(spark, d))


def u5_supplemented(spark, d):
    """Facts found about a supplier, and those that its name brings besides."""
    f = graph_facts(spark, d).withColumn("id", F.concat_ws(">", "subject_id", "predicate", "object_id"))
    asked = table(spark, d, "supplier").filter("s_suppkey % 100 = 0").select(F.col("s_suppkey").alias("qid"), F.col("s_name").alias("key"), F.concat(F.lit("supp:"), F.col("s_suppkey")).alias("subject_id"))
    found = f.hint("merge").join(asked, "subject_id").select("qid", "id").withColumn("rank", F.lit(1))
    return R.supplement(found, asked.select("qid", "key"), entities(spark, d), f).select("qid", "id", F.col("place").cast("long").alias("place"))


def r11_certainty(spark, d):
    """Hits with the certainty of their facts; what waits has none."""
    label = F.element_at(F.array(F.lit("stated"), F.lit("inferred"), F.lit("speculative"), F.lit(None).cast("string")), (F.substring("id", 2, 20).cast("long") % 4 + 1).cast("int"))
    s = statements(spark, d).withColumn("certainty", label)
    hits = R.keyword_search(query_batch(spark, d), s, 5).select("qid", "id")
    waiting = hits.filter("id like '%7'").withColumn("id", F.concat(F.lit("pending:"), F.col("id")))
    return R.with_certainty(hits.unionByName(waiting), s)


def _observed(spark, d):
    o = C.observe(T.with_state(event_facts(spark, d)))
    return o.select(F.concat_ws("|", *C.GROUP).alias("id"), "summary", "proof_count", F.lit("active").alias("epistemic_state"))


def _user_questions(spark, d):
    """What users of a number divisible by 100 own."""
    return table(spark, d, "customer").filter("c_custkey % 100 = 0").select(F.col("c_custkey").alias("qid"), F.concat(F.lit("u"), F.col("c_custkey"), F.lit(" owns k3")).alias("text"))


def l6_observation_search(spark, d):
    return _rank(R.observation_search(_user_questions(spark, d), _observed(spark, d), 20))


def _models(spark, d):
    return table(spark, d, "nation").select(F.concat(F.lit("m"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("title"), F.concat(F.lit("Notes on "), F.lower("n_name"), F.lit(" and u"), F.col("n_nationkey") * 100).alias("summary"))


def p20_model_matches(spark, d):
    """Parts of names that no word equals."""
    q = table(spark, d, "nation").select(F.col("n_nationkey").alias("qid"), F.substring("n_name", 2, 3).alias("text"))
    return _rank(R.match_models(q, _models(spark, d), 30)).drop("score")


def r15_priority(spark, d):
    """Curated models, then observations, then facts about what a user owns."""
    q = _user_questions(spark, d)
    f = event_facts(spark, d).select("id", "statement")
    found = R.recall(R.model_search(q, _models(spark, d), 3), R.observation_search(q, _observed(spark, d), 4), R.keyword_search(q, f, 10), 10)
    return found.withColumn("place", F.col("place").cast("long"))


def g4_topic_context(spark, d):
    """What lies within one fact of the best hits for a supplier."""
    g = written(graph_facts(spark, d)).withColumn("id", F.concat_ws(">", "subject_id", "predicate", "object_id"))  # read in each step, and distinct by a shuffle
    text = O.with_object(O.with_subject(g, entities(spark, d)), entities(spark, d)).select("id", F.concat_ws(" ", "subject_name", "predicate", "object").alias("statement"))
    topics = table(spark, d, "supplier").filter("s_suppkey % 100 = 0").select(F.col("s_suppkey").alias("qid"), F.col("s_name").alias("text"))
    return R.topic_context(topics, text, g, 1, 3)


def a16_run_summary(spark, d):
    f = event_facts(spark, d).select(F.col("subject_id").alias("session_id"), "statement", "seq")
    seconds = f.groupBy("session_id").agg((F.count("*") + 1).cast("double").alias("seconds_a"), F.count(F.when(F.col("seq") % 2 == 0, 1)).cast("double").alias("seconds_b"))
    return Q.run_summary(Q.compare_runs(f.filter("seq % 2 = 0"), f.filter("seq % 3 = 0")), seconds)


def v5_judged(spark, d):
    """Ten facts of a keyword search for each query; two classes expect strings, one silence, which a search that finds something breaks."""
    q = query_batch(spark, d)
    kind = F.element_at(F.array(F.lit("entity_lookup"), F.lit("inject"), F.lit("paraphrase")), (F.col("qid") % 3 + 1).cast("int"))
    none = F.array().cast("array<string>")
    e = q.select("qid", kind.alias("class"), F.when(F.col("qid") % 3 == 1, none).otherwise(F.split("text", " ")).alias("entities"), F.when(F.col("qid") % 3 == 2, F.array(F.lit("zzz-q"), F.lit("THE"))).alias("substrings"))
    found = R.of_hits(R.keyword_search(q, statements(spark, d), 10), statements(spark, d).select("id", "statement")).select("qid", "id", "statement")
    j = Q.judge(e, found)
    return j.select("qid", "class", "n_results", F.size("missing_entities").cast("long").alias("n_missing_entities"), F.array_join("missing_substrings", ",").alias("missing_substrings"), "passed")


def s14_query_check(spark, d):
    return Q.check_queries(table(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("no"), F.when(F.col("item_id") % 7 != 5, F.col("text")).alias("text")))


def s13_query_set(spark, d):
    """Benchmark items as a query set of JSON lines in the shared folder; some have no text or no class."""
    n = F.col("item_id")
    path = scratch_path(spark)
    q = table(spark, d, "benchmark").select(n.cast("string").alias("id"), F.when(n % 7 != 5, F.col("text")).alias("text"), F.when(n % 3 != 0, F.concat(F.lit("c"), n % 3)).alias("class"), F.array(F.concat(F.lit("d"), n), F.lit("d0")).alias("expected_ids"))
    q.write.json(path)
    return Q.load_queries(spark, path).select("id", "text", "class", F.array_join("expected_ids", ",").alias("expected_ids"))


def s15_alert_log(spark, d):
    """Alerts as JSON lines, in two writes, read again."""
    e = table(spark, d, "events").filter("event_type = 'error'").select(F.col("event_id").alias("id"), F.lit("error").alias("category"), "props")
    path = scratch_path(spark)
    S.write_json_lines(e.filter("id % 2 = 0"), path)
    S.write_json_lines(e.filter("id % 2 = 1"), path, "append")
    return spark.read.schema(e.schema).json(path)


def s16_facts_with_vectors(spark, d):
    """Vectors of one label have another size."""
    v = table(spark, d, "embeddings").select(F.concat(F.lit("d"), F.col("vec_id")).alias("id"), F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"))
    return R.usable_vectors(statements(spark, d).select("id"), v, 64).select("id", F.col("embedding").isNotNull().alias("usable"))


def s7_stored_texts(spark, d):
    """The text of each path as it is stored, by folder."""
    from .curation import _stored_docs

    path = scratch_path(spark)
    S.write_documents(_stored_docs(spark, d), path)
    return spark.read.parquet(path).select(F.concat_ws("/", "folder", "file").alias("path"), "file_id", F.octet_length("content").cast("long").alias("size_bytes"))


_DOC_FACTS = "df0 AS (SELECT 'd' || doc_id AS id, 'nat:' || (doc_id % 25) AS s, 'reg:' || (doc_id % 5) AS o, CASE WHEN doc_id % 17 = 0 THEN 'superseded' WHEN doc_id % 13 = 0 THEN 'contradicted' ELSE 'active' END AS state FROM documents)"
_TURNS = "turns AS (SELECT doc_id AS qid, coalesce(text, '') AS text FROM documents WHERE doc_id % 100 = 0)"
_KEYS = """kw0 AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 4)[1] AS keyword, min(item_id) AS n FROM benchmark GROUP BY 1),
 kn AS (SELECT DISTINCT qid, name FROM (SELECT turns.qid, unnest([n_name, r_name]) AS name FROM kw0 JOIN nation ON n_nationkey = n % 25 JOIN region ON r_regionkey = n % 5, turns WHERE keyword IS NOT NULL AND contains(lower(turns.text), keyword)))"""
_FIVE = "SELECT qid, text || CASE WHEN qid % 3 = 0 THEN ' in january' ELSE '' END || CASE WHEN qid % 2 = 0 THEN ' ' || lower(n_name) ELSE '' END AS text FROM asked JOIN nation ON n_nationkey = qid % 25"
_OWN = "SELECT c_custkey AS qid, 'u' || c_custkey || ' owns k3' AS text FROM customer WHERE c_custkey % 100 = 0"
_OBS = """gf AS (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate, namespace ORDER BY recorded_at DESC, seq DESC) AS place FROM state WHERE epistemic_state = 'active' AND assertion_source <> 'model'),
 ob AS (SELECT subject_id || '|' || predicate || '|' || namespace AS id, subject_id || ' ' || predicate || ': ' || array_to_string(list_slice(list(object_value ORDER BY place), 1, 5), '; ') AS summary, count(*) AS proof_count FROM gf WHERE place <= 20 GROUP BY subject_id, predicate, namespace)"""
_MODELS = "md AS (SELECT 'm' || n_nationkey AS id, n_name AS title, 'Notes on ' || lower(n_name) || ' and u' || (n_nationkey * 100) AS summary FROM nation)"
SQL = {
    "r9_five_lists": f"""WITH {ASKED}, {STATEMENTS}, {bm25_sql(_FIVE)}, {LISTS}, {_V}, {ENTITIES}, {_DOC_FACTS},
 vs AS (SELECT CAST(x.vec_id AS INTEGER) AS qid, 'd' || e.vec_id AS id, round(list_cosine_similarity(x.v, e.v), 6) AS score FROM e x JOIN q ON q.qid = x.vec_id, e), ve AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM vs),
 gt AS (SELECT qid, regexp_extract_all(lower(text), '[a-z0-9]+(?:[-_][a-z0-9]+)*') AS raw FROM q), gw AS (SELECT qid, unnest(list_distinct(raw)) AS word, raw FROM gt), gn AS (SELECT qid, word, list_position(raw, word) AS no FROM gw),
 gm AS (SELECT DISTINCT qid, no, x.id AS ent FROM gn, ents x WHERE (x.id LIKE 'nat:%' OR x.id LIKE 'reg:%') AND contains(lower(x.name), word)), gh AS (SELECT DISTINCT qid, no, df0.id FROM gm JOIN df0 ON s = ent OR o = ent),
 gk AS (SELECT *, row_number() OVER (PARTITION BY qid, no ORDER BY id) AS p FROM gh), go AS (SELECT qid, id, min(no) AS no FROM gk WHERE p <= 5 GROUP BY 1, 2), gr AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY no, id) AS rank FROM go),
 lists AS (SELECT qid, id, rank, 0 AS l FROM ve WHERE rank <= 20 UNION ALL SELECT qid, id, rank, 1 FROM bm WHERE rank <= 20 UNION ALL SELECT qid, id, rank, 2 FROM gr WHERE rank <= 20 UNION ALL SELECT qid, id, rank, 3 FROM te WHERE rank <= 20 UNION ALL SELECT qid, id, rank, 4 FROM re WHERE rank <= 20)
 {_FUSED} SELECT CAST(qid AS INTEGER) AS qid, id, score, rank FROM fr WHERE rank <= 10""",
    "j14_keyword_entities": f"WITH {_TURNS}, {_KEYS} SELECT * FROM kn",
    "r14_injected": f"""WITH {_TURNS}, {_KEYS}, {STATEMENTS}, {ENTITIES}, {_DOC_FACTS}, {bm25_sql('SELECT * FROM turns WHERE qid IN (SELECT qid FROM kn)')}, lv AS (SELECT * FROM df0 WHERE state = 'active'), ne AS (SELECT qid, x.id AS ent FROM kn JOIN ents x USING (name) WHERE x.id LIKE 'nat:%' OR x.id LIKE 'reg:%'),
 al AS (SELECT sc.qid, sc.id, 3 AS source FROM sc JOIN lv USING (id) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 10 UNION ALL SELECT qid, lv.id, 0 FROM ne JOIN lv ON s = ent UNION ALL SELECT qid, lv.id, 2 FROM ne JOIN lv ON o = ent)
 SELECT qid, id, CAST(min(source) AS BIGINT) AS source FROM al GROUP BY 1, 2""",
    "p17_entities_found": "SELECT s_suppkey AS qid, 'supp:' || s_suppkey AS entity_id FROM supplier",
    "u5_supplemented": f"""WITH {GRAPH}, g AS (SELECT *, subject_id || '>' || predicate || '>' || object_id AS id FROM graph), h AS (SELECT s_suppkey AS qid, id, 0 AS t FROM supplier JOIN g ON subject_id = 'supp:' || s_suppkey WHERE s_suppkey % 100 = 0 UNION ALL SELECT s_suppkey, id, 1 FROM supplier JOIN g ON object_id = 'supp:' || s_suppkey WHERE s_suppkey % 100 = 0)
 SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY t, id) AS place FROM h""",
    "r11_certainty": f"""WITH {ASKED}, {STATEMENTS}, {bm25_sql('SELECT * FROM asked')}, r AS (SELECT qid, id FROM sc QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 5), c AS (SELECT *, CAST(substring(id, 2) AS BIGINT) % 4 AS m FROM r)
 SELECT qid, id, CASE m WHEN 1 THEN 'inferred' WHEN 2 THEN 'speculative' ELSE 'stated' END AS certainty_label, CAST(CASE m WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 ELSE 1.0 END AS DOUBLE) AS certainty FROM c UNION ALL SELECT qid, 'pending:' || id, NULL, 0.0 FROM c WHERE id LIKE '%7'""",
    "l6_observation_search": f"WITH {STATE}, {_OBS}, {bm25_sql(_OWN, 'SELECT id, summary AS text FROM ob')} SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, proof_count DESC, id) AS rank FROM sc JOIN ob USING (id) QUALIFY rank <= 20",
    "p20_model_matches": f"WITH {_MODELS} SELECT n_nationkey AS qid, md.id, row_number() OVER (PARTITION BY n_nationkey ORDER BY md.id) AS rank FROM nation, md WHERE contains(lower(title), lower(substring(n_name, 2, 3))) OR contains(lower(summary), lower(substring(n_name, 2, 3)))",
    "r15_priority": f"""WITH {STATE}, {_OBS}, {_MODELS}, o AS (WITH {bm25_sql(_OWN, 'SELECT id, summary AS text FROM ob')} SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, proof_count DESC, id) AS rank FROM sc JOIN ob USING (id)),
 m AS (WITH {bm25_sql(_OWN, "SELECT id, title || ' ' || summary AS text FROM md")} SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc), f AS (WITH {bm25_sql(_OWN, 'SELECT id, statement AS text FROM facts')} SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc),
 u AS (SELECT qid, id, rank, 'mental_model' AS result_type, 0 AS tier FROM m WHERE rank <= 3 UNION ALL SELECT qid, id, rank, 'observation', 1 FROM o WHERE rank <= 4 UNION ALL SELECT qid, id, rank, 'fact', 2 FROM f WHERE rank <= 10)
 SELECT qid, id, result_type, row_number() OVER (PARTITION BY qid ORDER BY tier, rank, id) AS place FROM u QUALIFY place <= 10""",
    "g4_topic_context": f"""WITH {GRAPH}, {ENTITIES}, g AS (SELECT *, subject_id || '>' || predicate || '>' || object_id AS id FROM graph), gs AS (SELECT g.id, a.name || ' ' || predicate || ' ' || b.name AS text FROM g JOIN ents a ON a.id = subject_id JOIN ents b ON b.id = object_id),
 {bm25_sql('SELECT s_suppkey AS qid, s_name AS text FROM supplier WHERE s_suppkey % 100 = 0', 'SELECT id, text FROM gs')}, hit AS (SELECT qid, id FROM sc QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 3),
 ed AS (SELECT qid, unnest([subject_id, object_id]) AS e FROM hit JOIN g USING (id)), near AS (SELECT qid, e FROM ed UNION SELECT qid, object_id FROM ed JOIN g ON subject_id = e UNION SELECT qid, subject_id FROM ed JOIN g ON object_id = e)
 SELECT x.qid, g.id FROM g JOIN near x ON x.e = subject_id JOIN near y ON y.e = object_id AND y.qid = x.qid UNION SELECT qid, id FROM hit""",
    "a16_run_summary": f"""WITH {FACTS}, x AS (SELECT subject_id, count(*) + 1 AS sa, count(*) FILTER (seq % 2 = 0) AS sb, count(*) FILTER (seq % 2 = 0) AS a, count(*) FILTER (seq % 3 = 0) AS b FROM facts GROUP BY 1)
 SELECT count(*) AS sessions, round(avg(CASE WHEN sb > 0 THEN sa / sb END), 6) AS mean_speed, round(avg(CASE WHEN a > 0 THEN round(b / a, 6) END), 6) AS mean_fact_ratio FROM x WHERE a > 0 OR b > 0""",
    "v5_judged": f"""WITH {ASKED}, {STATEMENTS}, {bm25_sql('SELECT * FROM asked')}, r AS (SELECT qid, id FROM sc QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 10),
 t AS (SELECT qid, count(*) AS n, string_agg(statement, chr(10) ORDER BY statement) AS t FROM r JOIN stmts USING (id) GROUP BY 1), j AS (SELECT a.qid, a.text, coalesce(n, 0) AS n, lower(coalesce(t, '')) AS t, trim(regexp_replace(lower(coalesce(t, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS tn FROM asked a LEFT JOIN t USING (qid)),
 x AS (SELECT qid, n, CASE WHEN qid % 3 = 1 THEN 0 ELSE len(list_filter(string_split(text, ' '), lambda w: NOT (contains(t, w) OR contains(tn, w)))) END AS me, CASE WHEN qid % 3 = 2 THEN list_filter(['zzz-q', 'THE'], lambda w: NOT (contains(t, lower(w)) OR contains(tn, CASE w WHEN 'zzz-q' THEN 'zzz q' ELSE 'the' END))) ELSE CAST([] AS VARCHAR[]) END AS ms FROM j)
 SELECT qid, ['entity_lookup', 'inject', 'paraphrase'][CAST(qid % 3 + 1 AS INTEGER)] AS class, n AS n_results, CAST(me AS BIGINT) AS n_missing_entities, array_to_string(ms, ',') AS missing_substrings, CASE WHEN qid % 3 = 1 THEN n = 0 ELSE me = 0 AND len(ms) = 0 END AS passed FROM x""",
    "s14_query_check": "SELECT CASE WHEN min(CASE WHEN text IS NULL OR item_id % 7 = 5 THEN item_id END) IS NULL THEN 'ok' ELSE 'error' END AS status, count(*) AS queries, CAST(min(CASE WHEN text IS NULL OR item_id % 7 = 5 THEN item_id END) AS BIGINT) AS first_without_text FROM benchmark",
    "s13_query_set": "SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN item_id % 7 <> 5 THEN text END AS text, CASE WHEN item_id % 3 <> 0 THEN 'c' || (item_id % 3) END AS class, 'd' || item_id || ',d0' AS expected_ids FROM benchmark",
    "s15_alert_log": "SELECT event_id AS id, 'error' AS category, props FROM events WHERE event_type = 'error'",
    "s16_facts_with_vectors": "SELECT 'd' || doc_id AS id, vec_id IS NOT NULL AND vec_id % 5 <> 0 AS usable FROM documents LEFT JOIN embeddings ON vec_id = doc_id",
}


def _sql():
    from .curation import _STORE

    return SQL | {"s7_stored_texts": f"WITH {_STORE} SELECT path, file_id, size_bytes FROM ix"}


SQL = _sql()
QUERIES = {n: globals()[n] for n in SQL}
