"""Queries of storage, extraction, consolidation, curated models, health and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import content_hash, file_folder, file_name, has_substring, missing_strings, session_gate
from ..operators import consolidation as C
from ..operators import extraction as E
from ..operators import quality as Q
from ..operators import retrieval as R
from ..operators import storage as S
from ..operators import temporal as T
from ..sources import aliases, entities, episodes, event_facts, messages, sessions, statements, table, vocabulary
from .retrieval import _BM, _asked
from .views import EPISODES, FACTS, MESSAGES, STATE, STATEMENTS


def _state(spark, d):
    return T.with_state(event_facts(spark, d))


def _stored_docs(spark, d):
    e = table(spark, d, "documents")
    kind = F.element_at(F.array(*map(F.lit, ("text", "code", "pdf", "web", "voice", "json", "other"))), (F.col("doc_id") % 7 + 1).cast("int"))
    src = (
        F.when(F.col("doc_id") % 10 == 1, F.create_map(F.lit("type"), F.lit("arxiv"), F.lit("arxiv_id"), F.concat(F.lit("arxiv:24/"), F.col("doc_id"))))
        .when(F.col("doc_id") % 10 == 2, F.create_map(F.lit("url"), F.concat(F.lit("http://x.org/"), F.col("doc_id"), F.lit(".pdf"))))
        .when(F.col("doc_id") % 10 == 3, F.create_map(F.lit("type"), F.lit("code"), F.lit("filename"), F.concat(F.lit("f"), F.col("doc_id"), F.lit(".rs"))))
        .when(F.col("doc_id") % 10 == 4, F.create_map(F.lit("type"), F.lit("voice-note")))
    )
    return e.select(F.concat(F.lit("ep"), F.col("doc_id")).alias("episode_id"), F.coalesce("text", F.lit("")).alias("content"), kind.alias("content_type"), src.alias("source"), F.col("doc_id").alias("saved_at"))


def s3_new_episodes(spark, d):
    e = episodes(spark, d)
    again = e.unionByName(e.filter("id like '%7'"))
    return S.new_episodes(again, e.filter("id like '%3'")).select("id", "namespace")


def s4_usable_sessions(spark, d):
    return S.usable_sessions(sessions(spark, d), 40)


def s5_usable_messages(spark, d):
    return S.usable_messages(messages(spark, d)).groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


def s6_session_sample(spark, d):
    return S.session_sample(messages(spark, d))


def s7_document_store(spark, d):
    i = S.documents_index(_stored_docs(spark, d))
    return i.select("path", "file_id", "first_episode", "content_type", F.array_join("episode_ids", ",").alias("episode_ids"), "saved_at", F.col("size_bytes").cast("long").alias("size_bytes"))


def s8_list_documents(spark, d):
    return S.list_documents(S.documents_index(_stored_docs(spark, d)), "text", 10, 5).select("path", "saved_at")


def s10_text_by_episode(spark, d):
    docs = _stored_docs(spark, d)
    index = S.without_documents(S.documents_index(docs), S.documents_index(docs).filter("path like 'web/%'"))
    e = docs.select(F.col("episode_id").alias("id"), "content")
    asked = docs.select("episode_id").unionByName(spark.range(3).select(F.concat(F.lit("none"), F.col("id")).alias("episode_id")))
    return S.text_by_episode(asked, index, e).select("episode_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("md5"), "found_in")


def s9_episode_paths(spark, d):
    return S.path_of_episode(S.documents_index(_stored_docs(spark, d)))


def e15_session_episodes(spark, d):
    e = S.to_episodes(sessions(spark, d), messages(spark, d), 4)
    return e.select("id", "session_id", F.md5(F.col("content").cast("binary")).alias("md5"), "msg_range")


def s18_migration(spark, d):
    e = S.to_episodes(sessions(spark, d), messages(spark, d))
    return S.migration_plan(sessions(spark, d), messages(spark, d), e.filter("session_id % 2 = 0")).select("id", "status")


def s20_migration_summary(spark, d):
    """One fact for each message of an episode."""
    e = S.to_episodes(sessions(spark, d), messages(spark, d))
    span = F.split("msg_range", "-")
    facts = e.select(F.col("id").alias("episode_id"), F.explode(F.sequence(F.lit(1), (span[1].cast("int") - span[0].cast("int")))))
    return S.migration_summary(S.migration_plan(sessions(spark, d), messages(spark, d), e.filter("session_id % 2 = 0")), facts)


def s19_dry_run(spark, d):
    return S.usable_messages(messages(spark, d)).agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("messages"))


def _responses(spark, d):
    """One model answer for each event: plain, fenced, in prose, or broken."""
    f = event_facts(spark, d)
    fact = F.to_json(F.struct(F.col("subject_id").alias("subject"), F.when(F.col("seq") % 6 == 0, "likes").otherwise(F.col("predicate")).alias("predicate"), F.concat(F.lit(" "), F.upper("object_value"), F.lit("  x.")).alias("object"), "object_type", F.when(F.col("seq") % 4 == 0, "sure").otherwise(F.col("certainty")).alias("certainty"), "negation"))
    body = F.concat(F.lit('{"entities": [{"name": "'), F.col("subject_id"), F.lit('", "type": "thing"}], "facts": ['), fact, F.lit("]}"))
    text = F.when(F.col("seq") % 10 == 9, F.concat(F.lit("{broken "), body)).when(F.col("seq") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("seq") % 3 == 2, F.concat(F.lit("Here you are: "), body, F.lit(" Done."))).otherwise(body)
    return f.select("id", text.alias("response"))


def e3_parsed_responses(spark, d):
    return E.parse_responses(_responses(spark, d)).select("id", "parsed", F.size("result.facts").cast("long").alias("n_facts"))


def e4_valid_entities(spark, d):
    return E.valid_entities(E.parse_responses(_responses(spark, d)))


def e5_valid_facts(spark, d):
    return E.valid_facts(E.parse_responses(_responses(spark, d)), vocabulary(spark)).drop("valid_at", "assertion_source")


def e12_all_names(spark, d):
    p = E.parse_responses(_responses(spark, d))
    return E.all_names(E.valid_entities(p), E.valid_facts(p, vocabulary(spark)))


def e8_resolved_names(spark, d):
    """Upper-cased and unknown names; ids of new entities are hashes."""
    n = entities(spark, d).select(F.when(F.substring("id", -1, 1) == "7", F.concat(F.lit("Unknown "), F.col("id"))).otherwise(F.upper("name")).alias("name")).distinct()
    return E.resolve_names(n, aliases(spark, d)).select("name", "entity_id", "how")


def _known(spark, d):
    """Every customer is known under the name of the user of the same number."""
    return table(spark, d, "customer").select(F.concat(F.lit("u"), F.col("c_custkey")).alias("norm"), F.concat(F.lit("cust:"), F.col("c_custkey")).alias("entity_id"))


def _resolved(spark, d):
    p = E.parse_responses(_responses(spark, d))
    e, f = E.valid_entities(p), E.valid_facts(p, vocabulary(spark))
    return e, f, E.resolve_names(E.all_names(e, f), _known(spark, d))


def e9_new_entities(spark, d):
    e, _, r = _resolved(spark, d)
    return E.new_entities(r, e, _NOW).drop("created_at")


def e10_new_aliases(spark, d):
    _, _, r = _resolved(spark, d)
    return E.new_aliases(r, _known(spark, d))


def _logged(spark, d):
    _, f, r = _resolved(spark, d)
    return E.fact_log(f, r, event_facts(spark, d).select("id", "namespace", "recorded_at"), vocabulary(spark))


def e13_fact_log(spark, d):
    return _logged(spark, d)[0].select("id", "subject_id", "predicate", "object_id", "object_value", "statement", "functional", "negation", "certainty", "assertion_source", "epistemic_state", "valid_at_inferred", "namespace", "episode_id")


def e13_fact_evidence(spark, d):
    return _logged(spark, d)[1]


def e8_resolved_by_vector(spark, d):
    """Names that hold a vector's number, for numbers divisible by 100: most have that vector themselves, every third one another."""
    v = table(spark, d, "embeddings")
    known = v.select(F.concat(F.lit("e"), F.col("vec_id")).alias("id"), "embedding")
    own = v.filter("vec_id % 100 = 0").select(F.concat(F.lit("vector "), F.col("vec_id")).alias("qid"), F.when(F.col("vec_id") % 3 == 1, F.reverse("embedding")).otherwise(F.col("embedding")).alias("embedding"))
    names = own.select(F.initcap("qid").alias("name"))
    return E.resolve_names(names, aliases(spark, d), known, lambda asked: asked.hint("merge").join(own, "qid")).select("name", "entity_id", "how")


def w7_first_seen(spark, d):
    return E.first_seen(table(spark, d, "customer").select(F.upper("c_mktsegment").alias("name"), F.concat(F.lit("cust:"), F.col("c_custkey")).alias("entity_id"), F.col("c_custkey").alias("seq")))


def e6_retried(spark, d):
    """A model that fails for long prompts and answers with how much it was given."""

    def model(prompt):
        text = prompt.rpartition("Text:\n")[2]
        if len(text) > 1500:
            return "no idea"
        return '{"entities": [{"name": "n' + str(len(text)) + '"}], "facts": []}' if text else None

    x = E.extract(episodes(spark, d).select("id", "content"), ["uses"], model, 1200)
    return x.select("id", "parsed", F.col("attempt").cast("long").alias("attempt"), F.get("result.entities", F.lit(0))["name"].alias("name"))


def _letters(text: str) -> list[float]:
    """A deterministic model, of a wrong dimension for texts of even length."""
    v = [len(text), text.count("e"), text.count(" "), 1.0]
    return v if len(text) % 2 else v[:3]


def e14_embedded(spark, d):
    rows = E.embed_texts(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), _letters, 4)
    return rows.select("id", *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(("chars", "letters_e", "spaces"))))


def e7_dead_letters(spark, d):
    f = episodes(spark, d).select("id", "content", (F.length("content") % 4).alias("retries"))
    return E.dead_letters(f).select("id", "status", F.col("retries").cast("long").alias("retries"), F.length("content").cast("long").alias("chars"))


def c1_pending_groups(spark, d):
    return C.pending_groups(event_facts(spark, d))


def c2_group_facts(spark, d):
    return C.group_facts(_state(spark, d)).select("id", F.col("place").cast("long").alias("place"))


def _observed(spark, d):
    return C.observe(T.with_state(event_facts(spark, d).filter("seq % 3 <> 0")))


def c4_observations(spark, d):
    return C.observe(_state(spark, d)).withColumn("evidence_refs", F.array_join("evidence_refs", ","))


def c9_consolidated(spark, d):
    return C.consolidate(_state(spark, d), _observed(spark, d)).select(*C.GROUP, "action", "summary", "proof_count", F.array_join("evidence_refs", ",").alias("evidence_refs"))


def c4_support_edges(spark, d):
    return C.support_edges(C.observe(_state(spark, d)))


_NOW = "2026-03-01 00:00:00"


def _observations(spark, d):
    """What was observed of two thirds of the facts, an older observation and a replaced one of each group."""
    o = _observed(spark, d)
    row = lambda tag, summary, state, at: o.select(F.concat(F.lit(f"{tag}:"), F.concat_ws("|", *C.GROUP)).alias("id"), *C.GROUP, summary.alias("summary"), "proof_count", "evidence_refs", F.lit(state).alias("epistemic_state"), F.lit(at).cast("timestamp").alias("recorded_at"), F.lit(None).cast("timestamp").alias("invalid_at"))
    return row("now", F.col("summary"), "active", "2026-01-02").unionByName(row("old", F.lit("old"), "active", "2026-01-01")).unionByName(row("gone", F.lit("gone"), "superseded", "2026-01-03"))


def c3_latest_observations(spark, d):
    return C.latest_observations(_observations(spark, d)).select("id", "summary", "proof_count")


def _drained(spark, d):
    """All groups wait but those of the predicate `uses`; some keys lack a part."""
    s = _state(spark, d)
    groups = C.pending_groups(s).filter("predicate <> 'uses'")
    keys = C.queue(groups).unionByName(groups.select(F.concat_ws("|", "subject_id", "predicate").alias("group_key")).distinct())
    return C.drain(keys, s, _observations(spark, d), F.lit(_NOW).cast("timestamp"))


def c10_drained(spark, d):
    return _drained(spark, d).done


def c1_still_pending(spark, d):
    return _drained(spark, d).pending


def c6_observation_edges(spark, d):
    return _drained(spark, d).edges


def c7_observations_after(spark, d):
    o = _drained(spark, d).observations
    return o.select("id", "summary", "proof_count", F.array_join("evidence_refs", ",").alias("evidence_refs"), "epistemic_state", F.unix_seconds("recorded_at").alias("recorded"), F.unix_seconds("invalid_at").alias("invalid"))


def c8_model_summaries(spark, d):
    """A model that counts words, and fails for long prompts."""

    def model(prompt):
        if len(prompt) > 24:
            raise ValueError("too long")
        return f"{len(prompt.split(' '))} words"

    return C.summarised(C.observe(_state(spark, d)).select(*C.GROUP, "summary"), model)


def _model_requests(spark, d):
    """One model for each region, about its nations."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    names = n.groupBy("n_regionkey").agg(F.collect_list("n_name").alias("curated_for"))
    return r.join(names, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("title"), F.concat(F.lit("about "), F.lower("r_name")).alias("summary"), F.concat("curated_for", F.array(F.lit("nowhere"))).alias("curated_for"), F.when(F.col("r_regionkey") == 1, "personal").alias("namespace"))


def m1_created_models(spark, d):
    m, _ = C.create_models(_model_requests(spark, d), entities(spark, d), F.lit(_NOW).cast("timestamp"))
    return m.select("id", "title", "summary", "namespace", F.size("tags").cast("long").alias("n_tags"), "llm_drafted", "approved_by", "stale", F.unix_seconds("updated_at").alias("updated"))


def m1_curated_links(spark, d):
    return C.create_models(_model_requests(spark, d), entities(spark, d), F.lit(_NOW).cast("timestamp"))[1]


def _models(spark, d):
    n = table(spark, d, "nation")
    at = F.timestamp_micros(F.lit(0).cast("long"))
    return n.select(F.concat(F.lit("m"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("title"), F.array(F.concat(F.lit("tag"), F.col("n_nationkey") % 4)).alias("tags"), at.alias("created_at"))


def _curated(spark, d):
    return event_facts(spark, d).select("subject_id").distinct().select(F.concat(F.lit("m"), F.substring("subject_id", 2, 9).cast("long") % 25).alias("model_id"), F.col("subject_id").alias("entity_id"))


def m2_models(spark, d):
    return C.models_with_entities(_models(spark, d), _curated(spark, d)).select("id", "title", F.array_join("entities", ",").alias("entities"))


def m4_latest_models(spark, d):
    v = _models(spark, d).select("id", "title", F.lit(1).cast("long").alias("updated_at"), F.lit("first").alias("summary"))
    u = v.filter("id like '%2'").select("id", F.lit(None).cast("string").alias("title"), F.lit(2).cast("long").alias("updated_at"), F.lit("second").alias("summary"))
    return C.latest_models(v.unionByName(u))


def m5_stale_models(spark, d):
    f = event_facts(spark, d)
    t = f.agg(F.expr("timestamp_micros((unix_micros(min(recorded_at)) + 9 * unix_micros(max(recorded_at))) div 10)").alias("updated_at"))
    return C.stale_models(_models(spark, d).crossJoin(F.broadcast(t)), _curated(spark, d), f)  # t is one row


def m6_draft_models(spark, d):
    return C.draft_models(_state(spark, d))


def m3_model_search(spark, d):
    asked = table(spark, d, "region").select(F.col("r_regionkey").alias("qid"), F.concat(F.lit("tag"), F.col("r_regionkey") % 4).alias("text"))
    return R.model_search(asked, _models(spark, d).withColumn("summary", F.lit(None).cast("string")), 5).select("qid", "id", F.col("rank").cast("long").alias("rank"))


def q1_session_gate(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.when(F.col("role") == "user", 1)).alias("n"))
    return c.select("conv_id", session_gate("n", F.col("conv_id") % 10 == 3, F.col("conv_id") % 10 == 4).alias("reason"))


def q6_health(spark, d):
    s = _state(spark, d)
    return Q.health(s, C.pending_groups(s), "2030-01-01 00:00:00", ["owns", "uses", "has_role"])


def _expected(spark, d):
    q = _asked(spark, d).select("qid")
    ids = F.when(F.col("qid") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("d"), F.col("qid")), F.concat(F.lit("d"), F.col("qid") * 3 + 1)))
    return q.select("qid", F.concat(F.lit("class"), F.col("qid") % 3).alias("class"), ids.alias("expected_ids"))


def v1_retrieval_metrics(spark, d):
    return Q.retrieval_metrics(_expected(spark, d), R.keyword_search(_asked(spark, d), statements(spark, d), 200))


def v4_run_totals(spark, d):
    """Every query expects its first long word or a word that is nowhere, but for each fifth, which expects nothing."""
    q, s = _asked(spark, d), statements(spark, d)
    hits = R.keyword_search(q, s, 10)
    word = F.coalesce(F.get(F.filter(F.split("text", " "), lambda x: F.length(x) >= 10), F.lit(0)), F.lit("zzz-q"))
    e = q.select("qid", F.when(F.col("qid") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.when(F.col("qid") % 5 == 1, F.lit("zzz-q")).otherwise(F.upper(word)))).alias("substrings"))
    found = R.of_hits(hits, s.select("id", "statement")).select("qid", "id", "statement")
    return Q.run_totals(Q.retrieval_metrics(_expected(spark, d), hits), Q.substring_matches(e, found))


def v5_class_summary(spark, d):
    return Q.class_summary(Q.retrieval_metrics(_expected(spark, d), R.keyword_search(_asked(spark, d), statements(spark, d), 200)))


def v3_substrings(spark, d):
    s = statements(spark, d).withColumn("e", F.array(F.lit("THE "), F.lit("ion-the"), F.lit("zzz")))
    return s.select("id", has_substring("e", F.struct("statement")).alias("any_found"), F.size(missing_strings("e", "statement")).cast("long").alias("missing"))


def v7_compared_runs(spark, d):
    f = event_facts(spark, d).select(F.col("subject_id").alias("session_id"), "statement", "seq")
    return Q.compare_runs(f.filter("seq % 2 = 0"), f.filter("seq % 3 = 0"))


def f8_file_names(spark, d):
    s = _stored_docs(spark, d)
    return s.select("episode_id", content_hash("content").alias("hash"), file_folder("content_type", "source").alias("folder"), file_name("content", "content_type", "source").alias("name"))


_KIND = "['text', 'code', 'pdf', 'web', 'voice', 'json', 'other'][doc_id % 7 + 1]"
_STORE = f"""n AS (SELECT 'ep' || doc_id AS episode_id, coalesce(text, '') AS content, {_KIND} AS content_type, doc_id AS saved_at, substring(sha256(coalesce(text, '')), 1, 16) AS hash,
 CASE doc_id % 10 WHEN 1 THEN 'arxiv' WHEN 2 THEN 'web' WHEN 3 THEN 'code' WHEN 4 THEN 'transcripts' ELSE CASE {_KIND} WHEN 'code' THEN 'code' WHEN 'pdf' THEN 'documents' WHEN 'web' THEN 'web' WHEN 'voice' THEN 'transcripts' WHEN 'json' THEN 'json' ELSE 'text' END END AS folder,
 CASE {_KIND} WHEN 'code' THEN '.py' WHEN 'pdf' THEN '.pdf' WHEN 'web' THEN '.html' WHEN 'json' THEN '.json' ELSE '.txt' END AS ext, doc_id FROM documents),
 st AS (SELECT *, CASE doc_id % 10 WHEN 1 THEN '24_' || doc_id || '.txt' WHEN 2 THEN hash || '.pdf' WHEN 3 THEN 'f' || doc_id || '.rs' ELSE hash || ext END AS name FROM n),
 ix AS (SELECT folder || '/' || name AS path, arg_min(hash, saved_at) AS file_id, arg_min(episode_id, saved_at) AS first_episode, arg_min(content_type, saved_at) AS content_type, array_to_string(list_sort(list(DISTINCT episode_id)), ',') AS episode_ids, min(saved_at) AS saved_at, CAST(arg_min(octet_length(encode(content)), saved_at) AS BIGINT) AS size_bytes FROM st GROUP BY 1)"""
_USABLE = f"{MESSAGES}, um AS (SELECT * FROM msgs WHERE role IN ('user', 'assistant') AND coalesce(content, '') <> '' AND tool_name = '')"
_EPIS = """, us AS (SELECT * FROM sess WHERE archived = 0 AND message_count > 0), nm AS (SELECT um.*, row_number() OVER (PARTITION BY session_id ORDER BY "timestamp", role, content) - 1 AS i FROM um JOIN us ON us.id = session_id),
 ep AS (SELECT session_id, i // {n} AS b, min("timestamp") AS first_at, string_agg(upper(role[1]) || role[2:] || ': ' || CASE WHEN length(content) > 2000 THEN substring(content, 1, 2000) || ' [...] (truncated)' ELSE content END, chr(10) ORDER BY i) AS content, count(*) AS c FROM nm GROUP BY 1, 2),
 eh AS (SELECT *, sha1('session:' || session_id || ':' || first_at) AS h FROM ep)"""
_RESP = f"{FACTS}, rf AS (SELECT id, seq, subject_id AS subject, CASE WHEN seq % 6 = 0 THEN 'likes' ELSE predicate END AS predicate, CASE WHEN object_type = 'literal' THEN lower(object_value) || ' x' ELSE upper(object_value) || '  x.' END AS object, object_type, CASE WHEN seq % 4 = 0 THEN 'stated' ELSE certainty END AS certainty, negation FROM facts WHERE seq % 10 <> 9)"
_NAMES = f"""{_RESP}, an AS (SELECT subject AS name FROM rf UNION SELECT object FROM rf WHERE predicate <> 'likes' AND object_type = 'entity'),
 nm AS (SELECT name, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS norm FROM an),
 nr AS (SELECT name, norm, CASE WHEN c_custkey IS NULL THEN 'new' ELSE 'alias' END AS how, CASE WHEN c_custkey IS NULL THEN 'new:' || substring(sha256(min(name) OVER (PARTITION BY norm)), 1, 16) ELSE 'cust:' || c_custkey END AS entity_id FROM nm LEFT JOIN customer ON norm = 'u' || c_custkey)"""
_LOG = f"""{_NAMES}, l0 AS (SELECT rf.*, s.entity_id AS subject_id, CASE WHEN object_type = 'entity' THEN o.entity_id END AS object_id FROM rf JOIN nr s ON s.name = rf.subject LEFT JOIN nr o ON o.name = rf.object WHERE predicate <> 'likes'),
 lg AS (SELECT 'fact:' || substring(sha256(l0.id || '|' || l0.subject_id || '|' || l0.predicate || '|' || l0.object || '|' || l0.negation), 1, 16) AS id, l0.subject_id, l0.predicate, object_id, CASE WHEN object_id IS NULL THEN object END AS object_value, subject || ' ' || l0.predicate || ' ' || object AS statement,
  l0.predicate IN ('has_role', 'version_is') AS functional, l0.negation, l0.certainty, 'model' AS assertion_source, 'active' AS epistemic_state, true AS valid_at_inferred, f.namespace, l0.id AS episode_id FROM l0 JOIN facts f ON f.id = l0.id)"""
_GF = """gf AS (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate, namespace ORDER BY recorded_at DESC, seq DESC) AS place FROM state WHERE epistemic_state = 'active' AND assertion_source <> 'model'),
 ev AS (SELECT subject_id, predicate, namespace, list(id ORDER BY place) AS ids, list(object_value ORDER BY place) AS vals, count(DISTINCT object_value) AS n_objects FROM gf WHERE place <= 20 GROUP BY 1, 2, 3)"""
_SUM = "subject_id || ' ' || predicate || ': ' || array_to_string(list_slice(vals, 1, 5), '; ')"
#: The state of two thirds of the facts, and observations made of it.
_OLD = STATE.replace("FROM facts_k)", "FROM facts_k WHERE event_id % 3 <> 0)")
_OBS = f"{_OLD}, {_GF}"
_OBS_IN = "ob AS (WITH " + _OBS + f" SELECT subject_id, predicate, namespace, {_SUM} AS summary, CAST(len(ids) AS BIGINT) AS proof_count, list_sort(ids) AS refs FROM ev)"
_PLAN = f"""{STATE}, {_GF}, {_OBS_IN}, j AS (SELECT ev.*, o.refs, o.proof_count AS pc, list_filter(ids, lambda x: NOT list_contains(coalesce(refs, []), x)) AS fresh FROM ev LEFT JOIN ob o ON o.subject_id = ev.subject_id AND o.predicate = ev.predicate AND o.namespace = ev.namespace),
 a AS (SELECT *, CASE WHEN refs IS NULL THEN 'create' WHEN len(fresh) = 0 THEN 'skip' WHEN n_objects > 1 AND predicate IN ('has_role', 'version_is') THEN 'supersede' ELSE 'update' END AS action FROM j),
 pl AS (SELECT subject_id, predicate, namespace, action, ids, fresh, {_SUM} AS summary, CAST(CASE WHEN action IN ('create', 'supersede') THEN len(ids) ELSE pc + len(fresh) END AS BIGINT) AS proof_count, array_to_string(list_sort(CASE WHEN action IN ('create', 'supersede') THEN ids ELSE list_concat(refs, fresh) END), ',') AS evidence_refs FROM a)"""
_KEY = "subject_id || '|' || predicate || '|' || namespace"
_DRAIN = f"{_PLAN}, dr AS (SELECT *, {_KEY} AS k, CASE WHEN action = 'update' THEN 'now:' || {_KEY} ELSE 'obs:' || substring(sha256({_KEY} || '|2026-03-01 00:00:00'), 1, 16) END AS id FROM pl WHERE action <> 'skip' AND predicate <> 'uses')"
_MODEL_NS = "CASE WHEN r_regionkey = 1 THEN 'personal' ELSE 'shared' END"
_MODEL_ID = f"'model:' || substring(sha256({_MODEL_NS} || '|' || r_name || '|2026-03-01 00:00:00'), 1, 16)"
_CUR = "cur AS (SELECT DISTINCT 'm' || (CAST(substring(subject_id, 2) AS BIGINT) % 25) AS model_id, subject_id AS entity_id FROM facts)"
_EXP = "ex AS (SELECT qid, 'class' || (qid % 3) AS class, CASE WHEN qid % 5 = 0 THEN CAST([] AS VARCHAR[]) ELSE list_distinct(['d' || qid, 'd' || (qid * 3 + 1)]) END AS e FROM asked)"
_MET = f"WITH {_BM}, {_EXP}, h AS (SELECT qid, count(*) FILTER (rank <= 5) AS n, min(rank) AS best FROM (SELECT qid, unnest(e) AS id FROM ex) JOIN bm USING (qid, id) WHERE rank <= 200 GROUP BY 1), met AS (SELECT qid, class, round(CASE WHEN len(e) = 0 THEN 1.0::DOUBLE ELSE coalesce(n, 0) / len(e) END, 6) AS recall, round(CASE WHEN len(e) = 0 THEN 1.0::DOUBLE ELSE coalesce(1.0::DOUBLE / best, 0) END, 6) AS reciprocal_rank FROM ex LEFT JOIN h USING (qid))"
SQL = {
    "s3_new_episodes": f"WITH {EPISODES} SELECT id, namespace FROM eps WHERE id NOT LIKE '%3'",
    "s4_usable_sessions": f"WITH {MESSAGES} SELECT * FROM sess WHERE archived = 0 ORDER BY started_at, id LIMIT 40",
    "s5_usable_messages": f"WITH {_USABLE} SELECT session_id, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM um GROUP BY 1",
    "s6_session_sample": f"WITH {MESSAGES} SELECT session_id, count(*) AS n FROM msgs GROUP BY 1 HAVING count(*) BETWEEN 5 AND 30",
    "s7_document_store": f"WITH {_STORE} SELECT * FROM ix",
    "s8_list_documents": f"WITH {_STORE} SELECT path, saved_at FROM ix WHERE content_type = 'text' ORDER BY saved_at DESC, path LIMIT 10 OFFSET 5",
    "s10_text_by_episode": f"""WITH {_STORE} SELECT episode_id, md5(coalesce(f.content, st.content)) AS md5, CASE WHEN f.content IS NOT NULL THEN 'index' ELSE 'episode' END AS found_in FROM st LEFT JOIN (SELECT path, s2.content FROM ix JOIN (SELECT episode_id AS e2, content FROM st) s2 ON s2.e2 = first_episode WHERE path NOT LIKE 'web/%') f ON f.path = folder || '/' || name
 UNION ALL SELECT 'none' || i, md5(''), 'none' FROM range(3) t(i)""",
    "e15_session_episodes": f"WITH {_USABLE}{_EPIS.format(n=4)} SELECT h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS id, session_id, md5(content) AS md5, (b * 4) || '-' || (b * 4 + c) AS msg_range FROM eh",
    "s18_migration": f"WITH {_USABLE}{_EPIS.format(n=20)} SELECT h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS id, CASE WHEN session_id % 2 = 0 THEN 'skipped' ELSE 'created' END AS status FROM eh",
    "s20_migration_summary": f"WITH {_USABLE}{_EPIS.format(n=20)} SELECT CASE WHEN session_id % 2 = 0 THEN 'skipped' ELSE 'created' END AS status, count(*) AS episodes, CAST(sum(c) AS BIGINT) AS facts, round(sum(c) / count(*), 6) AS facts_per_episode FROM eh GROUP BY 1",
    "s19_dry_run": f"WITH {_USABLE} SELECT count(DISTINCT session_id) AS sessions, count(*) AS messages FROM um",
    "e3_parsed_responses": f"WITH {FACTS} SELECT id, seq % 10 <> 9 AS parsed, CAST(CASE WHEN seq % 10 <> 9 THEN 1 END AS BIGINT) AS n_facts FROM facts",
    "e4_valid_entities": f"WITH {_RESP} SELECT id, subject AS name, 'entity' AS type, '' AS summary FROM rf",
    "e5_valid_facts": f"WITH {_RESP} SELECT id, subject, predicate, object, object_type, certainty, negation FROM rf WHERE predicate <> 'likes'",
    "e12_all_names": f"WITH {_RESP} SELECT subject AS name FROM rf UNION SELECT object FROM rf WHERE predicate <> 'likes' AND object_type = 'entity'",
    "e8_resolved_names": """WITH e AS (SELECT 'cust:' || c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supp:' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'part:' || p_partkey, p_name FROM part UNION ALL SELECT 'nat:' || n_nationkey, n_name FROM nation UNION ALL SELECT 'reg:' || r_regionkey, r_name FROM region),
 nrm AS (SELECT *, trim(regexp_replace(regexp_replace(replace(replace(replace(lower(name), '-', ' '), '_', ' '), '/', ' '), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS norm FROM e),
 al AS (SELECT norm, min(id) AS entity_id FROM nrm GROUP BY 1), n AS (SELECT DISTINCT CASE WHEN id LIKE '%7' THEN 'Unknown ' || id ELSE upper(name) END AS name, CASE WHEN id LIKE '%7' THEN NULL ELSE norm END AS norm FROM nrm)
 SELECT name, CASE WHEN n.norm IS NULL THEN 'new:' || substring(sha256(name), 1, 16) ELSE al.entity_id END AS entity_id, CASE WHEN n.norm IS NULL THEN 'new' ELSE 'alias' END AS how FROM n LEFT JOIN al ON al.norm = n.norm""",
    "e9_new_entities": f"WITH {_NAMES} SELECT entity_id AS id, min(name) AS name, 'entity' AS type, '' AS summary FROM nr WHERE how = 'new' GROUP BY 1",
    "e10_new_aliases": f"WITH {_NAMES} SELECT DISTINCT norm, entity_id FROM nr WHERE how = 'new'",
    "e13_fact_log": f"WITH {_LOG} SELECT * FROM lg",
    "e13_fact_evidence": f"WITH {_LOG} SELECT 'ev:' || substring(id, 6, 16) AS id, id AS fact_id, episode_id FROM lg",
    "e8_resolved_by_vector": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id AS n, CASE WHEN vec_id % 3 = 1 THEN list_reverse(v) ELSE v END AS v FROM e WHERE vec_id % 100 = 0),
 s AS (SELECT n, 'e' || vec_id AS id, round(list_cosine_similarity(n.v, e.v), 6) AS score FROM n, e), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, id) = 1)
 SELECT 'Vector ' || n AS name, CASE WHEN score >= 0.95 THEN id ELSE 'new:' || substring(sha256('Vector ' || n), 1, 16) END AS entity_id, CASE WHEN score >= 0.95 THEN 'merged' WHEN score >= 0.8 THEN 'ambiguous' ELSE 'new' END AS how FROM b""",
    "w7_first_seen": "SELECT lower(c_mktsegment) AS norm, 'cust:' || min(c_custkey) AS entity_id FROM customer GROUP BY 1",
    "e6_retried": f"""WITH {EPISODES}, x AS (SELECT id, length(content) AS n FROM eps) SELECT id, n > 0 AS parsed, CAST(CASE WHEN n BETWEEN 1 AND 1500 THEN 1 ELSE 2 END AS BIGINT) AS attempt, CASE WHEN n > 0 THEN 'n' || CASE WHEN n > 1500 THEN 1200 ELSE n END END AS name FROM x""",
    "e7_dead_letters": f"WITH {EPISODES} SELECT id, CASE WHEN length(content) % 4 + 1 >= 3 THEN 'dead' ELSE 'retry' END AS status, CAST(length(content) % 4 + 1 AS BIGINT) AS retries, CAST(least(length(content), 500) AS BIGINT) AS chars FROM eps",
    "c1_pending_groups": f"WITH {FACTS} SELECT DISTINCT subject_id, predicate, namespace FROM facts WHERE assertion_source <> 'model'",
    "c2_group_facts": f"WITH {STATE}, {_GF} SELECT id, place FROM gf WHERE place <= 20",
    "c4_observations": f"WITH {STATE}, {_GF} SELECT subject_id, predicate, namespace, {_SUM} AS summary, CAST(len(ids) AS BIGINT) AS proof_count, array_to_string(list_sort(ids), ',') AS evidence_refs FROM ev",
    "c4_support_edges": f"WITH {STATE}, {_GF} SELECT subject_id, predicate, namespace, unnest(ids) AS fact_id FROM ev",
    "c3_latest_observations": f"WITH {_OBS_IN} SELECT 'now:' || subject_id || '|' || predicate || '|' || namespace AS id, summary, proof_count FROM ob",
    "c10_drained": f"WITH {_DRAIN} SELECT k AS group_key, id, action FROM dr",
    "c1_still_pending": f"WITH {_DRAIN} SELECT DISTINCT {_KEY} AS group_key FROM facts WHERE assertion_source <> 'model' AND predicate <> 'uses' AND {_KEY} NOT IN (SELECT k FROM dr)",
    "c6_observation_edges": f"""WITH {_DRAIN} SELECT 'SUPPORTS' AS kind, id AS from_id, unnest(CASE WHEN action = 'update' THEN fresh ELSE ids END) AS to_id FROM dr
 UNION ALL SELECT 'CONTRADICTS', unnest(fresh), 'now:' || k FROM dr WHERE action = 'supersede' UNION ALL SELECT 'SUPERSEDES', id, 'now:' || k FROM dr WHERE action = 'supersede'""",
    "c7_observations_after": f"""WITH {_DRAIN}, o AS (SELECT *, {_KEY} AS k, array_to_string(refs, ',') AS r FROM ob), oj AS (SELECT o.*, dr.action, dr.summary AS s2, dr.proof_count AS p2, dr.evidence_refs AS r2 FROM o LEFT JOIN dr USING (k))
 SELECT 'now:' || k AS id, CASE WHEN action = 'update' THEN s2 ELSE summary END AS summary, CASE WHEN action = 'update' THEN p2 ELSE proof_count END AS proof_count, CASE WHEN action = 'update' THEN r2 ELSE r END AS evidence_refs,
  CASE WHEN action = 'supersede' THEN 'superseded' ELSE 'active' END AS epistemic_state, CAST(epoch(TIMESTAMP '2026-01-02') AS BIGINT) AS recorded, CASE WHEN action = 'supersede' THEN CAST(epoch(TIMESTAMP '2026-03-01') AS BIGINT) END AS invalid FROM oj
 UNION ALL SELECT 'old:' || k, 'old', proof_count, r, 'active', CAST(epoch(TIMESTAMP '2026-01-01') AS BIGINT), NULL FROM o UNION ALL SELECT 'gone:' || k, 'gone', proof_count, r, 'superseded', CAST(epoch(TIMESTAMP '2026-01-03') AS BIGINT), NULL FROM o
 UNION ALL SELECT id, summary, proof_count, evidence_refs, 'active', CAST(epoch(TIMESTAMP '2026-03-01') AS BIGINT), NULL FROM dr WHERE action <> 'update'""",
    "c8_model_summaries": f"WITH {STATE}, {_GF}, x AS (SELECT subject_id, predicate, namespace, {_SUM} AS s FROM ev) SELECT subject_id, predicate, namespace, CASE WHEN length(s) > 24 THEN s ELSE len(string_split(s, ' ')) || ' words' END AS summary FROM x",
    "m1_created_models": f"SELECT {_MODEL_ID} AS id, r_name AS title, 'about ' || lower(r_name) AS summary, {_MODEL_NS} AS namespace, CAST(0 AS BIGINT) AS n_tags, false AS llm_drafted, CAST(NULL AS VARCHAR) AS approved_by, false AS stale, CAST(epoch(TIMESTAMP '2026-03-01') AS BIGINT) AS updated FROM region",
    "m1_curated_links": f"SELECT {_MODEL_ID} AS model_id, 'nat:' || n_nationkey AS entity_id FROM region JOIN nation ON n_regionkey = r_regionkey",
    "c9_consolidated": f"WITH {_PLAN} SELECT subject_id, predicate, namespace, action, summary, proof_count, evidence_refs FROM pl",
    "m2_models": f"WITH {FACTS}, {_CUR} SELECT 'm' || n_nationkey AS id, n_name AS title, array_to_string(e, ',') AS entities FROM nation LEFT JOIN (SELECT model_id, list_sort(list(entity_id)) AS e FROM cur GROUP BY 1) c ON c.model_id = 'm' || n_nationkey",
    "m4_latest_models": "SELECT 'm' || n_nationkey AS id, CAST(CASE WHEN n_nationkey % 10 = 2 THEN 2 ELSE 1 END AS BIGINT) AS updated_at, n_name AS title, CASE WHEN n_nationkey % 10 = 2 THEN 'second' ELSE 'first' END AS summary FROM nation",
    "m5_stale_models": f"""WITH {FACTS}, {_CUR}, t AS (SELECT make_timestamp((epoch_us(min(recorded_at)) + 9 * epoch_us(max(recorded_at))) // 10) AS t FROM facts), l AS (SELECT subject_id, max(recorded_at) AS newest FROM facts GROUP BY 1)
 SELECT model_id, count(*) AS n_newer_entities FROM cur JOIN l ON l.subject_id = entity_id, t WHERE newest > t GROUP BY 1""",
    "m6_draft_models": f"WITH {STATE}, r AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY recorded_at DESC, seq DESC) AS p FROM state WHERE epistemic_state = 'active') SELECT subject_id, string_agg(statement, '. ' ORDER BY p) AS summary, count(*) AS n_statements FROM r GROUP BY 1",
    "m3_model_search": "WITH m AS (SELECT 'm' || n_nationkey AS id, n_nationkey % 4 AS tag, len(list_filter(regexp_split_to_array(lower(n_name), '[^a-z0-9]+'), lambda x: x <> '')) AS l FROM nation), s AS (SELECT CAST(r_regionkey AS INTEGER) AS qid, id, l FROM region JOIN m ON tag = r_regionkey % 4) SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY l, id) AS rank FROM s QUALIFY rank <= 5",
    "q1_session_gate": "SELECT conv_id, CASE WHEN n < 2 THEN 'session has only ' || n || ' user turns (minimum 2)' WHEN conv_id % 10 = 3 THEN 'session ended in error state' WHEN conv_id % 10 = 4 THEN 'session was reverted' ELSE 'passed' END AS reason FROM (SELECT conv_id, count(*) FILTER (role = 'user') AS n FROM conversations GROUP BY 1)",
    "q6_health": f"""WITH {STATE}, c AS (SELECT 'queue_depth' AS check_name, CAST((SELECT count(*) FROM (SELECT DISTINCT subject_id, predicate, namespace FROM facts WHERE assertion_source <> 'model')) AS DOUBLE) AS value, 1000.0 AS lim
 UNION ALL SELECT 'ingestion_lag', CAST(floor(epoch(TIMESTAMP '2030-01-01')) - floor(epoch(max(recorded_at))) AS DOUBLE), 300 FROM facts UNION ALL SELECT 'other_predicates', round(avg(CASE WHEN predicate IN ('owns', 'uses', 'has_role') THEN 0.0 ELSE 1.0 END), 6), 0.15 FROM facts
 UNION ALL SELECT 'contradictions', CAST(count(*) FILTER (epistemic_state = 'contradicted') AS DOUBLE), 1e300 FROM state), s AS (SELECT check_name, value, CASE WHEN value > lim THEN 'warning' ELSE 'ok' END AS status FROM c)
 SELECT * FROM s UNION ALL SELECT 'overall', CAST(max(CASE status WHEN 'ok' THEN 1 ELSE 2 END) AS DOUBLE), max(status) FROM s""",
    "v1_retrieval_metrics": f"{_MET} SELECT * FROM met",
    "v4_run_totals": f"""{_MET.replace("rank <= 200", "rank <= 10")}, ww AS (SELECT qid, coalesce(list_filter(string_split(text, ' '), lambda x: length(x) >= 10)[1], 'zzz-q') AS word FROM q),
 su AS (SELECT qid, bool_or(contains(lower(statement), word)) AS hit FROM bm JOIN stmts USING (id) JOIN ww USING (qid) WHERE rank <= 10 GROUP BY 1), mm AS (SELECT met.*, CASE WHEN qid % 5 = 0 THEN 1.0::DOUBLE WHEN qid % 5 = 1 OR NOT coalesce(hit, false) THEN 0 ELSE 1 END AS m FROM met LEFT JOIN su USING (qid))
 SELECT count(*) AS queries, round(avg(recall), 4) AS recall, round(avg(reciprocal_rank), 4) AS mrr, round(avg(m), 4) AS substring_accuracy, CASE WHEN round(avg(recall), 4) >= 0.3 THEN 'pass' ELSE 'fail' END AS verdict FROM mm""",
    "e14_embedded": "SELECT doc_id AS id, CASE WHEN ok THEN CAST(length(text) AS DOUBLE) END AS chars, CASE WHEN ok THEN CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) END AS letters_e, CASE WHEN ok THEN CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) END AS spaces FROM (SELECT *, coalesce(length(text) % 2 = 1 AND regexp_matches(text, '[^ \\t-\\r]'), false) AS ok FROM documents)",
    "s9_episode_paths": f"WITH {_STORE} SELECT DISTINCT episode_id, folder || '/' || name AS path FROM st",
    "v5_class_summary": f"{_MET} SELECT class, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS mrr, count(*) FILTER (recall >= 0.3) AS passed FROM met GROUP BY 1",
    "v3_substrings": f"""WITH {STATEMENTS}, s AS (SELECT id, statement, lower(statement) AS l, trim(regexp_replace(lower(statement), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS n FROM stmts)
 SELECT id, contains(l, 'the ') OR contains(l, 'ion-the') OR contains(l, 'zzz') AS any_found, CAST((NOT (contains(l, 'the ') OR contains(n, 'the')))::INT + (NOT (contains(l, 'ion-the') OR contains(n, 'ion the')))::INT + (NOT contains(n, 'zzz'))::INT AS BIGINT) AS missing FROM s""",
    "v7_compared_runs": f"""WITH {FACTS}, a AS (SELECT subject_id AS session_id, count(*) FILTER (seq % 2 = 0) AS n_a, count(*) FILTER (seq % 3 = 0) AS n_b FROM facts WHERE seq % 2 = 0 OR seq % 3 = 0 GROUP BY 1),
 s AS (SELECT session_id, array_to_string(list_slice(list_sort(list(DISTINCT statement)), 1, 3), '|') AS samples FROM (SELECT subject_id AS session_id, statement FROM facts WHERE seq % 2 = 0 OR seq % 3 = 0) GROUP BY 1)
 SELECT *, CASE WHEN n_a > 0 THEN round(n_b / n_a, 6) END AS ratio FROM a JOIN s USING (session_id)""",
    "f8_file_names": f"WITH {_STORE} SELECT episode_id, hash, folder, name FROM st",
}
QUERIES = {n: globals()[n] for n in SQL}
