"""Tests of operators beyond what SQL on the given tables covers."""

import random

import pytest
from pyspark.sql import functions as F

from tempograph import functions as X
from tempograph import streaming
from tempograph.operators import consolidation, extraction, facts, graph, quality, retrieval, storage, temporal
from tempograph.sources import vocabulary

FACT = "id string, seq long, subject_id string, predicate string, namespace string, object_value string, functional boolean, negation boolean, recorded_at timestamp, valid_at timestamp"


def fold(rows):
    """The write rule, one fact at a time: edges and final states."""
    active, edges, state = {}, [], {}
    for r in sorted(rows, key=lambda r: (r["recorded_at"], r["seq"])):
        key = (r["subject_id"], r["predicate"], r["namespace"])
        before = len(edges)
        active[key] = streaming.fold_step(active.get(key, []), (r["id"], r["object_value"], r["negation"]), r["functional"], edges)
        state[r["id"]] = "active"
        for kind, a, b in edges[before:]:
            state[b] = "superseded" if kind == "SUPERSEDES" else "contradicted"
            if kind == "CONTRADICTS":
                state[a] = "contradicted"
    return edges, state


@pytest.mark.parametrize("seed", range(3))
def test_state_equals_fold(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(600):
        t = f"2026-01-01 00:{r.randrange(60):02d}:00"
        functional = r.random() < 0.5
        rows.append(dict(id=f"f{i}", seq=i, subject_id=f"s{r.randrange(6)}", predicate="has_role" if functional else "owns", namespace="a", object_value=f"o{r.randrange(3)}", functional=functional, negation=r.random() < 0.3, recorded_at=t, valid_at=t))
    df = spark.createDataFrame(rows, FACT.replace("timestamp", "string")).withColumns({c: F.col(c).cast("timestamp") for c in ("recorded_at", "valid_at")})
    edges, state = fold(rows)
    got = temporal.with_state(df).cache()
    assert {x.id: x.epistemic_state for x in got.collect()} == state
    assert sorted(map(tuple, temporal.state_edges(got).collect())) == sorted(edges)


def test_supersession_as_told(spark):
    rows = [("f1", 1, "dave", "works_at", "s", "acme", True, False, "2026-01-01", "2026-01-01"), ("f2", 2, "dave", "works_at", "s", "globex", True, False, "2026-06-01", "2026-06-01")]
    df = spark.createDataFrame(rows, FACT.replace("timestamp", "string")).withColumns({c: F.col(c).cast("timestamp") for c in ("recorded_at", "valid_at")})
    s = temporal.with_state(df)
    assert [(r.id, r.epistemic_state, str(r.invalid_at)[:10]) for r in s.orderBy("id").collect()] == [("f1", "superseded", "2026-06-01"), ("f2", "active", "None")]
    assert [r.id for r in temporal.true_at(s, "2026-03-01").collect()] == ["f1"]
    assert [r.id for r in temporal.true_at(s, "2026-07-01").collect()] == ["f2"]
    assert temporal.known_at(df, "2026-02-01").count() == 1


def test_names_and_literals(spark):
    pairs = [("Al-ice", "al ice"), ("Al_ice", "al ice"), ("Al/ice", "al ice"), ("Alice!", "alice"), ("", ""), ("Zoë", "zo"), (None, "")]
    df = spark.createDataFrame([(a,) for a, _ in pairs], "x string")
    assert [r[0] for r in df.select(X.normalize_name("x")).collect()] == [b for _, b in pairs]
    assert spark.range(1).select(X.normalize_literal(F.lit("  The  END.!? "))).first()[0] == "the end"


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    assert [r[0] for r in df.select(X.cosine("a", "b")).collect()] == [1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0]


def test_time_phrases(spark):
    now = F.lit("2026-08-15 10:30:00").cast("timestamp")
    cases = {
        "last spring": ("2025-03-01 00:00:00", "2025-06-01 00:00:00"), "In June": ("2026-06-01 00:00:00", "2026-06-30 23:59:59"), "in december": ("2025-12-01 00:00:00", "2025-12-31 23:59:59"),
        "on 2026-01-15": ("2026-01-15 00:00:00", "2026-01-15 23:59:59"), "2026-03": ("2026-03-01 00:00:00", "2026-03-31 23:59:59"), "last week": ("2026-08-08 00:00:00", "2026-08-15 10:30:00"),
        "last month": ("2026-07-01 00:00:00", "2026-08-01 00:00:00"), "nothing": None, "2026-77": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = [(str(r[0]["start"]), str(r[0]["end"])) if r[0] else None for r in df.select(X.time_range("t", now)).collect()]
    assert got == list(cases.values())


def test_fusion_ties_go_to_the_first_list(spark):
    one = lambda ids: spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(ids)], "qid long, id string, rank int")
    got = retrieval.ranked(retrieval.fuse([one(["f1", "f2", "f3"]), one(["f3", "f4", "f1"])]), None, [F.desc("score"), F.col("first_seen")]).orderBy("rank").collect()
    assert [r.id for r in got] == ["f1", "f3", "f2", "f4"]
    assert got[0].score == got[1].score
    twice = one(["a", "a", "b"])
    assert {r.id: r.score for r in retrieval.fuse([twice]).collect()}["a"] == pytest.approx(1 / 61, abs=1e-9)


def test_rerank_by_state(spark):
    fused = spark.createDataFrame([(1, "a", 0.5, (0, 1)), (1, "b", 0.3, (0, 2)), (1, "c", 0.9, (0, 3))], "qid long, id string, score double, first_seen struct<list_no:int,rank:int>")
    state = spark.createDataFrame([("a", "contradicted"), ("b", "active"), ("c", "superseded")], "id string, epistemic_state string")
    assert [r.id for r in retrieval.by_state(fused, state).orderBy("rank").collect()] == ["b", "a"]


def test_vector_search_in_blocks(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(500, None), (501, [1.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(4)
    q = v.filter("id < 30").select(F.col("id").alias("qid"), "embedding")
    whole = sorted(map(tuple, retrieval.vector_search(q, v, 5).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_VECTORS", 8)
    assert sorted(map(tuple, retrieval.vector_search(q, v, 5).collect())) == whole
    assert len(whole) == 150 and all(a[1] == a[0] for a in whole if a[3] == 1)


def test_responses(spark):
    good = '{"entities": [{"name": "A"}], "facts": [{"subject": "A", "predicate": "owns", "object": "B"}]}'
    texts = [good, f"```json\n{good}\n```", f"Sure: {good} Bye", "{}", "no json", "{broken", None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, response string")
    p = extraction.parse_responses(df)
    assert [r.parsed for r in p.orderBy("id").collect()] == [True, True, True, True, False, False, False]
    assert extraction.valid_facts(p, vocabulary(spark)).count() == 3


def test_model_calls_fail_softly(spark):
    rows = spark.createDataFrame([("1", "ok"), ("2", "boom"), ("3", "")], "id string, content string")

    def model(prompt):
        if prompt.endswith("boom"):
            raise RuntimeError("no")
        return prompt[-2:]

    got = {r.id: r.response for r in extraction.call_model(extraction.prompts(rows, ["owns"]), model).collect()}
    assert got["1"] == "ok" and got["2"] is None


def test_resolution_by_vectors(spark):
    names = spark.createDataFrame([("Bob",), ("BOB",), ("Robert",), ("Zed",)], "name string")
    aliases = spark.createDataFrame([("bob", "e1")], "norm string, entity_id string")
    vectors = spark.createDataFrame([("e1", [1.0, 0.0]), ("e2", [0.0, 1.0])], "id string, embedding array<float>")
    embed = lambda df: df.withColumn("embedding", F.when(F.col("qid") == "robert", F.array(F.lit(0.999), F.lit(0.01))).otherwise(F.array(F.lit(0.6), F.lit(0.8))))
    got = {r.name: (r.entity_id, r.how) for r in extraction.resolve_names(names, aliases, vectors, embed).collect()}
    assert got["Bob"] == got["BOB"] == ("e1", "alias") and got["Robert"] == ("e1", "merged") and got["Zed"][1] == "ambiguous"


def test_embedding_of_texts(spark):
    df = spark.createDataFrame([(1, "a b"), (2, " "), (3, "long")], "id long, text string")
    got = {r.id: r.embedding for r in extraction.embed_texts(df, lambda t: [1.0, 2.0] if t != "long" else [1.0], 2).collect()}
    assert got == {1: [1.0, 2.0], 2: None, 3: None}


def test_merges_end_at_the_root(spark):
    m = spark.createDataFrame([(f"e{i}", f"e{i - 1}") for i in range(1, 40)], "source_id string, target_id string")
    assert {r.root for r in graph.merged_root(m).collect()} == {"e0"}


def test_recall_without_expectation_is_one(spark):
    e = spark.createDataFrame([(1, "c", ["a", "b"]), (2, "c", []), (3, "c", ["z"])], "qid long, class string, expected_ids array<string>")
    f = spark.createDataFrame([(1, "x", 1), (1, "b", 2)], "qid long, id string, rank int")
    got = {r.qid: (r.recall, r.reciprocal_rank) for r in quality.retrieval_metrics(e, f).collect()}
    assert got == {1: (0.5, 0.5), 2: (1.0, 1.0), 3: (0.0, 0.0)}


def test_ingest_retries_then_stores(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    schema = "id string, content string"
    for i, rows in enumerate(([("a", "x"), ("bad", "y")], [("a", "again"), ("b", "z")], [("c", "w")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        ok = F.lit(True) if i == 2 else F.col("id") != "bad"
        streaming.ingest(stream, lambda df, ok=ok: df.withColumn("ok", ok), str(out / "stored"), str(out / "failed"), str(out / "dead"), str(out / "state"))
    assert sorted(r.id for r in spark.read.parquet(str(out / "stored")).collect()) == ["a", "b", "bad", "c"]
    assert sorted(r.retries for r in spark.read.parquet(str(out / "failed")).collect()) == [1, 2]


def test_priority_and_budget(spark):
    rows = spark.createDataFrame([(1, f"a{i}", i, "x" * 8) for i in range(5)], "qid long, id string, rank int, statement string")
    assert facts.within_budget(rows, "qid", "rank", X.token_estimate("statement"), 5).count() == 2
    assert [r.id for r in facts.by_priority([rows.filter("rank > 3"), rows.filter("rank < 2")], "qid", "rank", 2).orderBy("place").collect()] == ["a4", "a0"]


def test_session_batches(spark):
    s = spark.createDataFrame([("s1", 0, 5)], "id string, archived int, message_count long")
    m = spark.createDataFrame([("s1", float(i), "user" if i % 2 else "assistant", f"m{i}", None) for i in range(5)], "session_id string, timestamp double, role string, content string, tool_name string")
    got = storage.to_episodes(s, m, 2).orderBy("msg_range").collect()
    assert [r.msg_range for r in got] == ["0-2", "2-4", "4-5"] and got[0].content == "Assistant: m0\nUser: m1"
    assert len({r.id for r in got}) == 3 and all(len(r.id) == 36 for r in got)


def test_drafts_have_all_active_statements(spark):
    rows = [("s1", f"2026-01-01 00:00:{i:02d}", i, f"t{i}", "superseded" if i == 3 else "active") for i in range(25)] + [("s2", "2026-01-01 00:00:00", 99, "u", "active")]
    state = spark.createDataFrame(rows, "subject_id string, recorded_at string, seq long, statement string, epistemic_state string").withColumn("recorded_at", F.to_timestamp("recorded_at"))
    got = {r.subject_id: (r.summary, r.n_statements) for r in consolidation.draft_models(state).collect()}
    assert got == {"s1": (". ".join(f"t{i}" for i in reversed(range(25)) if i != 3), 24), "s2": ("u", 1)}
