"""Writes, retries, lookups and evaluation on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from tempograph import streaming
from tempograph.operators import consolidation, extraction, facts, graph, quality, retrieval, storage


def ids(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_a_replayed_batch_stores_rows_once(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    paths = [str(out / x) for x in ("stored", "failed", "dead", "state")]

    def run(rows):
        if rows:
            spark.createDataFrame(rows, "id string, content string").coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("id string, content string").parquet(str(src))
        streaming.ingest(stream, lambda df: df.withColumn("ok", F.col("id") != "bad"), *paths)

    for rows in ([("a", "x"), ("bad", "y" * 600)], [("a", "again"), ("b", "z")], [("c", "w")], [("d", "v")]):
        run(rows)
        commits = sorted((out / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
        commits[-1].unlink()  # as if the driver had died just before the commit
        (out / "state" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
        run([])
    assert ids(spark.read.parquet(paths[0]), "id") == [("a",), ("b",), ("c",), ("d",)]
    assert ids(spark.read.parquet(paths[2]).withColumn("n", F.length("content")), "id", "n", "retries") == [("bad", 500, 3)]
    assert ids(spark.read.parquet(paths[1]), "id", "retries") == [("bad", 1), ("bad", 2)]


def test_vectors_in_blocks_are_as_exact(spark, monkeypatch):
    vectors = spark.range(40).select("id", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.sin(F.col("id") * i).cast("float")).alias("embedding"))
    asked = vectors.select(F.col("id").alias("qid"), "embedding")
    want = ids(retrieval.vector_search(asked, vectors, 3), "qid", "id", "rank")
    monkeypatch.setattr(retrieval, "BROADCAST_VECTORS", 5)
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    assert ids(retrieval.vector_search(asked, vectors, 3), "qid", "id", "rank") == want


def test_requests_join_alike_when_many(spark, monkeypatch):
    f = spark.createDataFrame([(f"f{i}", "a" if i % 2 else "b") for i in range(20)], "id string, namespace string")
    keys = spark.createDataFrame([("t1", ["a"]), ("t2", ["a", "b"])], "token string, namespaces array<string>").select(F.sha2(F.col("token").cast("binary"), 256).alias("key_hash"), "namespaces", F.lit(True).alias("active"))
    asked = spark.createDataFrame([(1, "t1"), (2, "t2"), (3, "t3")], "qid int, token string")
    want = ids(facts.allowed(f, keys, asked), "qid", "id")
    monkeypatch.setattr(facts, "BROADCAST_REQUESTS", 0)
    assert ids(facts.allowed(f, keys, asked), "qid", "id") == want and len(want) == 30


def test_text_contains(spark):
    texts = spark.createDataFrame([(1, "The Red House"), (2, None), (3, ""), (4, "ab")], "id int, name string")
    needles = spark.createDataFrame([("red h",), ("A",), ("",), (None,), ("house!",)], "needle string")
    assert ids(retrieval.containing(texts, "name", needles, "needle"), "id", "needle") == [(1, "red h"), (4, "A")]


def test_model_search_falls_back_to_text(spark):
    models = spark.createDataFrame([("m1", "Cluster layout", "where things run"), ("m2", "Costs", "what clusters cost")], "id string, title string, summary string")
    asked = spark.createDataFrame([(1, "layout"), (2, "luster"), (3, "none")], "qid int, text string")
    assert ids(retrieval.model_search(asked, models), "qid", "id") == [(1, "m1"), (2, "m1"), (2, "m2")]


def test_merge_cycles_are_an_error(spark):
    m = lambda rows: spark.createDataFrame(rows, "source_id string, target_id string")
    assert ids(graph.merged_root(m([("a", "b"), ("b", "b")])), "source_id", "root") == [("a", "b"), ("b", "b")]
    with pytest.raises(ValueError, match="cycle"):
        graph.merged_root(m([("a", "b"), ("b", "c"), ("c", "a")]), 4)


def test_query_sets(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text("\n".join(json.dumps(x) for x in ({"id": "1", "text": "who", "class": "c", "expected_ids": ["a"]}, {"id": "2", "class": "c"})))
    q = quality.load_queries(spark, str(tmp_path / "q.jsonl"))
    assert [tuple(r) for r in quality.check_queries(q).collect()] == [("error", 2, 1)]
    assert [tuple(r) for r in quality.check_queries(q.limit(0)).collect()] == [("warning", 0, None)]
    assert q.filter("id = '1'").first().expected_ids == ["a"]
    yaml = pytest.importorskip("yaml")
    (tmp_path / "q.yaml").write_text(yaml.safe_dump({"queries": [{"id": 1, "text": "who"}]}))
    assert ids(quality.load_queries(spark, str(tmp_path / "q.yaml")), "id", "text") == [("1", "who")]


def test_drained_groups(spark):
    cols = "id string, subject_id string, predicate string, namespace string, object_value string, assertion_source string, epistemic_state string, recorded_at timestamp, seq long"
    at = lambda i: f"2026-01-01 00:00:0{i}"
    rows = [("f1", "s", "works_at", "n", "x", "user", "active", at(1), 1), ("f2", "s", "works_at", "n", "y", "user", "active", at(2), 2), ("f3", "t", "uses", "n", "z", "model", "active", at(3), 3)]
    state = spark.createDataFrame([], cols) if not rows else spark.createDataFrame(rows, cols.replace("timestamp", "string")).withColumn("recorded_at", F.to_timestamp("recorded_at"))
    old = spark.createDataFrame([("o1", "s", "works_at", "n", "old", 1, ["f1"], "active", at(0), None)], "id string, subject_id string, predicate string, namespace string, summary string, proof_count long, evidence_refs array<string>, epistemic_state string, recorded_at string, invalid_at string")
    old = old.withColumn("recorded_at", F.to_timestamp("recorded_at")).withColumn("invalid_at", F.to_timestamp("invalid_at"))
    keys = spark.createDataFrame([("s|works_at|n",), ("t|uses|n",), ("broken",)], "group_key string")
    got = consolidation.drain(keys, state, old, F.lit("2026-02-01").cast("timestamp"), lambda p: p.upper())
    (new,) = got.done.collect()
    assert (new.group_key, new.action) == ("s|works_at|n", "supersede")
    assert ids(got.edges, "kind", "from_id", "to_id") == [("CONTRADICTS", "f2", "o1"), ("SUPERSEDES", new.id, "o1"), ("SUPPORTS", new.id, "f1"), ("SUPPORTS", new.id, "f2")]
    assert ids(got.pending, "group_key") == [("t|uses|n",)]
    assert ids(got.observations, "id", "epistemic_state", "summary") == sorted([("o1", "superseded", "old"), (new.id, "active", "S WORKS_AT: Y; X")])


def test_a_failing_embedding_is_null(spark):
    df = spark.createDataFrame([(1, "a"), (2, "boom")], "id long, text string")

    def model(text):
        if text == "boom":
            raise RuntimeError("no")
        return [1.0, 2.0]

    assert {r.id: r.embedding for r in extraction.embed_texts(df, model, 2).collect()} == {1: [1.0, 2.0], 2: None}


def test_answers_in_any_wrapping(spark):
    body = '{"entities": [{"name": "n"}], "facts": []}'
    cases = {"plain": f" {body}\n", "fence": f"Sure:\n```json\n{body}\n```\nbye", "bare fence": f"```\n{body}```", "prose": f"It is {body} then", "broken": "{oops", "bad fence": f"```json\n{{oops\n```\n{body}", "none": None}
    got = extraction.parse_responses(spark.createDataFrame(list(cases.items()), "id string, response string"))
    assert {r.id: r.parsed for r in got.collect()} == {"plain": True, "fence": True, "bare fence": True, "prose": True, "broken": False, "bad fence": False, "none": False}


def test_documents_are_stored_by_folder(spark, tmp_path):
    docs = spark.createDataFrame([("e1", "same", "text", None, 1), ("e2", "same", "text", None, 2), ("e3", "code", "code", None, 3)], "episode_id string, content string, content_type string, source map<string,string>, saved_at long")
    assert storage.write_documents(docs, str(tmp_path / "store")).count() == 2
    assert ids(spark.read.parquet(str(tmp_path / "store")), "folder", "content") == [("code", "code"), ("text", "same")]
