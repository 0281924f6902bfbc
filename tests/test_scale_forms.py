"""Forms that have to hold for hot keys, many batches and stopped runs, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tempograph import streaming as X
from tempograph.operators import consolidation, facts, graph, retrieval, state_store, temporal, vector_index
from tempograph.operators.ordered import positions
from tempograph.sources import event_facts


def ids(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_positions_of_a_key_that_spans_tasks(spark):
    """One key has most rows, so its places go on through all partitions; a null key is a key."""
    r = random.Random(2)
    rows = [(i, "hot" if i % 10 else r.choice(["a", "b", None]), r.randint(0, 50), i % 3 == 0) for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, k string, v int, odd boolean").repartition(5)
    got = {x.id: (x.position, x.n) for x in positions(positions(df, ["k"], [F.col("v"), F.col("id")]).withColumn("_o", F.col("odd").cast("int")), ["k"], [F.col("v"), F.col("id")], "n", "_o").collect()}
    seen, odd = {}, {}
    for i, k, _, o in sorted(rows, key=lambda x: (x[2], x[0])):
        seen[k], odd[k] = seen.get(k, 0) + 1, odd.get(k, 0) + o
        assert got[i] == (seen[k], odd[k])
    assert positions(df.limit(0), ["k"], [F.col("id")]).count() == 0


def test_as_of_join_of_a_hot_subject(spark):
    """10^5 versions and 10^5 times of one subject; and all cases of ends and empty intervals on a few."""
    n = 100_000
    at = lambda c: F.timestamp_micros(F.lit(1_700_000_000_000_000) + c * 1_000_000)
    state = spark.range(n).select(F.lit("s").alias("subject_id"), F.col("id").cast("string").alias("id"), at(F.col("id") * 2).alias("valid_at"), at(F.col("id") * 2 + 4).alias("invalid_at"))
    asked = spark.range(n).select(F.lit("s").alias("subject_id"), at(F.col("id") * 2 + 1).alias("at"))
    assert temporal.true_for(state, asked).count() == 2 * n - 1
    r = random.Random(3)
    rows = [(r.choice("ab"), f"f{i}", r.choice([None, *range(6)]), r.choice([None, *range(6)])) for i in range(60)]
    when = [(r.choice("abc"), r.choice([None, *range(7)]), i) for i in range(30)]
    t = lambda v: None if v is None else v
    s = spark.createDataFrame([(a, b, t(c), t(d)) for a, b, c, d in rows], "subject_id string, id string, v int, i int").withColumn("valid_at", at(F.col("v"))).withColumn("invalid_at", at(F.col("i")))
    q = spark.createDataFrame(when, "subject_id string, w int, no int").withColumn("at", at(F.col("w")))
    want = sorted((no, f) for sub, w, no in when for a, f, v, i in rows if a == sub and w is not None and v is not None and v <= w and (i is None or i > w))
    assert ids(temporal.true_for(s, q), "no", "id") == want


def test_a_star_is_dealt_in_blocks(spark):
    f = spark.range(500).select(F.concat(F.lit("leaf"), "id").alias("subject_id"), F.lit("in").alias("predicate"), F.lit("hub").alias("object_id"))
    step, hubs = graph.adjacency(f, 60)
    assert step.groupBy("a", "block").count().agg(F.max("count")).first()[0] <= 60
    assert [tuple(r) for r in hubs.collect()] == [("hub", 9)]
    starts = spark.createDataFrame([("leaf1", "leaf1"), ("hub", "hub")], "seed string, id string")
    want = ids(graph.expand(f, starts, 2), "seed", "id", "hop")
    assert ids(graph.expand(f, starts, 2, 60), "seed", "id", "hop") == want and len(want) == 2 + 501 - 1 + 500


def test_what_seeds_reach_is_a_row_for_each_group(spark):
    """70 leaves of one hub fill two groups of 64 seeds, and each entity has a row for each of them and hop, not one for each seed; against a plain search."""
    r = random.Random(4)
    pairs = [(f"leaf{i}", "hub") for i in range(70)] + [(f"n{r.randint(0, 30)}", f"n{r.randint(0, 30)}") for _ in range(40)] + [("leaf1", "n1"), ("n2", "n2"), ("hub", None)] + 2 * [("leaf2", "n3")]
    f = spark.createDataFrame([(a, "in", b) for a, b in pairs], "subject_id string, predicate string, object_id string")
    seeds = [f"leaf{i}" for i in range(70)] + ["n1", "far"]
    got = graph.reach(f, spark.createDataFrame([(s, s) for s in seeds], "seed string, id string"), 3, 60)
    near = {}
    for a, b in pairs:
        if b is not None:
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    want, layers = [], set()
    for s in seeds:
        seen, front = {s: 0}, {s}
        for hop in (1, 2, 3):
            front = {b for a in front for b in near.get(a, ())} - set(seen)
            seen |= dict.fromkeys(front, hop)
        want += [(s, i, h) for i, h in seen.items()]
    assert ids(got.rows(), "seed", "id", "hop") == sorted(want)
    assert got.layers.filter("id = 'leaf5' and hop = 2").count() == 2 and len([w for w in want if w[1:] == ("leaf5", 2)]) == 69
    whole = {(s, i) for s, i, _ in want}
    between = sorted((s, a, b) for s in seeds for a, b in pairs if (s, a) in whole and (s, b) in whole)
    assert ids(graph.connecting_facts(f, got), "seed", "subject_id", "object_id") == between


def test_drafts_in_chunks(spark, monkeypatch):
    s = spark.range(50).select(F.lit("u").alias("subject_id"), F.concat(F.lit("s"), "id").alias("statement"), F.timestamp_seconds(F.col("id") % 7).alias("recorded_at"), F.col("id").alias("seq"), F.lit("active").alias("epistemic_state"))
    want = ids(consolidation.draft_models(s), "summary", "n_statements")
    monkeypatch.setattr(consolidation, "CHUNK", 4)
    assert ids(consolidation.draft_models(s), "summary", "n_statements") == want and want[0][1] == 50
    assert consolidation.draft_models(s, 3).first().summary == "s48. s41. s34"


def test_quantiles_of_one_hot_name(spark):
    rows = spark.range(3001).select(F.lit("x").alias("route"), F.col("id").cast("double").alias("ms"), F.lit(200).alias("status"), F.timestamp_seconds("id").alias("ts"), "id", F.lit("x").alias("name"), F.col("id").cast("double").alias("value"))
    r = facts.latency_summary(rows, "route").first()
    assert (r.p50, r.p95, r.p99) == (1500.0, pytest.approx(0.95 * 3002 - 1), pytest.approx(0.99 * 3002 - 1))
    h = facts.histograms(rows).first()
    assert (h.n, h.most, h["last"]) == (500 + 2000 % 501, 3000.0, 3000.0)


def test_state_of_appended_batches_is_that_of_the_log(spark, tmp_path):
    f = event_facts(spark, "/root/testdata/sf0.001").cache()
    store = state_store.opened(spark, str(tmp_path / "store"), 4)
    cuts = [0, 50, 400, 410, 1000]
    order = {r.id: i for i, r in enumerate(sorted(f.select("id", "recorded_at", "seq").collect(), key=lambda r: (r.recorded_at, r.seq)))}
    numbered = f.join(spark.createDataFrame(list(order.items()), "id string, _i long"), "id").cache()
    state = lambda df: ids(df.withColumn("at", F.unix_micros("invalid_at").cast("string")), "id", "write_kind", "epistemic_state")
    for n, (a, b) in enumerate(zip(cuts, cuts[1:]), 1):
        part = numbered.filter((F.col("_i") >= a) & (F.col("_i") < b)).drop("_i")
        assert store.append(part, n) == n
        store.append(part, n)  # a replay
        if n in (2, 4):
            assert state(store.state()) == state(temporal.with_state(numbered.filter(F.col("_i") < b).drop("_i")))
    whole = temporal.with_state(f)
    assert sorted(map(str, ids(store.state().select("id", F.coalesce("ended_by", F.lit("-")).alias("e")), "id", "e"))) == sorted(map(str, ids(whole.select("id", F.coalesce("ended_by", F.lit("-")).alias("e")), "id", "e")))
    touched = spark.createDataFrame([("shared", 1)], "namespace string, bucket int")
    plan = store.newest(touched)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan
    assert "PartitionFilters: [isnotnull(namespace" in store.log().filter("namespace = 'shared'")._jdf.queryExecution().toString()


def stream_of(spark, path, schema, *files):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_a_late_fact_takes_effect_when_it_comes(spark, tmp_path):
    """Recorded before the current fact, but in a later file: it supersedes that fact, as order of arrival drives."""
    schema = "id string, seq long, subject_id string, predicate string, namespace string, object_value string, recorded_at timestamp, valid_at timestamp, negation boolean, functional boolean"
    fact = lambda i, obj, day: (i, int(i[1:]), "s", "works_at", "n", obj, *2 * (__import__("datetime").datetime(2026, 1, day),), False, True)
    out = str(tmp_path / "out")
    first = X.state_changes(stream_of(spark, tmp_path / "in", schema, [fact("f1", "a", 1)], [fact("f2", "b", 9)]), out)
    assert ids(first, "kind", "from_id", "to_id") == [("SUPERSEDES", "f2", "f1")]
    again = X.state_changes(stream_of(spark, tmp_path / "in", schema, [fact("f3", "c", 5)]), out)
    assert ids(again, "kind", "from_id", "to_id") == [("SUPERSEDES", "f2", "f1"), ("SUPERSEDES", "f3", "f2")]


def test_alerts_of_one_hot_category(spark, tmp_path):
    r = random.Random(5)
    rows = sorted(((r.randint(0, 10_000_000), r.choice(["a", "a", "b", None]), i) for i in range(3000)), key=lambda x: (x[0], x[2]))
    files = [[(i, c, at) for at, c, i in rows[a : a + 1000]] for a in (0, 1000, 2000)]
    sent = X.suppressed_alerts(stream_of(spark, tmp_path / "in", "id long, category string, at long", *files), str(tmp_path / "out"), 1)
    got = ids(sent.withColumn("category", F.coalesce("category", F.lit("-"))), "category", "at")
    last, want = {}, []
    for at, c, _ in rows:
        if c not in last or at - last[c] >= 1_000_000:
            want.append((c or "-", at))
            last[c] = at
    assert got == sorted(want)


def test_pending_content_expires_and_is_removed(spark, tmp_path):
    at = lambda s: __import__("datetime").datetime.fromtimestamp(1_700_000_000 + s)
    waits = stream_of(spark, tmp_path / "w", "id string, content string, queued_at timestamp", [("old", "x", at(0)), ("b", "x", at(290))], [("c", "x", at(300)), ("d", "x", at(310)), ("e", "x", at(320))])
    done = stream_of(spark, tmp_path / "d", "id string, at timestamp", [("d", at(280))], [("b", at(305))])
    got = X.pending_cache(waits, done, str(tmp_path / "s"), 300)
    assert ids(got, "id") == [("c",), ("e",)]  # old has expired, b and d were ingested, d before it came
    few = X.pending_cache(waits, done, str(tmp_path / "s2"), 300, 1)
    assert ids(few, "id") == [("e",)]


def test_pending_content_makes_room_when_newer_is_ingested_later(spark, tmp_path):
    """b was beyond the newest one until c was ingested, a batch later."""
    at = lambda s: __import__("datetime").datetime.fromtimestamp(1_700_000_000 + s)
    waits = stream_of(spark, tmp_path / "w", "id string, content string, queued_at timestamp", [("b", "x", at(1)), ("c", "x", at(2))], [("a", "x", at(0))])
    done = stream_of(spark, tmp_path / "d", "id string, at timestamp", [("z", at(3))], [("c", at(3))])
    assert ids(X.pending_cache(waits, done, str(tmp_path / "s"), 300, 1), "id") == [("b",)]


def test_a_stopped_migration_goes_on(spark, tmp_path):
    m = spark.range(60).select((F.col("id") % 12).alias("session_id"), F.col("id").alias("timestamp"), F.lit("user").alias("role"), F.lit("hi").alias("content"), F.lit("").alias("tool_name"))
    rows = [[(s, 0, 5, 0) for s in part] for part in ((0, 1, 2, 3), (4, 5, 6, 7, 0), (8, 9, 10, 11))]
    stream = stream_of(spark, tmp_path / "in", "id long, started_at long, message_count long, archived int", *rows)
    out = str(tmp_path / "out")
    assert X.migrate(stream, m, out, 1).count() in (4, 5)
    assert ids(X.migrate(stream, m, out), "session_id", "status") == [(i, "migrated") for i in range(12)]
    assert ids(spark.read.parquet(f"{out}/episodes"), "session_id") == [(i,) for i in range(12)]


def test_vector_index_recall(spark):
    """Of queries divisible by 100 against all vectors; these have no clusters, so that many cells have to be probed."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = v.filter("id % 100 = 0").withColumnRenamed("id", "qid")
    found = vector_index.search(vector_index.build(v), q, 10)
    told = vector_index.recall(retrieval.vector_search(q, v, 10), found.hits).first()
    assert told.queries == 20 and told.recall >= 0.9, told
    assert ids(retrieval.vector_search(q, vector_index.build(v), 10), "qid", "id", "rank") == ids(found.hits, "qid", "id", "rank")
    assert found.compared.agg(F.avg("compared")).first()[0] < 1300


def test_vector_index_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", 20)
    rows = [(i, [1.0, 0.0]) for i in range(100)] + [(200, None), (201, []), (202, [1.0, 2.0, 3.0]), (203, [0.0, 0.0]), (204, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    index = vector_index.build(df, 3)
    q = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 3.0]), (3, None)], "qid int, embedding array<float>")
    got = ids(vector_index.search(index, q, 3, 3).hits, "qid", "id")
    assert got == ids(retrieval.vector_search(q, df.filter("id <> 202"), 3), "qid", "id")
    assert index.parts().groupBy("cell").count().agg(F.max("count")).first()[0] >= 5
    assert vector_index.search(vector_index.build(df.limit(0)), q, 3).hits.count() == 0


def test_rarest_pieces_make_fewer_candidates(spark):
    texts = spark.range(400).select("id", F.concat(F.lit("Supplier#"), F.format_string("%06d", F.col("id") * 37 % 1000)).alias("name"))
    needles = texts.filter("id < 10").select(F.lower("name").alias("_needle"))
    assert retrieval.candidates(texts, "name", needles).count() < 400 * 10 / 4  # by the first three letters all of them
    assert retrieval.containing(texts, "name", needles.withColumnRenamed("_needle", "needle"), "needle").count() == 10


def test_pieces_of_texts_are_not_written(spark, monkeypatch):
    """A piece of all texts and the texts that hold it are never rows of one key: what is written are the needles' pieces, and the same is found when there are many."""
    texts = spark.range(300).select("id", F.concat(F.lit("Größe#"), F.format_string("%05d", F.col("id") * 37 % 1000)).alias("name"))
    needles = spark.createDataFrame([("größe#0",), ("e#00",), ("99",), ("#",), ("none",)], "needle string")
    rows = []
    monkeypatch.setattr(retrieval, "written", lambda df: (rows.append(df.count()), df)[1])
    want = ids(retrieval.containing(texts, "name", needles, "needle"), "needle", "id")
    assert max(rows) <= 20, rows
    assert want == sorted((n.needle, t.id) for n in needles.collect() for t in texts.collect() if n.needle in t.name.lower())
    monkeypatch.setattr(retrieval, "BROADCAST_GRAMS", 0)
    assert ids(retrieval.containing(texts, "name", needles, "needle"), "needle", "id") == want


def test_a_word_of_many_queries_has_its_facts_once(spark):
    facts_ = spark.createDataFrame([(f"f{i:03}", f"e{i}", "hub" if i % 2 else f"e{i + 1}") for i in range(200)], "id string, subject_id string, object_id string")
    names = spark.createDataFrame([(f"e{i}", f"thing {i}") for i in range(201)] + [("hub", "hub thing")], "id string, name string")
    asked = spark.createDataFrame([(q, f"hub thing {q}") for q in range(150, 170)], "qid int, text string")
    got = retrieval.graph_search(asked, facts_, names)
    top = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "dense_rank" in line]
    assert top and not any("qid" in line for line in top), top
    by_q = {}
    for q, i, rank in ids(got, "qid", "id", "rank"):
        by_q.setdefault(q, []).append((rank, i))
    plain = {}
    for q in range(150, 170):
        seen = []
        for word in ("hub", "thing", str(q)):
            of = {e for e, n in [(f"e{i}", f"thing {i}") for i in range(201)] + [("hub", "hub thing")] if word in n}
            seen += [x for x in sorted(f"f{i:03}" for i in range(200) if f"e{i}" in of or ("hub" if i % 2 else f"e{i + 1}") in of)[:5] if x not in seen]
        plain[q] = seen[:20]
    assert {q: [i for _, i in sorted(v)] for q, v in by_q.items()} == plain


def test_injected_facts_are_not_grouped_by_turn(spark):
    """70 turns name one place of 30 facts: the first source counts, and the pairs of turn and fact are only made at the end."""
    facts_ = spark.createDataFrame([(f"f{i}", "hub" if i < 20 else f"e{i}", "hub" if i >= 10 else "x", "active" if i % 7 else "superseded") for i in range(30)], "id string, subject_id string, object_id string, epistemic_state string")
    entities = spark.createDataFrame([("hub", "Hub"), ("x", "X")], "id string, name string")
    none = spark.createDataFrame([], "norm string, entity_id string")
    names = spark.createDataFrame([(q, "Hub") for q in range(70)] + [(3, "X")], "qid int, name string")
    turns = spark.createDataFrame([(q, "nothing known") for q in range(71)], "qid int, text string")
    texts = spark.createDataFrame([("f0", "other words")], "id string, statement string")
    got = retrieval.name_injection(turns, names, entities, none, facts_, texts)
    assert not [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [qid#" in line and ", id#" in line.split("]")[0]]
    want = [(q, f"f{i}", 0 if i < 20 else 2) for q in range(70) for i in range(30) if i % 7]
    assert ids(got, "qid", "id", "source") == sorted(want)


def test_names_of_turns_are_made_once(spark):
    """A table of names that is made by reading texts is read once, not for each of its uses."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    names = spark.createDataFrame([(q, f"e{q % 3}") for q in range(40)], "qid int, name string").repartition(2).mapInArrow(counted, "qid int, name string")
    entities = spark.createDataFrame([(f"x{i}", f"e{i}") for i in range(3)], "id string, name string")
    facts_ = spark.createDataFrame([(f"f{i}", f"x{i % 3}", "p", None, "active") for i in range(6)], "id string, subject_id string, predicate string, object_id string, epistemic_state string")
    turns, texts = spark.createDataFrame([(q, "one") for q in range(40)], "qid int, text string"), spark.createDataFrame([("f0", "two")], "id string, statement string")
    none = spark.createDataFrame([], "norm string, entity_id string")
    assert retrieval.name_injection(turns, names, entities, none, facts_, texts).count() == 80
    assert read.value == 40


def test_topic_context_shuffles_no_facts_for_their_ends(spark, monkeypatch):
    """The ends of a few hits are found where facts are read, once; what was shuffled for them were all facts, twice."""
    rows = [(f"p{i}>in>h{i % 3}", f"p{i}", "in", f"h{i % 3}") for i in range(60)]
    facts_ = spark.createDataFrame(rows, "id string, subject_id string, predicate string, object_id string")
    texts = facts_.select("id", F.concat_ws(" ", "subject_id", "object_id").alias("statement"))
    seen, kept = [], retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df: (seen.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())), kept(df))[1])
    got = ids(retrieval.topic_context(spark.createDataFrame([(1, "p4"), (2, "p5")], "qid int, text string"), texts, facts_, 1, 1), "qid", "id")
    assert got == sorted((q, r[0]) for q, h in ((1, "h1"), (2, "h2")) for r in rows if r[3] == h)
    ends = [plan for columns, plan in seen if columns == ["seed", "id"] and "entity_id" in plan]
    assert len(ends) == 1 and "strategy=broadcast" in ends[0] and "strategy=merge" not in ends[0]


def test_pieces_of_a_long_text_take_linear_time(spark):
    """A substring at a place is found by a walk from the start, so pieces of 200,000 letters took 10^10 steps."""
    plan = spark.range(1).select(F.lit("x").alias("t")).select(retrieval._grams("t", 1, 3))._jdf.queryExecution().analyzed().toString()
    assert "substr" not in plan
    odd = [("abca", ["a", "b", "c", "abc", "bca"]), ("é🙂b", ["b", "é", "é🙂b", "🙂"]), ("ab", ["a", "b"]), ("aaaa", ["a", "aaa"])]
    got = spark.createDataFrame([(t,) for t, _ in odd], "t string").select("t", retrieval._grams("t", 1, 3).alias("g")).collect()
    assert {r.t: sorted(r.g) for r in got} == {t: sorted(g) for t, g in odd}


def test_a_task_holds_few_scores_at_once(monkeypatch):
    """However many vectors come in a batch; ties of other slices count by id, and the best k are those of all scores."""
    import numpy as np
    import pyarrow as pa
    from tempograph.operators import retrieval

    r = np.random.default_rng(5)
    v, q = r.normal(size=(500, 8)), r.normal(size=(20, 8))
    v[400:450] = v[:50]
    column = lambda m: pa.array(m.tolist(), pa.list_(pa.float64()))
    held, rounded = [], np.round
    monkeypatch.setattr(retrieval.np, "round", lambda x, n: (held.append(x.size), rounded(x, n))[1])
    monkeypatch.setattr(retrieval, "CELLS", 600, raising=False)
    (got,) = retrieval._best_of_all(pa.array(range(20)), column(q), 3)(iter([pa.record_batch([pa.array(range(500)), column(v)], ["id", "embedding"])]))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = rounded(unit(q) @ unit(v).T, 6)
    want = [(i, j, float(s[i][j])) for i in range(20) for j in sorted(range(500), key=lambda j: (-s[i][j], j))[:3]]
    assert [(x["qid"], x["id"], x["score"]) for x in got.to_pylist()] == want
    assert max(held) <= 600
