"""Health checks and evaluation of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import has_substring, missing_strings

#: When a check warns.
QUEUE_LIMIT, LAG_SECONDS, OTHER_SHARE, RECALL_GATE = 1000, 300, 0.15, 0.30
SEVERITY = ("ok", "warning", "critical")


def health(facts: DataFrame, pending: DataFrame, now, known: list[str]) -> DataFrame:
    """(check_name, value, status): queue depth, ingestion lag, share of unknown predicates, contradicted facts; and the worst of them."""
    f = facts.agg(
        (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.max("recorded_at"))).cast("double").alias("lag"),
        F.avg(F.when(F.col("predicate").isin(*known), 0.0).otherwise(1.0)).alias("other"),
        F.count(F.when(F.col("epistemic_state") == "contradicted", 1)).cast("double").alias("contradicted"),
    )
    q = pending.agg(F.count("*").cast("double").alias("depth"))
    checks = F.array(
        F.struct(F.lit("queue_depth").alias("check_name"), F.col("depth").alias("value"), (F.col("depth") > QUEUE_LIMIT).alias("bad")),
        F.struct(F.lit("ingestion_lag").alias("check_name"), F.col("lag").alias("value"), (F.col("lag") > LAG_SECONDS).alias("bad")),
        F.struct(F.lit("other_predicates").alias("check_name"), F.col("other").alias("value"), (F.col("other") > OTHER_SHARE).alias("bad")),
        F.struct(F.lit("contradictions").alias("check_name"), F.col("contradicted").alias("value"), F.lit(False).alias("bad")),
    )
    one = f.crossJoin(F.broadcast(q)).select(F.explode(checks).alias("c")).select("c.check_name", F.round("c.value", 6).alias("value"), F.when(F.col("c.bad"), "warning").otherwise("ok").alias("status"))
    rank = lambda: F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("status"))
    worst = one.agg(F.max(rank()).alias("r")).select(F.lit("overall").alias("check_name"), F.col("r").cast("double").alias("value"), F.element_at(F.array(*map(F.lit, SEVERITY)), F.col("r").cast("int")).alias("status"))
    return one.unionByName(worst)


def retrieval_metrics(expected: DataFrame, found: DataFrame, k: int = 5) -> DataFrame:
    """(qid, recall, reciprocal_rank): found has (qid, id, rank). Nothing expected counts as found."""
    e = expected.select("qid", "class", F.array_distinct("expected_ids").alias("e"))
    hits = e.select("qid", F.explode("e").alias("id")).join(found.select("qid", "id", "rank").hint("merge"), ["qid", "id"])
    h = hits.groupBy("qid").agg(F.count(F.when(F.col("rank") <= k, 1)).alias("n"), F.min("rank").alias("best"))
    j = e.join(h.hint("merge"), "qid", "left")
    recall = F.when(F.size("e") == 0, 1.0).otherwise(F.coalesce("n", F.lit(0)) / F.size("e"))
    rr = F.when(F.size("e") == 0, 1.0).otherwise(F.coalesce(1 / F.col("best"), F.lit(0.0)))
    return j.select("qid", "class", F.round(recall, 6).alias("recall"), F.round(rr, 6).alias("reciprocal_rank"))


def class_summary(metrics: DataFrame, gate: float = RECALL_GATE) -> DataFrame:
    return metrics.groupBy("class").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.count(F.when(F.col("recall") >= gate, 1)).alias("passed"))


def substring_matches(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, matched): whether any result (qid, id, statement) has any of the expected strings (qid, substrings), whatever the case; true where none is expected."""
    rows = found.hint("merge").join(expected.select("qid", "substrings"), "qid")
    hit = rows.groupBy("qid").agg(F.max(has_substring("substrings", F.struct("id", "statement"))).alias("_m"))
    j = expected.hint("merge").join(hit, "qid", "left")
    return j.select("qid", (F.coalesce(F.size("substrings"), F.lit(0)) <= 0).alias("_none"), "_m").select("qid", (F.col("_none") | F.coalesce("_m", F.lit(False))).alias("matched"))


def run_totals(metrics: DataFrame, matched: DataFrame, gate: float = RECALL_GATE) -> DataFrame:
    """One row for a run: (queries, recall, mrr, substring_accuracy, verdict), means over all queries. The run passes if its mean recall, as rounded, reaches the gate; without queries it is an error."""
    j = metrics.hint("merge").join(matched, "qid", "left")
    mean = lambda c: F.round(F.avg(c), 4)
    one = j.agg(F.count("*").alias("queries"), mean("recall").alias("recall"), mean("reciprocal_rank").alias("mrr"), mean(F.coalesce("matched", F.lit(False)).cast("double")).alias("substring_accuracy"))
    return one.withColumn("verdict", F.when(F.col("queries") == 0, "error").when(F.col("recall") >= gate, "pass").otherwise("fail"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(session_id, n_a, n_b, ratio, samples): facts of two extractor runs side by side, with three samples of each session that either has."""
    count = lambda df, n: df.groupBy("session_id").agg(F.count("*").alias(f"n_{n}"))
    w = Window.partitionBy("session_id").orderBy("statement")
    few = a.unionByName(b).select("session_id", "statement").distinct().withColumn("_p", F.row_number().over(w)).filter("_p <= 3")
    samples = few.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list("statement")), "|").alias("samples"))
    j = count(a, "a").join(count(b, "b"), "session_id", "full_outer").fillna(0, ["n_a", "n_b"]).join(samples, "session_id", "left")
    return j.withColumn("ratio", F.when(F.col("n_a") > 0, F.round(F.col("n_b") / F.col("n_a"), 6)))


def run_summary(compared: DataFrame, seconds: DataFrame) -> DataFrame:
    """(sessions, mean_speed, mean_fact_ratio) of `compare_runs` and of what each session took (session_id, seconds_a, seconds_b): how many times as
    fast the second run was, and its facts to the first one's, as means over sessions. A session of no time or no facts has no part in that mean."""
    j = compared.hint("merge").join(seconds, "session_id")
    speed = F.when(F.col("seconds_b") > 0, F.col("seconds_a") / F.col("seconds_b"))
    return j.agg(F.count("*").alias("sessions"), F.round(F.avg(speed), 6).alias("mean_speed"), F.round(F.avg("ratio"), 6).alias("mean_fact_ratio"))


def judge(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, class, n_results, missing_entities, missing_substrings, passed): `expected` is (qid, class, entities, substrings), `found` (qid, id, statement). A query passes if
    nothing is missing in what it found; one of class `inject` that expects nothing passes only if it found nothing. A query's results are one text here, as they are what one prompt gets."""
    texts = found.groupBy("qid").agg(F.count("*").alias("n_results"), F.array_join(F.array_sort(F.collect_list("statement")), "\n").alias("_t"))
    j = expected.hint("merge").join(texts, "qid", "left").withColumn("_t", F.coalesce("_t", F.lit(""))).withColumn("n_results", F.coalesce("n_results", F.lit(0).cast("long")))
    miss = lambda c: missing_strings(F.coalesce(c, F.array().cast("array<string>")), F.col("_t"))
    j = j.select("qid", "class", "n_results", miss("entities").alias("missing_entities"), miss("substrings").alias("missing_substrings"), (F.coalesce(F.size("entities"), F.lit(0)) + F.coalesce(F.size("substrings"), F.lit(0))).alias("_n"))
    silent = (F.col("class") == "inject") & (F.col("_n") <= 0)
    passed = F.when(silent, F.col("n_results") == 0).otherwise((F.size("missing_entities") == 0) & (F.size("missing_substrings") == 0))
    return j.withColumn("passed", passed).drop("_n")


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """(no, id, text, class, expected_ids): an evaluation query set of one JSON object a line, or a YAML file with a list or `queries:` where PyYAML is there. Missing fields are null."""
    schema = "id string, text string, class string, expected_ids array<string>"
    if path.endswith((".yaml", ".yml")):
        import json

        import yaml

        data = yaml.safe_load("\n".join(r.value for r in spark.read.text(path).collect()))  # a query set is written by hand
        rows = (data.get("queries", []) if isinstance(data, dict) else data) or []
        df = spark.createDataFrame([(i, json.dumps(r, default=str)) for i, r in enumerate(rows)], "no long, value string")
    else:
        df = spark.read.text(path).withColumn("no", F.monotonically_increasing_id())
    return df.select("no", F.from_json("value", schema).alias("q")).select("no", "q.*")


def check_queries(queries: DataFrame) -> DataFrame:
    """(status, queries, first_without_text): ok, a warning for an empty set, or an error with the number of the first query that has no text."""
    out = queries.agg(F.count("*").alias("queries"), F.min(F.when(F.col("text").isNull(), F.col("no"))).alias("first_without_text"))
    return out.select(F.when(F.col("queries") == 0, "warning").when(F.col("first_without_text").isNotNull(), "error").otherwise("ok").alias("status"), "queries", "first_without_text")
