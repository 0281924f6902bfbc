"""Tables of the fact model: reading, and deterministic projections of other tables into it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize_name, statement
from .vocabulary import FUNCTIONAL, PLURAL, vocabulary

__all__ = ["FUNCTIONAL", "PLURAL", "vocabulary", "table", "event_facts", "entities", "aliases", "graph_facts", "statements", "query_batch", "episodes", "sessions", "messages"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_facts(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """One fact for each event, with two time axes. `events` may be a stream of the table."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    predicate = F.when(kind == "signup", "has_role").when(kind == "error", "version_is").when(kind == "purchase", "owns").when(kind == "click", "uses").otherwise("related_to")
    e = (table(spark, sf_dir, "events") if events is None else events).withColumn("k", k).withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.select(
        F.concat(F.lit("f"), F.col("event_id")).alias("id"), F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("user_id")).alias("subject_id"), predicate.alias("predicate"),
        F.concat(F.lit("k"), F.col("k") % 5).alias("object_value"), F.col("ts").alias("recorded_at"), (F.col("ts") - F.make_interval(hours="k")).alias("valid_at"),
        F.when(F.col("user_id") % 4 == 0, "personal").otherwise("shared").alias("namespace"),
        F.element_at(F.array(*map(F.lit, ("stated", "inferred", "speculative"))), F.col("k") % 3 + 1).alias("certainty"),
        F.element_at(F.array(*map(F.lit, ("user", "tool_result", "model"))), (F.col("event_id") % 3 + 1).cast("int")).alias("assertion_source"),
        (F.col("k") % 10 == 0).alias("negation"), F.concat(F.lit("ep"), F.floor(F.col("event_id") / 10)).alias("episode_id"),
    )
    return e.withColumn("functional", F.col("predicate").isin("has_role", "version_is")).withColumn("object_type", F.when(F.col("predicate") == "version_is", "literal").otherwise("entity")).withColumn("statement", statement("subject_id", "predicate", "object_value"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, type) of customers, suppliers, parts, nations and regions."""
    out = None
    for prefix, name, key, label in (("cust", "customer", "c_custkey", "c_name"), ("supp", "supplier", "s_suppkey", "s_name"), ("part", "part", "p_partkey", "p_name"), ("nat", "nation", "n_nationkey", "n_name"), ("reg", "region", "r_regionkey", "r_name")):
        rows = table(spark, sf_dir, name).select(F.concat(F.lit(f"{prefix}:"), F.col(key)).alias("id"), F.col(label).alias("name"), F.lit("entity").alias("type"))
        out = rows if out is None else out.unionByName(rows)
    return out


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(norm, entity_id): normalised names, one entity each (the least id)."""
    return entities(spark, sf_dir).groupBy(normalize_name("name").alias("norm")).agg(F.min("id").alias("entity_id"))


def graph_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_id, predicate, object_id): facts between entities."""
    t = lambda n: table(spark, sf_dir, n)
    edge = lambda df, a, ka, p, b, kb: df.select(F.concat(F.lit(f"{a}:"), F.col(ka)).alias("subject_id"), F.lit(p).alias("predicate"), F.concat(F.lit(f"{b}:"), F.col(kb)).alias("object_id"))
    return (
        edge(t("customer"), "cust", "c_custkey", "located_in", "nat", "c_nationkey")
        .unionByName(edge(t("supplier"), "supp", "s_suppkey", "headquartered_in", "nat", "s_nationkey"))
        .unionByName(edge(t("nation"), "nat", "n_nationkey", "located_in", "reg", "n_regionkey"))
        .unionByName(edge(t("lineitem").select("l_partkey", "l_suppkey").distinct(), "part", "l_partkey", "manufactured_by", "supp", "l_suppkey"))
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as statements of a text corpus."""
    recorded = F.timestamp_micros(F.lit(1767225600000000) + F.col("doc_id") * 3600000000)  # hours from 2026-01-01
    state = F.when(F.col("doc_id") % 17 == 0, "superseded").when(F.col("doc_id") % 13 == 0, "contradicted").otherwise("active")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.coalesce("text", F.lit("")).alias("statement"), F.col("lang").alias("namespace"), recorded.alias("recorded_at"), recorded.alias("valid_at"), state.alias("epistemic_state"))


def query_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, text, now): the words of each benchmark item."""
    words = F.array_join(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), " ")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), words.alias("text"), F.lit("2026-02-15 12:00:00").cast("timestamp").alias("now"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as episodes with a JSON source; every eleventh source is no JSON."""
    raw = F.when(F.col("doc_id") % 11 == 0, F.col("source")).otherwise(F.concat(F.lit('{"agent": "a'), F.col("doc_id") % 3, F.lit('", "type": "'), F.col("source"), F.lit('"}')))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("ep"), F.col("doc_id")).alias("id"), F.coalesce("text", F.lit("")).alias("content"), F.lit("text").alias("content_type"), raw.alias("source"), F.col("lang").alias("namespace"), F.timestamp_micros(F.lit(1767225600000000) + F.col("doc_id") * 3600000000).alias("recorded_at"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.min("turn").alias("started_at"), F.count("*").alias("message_count")).withColumn("archived", (F.col("id") % 9 == 0).cast("int"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("timestamp"), "role", F.col("text").alias("content"), F.when(F.col("turn") % 7 == 6, "tool").otherwise("").alias("tool_name"))
