"""Queries that run a stream over a given table to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming as X
from ..operators.state_store import opened
from ..sources import event_facts, messages, sessions, statements, table
from ..sources.scratch import scratch_path, written
from .curation import _EPIS, _USABLE
from .views import FACTS, STATE, STATEMENTS


def x2_deduplicated(spark, d):
    e = event_facts(spark, d, X.read_table(spark, d, "events")).select("id", "recorded_at", "namespace")
    return X.run_to_table(X.deduplicated(e.unionByName(e))).select("id", "namespace")


def x1_ingested(spark, d):
    """Documents as a stream of episodes; one in seven fails and waits for another try."""
    path = scratch_path(spark)
    e = X.read_table(spark, d, "documents").select(F.concat(F.lit("ep"), F.col("doc_id")).alias("id"), F.coalesce("text", F.lit("")).alias("content"), "doc_id")
    stored, failed, dead, state = (f"{path}/{x}" for x in ("stored", "failed", "dead", "state"))
    X.ingest(e.unionByName(e), lambda df: df.withColumn("ok", F.col("doc_id") % 7 != 0), stored, failed, dead, state)
    at = lambda p, where, retries: spark.read.parquet(p).select("id", F.lit(where).alias("found_in"), retries.cast("long").alias("retries"))
    return at(stored, "stored", F.lit(0)).unionByName(at(failed, "failed", F.col("retries")))


def x3_state_changes(spark, d):
    return X.state_changes(event_facts(spark, d, X.read_table(spark, d, "events")), scratch_path(spark))


def x4_quota(spark, d):
    e = X.read_table(spark, d, "events")
    r = e.select((F.col("user_id") % 7).alias("key_id"), F.col("event_type").isin("purchase", "signup").alias("is_write"), F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)).alias("ts"))
    # A stream holds back its last windows until the watermark passes them; a tick a year on lets them go and is dropped itself.
    end = written(table(spark, d, "events").agg((F.max(F.col("ts").cast("timestamp")) + F.expr("interval 1 year")).alias("ts")))
    tick = spark.readStream.schema(end.schema).parquet(end.inputFiles()[0].rpartition("/")[0])
    return X.run_to_table(X.quota_use(X.closed_by(r, tick), 10, 2)).filter("key_id is not null")


def x5_alerts(spark, d):
    e = X.read_table(spark, d, "events").filter("event_type = 'error'")
    k = F.get_json_object("props", "$.k").cast("int")
    a = e.select(F.col("event_id").alias("id"), F.concat(F.lit("c"), k % 5).alias("category"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return X.suppressed_alerts(a, scratch_path(spark), 86400)


def _as_stream(df, files, order):
    """A table as a stream of files in order, one file a micro-batch."""
    path = scratch_path(df.sparkSession)
    df.repartitionByRange(files, order).sortWithinPartitions(order).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def x6_pending_stream(spark, d):
    """Statements of sixty days as they are queued, a micro-batch a file; those of a number ending in 3 are ingested as soon as they are there."""
    s = statements(spark, d).select("id", F.col("statement").alias("content"), F.col("recorded_at").alias("queued_at"))
    waits, done = _as_stream(s, 3, "queued_at"), _as_stream(s.filter("id like '%3'").select("id", F.col("queued_at").alias("at")), 3, "at")
    return X.pending_cache(waits, done, scratch_path(spark), 60 * 86400).select("id", F.unix_micros("queued_at").alias("queued_us"))


def t3_incremental_state(spark, d):
    """The log in three batches by time of recording; each reads only the buckets that it touches."""
    f = written(event_facts(spark, d))
    third = f.agg((F.max(F.unix_micros("recorded_at")) - F.min(F.unix_micros("recorded_at"))).alias("w"), F.min(F.unix_micros("recorded_at")).alias("a"))  # one row
    dealt = written(f.crossJoin(F.broadcast(third)).withColumn("_b", F.least(F.floor(3 * (F.unix_micros("recorded_at") - F.col("a")) / (F.col("w") + 1)), F.lit(2))).drop("w", "a"))
    store = opened(spark)
    for b in range(3):
        store.append(dealt.filter(F.col("_b") == b).drop("_b"))
    return store.state().select("id", "write_kind", "epistemic_state", F.unix_micros("invalid_at").alias("invalid_at_us"), "ended_by")


def s18_resumed_migration(spark, d):
    """Sessions as a stream of four files: stopped after one micro-batch, and run again to the end."""
    c, m = sessions(spark, d), messages(spark, d)
    stored, path = scratch_path(spark), scratch_path(spark)
    c.repartition(4, "id").write.parquet(stored)
    stream = lambda: spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(stored)
    X.migrate(stream(), m, path, 1)
    X.migrate(stream(), m, path)
    return spark.read.parquet(f"{path}/episodes").select("id", "session_id", F.md5(F.col("content").cast("binary")).alias("md5"), "msg_range")


SQL = {
    "x6_pending_stream": f"WITH {STATEMENTS} SELECT id, epoch_us(recorded_at) AS queued_us FROM stmts WHERE recorded_at > (SELECT max(recorded_at) FROM stmts) - INTERVAL 60 DAY AND id NOT LIKE '%3' ORDER BY recorded_at DESC, id LIMIT 1000",
    "t3_incremental_state": f"WITH {STATE} SELECT id, write_kind, epistemic_state, epoch_us(invalid_at) AS invalid_at_us, ended_by FROM state",
    "s18_resumed_migration": f"WITH {_USABLE}{_EPIS.format(n=20)} SELECT h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS id, session_id, md5(content) AS md5, (b * 20) || '-' || (b * 20 + c) AS msg_range FROM eh",
    "x2_deduplicated": f"WITH {FACTS} SELECT id, namespace FROM facts",
    "x1_ingested": "SELECT 'ep' || doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'stored' END AS found_in, CAST(CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS retries FROM documents",
    "x3_state_changes": f"WITH {STATE} SELECT CASE WHEN epistemic_state = 'superseded' THEN 'SUPERSEDES' ELSE 'CONTRADICTS' END AS kind, ended_by AS from_id, id AS to_id FROM state WHERE ended_by IS NOT NULL",
    "x4_quota": """WITH r AS (SELECT user_id % 7 AS key_id, event_type IN ('purchase', 'signup') AS is_write, epoch_us(ts) // 1000 AS us FROM events),
 w AS (SELECT key_id, is_write, us - us % 10000000 AS window_us, count(*) AS n FROM r GROUP BY ALL) SELECT *, greatest(n - CASE WHEN is_write THEN 2 ELSE 10 END, 0) AS refused FROM w""",
    "x5_alerts": """WITH RECURSIVE a AS (SELECT event_id AS id, 'c' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 5) AS category, epoch_us(ts) AS t FROM events WHERE event_type = 'error'),
 s AS (SELECT category, min(t) AS t FROM a GROUP BY 1 UNION ALL SELECT s.category, (SELECT min(a.t) FROM a WHERE a.category = s.category AND a.t >= s.t + 86400000000) FROM s WHERE s.t IS NOT NULL)
 SELECT a.id, a.category, a.t AS at FROM a JOIN s ON a.category = s.category AND a.t = s.t""",
}
QUERIES = {n: globals()[n] for n in SQL}
