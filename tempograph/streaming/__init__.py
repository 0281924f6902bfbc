"""Streaming forms of ingest, state changes, quotas, alerts, pending content and migration, over file sources with `availableNow` triggers.

Order of arrival, by micro-batch and then (recorded_at, seq), drives supersession, not event time; watermarks only bound the state of
de-duplication and of quota windows. State that rules need in order is a table that micro-batches read and write in folders of their own, so that
Spark sorts and spills what a task streams through, and a replayed batch writes over what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.extraction import MAX_RETRIES, dead_letters
from ..operators.state_store import StateStore
from ..operators.storage import to_episodes
from ..operators.temporal import state_edges
from ..sources.scratch import scratch_path, written

READ_LIMIT, WRITE_LIMIT, WINDOW_SECONDS = 100, 20, 10
SUPPRESS_SECONDS = 300
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table as a stream, be it one file or a folder of files."""
    batch = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    stream = spark.readStream.schema(batch.schema)
    first = next(iter(batch.inputFiles()), "")
    if first.rstrip("/").rpartition("/")[0].endswith(f"{name}.parquet"):
        return stream.parquet(f"{sf_dir}/{name}.parquet")
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is there, into a Parquet table in the shared folder, and read that."""
    spark = stream.sparkSession
    path = scratch_path(spark)
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def deduplicated(stream: DataFrame, time: str = "recorded_at", within: str = "1 hour") -> DataFrame:
    """Each episode id once within the watermark."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(["id"])


def ingest(stream: DataFrame, process: Callable[[DataFrame], DataFrame], stored: str, failed: str, dead: str, checkpoint: str) -> None:
    """Micro-batches of episodes (id, content, ...): those that failed in the batch before come first. An id that came before is skipped; the ids seen are the stream's keyed state, looked up
    one by one, so what a batch reads doesn't grow with what is stored. `process` adds a column `ok`. Rows that are not ok wait in the failed table with one more retry; after MAX_RETRIES their beginning goes to the dead-letter table.

    Each table has a folder `batch=<number>` for each micro-batch, which a replayed batch writes over, and which is read without the replayed batch's own
    folder and later ones; so a batch that runs twice stores its rows once. Of the failed table only the last batch's folder is read, of the stored one only ids."""
    spark = stream.sparkSession

    def put(rows: DataFrame, path: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    def one(batch: DataFrame, number: int) -> None:
        waiting_schema = StructType([*batch.schema.fields, StructField("retries", LongType())])
        waiting = _written_before(spark, failed, number, waiting_schema).filter(F.col("batch") == number - 1).drop("batch")
        fresh = batch.withColumn("retries", F.lit(0).cast("long"))
        done = process(waiting.unionByName(fresh.select(*waiting.columns))).persist()
        put(done.filter("ok").select(*batch.columns), stored, number)
        again = dead_letters(done.filter("not ok").select(*waiting.columns)).persist()
        full = done.filter("not ok").withColumn("retries", F.col("retries") + 1)
        put(full.filter(F.col("retries") < MAX_RETRIES).select(*waiting.columns), failed, number)
        put(again.filter("status = 'dead'").select("id", "content", F.col("retries").cast("long").alias("retries")), dead, number)
        again.unpersist()
        done.unpersist()

    stream.dropDuplicates(["id"]).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def quota_use(requests: DataFrame, read_limit: int = READ_LIMIT, write_limit: int = WRITE_LIMIT) -> DataFrame:
    """Requests (key_id, is_write, ts) for each key, kind and fixed window of ten seconds, and by how much they are over the limit. Works on a table and on a stream."""
    w = F.window("ts", f"{WINDOW_SECONDS} seconds")
    source = requests.withWatermark("ts", "1 minute") if requests.isStreaming else requests
    used = source.groupBy("key_id", "is_write", w.alias("w")).agg(F.count("*").alias("n"))
    limit = F.when(F.col("is_write"), write_limit).otherwise(read_limit)
    return used.select("key_id", "is_write", F.unix_micros("w.start").alias("window_us"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("refused"))


def closed_by(requests: DataFrame, tick: DataFrame) -> DataFrame:
    """Requests and one late tick (ts; other columns null), both streams: the tick moves the watermark past the last real window, so a stream that ends gives all windows."""
    return requests.unionByName(tick, allowMissingColumns=True)


def suppressed_alerts(alerts: DataFrame, path: str, seconds: int = SUPPRESS_SECONDS) -> DataFrame:
    """Alerts (id, category, at in microseconds) that go out: one for each category and period since the last one sent. Batches are taken to come in order, as an alert source writes them.
    Each micro-batch is sorted by Spark and read as a stream, which keeps one time for each category, so a category of any size needs no memory; the last times are a table of a row
    a category. A batch that is replayed takes its own place and starts from the times before it."""
    spark = alerts.sparkSession
    micros = seconds * 1_000_000
    types = {c: alerts.schema[c].dataType.simpleString() for c in ("id", "category", "at")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        category, free = None, None  # the category that goes on, and from when on it may send again
        for batch in batches:
            names, at, last = batch.column(1).to_pylist(), batch.column(2).to_numpy(), batch.column(3).to_pylist()
            keep, i, n = [], 0, len(names)
            ends = np.append(np.flatnonzero([a != b for a, b in zip(names, names[1:])]) + 1, n)  # of runs of one category
            while i < n:
                if names[i] != category or free is None:
                    category, free = names[i], at[i] if last[i] is None else last[i] + micros
                end = int(ends[np.searchsorted(ends, i, "right")])
                i += int(np.searchsorted(at[i:end], free))
                if i < end:
                    keep.append(i)
                    free = at[i] + micros
                    i += 1
            yield batch.select([0, 1, 2]).take(pa.array(keep, pa.int64()))

    def one(batch: DataFrame, number: int) -> None:
        sent = _written_before(spark, f"{path}/sent", number, StructType([alerts.schema["category"], StructField("last", LongType())]))
        last = sent.groupBy("category").agg(F.max("last").alias("last"))
        rows = batch.select("id", "category", "at").hint("merge").join(last.withColumnRenamed("category", "_c"), F.col("category").eqNullSafe(F.col("_c")), "left").select("id", "category", "at", "last")
        ordered = rows.repartition("category").sortWithinPartitions("category", "at", "id")
        out = ordered.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in types.items()))
        out.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        kept = spark.read.schema(alerts.select(*types).schema).parquet(f"{path}/rows/batch={number}")
        kept.groupBy("category").agg(F.max("at").alias("last")).write.mode("overwrite").parquet(f"{path}/sent/batch={number}")

    alerts.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows").select(*types)


def _written_before(spark: SparkSession, path: str, number: int, schema: StructType) -> DataFrame:
    """Rows of the `batch=` folders below `number`."""
    schema = StructType([*schema.fields, StructField("batch", LongType())])
    try:
        return spark.read.schema(schema).parquet(path).filter(F.col("batch") < number)
    except Exception as e:  # not written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def fold_step(active: list, fact: tuple, functional: bool, changes: list) -> list:
    """Active facts of a key after one more; appends what the fact did to others."""
    name, obj, negated = fact
    other = [a for a in active if a[1] != obj] if functional else []
    if other:
        changes += [("SUPERSEDES", name, a[0]) for a in other]
        return [a for a in active if a[1] == obj] + [fact]
    against = [a for a in active if a[1] == obj and a[2] != negated]
    if against:
        changes += [("CONTRADICTS", name, a[0]) for a in against]
        return [a for a in active if a not in against]
    return [*active, fact]


def state_changes(facts: DataFrame, path: str) -> DataFrame:
    """Edges (kind, from_id, to_id) as facts arrive: each micro-batch is appended to a `state_store.StateStore` at `path`, which folds it by windows onto what is active in the buckets that it
    touches. A replayed batch is appended once; a fact that comes late takes effect when it comes, after all that came before."""
    store = StateStore(facts.sparkSession, path)
    facts.writeStream.foreachBatch(lambda batch, number: store.append(batch, number + 1) and None).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return state_edges(store.ended())


def pending_cache(content: DataFrame, done: DataFrame, path: str, ttl_seconds: int = 300, newest: int = 1_000) -> DataFrame:
    """(id, content, queued_at) of what still waits after a stream of content (id, content, queued_at) and of ingested ids `done` (id, at): the newest `newest` of the last `ttl_seconds` before the
    latest time that either has. Each micro-batch takes the rows kept before, adds its own, and drops what was ingested or has expired; all others are kept, as those among the newest may
    yet be ingested and make room. The newest are taken at the end, by a top-k over all tasks. The state is content that waits and, for as long as content of their age could still wait,
    the ids ingested."""
    spark = content.sparkSession
    queued = content.select("id", "content", F.col("queued_at").alias("at"), F.lit(False).alias("gone"))
    left = done.select("id", F.lit(None).cast("string").alias("content"), "at", F.lit(True).alias("gone"))
    both = queued.unionByName(left)
    schema = both.schema

    def one(batch: DataFrame, number: int) -> None:
        kept = _written_before(spark, f"{path}/kept", number, schema)
        every = kept.filter(F.col("batch") == number - 1).drop("batch").unionByName(batch)
        now = every.agg(F.max("at").alias("_now"))  # one row
        live = every.crossJoin(F.broadcast(now)).filter(F.col("at") > F.col("_now") - F.make_dt_interval(secs=F.lit(ttl_seconds))).drop("_now")
        ids = live.filter("gone").groupBy("id").agg(F.max("at").alias("at"))
        waits = live.filter("not gone").hint("merge").join(ids.select("id"), "id", "left_anti")
        first = waits.groupBy("id").agg(F.max(F.struct("at", "content")).alias("x")).select("id", "x.content", "x.at", F.lit(False).alias("gone"))
        first.unionByName(ids.select("id", F.lit(None).cast("string").alias("content"), "at", F.lit(True).alias("gone"))).write.mode("overwrite").parquet(f"{path}/kept/batch={number}")
        spark.createDataFrame([(number,)], "last long").coalesce(1).write.mode("overwrite").parquet(f"{path}/last")

    both.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{path}/last").first()[0]
    return spark.read.schema(schema).parquet(f"{path}/kept/batch={last}").filter("not gone").orderBy(F.desc("at"), "id").limit(newest).select("id", "content", F.col("at").alias("queued_at"))


def migrate(sessions: DataFrame, messages: DataFrame, path: str, max_batches: int | None = None) -> DataFrame:
    """Episodes of a stream of sessions (id, started_at, ...) and their messages, written with a status for each session. The stream's checkpoint says which sessions are done: stopped after
    `max_batches` or by a failure it goes on from there when run again, and a session that comes twice is migrated once. A batch tried again takes its own place."""
    spark = sessions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    left = [max_batches]

    class Stopped(Exception):
        pass

    def one(batch: DataFrame, number: int) -> None:
        if left[0] == 0:
            raise Stopped
        made = to_episodes(batch, messages)
        made.write.mode("overwrite").parquet(f"{path}/episodes/batch={number}")
        counted = spark.read.schema(made.schema).parquet(f"{path}/episodes/batch={number}").groupBy("session_id").agg(F.count("*").alias("n_episodes"))
        batch.select(F.col("id").alias("session_id")).hint("merge").join(counted, "session_id", "left").select("session_id", F.coalesce("n_episodes", F.lit(0)).alias("n_episodes"), F.when(F.col("n_episodes") > 0, "migrated").otherwise("empty").alias("status")).write.mode("overwrite").parquet(f"{path}/status/batch={number}")
        if left[0] is not None:
            left[0] -= 1

    try:
        sessions.dropDuplicates(["id"]).writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    except Exception as e:
        if max_batches is None or "Stopped" not in str(e):
            raise
    return spark.read.parquet(f"{path}/status").drop("batch")
