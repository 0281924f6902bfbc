"""The fact log laid out by namespace and key, with the state of every fact kept up batch by batch.

Four tables under one path, each with a `batch=` folder for each append, partitioned by namespace and a hash bucket of the key:

`log` are the facts as they came, `ended` facts that a batch superseded or contradicted, with what ended them, `active` for each bucket that a batch touched all
facts then active in it, and `versions` (namespace, bucket) the buckets touched, written last: a batch without it is not seen, and one tried again takes its place.

An append reads only the newest `active` rows of the buckets that it touches. What is active in a lane is of one object and polarity, so the write rule
(`temporal.with_state`) over those facts and then the batch's gives what it gives over the whole log. Facts take effect in order of arrival: by batch, then (recorded_at, seq).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path, written
from .temporal import KEY, ORDER, with_state

BUCKETS = 16
#: Pairs of namespace and bucket that are sent to every task; beyond that they are joined by shuffle.
BROADCAST_BUCKETS = 100_000
_PLACE = ["namespace", "bucket"]


@dataclass
class StateStore:
    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")

    def _put(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.repartition(*_PLACE).write.mode("overwrite").partitionBy(*_PLACE).parquet(f"{self.path}/{name}/batch={batch}")

    def versions(self) -> DataFrame | None:
        """(namespace, bucket, batch) of each touched bucket's batches; None before the first append."""
        try:
            return self.spark.read.parquet(f"{self.path}/versions")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def log(self) -> DataFrame:
        """All facts, as appended; a filter on namespace reads only that namespace's folders."""
        done = self.versions().select("batch").distinct()
        return self._read("log").join(F.broadcast(done), "batch", "left_semi")  # a row a batch

    def newest(self, touched: DataFrame | None = None) -> DataFrame:
        """Active facts: the newest version of every bucket, or of those in `touched` (namespace, bucket), whose folders alone are read."""
        versions = self.versions()
        if touched is not None:
            versions = versions.hint("merge").join(touched, _PLACE, "left_semi")
        last = written(versions.groupBy(*_PLACE).agg(F.max("batch").alias("batch")))
        few = last.limit(BROADCAST_BUCKETS + 1).count() <= BROADCAST_BUCKETS
        rows = self._read("active").filter("id is not null")  # a row without id only says that a bucket was emptied
        last = last.filter("batch > 0")  # true of all; a filter on the side that is sent lets Spark prune the folders of the other by it
        return rows.join(F.broadcast(last) if few else last.hint("merge"), [*_PLACE, "batch"])

    def append(self, facts: DataFrame, number: int | None = None) -> int:
        """Add a batch; gives its number. With a `number` that is already there nothing is done, so a stream may replay its batches."""
        versions = self.versions()
        last = (versions.agg(F.max("batch")).first()[0] if versions is not None else None) or 0
        if number is not None and number <= last:
            return number
        batch = last + 1 if number is None else number
        at: Column = F.pmod(F.xxhash64(*(c for c in KEY if c != "namespace")), F.lit(self.buckets)).cast("int")
        self._put(facts.withColumn("bucket", at), "log", batch)
        # What was written is read back by its own columns: a folder's name alone doesn't tell the type of a namespace.
        columns = facts.columns
        schema = facts.withColumn("bucket", at).schema
        new = self.spark.read.schema(schema).parquet(f"{self.path}/log/batch={batch}")
        touched = written(new.select(*_PLACE).distinct())
        before = None
        if versions is not None:
            before = self.newest(touched).select(*columns, "bucket", F.col("write_kind").alias("_kind"), F.lit(0).alias("_late"))
        rows = new.select(*columns, "bucket", F.lit(None).cast("string").alias("_kind"), F.lit(1).alias("_late"))
        folded = with_state(rows if before is None else before.unionByName(rows), ("_late", *ORDER)).withColumn("write_kind", F.coalesce("_kind", "write_kind")).drop("_kind", "_late")
        folded = written(folded)
        self._put(folded.filter("epistemic_state <> 'active'"), "ended", batch)
        marks = touched.withColumn("id", F.lit(None).cast("string"))
        self._put(folded.filter("epistemic_state = 'active'").unionByName(marks, allowMissingColumns=True), "active", batch)
        touched.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/batch={batch}")
        return batch

    def ended(self) -> DataFrame:
        done = self.versions().select("batch").distinct()
        return self._read("ended").join(F.broadcast(done), "batch", "left_semi").filter("id is not null")

    def state(self) -> DataFrame:
        """All facts with write_kind, epistemic_state, invalid_at and ended_by, as `temporal.with_state` gives them for the whole log."""
        return self.ended().unionByName(self.newest()).drop("batch", "bucket")


def opened(spark: SparkSession, path: str | None = None, buckets: int = BUCKETS) -> StateStore:
    return StateStore(spark, path or scratch_path(spark), buckets)
