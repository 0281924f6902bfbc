"""Episodes, sessions and documents: idempotent writes, content-addressed storage, migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import content_hash, episode_id, file_folder, file_name, message_line
from ..sources.scratch import written

BATCH = 20


def new_episodes(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming episodes whose id is not stored yet, each id once (its earliest)."""
    w = Window.partitionBy("id").orderBy("recorded_at", "content")
    once = incoming.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return once.join(existing.select("id"), "id", "left_anti")


def usable_sessions(sessions: DataFrame, limit: int | None = None) -> DataFrame:
    """Not archived, with messages, by start."""
    s = sessions.filter("archived = 0 and message_count > 0")
    return s if limit is None else s.orderBy("started_at", "id").limit(limit)


def usable_messages(messages: DataFrame) -> DataFrame:
    """What users and assistants said, without tool output."""
    return messages.filter(F.col("role").isin("user", "assistant") & (F.coalesce("content", F.lit("")) != "") & (F.coalesce("tool_name", F.lit("")) == ""))


def session_sample(messages: DataFrame, low: int = 5, high: int = 30) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count("*").alias("n")).filter(F.col("n").between(low, high))


def to_episodes(sessions: DataFrame, messages: DataFrame, batch: int = BATCH) -> DataFrame:
    """Sessions as episodes of 20 messages each, with a repeatable id."""
    w = Window.partitionBy("session_id").orderBy("timestamp", "role", "content")
    m = usable_messages(messages).join(usable_sessions(sessions).select(F.col("id").alias("session_id")), "session_id")
    m = m.withColumn("_i", F.row_number().over(w) - 1).withColumn("batch", F.floor(F.col("_i") / batch))
    lines = F.array_sort(F.collect_list(F.struct("_i", message_line("role", "content").alias("line"))))  # at most `batch` lines
    out = m.groupBy("session_id", "batch").agg(F.min("timestamp").alias("first_at"), lines.alias("_l"))
    content = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    msg_range = F.concat_ws("-", F.col("batch") * batch, F.col("batch") * batch + F.size("_l"))
    return out.select(episode_id("session_id", "first_at").alias("id"), "session_id", content.alias("content"), msg_range.alias("msg_range"))


def migration_plan(sessions: DataFrame, messages: DataFrame, existing: DataFrame) -> DataFrame:
    """Episodes of a migration with status created or skipped, for a dry run or a resumed one."""
    e = to_episodes(sessions, messages)
    known = existing.select("id").distinct().withColumn("_known", F.lit(True))
    return e.join(known, "id", "left").withColumn("status", F.when(F.col("_known"), "skipped").otherwise("created")).drop("_known")


def migration_summary(plan: DataFrame, facts: DataFrame) -> DataFrame:
    """(status, episodes, facts, facts_per_episode) of a migration (id, status) and the facts (episode_id) written of its episodes."""
    n = facts.groupBy(F.col("episode_id").alias("id")).agg(F.count("*").alias("_n"))
    j = plan.hint("merge").join(n, "id", "left")
    return j.groupBy("status").agg(F.count("*").alias("episodes"), F.coalesce(F.sum("_n"), F.lit(0).cast("long")).alias("facts"), F.round(F.coalesce(F.sum("_n"), F.lit(0)) / F.count("*"), 6).alias("facts_per_episode"))


def documents_index(docs: DataFrame) -> DataFrame:
    """Content-addressed store: one row for each path, with the first content and all episodes that have it.

    `docs`: episode_id, content, content_type, source (map), saved_at. A path's row lists all its episodes, so it grows with their number; `path_of_episode` gives them as rows. Hashes are made before the shuffle; the text itself moves only for the first of each path."""
    d = docs.withColumn("path", F.concat_ws("/", file_folder("content_type", "source"), file_name("content", "content_type", "source"))).withColumn("file_id", content_hash("content"))
    facts = d.groupBy("path").agg(F.min_by(F.struct("file_id", "episode_id", "content_type"), F.struct("saved_at", "episode_id")).alias("f"), F.array_sort(F.collect_set("episode_id")).alias("episode_ids"), F.min("saved_at").alias("saved_at"), F.min_by(F.octet_length("content"), F.struct("saved_at", "episode_id")).alias("size_bytes"))
    return facts.select("path", "f.file_id", F.col("f.episode_id").alias("first_episode"), "f.content_type", "episode_ids", "saved_at", "size_bytes")


def list_documents(index: DataFrame, content_type: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    d = index if content_type is None else index.filter(F.col("content_type") == content_type)
    return d.orderBy(F.desc("saved_at"), "path").offset(offset).limit(limit)


def path_of_episode(index: DataFrame) -> DataFrame:
    """(episode_id, path): where each episode's document is stored."""
    return index.select(F.explode("episode_ids").alias("episode_id"), "path")


def text_by_episode(asked: DataFrame, index: DataFrame, episodes: DataFrame) -> DataFrame:
    """(episode_id, text, found_in): stored document, else the episode's own content."""
    stored = written(path_of_episode(index).hint("merge").join(index.select("path", "first_episode"), "path"))
    first = episodes.select(F.col("id").alias("first_episode"), F.col("content").alias("_stored"))
    own = episodes.select(F.col("id").alias("episode_id"), F.col("content").alias("_own"))
    out = asked.hint("merge").join(stored, "episode_id", "left").hint("merge").join(first, "first_episode", "left").hint("merge").join(own, "episode_id", "left")
    return out.select("episode_id", F.coalesce("_stored", "_own").alias("text"), F.when(F.col("_stored").isNotNull(), "index").when(F.col("_own").isNotNull(), "episode").otherwise("none").alias("found_in"))


def without_documents(index: DataFrame, paths: DataFrame) -> DataFrame:
    return index.join(paths.select("path"), "path", "left_anti")


def write_documents(docs: DataFrame, path: str) -> DataFrame:
    """Store each document's text once, as (file, file_id, content) in a folder for each kind, and give the index. The first text of each path is found by its hash before any text moves."""
    index = written(documents_index(docs))
    first = index.select("path", F.col("first_episode").alias("episode_id"))
    texts = docs.select("episode_id", "content").hint("merge").join(first, "episode_id")
    texts.select(F.substring_index("path", "/", 1).alias("folder"), F.substring_index("path", "/", -1).alias("file"), content_hash("content").alias("file_id"), "content").write.partitionBy("folder").mode("append").parquet(path)
    return index


def write_json_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Results or alerts, one JSON object a line; mode `append` for a log."""
    rows.write.mode(mode).json(path)
