"""Consolidation of facts into observations, and curated models."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import EXCLUSIVE_PREDICATES, can_consolidate, group_label
from ..sources.scratch import written
from .ordered import positions

GROUP = ("subject_id", "predicate", "namespace")
CAP = 20


def pending_groups(facts: DataFrame) -> DataFrame:
    return facts.filter(can_consolidate("assertion_source")).select(*GROUP).distinct()


def queue(groups: DataFrame) -> DataFrame:
    """Keys `subject|predicate|namespace` of groups that wait."""
    return groups.select(group_label(*GROUP).alias("group_key")).distinct()


def queued_groups(pending: DataFrame) -> DataFrame:
    """The groups that keys name; a key of fewer than three parts is malformed and names none."""
    parts = F.split("group_key", r"\|", 3)
    named = pending.select("group_key", parts.alias("_p")).filter(F.size("_p") == 3)
    return named.select("group_key", *(F.col("_p")[i].alias(c) for i, c in enumerate(GROUP))).distinct()


def dequeue(pending: DataFrame, done: DataFrame) -> DataFrame:
    """What still waits: keys that are neither done nor malformed."""
    return queued_groups(pending).select("group_key").hint("merge").join(done.select("group_key"), "group_key", "left_anti")


def latest_observations(observations: DataFrame) -> DataFrame:
    """The newest active observation of each group."""
    w = Window.partitionBy(*GROUP).orderBy(F.desc("recorded_at"), F.desc("id"))
    return observations.filter("epistemic_state = 'active'").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def group_facts(state: DataFrame, cap: int = CAP) -> DataFrame:
    """Active facts of each group that are not model-sourced, the newest `cap`."""
    w = Window.partitionBy(*GROUP).orderBy(F.desc("recorded_at"), F.desc("seq"))
    active = state.filter((F.col("epistemic_state") == "active") & can_consolidate("assertion_source"))
    return active.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= cap)


def summary(subject: Column, predicate: Column, values: Column) -> Column:
    """`subject predicate: v1; v2; ...` of the first five values."""
    return F.concat(subject, F.lit(" "), predicate, F.lit(": "), F.array_join(F.slice(values, 1, 5), "; "))


def evidence(state: DataFrame, cap: int = CAP) -> DataFrame:
    """One row for each group: its facts, newest first (at most `cap`), and how many objects they name."""
    listed = F.array_sort(F.collect_list(F.struct("place", "id", F.coalesce("object_value", F.lit("")).alias("value"))))
    g = group_facts(state, cap).groupBy(*GROUP).agg(listed.alias("_f"), F.countDistinct(F.coalesce("object_value", F.lit(""))).alias("n_objects"))
    return g.select(*GROUP, F.transform("_f", lambda x: x["id"]).alias("fact_ids"), F.transform("_f", lambda x: x["value"]).alias("object_values"), "n_objects")


def observe(state: DataFrame) -> DataFrame:
    """First observations: one for each group."""
    e = evidence(state)
    return e.select(*GROUP, summary(F.col("subject_id"), F.col("predicate"), F.col("object_values")).alias("summary"), F.size("fact_ids").cast("long").alias("proof_count"), F.array_sort("fact_ids").alias("evidence_refs"))


def consolidate(state: DataFrame, observations: DataFrame) -> DataFrame:
    """What each group's facts do to its observation, in one plan: create, supersede (values exclude each other), update or skip."""
    e = evidence(state)
    old_id = F.col("id") if "id" in observations.columns else F.lit(None).cast("string")
    old = observations.select(*GROUP, F.col("evidence_refs").alias("_refs"), F.col("proof_count").alias("_count"), old_id.alias("observation_id"))
    j = e.join(old, list(GROUP), "left").withColumn("new_facts", F.array_except("fact_ids", F.coalesce("_refs", F.array().cast("array<string>"))))
    clash = (F.col("n_objects") > 1) & F.col("predicate").isin(*EXCLUSIVE_PREDICATES)
    action = F.when(F.col("_refs").isNull(), "create").when(F.size("new_facts") == 0, "skip").when(clash, "supersede").otherwise("update")
    j = j.withColumn("action", action)
    replaced = F.col("action").isin("create", "supersede")
    refs = F.when(replaced, F.col("fact_ids")).otherwise(F.array_union(F.coalesce("_refs", F.array().cast("array<string>")), "new_facts"))
    count = F.when(replaced, F.size("fact_ids")).otherwise(F.col("_count") + F.size("new_facts")).cast("long")
    return j.select(*GROUP, "action", summary(F.col("subject_id"), F.col("predicate"), F.col("object_values")).alias("summary"), count.alias("proof_count"), F.array_sort(refs).alias("evidence_refs"), "new_facts", "fact_ids", "observation_id")


class Drained(NamedTuple):
    observations: DataFrame
    edges: DataFrame
    pending: DataFrame
    done: DataFrame


def drain(pending: DataFrame, state: DataFrame, observations: DataFrame, now: Column, model: Callable[[str], str | None] | None = None) -> Drained:
    """Work off all queued groups in one plan.

    observations: all of them afterwards: new ones, updated ones, and replaced ones, which become superseded at `now`.
    edges (kind, from_id, to_id): SUPPORTS from an observation to its new facts, CONTRADICTS from new facts to the observation that they replace, SUPERSEDES
    from the new observation to the old. pending: keys that still wait (groups without new facts; malformed keys go). done: group_key, id, action."""
    groups = queued_groups(pending)
    live = state.hint("merge").join(groups.select(*GROUP), list(GROUP), "left_semi")
    plan = consolidate(live, latest_observations(observations)).filter("action <> 'skip'")
    fresh = F.concat(F.lit("obs:"), F.substring(F.sha2(F.concat_ws("|", *GROUP, now.cast("string")).cast("binary"), 256), 1, 16))
    plan = written(plan.withColumn("id", F.when(F.col("action") == "update", F.col("observation_id")).otherwise(fresh)))
    if model is not None:
        plan = written(summarised(plan, model))
    replaced = plan.filter("action = 'supersede'")
    new = plan.filter("action <> 'update'").select("id", *GROUP, "summary", "proof_count", "evidence_refs", F.lit("active").alias("epistemic_state"), now.alias("recorded_at"), F.lit(None).cast("timestamp").alias("invalid_at"))
    change = plan.filter("action <> 'create'").select(F.col("observation_id").alias("id"), F.col("action").alias("_a"), F.col("summary").alias("_s"), F.col("proof_count").alias("_n"), F.col("evidence_refs").alias("_r"))
    updated = F.col("_a") == "update"
    after = observations.hint("merge").join(change, "id", "left").select(
        "id", *GROUP, F.when(updated, F.col("_s")).otherwise(F.col("summary")).alias("summary"), F.when(updated, F.col("_n")).otherwise(F.col("proof_count")).alias("proof_count"),
        F.when(updated, F.col("_r")).otherwise(F.col("evidence_refs")).alias("evidence_refs"), F.when(F.col("_a") == "supersede", "superseded").otherwise(F.col("epistemic_state")).alias("epistemic_state"),
        "recorded_at", F.when(F.col("_a") == "supersede", now).otherwise(F.col("invalid_at")).alias("invalid_at"),
    )
    supports = plan.select(F.lit("SUPPORTS").alias("kind"), F.col("id").alias("from_id"), F.explode(F.when(F.col("action") == "update", F.col("new_facts")).otherwise(F.col("fact_ids"))).alias("to_id"))
    against = replaced.select(F.lit("CONTRADICTS").alias("kind"), F.explode("new_facts").alias("from_id"), F.col("observation_id").alias("to_id"))
    over = replaced.select(F.lit("SUPERSEDES").alias("kind"), F.col("id").alias("from_id"), F.col("observation_id").alias("to_id"))
    done = plan.select(group_label(*GROUP).alias("group_key"), "id", "action")
    return Drained(after.unionByName(new), supports.unionByName(against).unionByName(over), dequeue(pending, done), done)


def summarised(plan: DataFrame, model: Callable[[str], str | None]) -> DataFrame:
    """Put the user's model's words in place of `summary`, which is also its prompt; a failing call or an empty answer leaves it."""
    columns, at = plan.columns, plan.columns.index("summary")

    def run(batches):
        for batch in batches:
            out = []
            for prompt in batch.column(at).to_pylist():
                try:
                    out.append(model(prompt) or prompt)
                except Exception:  # the model is the user's
                    out.append(prompt)
            yield pa.record_batch([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], columns)

    return plan.mapInArrow(run, plan.schema)


def support_edges(observations: DataFrame) -> DataFrame:
    """(subject_id, predicate, namespace, fact_id): which facts support which observation."""
    return observations.select(*GROUP, F.explode("evidence_refs").alias("fact_id"))


def create_models(requests: DataFrame, entities: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Models (id, title, summary, namespace, tags, llm_drafted, approved_by, stale, created_at, updated_at) and curated (model_id, entity_id) of
    requests (title, summary, curated_for: array of entity names; namespace, tags, llm_drafted, approved_by may be left out or null). Ids are
    repeatable; a name that no entity has makes no link, one that several have links to each."""
    has = lambda c, default: F.coalesce(F.col(c), default) if c in requests.columns else default
    r = requests.select("title", "summary", "curated_for", has("namespace", F.lit("shared")).alias("namespace"), has("tags", F.array().cast("array<string>")).alias("tags"), has("llm_drafted", F.lit(False)).alias("llm_drafted"), (F.col("approved_by") if "approved_by" in requests.columns else F.lit(None).cast("string")).alias("approved_by"))
    r = r.withColumn("id", F.concat(F.lit("model:"), F.substring(F.sha2(F.concat_ws("|", "namespace", "title", now.cast("string")).cast("binary"), 256), 1, 16)))
    models = r.select("id", "title", "summary", "namespace", "tags", "llm_drafted", "approved_by", F.lit(False).alias("stale"), now.alias("created_at"), now.alias("updated_at"))
    wanted = r.select(F.col("id").alias("model_id"), F.explode("curated_for").alias("name")).distinct()
    return models, wanted.hint("merge").join(entities.select(F.col("id").alias("entity_id"), "name"), "name").select("model_id", "entity_id").distinct()


def models_with_entities(models: DataFrame, curated: DataFrame) -> DataFrame:
    c = curated.groupBy("model_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entities"))
    return models.join(c, models["id"] == c["model_id"], "left").drop("model_id")


def latest_models(versions: DataFrame) -> DataFrame:
    """Models as of their newest version; a field that an update leaves null keeps its last value."""
    w = Window.partitionBy("id").orderBy("updated_at").rowsBetween(Window.unboundedPreceding, 0)
    fields = [c for c in versions.columns if c not in ("id", "updated_at")]
    v = versions.select("id", "updated_at", *(F.last(c, ignorenulls=True).over(w).alias(c) for c in fields))
    newest = Window.partitionBy("id").orderBy(F.desc("updated_at"))
    return v.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def stale_models(models: DataFrame, curated: DataFrame, facts: DataFrame) -> DataFrame:
    """Models of which a curated entity has a fact recorded after the model's update. Facts are reduced to one row for each entity before the join."""
    newest = facts.groupBy(F.col("subject_id").alias("entity_id")).agg(F.max("recorded_at").alias("newest"))
    hit = curated.join(newest, "entity_id").join(models.select(F.col("id").alias("model_id"), "updated_at"), "model_id").filter(F.col("newest") > F.col("updated_at"))
    return hit.groupBy("model_id").agg(F.count("*").alias("n_newer_entities"))


#: Statements of a draft that are joined at once.
CHUNK = 1_000


def draft_models(state: DataFrame, statements: int | None = None) -> DataFrame:
    """A draft for each entity: its active statements, newest first, joined; of the newest `statements` only, if given. The draft is
    one text, so it grows with the entity's facts; it is joined from chunks of CHUNK statements, which are placed and joined over all tasks."""
    top = positions(state.filter("epistemic_state = 'active'").select("subject_id", "statement", "recorded_at", "seq"), ["subject_id"], [F.desc("recorded_at"), F.desc("seq"), F.desc("statement")], "_p")
    if statements is not None:
        top = top.filter(F.col("_p") <= statements)
    joined = lambda of, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, of))), lambda x: x[of]), ". ")
    chunks = top.groupBy("subject_id", F.floor((F.col("_p") - 1) / CHUNK).alias("_chunk")).agg(joined("statement", "_p").alias("text"), F.count("*").alias("n"))
    return chunks.groupBy("subject_id").agg(joined("text", "_chunk").alias("summary"), F.sum("n").alias("n_statements"))
