"""From model responses to validated facts, and from names to entities."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vector_index import VectorIndex
from ..functions import clip, normalize_literal, normalize_name, resolve_valid_at, statement
from ..sources.scratch import written

RESULT = "struct<entities:array<struct<name:string,type:string,summary:string>>,facts:array<struct<subject:string,predicate:string,object:string,object_type:string,certainty:string,assertion_source:string,valid_at:string,negation:boolean>>>"
PROMPT = "Extract entities and facts from the text as JSON. Use only these predicates: {vocabulary}\n\nText:\n"
RETRY_CHARS = 2000
DEAD_LETTER_CHARS = 500
MAX_RETRIES = 3
MERGE_FROM, AMBIGUOUS_FROM = 0.95, 0.80


def prompts(episodes: DataFrame, predicates: list[str], chars: int | None = None) -> DataFrame:
    content = F.col("content") if chars is None else clip("content", chars)
    return episodes.select("id", F.concat(F.lit(PROMPT.format(vocabulary=", ".join(predicates))), content).alias("prompt"))


def call_model(rows: DataFrame, model: Callable[[str], str | None]) -> DataFrame:
    """Add `response`: the user's model on each prompt, in the tasks. A failing call or an empty answer is null."""

    def run(batches):
        for batch in batches:
            out = []
            for p in batch.column(1).to_pylist():
                try:
                    out.append(model(p) or None)
                except Exception:  # the model is the user's; a failure is a row to retry
                    out.append(None)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], ["id", "response"])

    return rows.select("id", "prompt").mapInArrow(run, "id string, response string")


def parse_responses(responses: DataFrame) -> DataFrame:
    """(id, result, parsed): the whole answer, else what stands between code fences, else the outermost braces, as JSON. Written once, so that
    no filter on the result reads JSON again."""
    answer = F.trim("response", F.lit(" \t\r\n"))
    marked = F.try_element_at(F.split("response", "```"), F.lit(2))  # null without a fence
    fenced = F.trim(F.regexp_replace(marked, "^json", ""), F.lit(" \t\r\n"))
    inner = F.regexp_extract("response", r"(?s)\{.*\}", 0)
    tried = F.array(answer, F.when(marked.isNull(), inner).otherwise(fenced))
    text = F.get(F.filter(tried, lambda x: x.startswith("{") & F.try_parse_json(x).isNotNull()), F.lit(0))
    return written(responses.select("id", text.alias("text")).select("id", F.from_json("text", RESULT).alias("result"), F.col("text").isNotNull().alias("parsed")))


def extract(episodes: DataFrame, predicates: list[str], model: Callable[[str], str | None], retry_chars: int = RETRY_CHARS) -> DataFrame:
    """(id, result, parsed, attempt): the model on every episode, then once more, on the first `retry_chars` characters, where its answer can't be read."""
    first = parse_responses(call_model(prompts(episodes, predicates), model))
    failed = episodes.hint("merge").join(first.filter("not parsed").select("id"), "id", "left_semi")
    again = parse_responses(call_model(prompts(failed, predicates, retry_chars), model))
    return first.filter("parsed").withColumn("attempt", F.lit(1)).unionByName(again.withColumn("attempt", F.lit(2)))


def valid_entities(parsed: DataFrame) -> DataFrame:
    e = parsed.select("id", F.explode("result.entities").alias("e")).filter("e.name is not null")
    return e.select("id", "e.name", F.when(F.col("e.type").isin("entity", "concept"), F.col("e.type")).otherwise("entity").alias("type"), F.coalesce("e.summary", F.lit("")).alias("summary"))


def valid_facts(parsed: DataFrame, vocab: DataFrame) -> DataFrame:
    """Facts with subject, known predicate and object; labels outside their sets get the default; literals normalised."""
    f = parsed.select("id", F.explode("result.facts").alias("f")).select("id", "f.*")
    f = f.filter((F.trim("subject") != "") & (F.trim("predicate") != "") & F.col("object").isNotNull())
    f = f.join(F.broadcast(vocab.select("predicate")), "predicate", "left_semi")  # 70 rows
    clamp = lambda c, allowed, default: F.when(F.col(c).isin(*allowed), F.col(c)).otherwise(default)
    f = f.withColumn("object_type", clamp("object_type", ("entity", "literal"), "entity")).withColumn("certainty", clamp("certainty", ("stated", "inferred", "speculative"), "stated")).withColumn("assertion_source", clamp("assertion_source", ("user", "tool_result", "model"), "model"))
    obj = F.when(F.col("object_type") == "literal", normalize_literal("object")).otherwise(F.trim("object"))
    return f.select("id", F.trim("subject").alias("subject"), "predicate", obj.alias("object"), "object_type", "certainty", "assertion_source", "valid_at", F.coalesce("negation", F.lit(False)).alias("negation"))


def dead_letters(failed: DataFrame) -> DataFrame:
    """Episodes that have used up their retries; the others go on with one more."""
    f = failed.withColumn("retries", F.col("retries") + 1)
    return f.withColumn("status", F.when(F.col("retries") >= MAX_RETRIES, "dead").otherwise("retry")).withColumn("content", clip("content", DEAD_LETTER_CHARS))


def all_names(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Every name to resolve: entities, subjects, and objects that are entities."""
    return entities.select("name").union(facts.select("subject")).union(facts.filter("object_type = 'entity'").select("object")).distinct()


def resolve_names(names: DataFrame, aliases: DataFrame, entity_vectors: DataFrame | VectorIndex | None = None, embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(name, norm, entity_id, how): alias, else the nearest entity by cosine from 0.95 (merged) or from 0.80 (ambiguous: kept apart for review),
    else a new entity, whose id is that of the first spelling of the normalised name. With an index of entity vectors only near cells are compared."""
    from .retrieval import vector_search

    n = names.select("name", normalize_name("name").alias("norm"))
    known = n.join(aliases.hint("merge"), "norm", "left")
    out = known.filter("entity_id is not null").withColumn("how", F.lit("alias"))
    rest = known.filter("entity_id is null").drop("entity_id")
    new_id = F.concat(F.lit("new:"), F.substring(F.sha2(F.min("name").over(Window.partitionBy("norm")).cast("binary"), 256), 1, 16))
    if entity_vectors is not None and embed is not None:
        near = vector_search(embed(rest.select(F.col("norm").alias("qid")).distinct()), entity_vectors, 1).select(F.col("qid").alias("norm"), F.col("id").alias("_near"), "score")
        rest = rest.join(near.hint("merge"), "norm", "left")
    else:
        rest = rest.withColumn("_near", F.lit(None).cast("string")).withColumn("score", F.lit(0.0))
    merged = F.col("score") >= MERGE_FROM
    rest = rest.withColumn("entity_id", F.when(merged, F.col("_near")).otherwise(new_id)).withColumn("how", F.when(merged, "merged").when(F.col("score") >= AMBIGUOUS_FROM, "ambiguous").otherwise("new"))
    return out.select("name", "norm", "entity_id", "how").unionByName(rest.select("name", "norm", "entity_id", "how"))


def first_seen(names: DataFrame) -> DataFrame:
    """(norm, entity_id): of names (name, entity_id, seq) that are one when normalised, the entity that was seen first."""
    return names.groupBy(normalize_name("name").alias("norm")).agg(F.min_by("entity_id", F.struct("seq", "entity_id")).alias("entity_id"))


def new_entities(resolved: DataFrame, mentions: DataFrame, now) -> DataFrame:
    """(id, name, type, summary, created_at) of entities that `resolved` (`resolve_names`) makes: the least spelling, with the type and summary of a
    mention (name, type, summary), the longest summary if there are several."""
    made = resolved.filter(F.col("how").isin("new", "ambiguous"))
    said = mentions.groupBy("name").agg(F.max_by(F.struct("type", "summary"), F.struct(F.length("summary"), "summary", "type")).alias("m"))
    rows = made.hint("merge").join(said, "name", "left").groupBy("entity_id").agg(F.min("name").alias("name"), F.max_by("m", F.struct(F.length("m.summary"), "m")).alias("m"))
    return rows.select(F.col("entity_id").alias("id"), "name", F.coalesce("m.type", F.lit("entity")).alias("type"), F.coalesce("m.summary", F.lit("")).alias("summary"), F.lit(now).cast("timestamp").alias("created_at"))


def new_aliases(resolved: DataFrame, aliases: DataFrame) -> DataFrame:
    """(norm, entity_id): normalised names that have no alias yet, of new entities and of those that a name was merged into."""
    return resolved.filter("how <> 'alias'").select("norm", "entity_id").distinct().hint("merge").join(aliases.select("norm"), "norm", "left_anti")


def fact_log(facts: DataFrame, resolved: DataFrame, episodes: DataFrame, vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the fact log and of its evidence (id, fact_id, episode_id) for validated facts, whose `id` is the episode's. Ids are repeatable, so facts that
    an episode states twice, or that are written again, are one. A subject without an entity is left out, an object without one keeps its text."""
    who = lambda c: resolved.select(F.col("name").alias(c), F.col("entity_id").alias(f"{c}_id")).distinct()
    e = episodes.select(F.col("id").alias("episode_id"), "namespace", "recorded_at")
    f = facts.withColumnRenamed("id", "episode_id").hint("merge").join(e, "episode_id").join(F.broadcast(vocab), "predicate")  # 70 rows
    f = f.hint("merge").join(who("subject"), "subject").hint("merge").join(who("object"), "object", "left").withColumn("object_id", F.when(F.col("object_type") == "entity", F.col("object_id")))
    valid_at, inferred = resolve_valid_at("valid_at", "recorded_at")
    name = F.concat_ws("|", "episode_id", "subject_id", "predicate", "object", F.col("negation").cast("string"))
    f = f.withColumn("id", F.concat(F.lit("fact:"), F.substring(F.sha2(name.cast("binary"), 256), 1, 16)))
    log = f.select(
        "id", "subject_id", "predicate", "object_id", F.when(F.col("object_id").isNull(), F.col("object")).alias("object_value"), "object_type", statement("subject", "predicate", "object").alias("statement"), "functional", "negation", "certainty",
        "assertion_source", F.lit("active").alias("epistemic_state"), valid_at.alias("valid_at"), inferred.alias("valid_at_inferred"), F.lit(None).cast("timestamp").alias("invalid_at"), "recorded_at", "namespace", "episode_id",
    ).dropDuplicates(["id"])
    return log, log.select(F.concat(F.lit("ev:"), F.substring("id", 6, 16)).alias("id"), F.col("id").alias("fact_id"), "episode_id")


def embed_texts(rows: DataFrame, model: Callable[[str], list[float] | None], dim: int) -> DataFrame:
    """Add `embedding` (array<float>) of `text` by the user's model; blank text, a failure or a wrong dimension is null."""
    rows = rows.select("id", "text")

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                try:
                    v = model(t) if t and t.strip() else None
                    out.append([float(x) for x in v] if v is not None and len(v) == dim else None)
                except Exception:  # the model is the user's; a failure has no vector
                    out.append(None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float32()))], ["id", "text", "embedding"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string, embedding array<float>")
