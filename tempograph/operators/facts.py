"""Filters, joins, aggregates, ranks and set operations over facts and entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import passes_assertion_gate
from .ordered import positions


BROADCAST_REQUESTS = 100_000
SALT = 64


def in_namespaces(facts: DataFrame, *namespaces: str) -> DataFrame:
    return facts.filter(F.col("namespace").isin(*namespaces))


def allowed(facts: DataFrame, keys: DataFrame, requests: DataFrame) -> DataFrame:
    """Facts that each request (qid, token) may see: its active key's namespaces. Up to BROADCAST_REQUESTS pairs of request and namespace go to every task; beyond that
    facts are joined by namespace in SALT parts, as namespaces are few."""
    key = keys.filter("active").select("key_hash", F.explode("namespaces").alias("namespace"))
    seen = requests.withColumn("key_hash", F.sha2(F.col("token").cast("binary"), 256)).hint("merge").join(key, "key_hash").select("qid", "namespace").distinct()
    if seen.limit(BROADCAST_REQUESTS + 1).count() <= BROADCAST_REQUESTS:
        return facts.join(F.broadcast(seen), "namespace")
    parts = seen.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return facts.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).hint("merge").join(parts, ["namespace", "_salt"]).drop("_salt")


def valid_vocabulary(facts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Facts with a known predicate. The vocabulary is a fixed list of 70 rows."""
    return facts.join(F.broadcast(vocab.select("predicate")), "predicate", "left_semi")


def gated(facts: DataFrame) -> DataFrame:
    return facts.filter(passes_assertion_gate("assertion_source"))


def with_subject(facts: DataFrame, entities: DataFrame) -> DataFrame:
    return facts.join(entities.select(F.col("id").alias("subject_id"), F.col("name").alias("subject_name")), "subject_id")


def with_object(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Object text: the entity's name, else the literal value."""
    names = entities.select(F.col("id").alias("object_id"), F.col("name").alias("_name"))
    value = F.col("object_value") if "object_value" in facts.columns else F.lit(None).cast("string")
    return facts.join(names, "object_id", "left").withColumn("object", F.coalesce("_name", value)).drop("_name")


def roles(facts: DataFrame) -> DataFrame:
    """Each fact once for each entity in it, with the entity's role. A union of two projections, not an OR join."""
    rest = [c for c in facts.columns if c not in ("entity_id", "role")]
    one = lambda c, r: facts.filter(F.col(c).isNotNull()).select(F.col(c).alias("entity_id"), F.lit(r).alias("role"), *rest)
    return one("subject_id", "subject").unionByName(one("object_id", "object"))


def totals(state: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Counts by state in one pass, and of entities if they are given."""
    n = lambda c: F.count(F.when(c, 1))
    out = state.agg(
        F.count("*").alias("facts"), n(F.col("epistemic_state") == "active").alias("active"), n(F.col("epistemic_state") == "superseded").alias("superseded"),
        n(F.col("epistemic_state") == "contradicted").alias("contradicted"), F.countDistinct("subject_id").alias("subjects"), F.countDistinct("episode_id").alias("episodes"), n(F.col("object_type") == "literal").alias("literals"),
    )
    return out if entities is None else out.crossJoin(F.broadcast(entities.agg(F.count("*").alias("entities"))))  # one row each


def dispositions(namespaces: DataFrame, defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """(namespace, skepticism, literalism, empathy): an override's value where there is one, else the namespace's default, else that of `shared`. Both tables are
    (namespace, trait, value), one row for each setting."""
    traits = ("skepticism", "literalism", "empathy")
    wide = lambda df, p: df.groupBy("namespace").agg(*(F.max(F.when(F.col("trait") == t, F.col("value"))).alias(f"{p}{t}") for t in traits))
    shared = wide(defaults.filter("namespace = 'shared'"), "s_").drop("namespace")  # one row
    j = namespaces.select("namespace").distinct().hint("merge").join(wide(defaults, "d_"), "namespace", "left").hint("merge").join(wide(overrides, "o_"), "namespace", "left").join(F.broadcast(shared), F.lit(True), "left")
    return j.select("namespace", *(F.coalesce(f"o_{t}", f"d_{t}", f"s_{t}").alias(t) for t in traits))


def top_predicates(facts: DataFrame, k: int = 10) -> DataFrame:
    return facts.groupBy("predicate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicate").limit(k)


def entity_facts(asked: DataFrame, entities: DataFrame, facts: DataFrame) -> DataFrame:
    """The page of each entity asked for (qid, key: id or name): (qid, entity_id, name, role, id, subject_name, predicate, object, valid_at, place), the newest valid_at first, then id."""
    from .retrieval import find_entities

    met = find_entities(asked, entities)
    mine = roles(facts).hint("merge").join(met, "entity_id")
    called = lambda key, name: entities.select(F.col("id").alias(key), F.col("name").alias(name))
    named = mine.hint("merge").join(called("entity_id", "name"), "entity_id").hint("merge").join(called("subject_id", "subject_name"), "subject_id", "left").hint("merge").join(called("object_id", "object"), "object_id", "left")
    place = F.row_number().over(Window.partitionBy("qid", "entity_id").orderBy(F.desc_nulls_last("valid_at"), "id", "role")).alias("place")
    return named.select("qid", "entity_id", "name", "role", "id", "subject_name", "predicate", "object", "valid_at", place)


def entity_page(entities: DataFrame, facts: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Entities by number of facts about them, one page, with the total."""
    n = facts.groupBy(F.col("subject_id").alias("id")).agg(F.count("*").alias("n_facts"))
    page = entities.join(n, "id", "left").withColumn("n_facts", F.coalesce("n_facts", F.lit(0))).orderBy(F.desc("n_facts"), "name", "id").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(entities.agg(F.count("*").alias("total"))))  # one row


def newest_per_group(facts: DataFrame, keys: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("recorded_at"), F.desc("seq"))
    return facts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def top_k(rows: DataFrame, k: int, by: list[Column], within: str | None = None) -> DataFrame:
    """Best k rows, of each group if `within` is given; `by` must order all rows."""
    if within is None:
        return rows.orderBy(*by).limit(k)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(within).orderBy(*by))).filter(F.col("place") <= k)


def first_seen_union(lists: list[DataFrame], key: str, order: str) -> DataFrame:
    """Union of ranked lists; a key that is in several keeps its row of the earliest list, then rank."""
    tagged = [df.withColumn("_list", F.lit(i)) for i, df in enumerate(lists)]
    every = reduce(lambda a, b: a.unionByName(b), tagged)
    w = Window.partitionBy(key).orderBy("_list", order)
    return every.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").withColumnRenamed("_list", "list_no")


def by_priority(lists: list[DataFrame], qid: str, order: str, limit: int) -> DataFrame:
    """For each query all of the first list, then of the second, ..., cut at `limit`."""
    every = reduce(lambda a, b: a.unionByName(b), [df.withColumn("tier", F.lit(i)) for i, df in enumerate(lists)])
    w = Window.partitionBy(qid).orderBy("tier", order)
    return every.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def fallback(first: DataFrame, second: DataFrame, qid: str = "qid") -> DataFrame:
    """The second list only for queries for which the first has nothing."""
    return first.unionByName(second.hint("merge").join(first.select(qid).distinct(), qid, "left_anti"))


def within_budget(rows: DataFrame, qid: str, order: str, cost: Column, budget: int) -> DataFrame:
    """The first rows whose summed cost stays in the budget."""
    w = Window.partitionBy(qid).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(cost).over(w)).filter(F.col("spent") <= budget)


def counters(metrics: DataFrame) -> DataFrame:
    """Totals by name and tags, the order of tags aside."""
    tags = F.array_join(F.array_sort(F.transform(F.map_entries("tags"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return metrics.groupBy("name", tags.alias("tags")).agg(F.sum("value").alias("total"))


def gauges(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("name").agg(F.max_by("value", F.struct("ts", "id")).alias("value"))


def histograms(metrics: DataFrame) -> DataFrame:
    """Count, least, greatest, mean and last of the history that is kept: past 1,000 values it is cut to the newest 500. Places are taken over all tasks, so a name may have any
    number of values."""
    n = metrics.groupBy("name").agg(F.count("*").alias("_n"))
    keep = F.when(F.col("_n") <= 1000, F.col("_n")).otherwise(500 + (F.col("_n") - 1001) % 501)
    newest = positions(metrics.select("name", "ts", "id", "value"), ["name"], [F.desc("ts"), F.desc("id")], "_new").filter("_new <= 1000")
    kept = newest.hint("merge").join(n.select("name", keep.alias("_keep")), "name").filter("_new <= _keep")
    return kept.groupBy("name").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.max_by("value", F.struct("ts", "id")).alias("last"))


def latency_summary(requests: DataFrame, by: str, points=(0.5, 0.95, 0.99)) -> DataFrame:
    """Counts of outcomes and latency quantiles at position q * (n + 1), interpolated. Ranks are taken over all tasks; of the sorted values only those of the ranks
    wanted, two for each quantile, are joined."""
    n = lambda c: F.count(F.when(c, 1))
    counts = requests.groupBy(by).agg(F.count("*").alias("n"), n(F.col("status") == 200).alias("ok"), n(F.col("status") == 429).alias("rate_limited"), n(~F.col("status").isin(200, 429)).alias("errors"))
    sorted_ms = positions(requests.filter("status = 200 and ms is not null").select(by, "ms"), [by], [F.col("ms")], "_r")
    usable = sorted_ms.groupBy(by).agg(F.max("_r").alias("_n"))
    each = usable.select(by, "_n", F.explode(F.array(*(F.struct(F.lit(f"p{int(q * 100)}").alias("p"), F.lit(q).alias("q")) for q in points))).alias("_q")).select(by, "_n", "_q.*")
    at = F.col("q") * (F.col("_n") + 1)
    low = F.least(F.greatest(F.floor(at), F.lit(1)), F.col("_n") - 1)
    two = each.select(by, "p", F.explode(F.array(F.struct(low.alias("_r"), (1 - (at - low)).alias("_w")), F.struct((low + 1).alias("_r"), (at - low).alias("_w")))).alias("_x")).select(by, "p", "_x.*")
    met = sorted_ms.hint("merge").join(two, [by, "_r"])
    quantiles = met.groupBy(by).agg(*(F.sum(F.when(F.col("p") == f"p{int(q * 100)}", F.col("ms") * F.col("_w"))).alias(f"p{int(q * 100)}") for q in points))
    return counts.hint("merge").join(quantiles, by, "left")


def provenance(facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """(fact_id, level, value): agent, channel, session, episode and source of each fact, with defaults. `source` of episodes is JSON text."""
    from ..functions import parse_source

    e = episodes.select(F.col("id").alias("episode_id"), parse_source("source").alias("_m"))
    get = lambda k, d: F.coalesce(F.try_element_at("_m", F.lit(k)), F.lit(d))
    chain = [("agent", get("agent", "unknown")), ("channel", get("channel", "unknown")), ("session", get("session", "unknown")), ("episode", F.col("episode_id")), ("source", get("type", "session_transcript"))]
    levels = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(k).alias("level"), v.alias("value")) for i, (k, v) in enumerate(chain)))
    return facts.select(F.col("id").alias("fact_id"), "episode_id").join(e, "episode_id").select("fact_id", F.explode(levels).alias("x")).select("fact_id", "x.step", "x.level", "x.value")
