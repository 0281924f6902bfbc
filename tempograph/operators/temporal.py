"""Bitemporal operators over an append-only log of facts.

Nothing is deleted. What a fact's state is, when it stopped being true and which fact ended it are derived from the log
with windows over each key, so a key of any size streams through a sort and no state is kept in Python.

The write rule, in order of (recorded_at, seq) within a key (subject, predicate, namespace):
a functional fact supersedes all active facts of another object; else a fact of opposite polarity to active facts of its object
contradicts all of them and itself; else it is plain. Facts of plural predicates meet only facts of their own object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ordered import positions

KEY = ("subject_id", "predicate", "namespace")
ORDER = ("recorded_at", "seq")


def _lane() -> Column:
    """Plural predicates are told apart by object too."""
    return F.when(F.col("functional"), F.lit("")).otherwise(F.coalesce("object_value", F.lit("")))


def with_state(facts: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Add write_kind, epistemic_state, invalid_at and ended_by (the id of the fact that ended it)."""
    lane = Window.partitionBy(*KEY, "_lane")
    w = lane.orderBy(*order)
    f = facts.withColumn("_lane", _lane())
    same = F.coalesce("object_value", F.lit("")) == F.lag(F.coalesce("object_value", F.lit(""))).over(w)
    f = f.withColumn("_first", F.row_number().over(w) == 1).withColumn("_same", F.coalesce(same, F.lit(False)))
    f = f.withColumn("_flip", F.col("_same") & (F.col("negation") != F.lag("negation").over(w)))
    # A contradicting write empties the active set, so within a run of flips every second one finds nothing to contradict.
    f = f.withColumn("_run", F.sum(F.when(F.col("_flip"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    f = f.withColumn("_contradicts", F.col("_flip") & ((F.row_number().over(Window.partitionBy(*KEY, "_lane", "_run").orderBy(*order)) % 2) == 0))
    emptied = F.coalesce(F.lag("_contradicts").over(w), F.lit(False))
    f = f.withColumn("_supersedes", F.col("functional") & ~F.col("_first") & ~F.col("_same") & ~emptied)
    kind = F.when(F.col("_supersedes"), "supersede").when(F.col("_contradicts"), "contradict").otherwise("plain")
    f = f.withColumn("write_kind", kind)
    # The next write that ends something ends every fact still active before it. Read backwards, it is a running "last".
    back = lane.orderBy(*(F.col(c).desc() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    event = F.when(F.col("write_kind") != "plain", F.struct("write_kind", "id", "valid_at"))
    f = f.withColumn("_end", F.last(event, ignorenulls=True).over(back))
    own = F.col("write_kind") == "contradict"
    ended = F.col("_end.write_kind")
    f = f.withColumn("epistemic_state", F.when(own | (ended == "contradict"), "contradicted").when(ended == "supersede", "superseded").otherwise("active"))
    f = f.withColumn("invalid_at", F.when(F.col("epistemic_state") == "superseded", F.col("_end.valid_at"))).withColumn("ended_by", F.when(~own, F.col("_end.id")))
    return f.drop("_lane", "_first", "_same", "_flip", "_run", "_contradicts", "_supersedes", "_end")


def version_chain(facts: DataFrame) -> DataFrame:
    """For functional facts without negation: the next differing object of a key closes all of the run before it."""
    w = Window.partitionBy(*KEY).orderBy(*ORDER)
    f = facts.withColumn("_new", F.coalesce((F.col("object_value") != F.lag("object_value").over(w)).cast("int"), F.lit(0)))
    f = f.withColumn("version", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy(*KEY).orderBy(*(F.col(c).desc() for c in ORDER)).rowsBetween(Window.unboundedPreceding, -1)
    return f.withColumn("invalid_at", F.last(F.when(F.col("_new") == 1, F.col("valid_at")), ignorenulls=True).over(back)).drop("_new")


def state_edges(state: DataFrame) -> DataFrame:
    """(kind, from_id, to_id): which fact superseded or contradicted which."""
    return state.filter("ended_by is not null").select(F.when(F.col("epistemic_state") == "superseded", "SUPERSEDES").otherwise("CONTRADICTS").alias("kind"), F.col("ended_by").alias("from_id"), F.col("id").alias("to_id"))


def known_at(facts: DataFrame, when) -> DataFrame:
    """What had been recorded by a time."""
    return facts.filter(F.col("recorded_at") <= F.lit(when).cast("timestamp"))


def true_at(state: DataFrame, when) -> DataFrame:
    """What was true at a time; an empty interval never is."""
    t = F.lit(when).cast("timestamp")
    return state.filter((F.col("valid_at") <= t) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > t)))


def true_for(state: DataFrame, asked: DataFrame) -> DataFrame:
    """The same for a table of (subject_id, at, ...), as a sweep: in one order of all times of a subject, a running count of questions says which questions, by number, lie in
    a fact's interval; so what is joined is what is found, however many versions and times a subject has. `id` has to be unique."""
    points = asked.filter("at is not null").select("subject_id", F.col("at").cast("timestamp").alias("_t")).distinct()
    facts = state.filter("valid_at is not null").hint("merge").join(points.select("subject_id").distinct(), "subject_id", "left_semi")
    end = lambda t, kind, row: facts.select("subject_id", F.col(t).alias("_t"), F.lit(kind).alias("_kind"), F.col("id").alias("_id"), row.alias("_row"))
    whole = F.struct(*(c for c in facts.columns if c != "subject_id"))
    times = end("valid_at", 0, whole).unionByName(end("invalid_at", 1, F.when(F.lit(False), whole))).unionByName(points.withColumn("_kind", F.lit(2)), allowMissingColumns=True)
    # Ends before questions of the same time: an interval holds its first moment and not its last. No end comes after all questions.
    counted = positions(times.withColumn("_q", (F.col("_kind") == 2).cast("int")), ["subject_id"], [F.asc_nulls_last("_t"), F.col("_kind"), F.col("_id")], "_n", "_q")
    at = lambda kind: F.max(F.when(F.col("_kind") == kind, F.col("_n")))
    spans = counted.filter("_kind < 2").groupBy("subject_id", "_id").agg(at(0).alias("_from"), at(1).alias("_to"), F.first("_row", ignorenulls=True).alias("_row")).filter("_from < _to")
    hits = spans.select("subject_id", "_row", F.explode(F.sequence(F.col("_from") + 1, F.col("_to"))).alias("_n"))
    when = counted.filter("_kind = 2").select("subject_id", "_n", "_t")
    found = hits.hint("merge").join(when, ["subject_id", "_n"]).select("subject_id", "_t", "_row.*")
    both = asked.withColumn("_t", F.col("at").cast("timestamp")).hint("merge").join(found, ["subject_id", "_t"])
    return both.drop("_t")


def history(facts: DataFrame, state: DataFrame, mode: str, when) -> DataFrame:
    """By `mode`: "knowledge" or "world"."""
    return known_at(facts, when) if mode == "knowledge" else true_at(state, when)


def supersession_chain(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(id, head, length): the fact that is current at the end of each superseded fact's chain. Each round doubles the distance."""
    now = edges.filter("kind = 'SUPERSEDES'").groupBy(F.col("to_id").alias("id")).agg(F.min("from_id").alias("head")).withColumn("length", F.lit(1).cast("long"))
    now = written(now)
    for _ in range(rounds):
        nxt = now.select(F.col("id").alias("head"), F.col("head").alias("_far"), F.col("length").alias("_more"))
        joined = written(now.hint("merge").join(nxt, "head", "left"))
        if joined.filter("_far is not null").isEmpty():
            return now
        now = joined.select("id", F.coalesce("_far", "head").alias("head"), (F.col("length") + F.coalesce("_more", F.lit(0))).alias("length"))
    raise ValueError(f"supersession doesn't end after {rounds} rounds of doubling: some facts form a cycle")


def timeline(facts: DataFrame) -> DataFrame:
    """Facts of a subject by valid_at, with the one before and the gap in microseconds."""
    w = Window.partitionBy("subject_id").orderBy("valid_at", "seq")
    return facts.withColumn("position", F.row_number().over(w)).withColumn("before_id", F.lag("id").over(w)).withColumn("gap_us", F.unix_micros("valid_at") - F.unix_micros(F.lag("valid_at").over(w)))


def odd_intervals(state: DataFrame) -> DataFrame:
    """Facts whose successor became true no later than they did: they never held."""
    return state.filter(F.col("invalid_at") <= F.col("valid_at"))
