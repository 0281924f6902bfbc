"""Queries of the bitemporal operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal as T
from ..sources import event_facts, vocabulary
from .views import FACTS, STATE

MID = "2024-01-15 00:00:00"
MICROS = lambda c: F.unix_micros(c).alias(f"{c}_us")


def _state(spark, d):
    return T.with_state(event_facts(spark, d))


def t3_fact_state(spark, d):
    return _state(spark, d).select("id", "write_kind", "epistemic_state", MICROS("invalid_at"), "ended_by")


def t4_state_summary(spark, d):
    return _state(spark, d).groupBy("predicate", "write_kind", "epistemic_state").agg(F.count("*").alias("n"))


def t6_state_edges(spark, d):
    return T.state_edges(_state(spark, d))


def w6_version_chain(spark, d):
    f = event_facts(spark, d).filter("functional and not negation")
    return T.version_chain(f).select("id", "version", MICROS("invalid_at"))


def t1_as_of_knowledge(spark, d):
    return T.known_at(_with_mid(spark, d, event_facts(spark, d)), F.col("_mid")).select("id", "subject_id", "statement", MICROS("recorded_at"))


def t2_as_of_world(spark, d):
    return T.true_at(_with_mid(spark, d, _state(spark, d)), F.col("_mid")).select("id", "subject_id", "statement", "epistemic_state", MICROS("valid_at"), MICROS("invalid_at"))


def _with_mid(spark, d, rows):
    """Add the time half way through what was recorded, to the hour: a table of one row, broadcast."""
    mid = event_facts(spark, d).agg(F.expr("date_trunc('hour', timestamp_micros((unix_micros(min(recorded_at)) + unix_micros(max(recorded_at))) div 2))").alias("_mid"))
    return rows.crossJoin(F.broadcast(mid))


def j12_interval_join(spark, d):
    asked = event_facts(spark, d).groupBy("subject_id").agg(F.max("recorded_at").alias("at"))
    return T.true_for(_state(spark, d), asked).groupBy("subject_id").agg(F.count("*").alias("n_true"), F.min("id").alias("least_id"))


def t8_history_counts(spark, d):
    f, s = (_with_mid(spark, d, x) for x in (event_facts(spark, d), _state(spark, d)))
    one = lambda mode: T.history(f, s, mode, F.col("_mid")).groupBy("namespace").agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "namespace", "n")
    return one("knowledge").unionByName(one("world"))


def t11_supersession_chain(spark, d):
    return T.supersession_chain(T.state_edges(_state(spark, d)))


def t12_timeline(spark, d):
    return T.timeline(event_facts(spark, d)).select("id", F.col("position").cast("long").alias("position"), "before_id", F.col("gap_us"))


def t7_odd_intervals(spark, d):
    return T.odd_intervals(_state(spark, d)).groupBy("predicate").agg(F.count("*").alias("n_never_true"))


def j13_unsupported_facts(spark, d):
    """Facts that no other fact ended and that ended none."""
    s = _state(spark, d)
    touched = T.state_edges(s).select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    return s.select("id", "subject_id").hint("merge").join(touched, "id", "left_anti")


def p7_functional_by_vocabulary(spark, d):
    """The vocabulary is 70 rows, so it is broadcast."""
    f = event_facts(spark, d).drop("functional")
    return f.join(F.broadcast(vocabulary(spark)), "predicate").groupBy("predicate", "functional").agg(F.count("*").alias("n"))


_M = "(SELECT date_trunc('hour', make_timestamp((epoch_us(min(recorded_at)) + epoch_us(max(recorded_at))) // 2)) FROM facts)"
SQL = {
    "t3_fact_state": f"WITH {STATE} SELECT id, write_kind, epistemic_state, epoch_us(invalid_at) AS invalid_at_us, ended_by FROM state",
    "t4_state_summary": f"WITH {STATE} SELECT predicate, write_kind, epistemic_state, count(*) AS n FROM state GROUP BY ALL",
    "t6_state_edges": f"WITH {STATE} SELECT CASE WHEN epistemic_state = 'superseded' THEN 'SUPERSEDES' ELSE 'CONTRADICTS' END AS kind, ended_by AS from_id, id AS to_id FROM state WHERE ended_by IS NOT NULL",
    "w6_version_chain": f"""WITH {FACTS}, f AS (SELECT * FROM facts WHERE functional AND NOT negation),
 v AS (SELECT *, CASE WHEN object_value <> lag(object_value) OVER w THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY subject_id, predicate, namespace ORDER BY recorded_at, seq)),
 g AS (SELECT *, sum(new) OVER (PARTITION BY subject_id, predicate, namespace ORDER BY recorded_at, seq) AS version FROM v),
 heads AS (SELECT subject_id, predicate, namespace, version, arg_min(valid_at, seq) AS starts FROM g GROUP BY ALL)
 SELECT g.id, CAST(g.version AS BIGINT) AS version, epoch_us(h.starts) AS invalid_at_us FROM g LEFT JOIN heads h ON g.subject_id = h.subject_id AND g.predicate = h.predicate AND g.namespace = h.namespace AND h.version = g.version + 1""",
    "t1_as_of_knowledge": f"WITH {FACTS} SELECT id, subject_id, statement, epoch_us(recorded_at) AS recorded_at_us FROM facts WHERE recorded_at <= {_M}",
    "t2_as_of_world": f"WITH {STATE} SELECT id, subject_id, statement, epistemic_state, epoch_us(valid_at) AS valid_at_us, epoch_us(invalid_at) AS invalid_at_us FROM state WHERE valid_at <= {_M} AND (invalid_at IS NULL OR invalid_at > {_M})",
    "j12_interval_join": f"WITH {STATE}, q AS (SELECT subject_id, max(recorded_at) AS asked_at FROM facts GROUP BY 1) SELECT s.subject_id, count(*) AS n_true, min(id) AS least_id FROM state s JOIN q ON s.subject_id = q.subject_id AND valid_at <= asked_at AND (invalid_at IS NULL OR invalid_at > asked_at) GROUP BY 1",
    "t8_history_counts": f"WITH {STATE} SELECT 'knowledge' AS mode, namespace, count(*) AS n FROM facts WHERE recorded_at <= {_M} GROUP BY 2 UNION ALL SELECT 'world', namespace, count(*) FROM state WHERE valid_at <= {_M} AND (invalid_at IS NULL OR invalid_at > {_M}) GROUP BY 2",
    "t11_supersession_chain": f"""WITH RECURSIVE {STATE}, e AS (SELECT id, ended_by AS nxt FROM state WHERE epistemic_state = 'superseded'),
 walk AS (SELECT id, nxt AS head, 1 AS length FROM e UNION ALL SELECT w.id, e.nxt, w.length + 1 FROM walk w JOIN e ON w.head = e.id) SELECT id, arg_max(head, length) AS head, CAST(max(length) AS BIGINT) AS length FROM walk GROUP BY id""",
    "t12_timeline": f"""WITH {FACTS} SELECT id, row_number() OVER w AS position, lag(id) OVER w AS before_id, epoch_us(valid_at) - epoch_us(lag(valid_at) OVER w) AS gap_us FROM facts WINDOW w AS (PARTITION BY subject_id ORDER BY valid_at, seq)""",
    "t7_odd_intervals": f"WITH {STATE} SELECT predicate, count(*) AS n_never_true FROM state WHERE invalid_at <= valid_at GROUP BY 1",
    "j13_unsupported_facts": f"WITH {STATE} SELECT id, subject_id FROM state WHERE ended_by IS NULL AND id NOT IN (SELECT ended_by FROM state WHERE ended_by IS NOT NULL)",
    "p7_functional_by_vocabulary": f"WITH {FACTS} SELECT predicate, functional, count(*) AS n FROM facts GROUP BY ALL",
}
QUERIES = {n: globals()[n] for n in SQL}
