"""Queries of retrieval, vector and graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cosine
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import vector_index as V
from ..operators.search_index import build
from ..sources import aliases, entities, graph_facts, query_batch, statements, table
from ..sources.scratch import written
from .views import ENTITIES, GRAPH, QUERIES as ASKED, STATEMENTS


def _asked(spark, d):
    """Every third query names a month."""
    return query_batch(spark, d).withColumn("text", F.when(F.col("qid") % 3 == 0, F.concat("text", F.lit(" in january"))).otherwise(F.col("text")))


def _rank(df):
    return df.select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


def r1_bm25(spark, d):
    return _rank(R.keyword_search(_asked(spark, d), statements(spark, d), 10))


def r1_bm25_namespace(spark, d):
    return _rank(R.keyword_search(_asked(spark, d), statements(spark, d), 10, "fr"))


def _vectors(spark, d):
    v = table(spark, d, "embeddings")
    return v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding"), v.select(F.col("vec_id").alias("id"), "embedding")


def r2_vector_top_k(spark, d):
    q, v = _vectors(spark, d)
    return _rank(R.vector_search(q, v, 10))


def j7_vector_index(spark, d):
    """The same queries by an inverted file: not exact, see its test for what it finds."""
    q, v = _vectors(spark, d)
    return _rank(V.search(V.build(v), q, 10).hits)


def f4_cosine(spark, d):
    """Each vector with the next one."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(cosine("embedding", "other"), 5).alias("cosine"))


def s16_usable_vectors(spark, d):
    return table(spark, d, "embeddings").filter("size(embedding) = 64").groupBy("label").agg(F.count("*").alias("n"))


def r5_temporal(spark, d):
    return _rank(R.temporal_search(_asked(spark, d), statements(spark, d), 20))


def r6_recency(spark, d):
    return _rank(R.recency_search(_asked(spark, d), statements(spark, d), 20, 40))


def r8_fused_by_state(spark, d):
    q, s = _asked(spark, d), statements(spark, d)
    index = build(s, asked=q)
    return _rank(R.by_state(R.fuse([R.keyword_search(q, s, 20, index=index), R.recency_search(q, s, 20, 40, index)]), s))


def r9_search(spark, d):
    return _rank(R.search(_asked(spark, d), statements(spark, d), 10))


def r13_inject(spark, d):
    s = statements(spark, d)
    return R.inject(R.search(_asked(spark, d), s, 20), s).select("qid", "id", "spent")


def r4_graph(spark, d):
    """Suppliers of a number divisible by 100, asked for by the start of their nation's name and by their number."""
    facts = graph_facts(spark, d).withColumn("id", F.concat_ws(">", "subject_id", "predicate", "object_id"))
    nations = F.broadcast(table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"))  # 25 rows
    asked = table(spark, d, "supplier").filter("s_suppkey % 100 = 0").join(nations, "s_nationkey").select(F.col("s_suppkey").alias("qid"), F.lower(F.concat_ws(" ", F.substring("n_name", 1, 5), F.regexp_extract("s_name", "[0-9]+", 0))).alias("text"))
    return _rank(R.graph_search(asked, facts, entities(spark, d))).drop("score")


def r12_pending(spark, d):
    s = statements(spark, d).select("id", F.col("statement").alias("content"), F.col("recorded_at").alias("queued_at"))
    return _rank(R.pending_search(_asked(spark, d), s, "2026-01-04 00:00:00", 1000, 86400))


def x6_still_pending(spark, d):
    """What waits, without what was ingested meanwhile."""
    s = statements(spark, d).select("id", F.col("statement").alias("content"), F.col("recorded_at").alias("queued_at"))
    return _rank(R.pending_search(_asked(spark, d), s, "2026-01-04 00:00:00", 1000, 86400, 10, s.filter("id like '%3'")))


def r3_hybrid(spark, d):
    """Queries of a number divisible by 100. Query and statement vectors of the same number stand in for embedded texts."""
    v = table(spark, d, "embeddings")
    qv = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    sv = v.select(F.concat(F.lit("d"), F.col("vec_id")).alias("id"), "embedding")
    return _rank(R.hybrid_search(_asked(spark, d).filter("qid % 100 = 0"), statements(spark, d), qv, sv, 10))


def r11_scoped(spark, d):
    q = _asked(spark, d)
    allowed = q.select("qid", F.when(F.col("qid") % 2 == 0, "fr").otherwise("de").alias("namespace"))
    s = statements(spark, d).select("id", F.col("statement").alias("content"), F.col("recorded_at").alias("queued_at"))
    return _rank(R.scoped_search(q, statements(spark, d), allowed, R.pending_search(q, s, "2026-01-04 00:00:00", 1000, 86400, 3), 8))


def r14_name_lookup(spark, d):
    """Customers and suppliers of a number divisible by 100, by alias."""
    facts = graph_facts(spark, d).withColumn("id", F.concat_ws(">", "subject_id", "predicate", "object_id"))
    asked = entities(spark, d).filter("(id like 'cust:%' or id like 'supp:%') and cast(substring_index(id, ':', -1) as long) % 100 = 0").select(F.col("id").alias("qid"), F.upper("name").alias("text"))
    return R.name_lookup(asked, aliases(spark, d), facts).select("qid", "id", F.col("tier").cast("long").alias("tier"))


def g1_multi_hop(spark, d):
    seeds = table(spark, d, "supplier").filter("s_suppkey % 100 = 0").select(F.concat(F.lit("supp:"), F.col("s_suppkey")).alias("seed"))
    return G.multi_hop(written(graph_facts(spark, d)), seeds, 3).withColumn("hop", F.col("hop").cast("long"))


def g2_neighbours(spark, d):
    return G.neighbours(graph_facts(spark, d)).select("a", "b", F.array_join("predicates", ",").alias("predicates"))


def g3_backlinks(spark, d):
    return G.backlinks(graph_facts(spark, d))


def g4_connecting_facts(spark, d):
    seeds = table(spark, d, "supplier").filter("s_suppkey % 100 = 0").select(F.concat(F.lit("supp:"), F.col("s_suppkey")).alias("seed")).withColumn("id", F.col("seed"))
    g = graph_facts(spark, d)
    return G.connecting_facts(g, G.reach(g, seeds, 1)).groupBy("seed", "predicate").agg(F.count("*").alias("n"))


def e11_merged_root(spark, d):
    c = table(spark, d, "customer").filter("c_custkey % 5 <> 1 and c_custkey > 0").select(F.concat(F.lit("cust:"), F.col("c_custkey")).alias("source_id"), F.concat(F.lit("cust:"), F.col("c_custkey") - 1).alias("target_id"))
    return G.merged_root(c)


_T = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_MONTH = "SELECT qid, CASE WHEN qid % 3 = 0 THEN text || ' in january' ELSE text END AS text FROM asked"


def bm25_sql(asked: str, texts: str = "SELECT id, statement AS text FROM stmts") -> str:
    """Views q (qid, text) and sc (qid, id, score) for queries `asked` (qid, text) over `texts` (id, text)."""
    return f"""q AS ({asked}), qt AS (SELECT qid, unnest(list_distinct({_T.format('text')})) AS term FROM q), w AS (SELECT id, {_T.format('text')} AS t FROM ({texts})),
 st AS (SELECT count(*) AS n, avg(len(t)) AS av FROM w), p AS (SELECT id, len(t) AS l, unnest(t) AS term FROM w), tf AS (SELECT term, id, l, count(*) AS f FROM p WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
 df AS (SELECT term, count(*) AS d FROM tf GROUP BY 1),
 sc AS (SELECT qid, id, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / av))), 6) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), st GROUP BY 1, 2)"""


LISTS = """jan AS (SELECT qid, TIMESTAMP '2026-01-01' AS a, TIMESTAMP '2026-01-31 23:59:59' AS b FROM q WHERE qid % 3 = 0),
 bm AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc),
 te AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc JOIN jan USING (qid) JOIN stmts USING (id) WHERE epistemic_state = 'active' AND valid_at BETWEEN a AND b),
 rc AS (SELECT qid, id, score, recorded_at, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS c FROM sc JOIN stmts USING (id) WHERE epistemic_state = 'active'),
 re AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY recorded_at DESC, id) AS rank FROM rc WHERE c <= 40)"""
_BM = f"{ASKED}, {STATEMENTS}, {bm25_sql(_MONTH)}, {LISTS}"
_FUSED = """, f AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(struct_pack(l := l, r := rank)) AS seen FROM lists GROUP BY 1, 2),
 fr AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY CASE epistemic_state WHEN 'active' THEN 0 ELSE 1 END, score DESC, seen, id) AS rank FROM f JOIN stmts USING (id) WHERE epistemic_state <> 'superseded')"""
_TWO = ", lists AS (SELECT qid, id, rank, 0 AS l FROM bm WHERE rank <= 20 UNION ALL SELECT qid, id, rank, 1 FROM re WHERE rank <= 20)"
_THREE = ", lists AS (SELECT qid, id, rank, 0 AS l FROM bm WHERE rank <= 20 UNION ALL SELECT qid, id, rank, 1 FROM te WHERE rank <= 20 UNION ALL SELECT qid, id, rank, 2 FROM re WHERE rank <= 20)"
_V = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_LINKS = "l AS (SELECT subject_id AS a, predicate, object_id AS b FROM graph UNION ALL SELECT object_id, predicate, subject_id FROM graph)"
SQL = {
    "r1_bm25": f"WITH {_BM} SELECT * FROM bm WHERE rank <= 10",
    "r1_bm25_namespace": f"WITH {_BM} SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc WHERE id IN (SELECT id FROM stmts WHERE namespace = 'fr') QUALIFY rank <= 10",
    "r2_vector_top_k": f"WITH {_V}, s AS (SELECT q.vec_id AS qid, e.vec_id AS id, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM e q, e WHERE q.vec_id % 100 = 0) SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10",
    "f4_cosine": f"WITH {_V} SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 5) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1",
    "s16_usable_vectors": "SELECT label, count(*) AS n FROM embeddings WHERE len(embedding) = 64 GROUP BY 1",
    "r5_temporal": f"WITH {_BM} SELECT * FROM te WHERE rank <= 20",
    "r6_recency": f"WITH {_BM} SELECT * FROM re WHERE rank <= 20",
    "r8_fused_by_state": f"WITH {_BM}{_TWO}{_FUSED} SELECT * FROM fr",
    "r9_search": f"WITH {_BM}{_THREE}{_FUSED} SELECT * FROM fr WHERE rank <= 10",
    "r13_inject": f"WITH {_BM}{_THREE}{_FUSED}, b AS (SELECT qid, id, CAST(sum(length(statement) // 4) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM fr JOIN stmts USING (id) WHERE rank <= 20 AND score >= 0.001) SELECT * FROM b WHERE spent <= 1500",
    "r4_graph": f"""WITH {ENTITIES}, {GRAPH}, g AS (SELECT *, subject_id || '>' || predicate || '>' || object_id AS id FROM graph), t0 AS (SELECT s_suppkey AS qid, lower(substring(n_name, 1, 5) || ' ' || regexp_extract(s_name, '[0-9]+')) AS text FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 100 = 0),
 t AS (SELECT qid, regexp_extract_all(text, '[a-z0-9]+(?:[-_][a-z0-9]+)*') AS raw FROM t0), w AS (SELECT qid, unnest(list_distinct(raw)) AS word, raw FROM t), wn AS (SELECT qid, word, list_position(raw, word) AS no FROM w), m AS (SELECT DISTINCT qid, no, e.id AS ent FROM wn, ents e WHERE contains(lower(e.name), word)),
 h AS (SELECT DISTINCT qid, no, g.id FROM m JOIN g ON g.subject_id = ent UNION SELECT DISTINCT qid, no, g.id FROM m JOIN g ON g.object_id = ent), k AS (SELECT *, row_number() OVER (PARTITION BY qid, no ORDER BY id) AS p FROM h), o AS (SELECT qid, id, min(no) AS no FROM k WHERE p <= 5 GROUP BY 1, 2)
 SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY no, id) AS rank FROM o QUALIFY rank <= 20""",
    "r12_pending": f"""WITH {ASKED}, {STATEMENTS}, c AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(statement), '[ \\t-\\r]+'), lambda x: x <> '')) AS w FROM stmts WHERE recorded_at > TIMESTAMP '2026-01-03' ORDER BY recorded_at DESC, id LIMIT 1000),
 q AS (SELECT qid, list_distinct(list_filter(string_split(CASE WHEN qid % 3 = 0 THEN text || ' in january' ELSE text END, ' '), lambda x: x <> '')) AS w FROM asked), s AS (SELECT qid, id, round(len(list_intersect(q.w, c.w)) / greatest(len(q.w), 1), 6) AS score FROM q, c)
 SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 10""",
    "x6_still_pending": f"""WITH {ASKED}, {STATEMENTS}, c AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(statement), '[ \\t-\\r]+'), lambda x: x <> '')) AS w FROM stmts WHERE recorded_at > TIMESTAMP '2026-01-03' AND id NOT LIKE '%3' ORDER BY recorded_at DESC, id LIMIT 1000),
 q AS (SELECT qid, list_distinct(list_filter(string_split(CASE WHEN qid % 3 = 0 THEN text || ' in january' ELSE text END, ' '), lambda x: x <> '')) AS w FROM asked), s AS (SELECT qid, id, round(len(list_intersect(q.w, c.w)) / greatest(len(q.w), 1), 6) AS score FROM q, c)
 SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 10""",
    "r3_hybrid": f"""WITH {_BM}, {_V}, s AS (SELECT q.vec_id AS qid, 'd' || e.vec_id AS id, e.vec_id AS n, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM e q, e WHERE q.vec_id % 100 = 0),
 vr AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 20),
 li AS (SELECT qid, id, rank, 0 AS l FROM vr UNION ALL SELECT qid, id, rank, 1 FROM bm WHERE rank <= 20 AND qid % 100 = 0), f AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(struct_pack(l := l, r := rank)) AS seen FROM li GROUP BY 1, 2)
 SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen, id) AS rank FROM f QUALIFY rank <= 10""",
    "r11_scoped": f"""WITH {_BM}, c AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(statement), '[ \\t-\\r]+'), lambda x: x <> '')) AS w FROM stmts WHERE recorded_at > TIMESTAMP '2026-01-03' ORDER BY recorded_at DESC, id LIMIT 1000),
 pq AS (SELECT qid, list_distinct(list_filter(string_split(text, ' '), lambda x: x <> '')) AS w FROM q), ps AS (SELECT qid, id, round(len(list_intersect(pq.w, c.w)) / greatest(len(pq.w), 1), 6) AS score FROM pq, c),
 pr AS (SELECT qid, id, score FROM ps WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 3),
 u AS (SELECT qid, id, score, 0 AS tier FROM sc JOIN stmts USING (id) WHERE namespace = CASE WHEN qid % 2 = 0 THEN 'fr' ELSE 'de' END UNION ALL SELECT qid, 'pending:' || id, score, 1 FROM pr)
 SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY tier, score DESC, id) AS rank FROM u QUALIFY rank <= 8""",
    "r14_name_lookup": f"""WITH {GRAPH}, a AS (SELECT 'cust:' || c_custkey AS qid FROM customer WHERE c_custkey % 100 = 0 UNION ALL SELECT 'supp:' || s_suppkey FROM supplier WHERE s_suppkey % 100 = 0),
 h AS (SELECT qid, subject_id || '>' || predicate || '>' || object_id AS id, 0 AS tier FROM a JOIN graph ON subject_id = qid UNION ALL SELECT qid, subject_id || '>' || predicate || '>' || object_id, 1 FROM a JOIN graph ON object_id = qid)
 SELECT qid, id, CAST(min(tier) AS BIGINT) AS tier FROM h GROUP BY 1, 2""",
    "g1_multi_hop": f"WITH RECURSIVE {GRAPH}, {_LINKS}, walk AS (SELECT 'supp:' || s_suppkey AS seed, 'supp:' || s_suppkey AS id, 0 AS hop FROM supplier WHERE s_suppkey % 100 = 0 UNION SELECT seed, l.b, hop + 1 FROM walk JOIN l ON l.a = walk.id WHERE hop < 3) SELECT seed, id, CAST(min(hop) AS BIGINT) AS hop FROM walk GROUP BY 1, 2 HAVING min(hop) > 0",
    "g2_neighbours": f"WITH {GRAPH}, {_LINKS} SELECT a, b, array_to_string(list_sort(list(DISTINCT predicate)), ',') AS predicates FROM l GROUP BY 1, 2",
    "g3_backlinks": f"WITH {GRAPH} SELECT DISTINCT object_id AS id, subject_id AS referrer FROM graph",
    "g4_connecting_facts": f"""WITH {GRAPH}, {_LINKS}, s AS (SELECT 'supp:' || s_suppkey AS seed FROM supplier WHERE s_suppkey % 100 = 0), near AS (SELECT seed, seed AS id FROM s UNION SELECT seed, b FROM s JOIN l ON l.a = seed)
 SELECT x.seed, predicate, count(*) AS n FROM graph JOIN near x ON x.id = subject_id JOIN near y ON y.id = object_id AND y.seed = x.seed GROUP BY 1, 2""",
    "e11_merged_root": "SELECT 'cust:' || c_custkey AS source_id, 'cust:' || (c_custkey - (c_custkey - 1) % 5) AS root FROM customer WHERE c_custkey % 5 <> 1 AND c_custkey > 0",
}
QUERIES = {n: globals()[n] for n in (*SQL, "j7_vector_index")}
