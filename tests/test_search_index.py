"""The stored index finds what scoring every statement finds, and scores far fewer pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempograph.operators import retrieval as R
from tempograph.operators import search_index as S


def corpus(seed=1, n=900):
    """Few common words in all texts and many rare ones, with copies."""
    r = random.Random(seed)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(1500)]
    rows = [(f"d{i}", " ".join(r.choices(common, k=r.randint(3, 40)) + r.choices(rare, k=r.randint(0, 12))), f"n{i % 3}") for i in range(n)]
    rows += [(f"e{i}", rows[i % 7][1], "n0") for i in range(60)] + [("empty", "", "n1"), ("null", None, "n2")]
    asked = [(q, " ".join(r.choices(common, k=4) + r.choices(rare, k=r.randint(0, 6)))) for q in range(25)] + [(100, ""), (101, None), (102, "never seen")]
    return rows, asked


def rows_of(df):
    return sorted((r.qid, r.id, round(r.score, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def tables(spark):
    rows, asked = corpus()
    return spark.createDataFrame(rows, "id string, statement string, namespace string").repartition(4).cache(), spark.createDataFrame(asked, "qid int, text string")


@pytest.fixture(scope="module")
def index(tables):
    return S.build(tables[0])


def test_best_k_are_those_of_all_pairs(tables, index):
    statements, asked = tables
    every = R.bm25(asked, statements)
    for k in (1, 5, 2000):
        assert rows_of(S.search(index, asked, k).hits) == rows_of(R.ranked(every, k))
    told = S.search(index, asked, 5).report()
    assert told["pairs_scored"] < every.count() * 4  # weights, of some ten terms a query


def test_shards_and_terms_are_skipped(tables, monkeypatch):
    statements, asked = tables
    monkeypatch.setattr(S, "SHARD", 20)
    monkeypatch.setattr(S, "BLOCK", 7)
    small = S.build(statements)
    assert rows_of(S.search(small, asked, 3).hits) == rows_of(R.ranked(R.bm25(asked, statements), 3))
    whole = statements.filter("id in ('d1', 'd2', 'd3', 'd4')").select("id", F.col("statement").alias("text")).withColumnRenamed("id", "qid")
    found = S.search(small, whole, 1)
    assert rows_of(found.hits) == rows_of(R.ranked(R.bm25(whole, statements), 1))
    told = found.report()
    assert told["shards_searched"] < told["shards_possible"] * 0.7, told


def test_ties_are_whole(tables, index):
    """60 texts are copies of seven."""
    statements, _ = tables
    asked = statements.filter("id = 'd1'").select(F.lit(1).alias("qid"), F.col("statement").alias("text"))
    every = R.bm25(asked, statements)
    least = sorted((r.score for r in every.collect()), reverse=True)[1]
    assert rows_of(S.search(index, asked, 2, ties=True).hits) == rows_of(every.filter(F.col("score") >= least))


def test_only_what_may_be_found_sets_thresholds(tables, index):
    """By a column of documents and by one of each query."""
    statements, asked = tables
    docs = statements.filter("id <> 'd3'").select("id", "namespace")
    own = docs.filter("namespace = 'n2'").select("id")
    want = R.ranked(R.bm25(asked, statements).join(own, "id", "left_semi"), 5)
    assert rows_of(S.search(index, asked, 5, docs, lambda d, q: d["namespace"] == "n2").hits) == rows_of(want)
    odd = asked.withColumn("only", F.concat(F.lit("n"), F.col("qid") % 3))
    want = R.ranked(R.bm25(asked, statements).join(odd.select("qid", F.col("only").alias("namespace")), "qid").join(docs, ["id", "namespace"], "left_semi"), 5)
    assert rows_of(S.search(index, odd, 5, docs, lambda d, q: d["namespace"] == q["only"]).hits) == rows_of(want)


def test_queries_that_differ_by_rare_words_are_asked_once(spark, tables, monkeypatch):
    """Pairs of query and shard grow with postings of rare words, not with queries times shards; results are those of all pairs, with places of equal scores by `prefer`."""
    monkeypatch.setattr(S, "SHARD", 20)
    statements = tables[0]
    small = S.build(statements)
    asked = spark.range(40).select(F.col("id").cast("int").alias("qid"), F.concat(F.lit("c1 c2 r"), F.col("id") * 7).alias("text"))
    found = S.search(small, asked, 5)
    every = R.bm25(asked, statements)
    assert rows_of(found.hits) == rows_of(R.ranked(every, 5))
    told = found.report()
    rare = every.sparkSession.createDataFrame([(f"r{i * 7}",) for i in range(40)], "term string").join(small.table("postings"), "term").count()
    assert told["shards_searched"] <= rare + told["shards_possible"] < 40 * 10, told
    liked = statements.withColumn("prefer", F.coalesce(F.length("statement"), F.lit(0)).cast("long"))
    want = R.ranked(every.join(liked.select("id", "prefer"), "id"), 5, [F.desc("score"), F.desc("prefer")])
    assert rows_of(S.search(small, asked, 5, liked.select("id", "prefer")).hits) == rows_of(want)


def test_an_index_grows_by_segments(spark, tables, tmp_path):
    """Of segments with other mean lengths, opened again by path."""
    statements, asked = tables
    first = statements.filter("length(statement) < 90")
    rest = statements.join(first.select("id"), "id", "left_anti")
    path = str(tmp_path / "index")
    S.build(first, path=path)
    for part in (rest, statements.limit(0)):
        S.append(S.opened(spark, path), part)
    assert rows_of(S.search(S.opened(spark, path), asked, 7).hits) == rows_of(R.ranked(R.bm25(asked, statements), 7))
    assert S.opened(spark, path).table("sizes").count() == 3


def test_a_search_reads_heads_without_postings(index, tables):
    heads = index.table("postings").select("bucket", "term", "segment", "shard", "best").filter("bucket = 3 and term = 'c1'")
    plan = heads._jdf.queryExecution().toString()
    assert "places" not in plan.split("ReadSchema")[-1] and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def test_an_empty_index(spark, tables):
    empty = S.build(tables[0].limit(0))
    assert S.search(empty, tables[1], 5).hits.count() == 0


def test_an_index_for_given_queries_has_only_their_terms(spark, tables, tmp_path):
    """Of 1,500 rare words some are asked for. Lengths and counts of documents are those of whole texts, so scores are the same; other queries are refused."""
    statements, asked = tables
    whole, own = S.build(statements), S.build(statements, asked=asked)
    terms = {r.term for r in R.query_terms(asked).collect()}
    assert {r.term for r in own.table("terms").select("term").collect()} == {r.term for r in whole.table("terms").select("term").collect()} & terms
    assert own.table("postings").count() < whole.table("postings").count() / 4
    lengths = lambda index: sorted((r.id, r.len) for r in index.table("docs").select("id", "len").collect())
    assert lengths(own) == lengths(whole)
    assert rows_of(S.search(own, asked, 7).hits) == rows_of(R.ranked(R.bm25(asked, statements), 7))
    with pytest.raises(ValueError, match="other queries"):
        S.search(own, spark.createDataFrame([(1, "c1 elsewhere")], "qid int, text string"), 7)
    with pytest.raises(ValueError, match="all terms"):
        S.build(statements, path=str(tmp_path / "kept"), asked=asked)


def test_terms_are_those_of_the_expression(spark):
    """Also where the text is cut apart outside of it: odd spaces, signs, letters that change their length in lower case."""
    texts = ["", " ", None, "  a  b ", "İstanbul ΣΟΦΟΣ", "x y z", "½٣_Ⅷ áb", "中文 \U0001f600q\U00010400", "A-a.A\n\ta\x00b"]
    df = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "id string, statement string")
    want = {(r.id, r.term): r.tf for r in df.select("id", F.explode(S.terms("statement")).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf")).collect()}
    for index in (S.build(df), S.build(df, asked=df.select(F.col("statement").alias("text")))):
        posted = index.table("postings").select("term", F.explode(F.arrays_zip("places", "tf")).alias("p")).select("term", F.col("p.places").alias("place"), "p.tf")
        assert {(r.id, r.term): r.tf for r in posted.join(index.table("docs").select("place", "id"), "place").collect()} == want


def test_few_documents_pass_a_threshold_of_several_shards(tables, monkeypatch):
    """For many wanted documents the first step searches as many shards as hold FIRST for each, so that others give few rows; terms may be added in any steps."""
    statements, asked = tables
    monkeypatch.setattr(S, "SHARD", 20)
    index = S.build(statements, asked=asked)
    want = rows_of(R.ranked(R.bm25(asked, statements), 20))
    rows = []
    real = S.written

    def counting(df):
        out = real(df)
        if "prefer" in out.columns:
            rows[-1] += out.filter("id is not null").count()
        return out

    monkeypatch.setattr(S, "written", counting)
    for first, step in ((1, 1), (10, 50), (40, 3)):
        monkeypatch.setattr(S, "FIRST", first)
        monkeypatch.setattr(S, "STEP", step)
        rows.append(0)
        assert rows_of(S.search(index, asked, 20).hits) == want
    assert rows[1] < rows[0], rows


def test_texts_of_hits_are_not_shuffled(spark, tables):
    """A prompt's texts are taken where they are read."""
    statements, _ = tables
    hits = spark.createDataFrame([(1, "d1", 1, 0.5), (1, "d2", 2, 0.4), (2, "d1", 1, 0.0)], "qid int, id string, rank int, score double")
    plan = R.inject(hits, statements)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((r.qid, r.id) for r in R.inject(hits, statements).collect()) == [(1, "d1"), (1, "d2")]


def test_long_queries_are_scored_together(tables, monkeypatch):
    """Queries of all lengths in one block, and of documents that not all may be found."""
    statements, asked = tables
    every = asked.unionByName(statements.filter("id < 'd15'").select((F.substring("id", 2, 9).cast("int") + 1000).alias("qid"), F.col("statement").alias("text")))
    live = statements.filter("namespace <> 'n1'").select("id")
    want = R.bm25(every, statements)
    monkeypatch.setattr(S, "LONG", 9)
    index = S.build(statements)
    for k in (1, 7):
        assert rows_of(S.search(index, every, k).hits) == rows_of(R.ranked(want, k))
        assert rows_of(S.search(index, every, k, live).hits) == rows_of(R.ranked(want.join(live, "id"), k))


@pytest.mark.parametrize(("frequent", "dense"), [(32, 4096), (3, 2), (10**9, 0), (1, 10**6)])
def test_scores_by_matrices_are_those_of_one_term_after_another(monkeypatch, frequent, dense):
    """Terms in a matrix, those that are too rare for it and those that find no place in it; with ties, bounds and documents that no query may find."""
    r = random.Random(4)
    monkeypatch.setattr(S, "FREQUENT", frequent)
    monkeypatch.setattr(S, "DENSE", dense)
    n, terms = 200, [f"t{i}" for i in range(60)]
    docs = {"id": np.array([f"d{i}" for i in range(n)], object), "len": np.array([r.choice([5, 9, 40]) for _ in range(n)]), "known": np.array([i % 5 > 0 for i in range(n)]), "prefer": np.arange(n) % 3}
    places = [sorted(r.sample(range(n), r.choice([1, 3, 40, 150]))) for _ in terms]
    posted = pa.table({"term": terms, "places": pa.array(places, pa.list_(pa.int32())), "tf": pa.array([[r.randint(1, 3) for _ in x] for x in places], pa.list_(pa.int32())), "idf": [2.0] * len(terms), "average": [9.0] * len(terms), "top": [5.0] * len(terms)})
    asks = [{"qid": q, "terms": r.sample([*terms, "unseen"], r.choice([0, 1, 8, 50])), "rare": [], "least": r.choice([0.0, 3.0])} for q in range(40)]
    for ties in (False, True):
        shard = S._Shard(docs, posted, 4, ties, lambda d, q: d["len"] != 40 if q["qid"] % 2 else d["len"] > 0)
        plain = lambda found: [[(i, round(s, 6), p) for i, s, p in rows] for rows, _ in found]
        assert plain(shard.whole(asks)) == plain(map(shard.best, asks))
        assert [n for _, n in shard.whole(asks)] == [sum(len(places[terms.index(t)]) for t in q["terms"] if t in terms) for q in asks]


def test_no_null_lists_are_sent_to_python(tables):
    """Arrow walks over null lists at the end of a column for each row that follows, which was most of a search's time."""
    rows = tables[1].selectExpr("1 as post_term", "array(1) as post_places", "cast(null as int) as ask_least", "cast(null as array<string>) as ask_terms")
    rows = rows.unionByName(tables[1].selectExpr("null as post_term", "null as post_places", "1 as ask_least", "cast(null as array<string>) as ask_terms"))
    got = S._without_null_lists(rows, {"post": "term", "ask": "least"}).distinct().collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, [1], None, []), (None, [], 1, None)]))


def test_equal_documents_stand_for_each_other(spark, tables, monkeypatch):
    """Of documents that equal in length and counts of asked terms an index for the best k keeps the least k ids of a batch; frequencies, lengths and results are those of all documents."""
    statements, asked = tables
    few = asked.filter("qid < 3 or qid >= 100")
    alike = spark.range(3000).select(F.concat(F.lit("f"), "id").alias("id"), F.concat(F.lit("c1 supplier "), F.col("id")).alias("statement"), F.lit("n0").alias("namespace"))
    rows = statements.unionByName(alike).repartition(4)
    index = S.build(rows, asked=few, first=2)
    assert index.table("docs").filter("id like 'f%'").count() <= 8  # 2 for each batch
    assert tuple(index.table("sizes").select("n", "total").first()) == tuple(S.build(rows).table("sizes").select("n", "total").first())
    every = R.bm25(few, rows)
    for k in (1, 2):
        assert rows_of(S.search(index, few, k).hits) == rows_of(R.keyword_search(few, rows, k)) == rows_of(R.ranked(every, k))
    for other in (dict(k=3), dict(k=2, ties=True), dict(k=2, docs=rows.select("id")), dict(k=2, may=lambda d, q: d["len"] > 1)):
        with pytest.raises(ValueError):
            S.search(index, few, **other)
