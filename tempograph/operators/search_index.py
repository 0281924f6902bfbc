"""A stored inverted index, and a search over it that stops early.

The index is four Parquet tables under one path, written once and appended to, a `segment=` folder for each write:

`postings` (segment, bucket, term, shard, places, tf, best): one row for each term and shard of some SHARD documents, partitioned by a hash of the term and sorted by
term; `best` is the greatest weight that the term has there, before its inverse document frequency and at the segment's own mean length;
`docs` (segment, shard, place, id, len) are the documents of a shard, `terms` (segment, bucket, term, df, best) has each term once a segment, `sizes` (segment, n, total, buckets) one row.

A search for the best k of each query joins its terms with `postings` by bucket and term. What is shuffled are postings of terms asked for, once for each block of
BLOCK queries that asks, never pairs of query and document:

1. from `best` alone, read without the postings, comes an upper bound for each query and shard;
2. each query is answered in the shard with its greatest bound, or in as many as hold FIRST documents for each that is wanted; the k-th score there is a threshold, as no
   document below it matters;
3. only shards whose bound reaches the threshold are searched at all. In a shard, terms are added from the strongest on, until those left together can't
   lift a document over the threshold; the rest is looked up for the few documents that they can lift. Queries of LONG terms and more, such as whole
   documents, reach almost all documents of a shard, so those of a block are scored together: frequent terms by one product of matrices, others by one sum a query.

Queries that differ only by rare terms (in at most SHARD documents) are asked once without them, and each for itself only of the documents that have its rare terms, so work
grows with their postings, not with queries times shards.

An index that is built for given queries and left in the shared folder holds postings of their terms only, which are a small part of all; lengths, counts of documents
and frequencies are those of whole texts, so scores are the same. It refuses queries with other terms. Terms are counted where texts are read, so texts are not shuffled. If it is built for the `first` k of all
documents, of those that equal in length and counts only the least k ids of a batch are kept and stand for the others.

The best k of a shard are its rows, so k rows for each query and shard searched are left, and `report` counts pairs that were scored. The result is that
of scoring every document. Which documents a query may find is decided in the shard, before thresholds are taken.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import term_line, terms
from ..sources.scratch import scratch_path, written

K1, B = 1.2, 0.75
#: Documents of a shard and queries of a block.
SHARD = 1_024
BLOCK = 512
#: Rows of asked terms that are sent to every task; more are joined by shuffle.
BROADCAST_TERMS = 100_000
#: Queries, and shards that they are asked of, that are sent to every task.
BROADCAST_QUERIES, BROADCAST_SHARDS = 2_048, 100_000
#: Documents for each one wanted that are searched before thresholds are taken.
FIRST = 100
#: Terms that are added at once, between two looks at what can still matter.
STEP = 8
#: Terms from which on a query is scored whole, with others of its block; for these, terms in at least one of FREQUENT documents, up to DENSE of them, are rows of a matrix.
LONG, FREQUENT, DENSE = 64, 32, 4_096
#: Least number of buckets of a new index, and terms in a bucket from which on there are more.
BUCKETS = 8
BUCKET_TERMS = 4_000_000
#: Sums of the same weights in another order differ by less.
_SLACK = 1e-6

#: From columns of a shard's documents and a query's row, which documents it may find.
May = Callable[[dict, dict], np.ndarray]
_SCHEMAS = {"postings": "term string, shard int, df long, best double, places array<int>, tf array<int>, segment int, bucket int", "terms": "term string, df long, best double, segment int, bucket int"}


@dataclass
class SearchIndex:
    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    #: The terms that it has, null for all.
    only: pa.Array | None = None
    #: How many documents a query may ask for, null for any number, of all documents.
    first: int | None = None

    def table(self, name: str) -> DataFrame:
        read = self.spark.read.schema(_SCHEMAS[name]) if name in _SCHEMAS else self.spark.read  # an empty segment has no file that tells
        return read.parquet(f"{self.path}/{name}")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("bucket")


def saturation(tf, length, average):
    """A term's weight in a document of `length` terms that has it `tf` times, before its inverse document frequency; of columns or arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def append(index: SearchIndex, statements: DataFrame, text: str = "statement") -> SearchIndex:
    """Add statements (id, `text`) that the index doesn't have yet, as one more segment. Texts are shuffled and tokenised once. Sizes are written last: a segment without them is
    not seen, and a write that is tried again takes its place."""
    spark = index.spark
    segment = _next_segment(index)
    id_type = statements.schema["id"].dataType.simpleString()
    lines = statements.select("id", term_line(text).alias("_line"))
    if index.only is not None:
        lines = written(lines.mapInArrow(_counted(index.only, index.first), f"id {id_type}, len int, n long, codes array<int>, counts array<int>"))
    shard = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-lines.count() // SHARD)))).cast("int").alias("shard")
    if index.only is None:  # texts are shuffled, not their terms in an array
        lines = statements.select(shard, "id", F.col(text).alias("_text")).repartition("shard").select("shard", "id", term_line("_text").alias("_line"))
    else:
        lines = lines.select(shard, "*")
    placed = written(lines.groupBy("shard").applyInArrow(_inverted(index.only), f"term string, shard int, df long, best double, mean double, places array<int>, tf array<int>, place int, id {id_type}, len int, n long"))
    docs = placed.filter("term is null").select("shard", "place", "id", "len", "n")
    n, total = docs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("len")), F.lit(0))).first()
    posted = placed.filter("term is not null")
    if segment == 1:
        held = total if index.only is None else posted.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
        index.buckets = max(BUCKETS, 1 << (held // BUCKET_TERMS).bit_length())
    put = lambda df, name, by: df.write.mode("overwrite").partitionBy(*by).parquet(f"{index.path}/{name}/segment={segment}")
    put(docs.drop("n"), "docs", [])
    # Weights at the shard's own mean length grow by no more than the ratio.
    best = (F.col("best") * F.greatest(F.lit(1.0), F.lit(max(total, 1) / max(n, 1)) / F.col("mean"))).alias("best")
    rows = posted.select(index.bucket(), "term", "shard", "df", best, "places", "tf")
    put(rows.repartitionById(index.buckets, F.col("bucket")).sortWithinPartitions("bucket", "term", "shard"), "postings", ["bucket"])
    own = index.table("postings").filter(F.col("segment") == segment)
    put(own.groupBy("bucket", "term").agg(F.sum("df").alias("df"), F.max("best").alias("best")).repartitionById(index.buckets, F.col("bucket")).sortWithinPartitions("bucket", "term"), "terms", ["bucket"])
    spark.range(1).coalesce(1).select(F.lit(n).cast("long").alias("n"), F.lit(int(total)).cast("long").alias("total"), F.lit(index.buckets).alias("buckets")).write.mode("overwrite").parquet(f"{index.path}/sizes/segment={segment}")
    return index


def _found(line: pa.Array, only: pa.Array | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The length of each line of terms, and for each pair of a term, of those in `only` if it is given, and a line that has it: the term's number in the names that come last, the line and how often."""
    words = pc.split_pattern(line, " ")
    flat, size = words.flatten(), pc.list_value_length(words).to_numpy()
    length = np.where(pc.equal(line, "").to_numpy(zero_copy_only=False), 0, size)
    owner = np.repeat(np.arange(len(line)), size)
    if only is None:
        named = flat.dictionary_encode()
        names, code, real = named.dictionary, named.indices.to_numpy(), length[owner] > 0
    else:
        found = pc.index_in(flat, value_set=only)
        names, code, real = only, found.fill_null(0).to_numpy(), found.is_valid().to_numpy(zero_copy_only=False)
    pairs, tf = np.unique(code[real].astype(np.int64) * len(line) + owner[real], return_counts=True)
    return length, *(np.divmod(pairs, len(line)) if len(line) else (pairs, pairs)), tf, names


def _counted(only: pa.Array, first: int | None):
    """A function over documents (id, _line) that gives their length and how often they have which terms of `only`. Documents that are equal in this have equal scores, so if no more than `first` are wanted,
    those of the least ids stand for all of a batch: `n` counts how many."""

    def run(batches):
        for batch in batches:
            ids, line = batch.column(0), batch.column(1).fill_null("")
            length, code, at, tf, _ = _found(line, only)
            order = np.argsort(at, kind="stable")
            code, at, tf = (x[order].astype(np.int32) for x in (code, at, tf))
            ends = np.searchsorted(at, np.arange(len(line) + 1)).astype(np.int32)
            n, keep = np.ones(len(line), np.int64), None
            if first is not None:
                known, own, keep = np.stack([code, tf], 1), {}, []
                for i in pc.array_sort_indices(ids, null_placement="at_start").to_pylist():
                    alike = own.setdefault((int(length[i]), known[ends[i] : ends[i + 1]].tobytes()), [i, 0])
                    alike[1] += 1
                    if alike[1] <= first:
                        keep.append(i)
                    else:
                        n[alike[0]] += 1
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (code, tf)]
            rows = pa.record_batch([ids, pa.array(length.astype(np.int32)), pa.array(n), *lists], ["id", "len", "n", "codes", "counts"])
            yield rows if keep is None else rows.take(pa.array(keep, pa.int64()))

    return run


def _inverted(only: pa.Array | None):
    """A function over a shard's documents (shard, id, _line; with `only` those of `_counted`) that gives its documents, of no term, and its postings."""

    def run(rows: pa.Table) -> pa.Table:
        if only is None:
            line = rows["_line"].combine_chunks().fill_null("")
            length, term, at, tf, names = _found(line, None)
            stands = np.ones(len(line), np.int64)
        else:
            codes, counts = (rows[c].combine_chunks() for c in ("codes", "counts"))
            length, stands, names = rows["len"].to_numpy().astype(np.int64), rows["n"].to_numpy(), only
            term, tf = (x.flatten().to_numpy().astype(np.int64) for x in (codes, counts))
            at = np.repeat(np.arange(len(length)), pc.list_value_length(codes).to_numpy())
            order = np.lexsort((at, term))
            term, at, tf = term[order], at[order], tf[order]
        line = length
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else term
        ends = pa.array(np.r_[first, len(term)].astype(np.int32))
        df = np.add.reduceat(stands[at], first) if len(term) else term
        mean = max(1, length.sum()) / max(1, len(line))
        best = np.maximum.reduceat(saturation(tf.astype(float), length[at], mean), first) if len(term) else np.zeros(0)
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (at, tf)]
        shard = rows["shard"][0].as_py() if rows.num_rows else 0
        same = lambda value, n, kind: pa.array(np.full(n, value), kind)
        n = len(first)
        posted = {"term": names.take(pa.array(term[first])), "shard": same(shard, n, pa.int32()), "df": pa.array(df, pa.int64()), "best": pa.array(best), "mean": same(mean, n, pa.float64()), "places": lists[0], "tf": lists[1]}
        docs = {"shard": same(shard, len(line), pa.int32()), "place": pa.array(np.arange(len(line), dtype=np.int32)), "id": rows["id"].combine_chunks(), "len": pa.array(length.astype(np.int32)), "n": pa.array(stands)}
        types = {"term": pa.string(), "shard": pa.int32(), "df": pa.int64(), "best": pa.float64(), "mean": pa.float64(), "places": lists[0].type, "tf": lists[1].type, "place": pa.int32(), "id": rows["id"].type, "len": pa.int32(), "n": pa.int64()}
        parts = [pa.table([x[c] if c in x else pa.nulls(size, t) for c, t in types.items()], list(types)) for x, size in ((docs, len(line)), (posted, n))]
        return pa.concat_tables(parts)

    return run


def _next_segment(index: SearchIndex) -> int:
    try:
        return (index.table("sizes").agg(F.max("segment")).first()[0] or 0) + 1
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 1


def build(statements: DataFrame, text: str = "statement", path: str | None = None, asked: DataFrame | None = None, first: int | None = None) -> SearchIndex:
    """An index of `statements` in a new folder, of the shared one unless `path` is given. One for `asked` queries (text) has only their terms, if those are few enough to send to every
    task, and is for these queries alone, so it can't be given a path; with `first` they may want that many documents at most, of all."""
    if path is not None and asked is not None:
        raise ValueError("an index that is kept holds all terms")
    only = None if asked is None else _few(asked.select(F.explode(terms("text")).alias("term")).distinct())
    return append(SearchIndex(statements.sparkSession, path or scratch_path(statements.sparkSession), only=only, first=None if only is None else first), statements, text)


def _few(wanted: DataFrame) -> pa.Array | None:
    """The terms of `wanted` (term) if they are at most BROADCAST_TERMS."""
    rows = wanted.select("term").limit(BROADCAST_TERMS + 1).toArrow()["term"].combine_chunks().cast(pa.string())
    return rows if len(rows) <= BROADCAST_TERMS else None


def opened(spark: SparkSession, path: str) -> SearchIndex:
    index = SearchIndex(spark, path)
    index.buckets = index.table("sizes").agg(F.max("buckets")).first()[0]
    return index


@dataclass
class Found:
    """`hits` are (qid, id, score); `scored` counts for each query and shard searched the pairs that got any weight, `bounds` are the pairs of query and shard that have a term in common."""

    hits: DataFrame
    scored: DataFrame
    bounds: DataFrame

    def report(self) -> dict[str, int]:
        s = self.scored.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        return {"shards_possible": self.bounds.count(), "shards_searched": s[0], "pairs_scored": s[1]}


def _array(column: pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type) or pa.types.is_boolean(column.type):
        return column.fill_null(False if pa.types.is_boolean(column.type) else 0).to_numpy(zero_copy_only=False)
    return np.array([*column.to_pylist(), None], object)[:-1]


class _Shard:
    """The documents of one shard and its postings of the terms asked for."""

    def __init__(self, docs: dict, postings: pa.Table, k: int, ties: bool, may: May | None):
        self.docs, self.k, self.ties, self.may = docs, k, ties, may
        postings = {c: postings[c].combine_chunks() for c in postings.column_names}
        term, top = (postings[c].to_pylist() for c in ("term", "top"))
        lists = [postings[c] for c in ("places", "tf")]
        ends, places, tf = lists[0].offsets.to_numpy(), *(x.values.to_numpy() for x in lists)
        idf, average = (np.repeat(postings[c].to_numpy(), np.diff(ends)) for c in ("idf", "average"))
        places, tf = (x[ends[0] : ends[-1]] if len(term) else x[:0] for x in (places, tf))
        weight = idf * saturation(tf.astype(float), docs["len"][places], average)
        ends = ends - ends[0] if len(term) else ends
        self.ends, self.places, self.weight, self.number = ends, places, weight, {name: i for i, name in enumerate(term)}
        self.terms = {name: (top[i], places[a:b], weight[a:b]) for i, (name, a, b) in enumerate(zip(term, ends[:-1].tolist(), ends[1:].tolist()))}
        self.known = docs["known"] if "known" in docs else np.ones(len(docs["len"]), bool)

    def whole(self, asks: list[dict]) -> list[tuple[list[tuple], int]]:
        """What `best` gives for each of the queries, none of which has `rare` terms, from scores of all documents."""
        n, size = len(self.docs["len"]), np.diff(self.ends)
        dense = np.flatnonzero(size * FREQUENT >= n)
        dense = dense[np.argsort(-size[dense], kind="stable")[:DENSE]]
        row = np.full(len(size), -1)
        row[dense] = np.arange(len(dense))
        at = np.repeat(row, size)
        matrix = np.zeros((len(dense), n))
        matrix[at[at >= 0], self.places[at >= 0]] = self.weight[at >= 0]
        found = [np.array(sorted(self.number[t] for t in set(q["terms"]) if t in self.number), np.int64) for q in asks]
        has = np.zeros((len(asks), len(dense)))
        for i, f in enumerate(found):
            has[i, row[f][row[f] >= 0]] = 1
        scores, out = has @ matrix, []
        for q, f, score in zip(asks, found, scores):
            rest = f[row[f] < 0]
            count = size[rest]
            flat = np.repeat(self.ends[:-1][rest] - np.cumsum(count) + count, count) + np.arange(count.sum())
            score += np.bincount(self.places[flat], self.weight[flat], n)
            may = self.known if self.may is None else self.known & self.may(self.docs, q)
            least = q["least"]
            if may.sum() >= self.k:
                least = max(least, np.partition(score[may], -self.k)[-self.k])
            lifted = np.flatnonzero(may & (score > 0) & (score >= least - _SLACK))
            out.append((self._rows(lifted, score[lifted]), int(size[f].sum())))
        return out

    def best(self, asked: dict) -> tuple[list[tuple], int]:
        """(id, score, prefer) of the best k for a query, and how many weights were added; with `rare` terms only of documents that have one of them."""
        n = len(self.docs["len"])
        may = self.known if self.may is None else self.known & self.may(self.docs, asked)
        enough, every = may.sum() >= self.k, may.all()
        found = sorted((self.terms[t] for t in set(asked["terms"]) if t in self.terms), key=lambda x: -x[0])
        left = np.cumsum([x[0] for x in found][::-1])[::-1].tolist() + [0.0]
        score, least, added, at = np.zeros(n), asked["least"], 0, 0
        if asked["rare"]:
            has = np.zeros(n, bool)
            for t in asked["rare"]:
                if t in self.terms:
                    has[self.terms[t][1]] = True
            lifted = np.flatnonzero(may & has)
        else:
            while at < len(found) and left[at] >= least - _SLACK:
                some = found[at : at + STEP]
                score += np.bincount(np.concatenate([x[1] for x in some]), np.concatenate([x[2] for x in some]), n)
                at += len(some)
                added += sum(len(x[1]) for x in some)
                if enough:
                    least = max(least, np.partition(score if every else score[may], -self.k)[-self.k])
            lifted = np.flatnonzero(may & (score > 0) & (score + left[at] >= least - _SLACK)) if at else np.zeros(0, int)
        for _, places, weight in found[at:]:
            i = np.minimum(np.searchsorted(places, lifted), len(places) - 1)
            hit = places[i] == lifted
            score[lifted[hit]] += weight[i[hit]]
            added += int(hit.sum())
        return self._rows(lifted, score[lifted]), added

    def _rows(self, lifted: np.ndarray, score: np.ndarray) -> list[tuple]:
        """(id, score, prefer) of the best k of some documents."""
        rounded = np.round(score, 6)
        if len(lifted) > self.k:
            edge = np.partition(rounded, -self.k)[-self.k]
            lifted, rounded = lifted[rounded >= edge], rounded[rounded >= edge]
        prefer = self.docs["prefer"][lifted].tolist() if "prefer" in self.docs else [0] * len(lifted)
        rows = sorted(((self.docs["id"][i], s, p) for i, s, p in zip(lifted.tolist(), rounded.tolist(), prefer)), key=lambda x: (-x[1], -x[2], x[0]))
        return rows if self.ties else rows[: self.k]


def search(index: SearchIndex, queries: DataFrame, k: int, docs: DataFrame | None = None, may: May | None = None, ties: bool = False) -> Found:
    """The best k statements (qid, id, score) of each query (qid, text), by score, then id; with `ties` all that share the k-th score. Only those in `docs` (id, ...), if it is
    given; of equal scores those of a greater `prefer` (a whole number) come first, if it has that column. `may` gets its columns as arrays, a null in whole numbers or
    booleans as 0, and a row of `queries` without its text."""
    if index.first is not None and (k > index.first or docs is not None or may is not None or ties):
        raise ValueError(f"the index was built for the best {index.first} of all documents")
    sizes = index.table("sizes")
    whole = sizes.agg(F.sum("n").alias("_n"), (F.greatest(F.sum("total"), F.lit(1)) / F.greatest(F.sum("n"), F.lit(1))).alias("average"))  # one row
    # A segment's `best` was taken at its own mean length; at a greater one weights grow by no more than the ratio.
    scale = sizes.crossJoin(F.broadcast(whole)).select("segment", "average", F.greatest(F.lit(1.0), F.col("average") / (F.greatest("total", F.lit(1)) / F.greatest("n", F.lit(1)))).alias("_scale"))  # a row a segment
    given = written(queries.withColumn("terms", F.array_distinct(terms("text"))).drop("text"))
    words = written(given.select("qid", F.explode("terms").alias("term")).withColumn("bucket", index.bucket()))
    wanted = words.select("bucket", "term").distinct()
    some_terms = _few(wanted)
    few = some_terms is not None
    if index.only is not None and (not few or not pc.all(pc.is_in(some_terms, value_set=index.only), min_count=0).as_py()):
        raise ValueError("the index was built for other queries and lacks some terms of these")
    near = F.broadcast if few else (lambda df: df.hint("merge"))
    counted = index.table("terms").join(near(wanted), ["bucket", "term"], "left_semi").groupBy("bucket", "term").agg(F.sum("df").alias("df")).crossJoin(F.broadcast(whole))
    known = written(counted.select("bucket", "term", "df", F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))
    asked, alike = _split(given, words.join(near(known), ["bucket", "term"]))
    n_alike = alike.count()
    blocks = max(1, -(-n_alike // BLOCK))
    alike = alike.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    top = (F.col("idf") * F.col("best") * F.col("_scale")).alias("top")
    own_words = alike.select("qid", "block", F.explode("terms").alias("term")).withColumn("bucket", index.bucket())
    priced = written(known.drop("df").hint("merge").join(own_words.select("bucket", "term", "block").distinct(), ["bucket", "term"]))
    some = priced.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    of_terms = lambda *columns: index.table("postings").select("bucket", "term", "segment", "shard", "best", *columns).join(F.broadcast(priced) if some else priced.hint("merge"), ["bucket", "term"]).join(F.broadcast(scale), "segment")
    heads = of_terms().select("bucket", "term", "block", "segment", "shard", top)
    bounds = written(heads.hint("merge").join(own_words, ["bucket", "term", "block"]).groupBy("qid", "block", "segment", "shard").agg(F.sum("top").alias("high")))

    own = index.table("docs")
    if docs is not None:
        own = written(own.hint("merge").join(docs.withColumn("known", F.lit(True)), "id", "left"))  # read in both steps
    doc_columns = [c for c in own.columns if c not in ("segment", "shard")]
    key = ["block", "segment", "shard"]
    qid_type, id_type = given.schema["qid"].dataType.simpleString(), own.schema["id"].dataType.simpleString()

    def answered(places: DataFrame, asks: DataFrame, posted: DataFrame, sent: bool = False) -> DataFrame:
        """(qid, id, score, prefer, n) of queries in shards, `places` (qid, block, segment, shard, least), with the postings of the block's terms there; id is null in the row that counts. `asks` are `sent`
        to every task if they are few."""
        shards = places.select(*key).distinct()
        marks = {"post": "term", "doc": "place", "ask": "least"}
        flat = lambda df, kind, columns: df.select(*key, *(F.col(c).alias(f"{kind}_{c}") for c in columns))
        post = flat(posted.withColumn("top", top), "post", ("term", "places", "tf", "idf", "average", "top"))
        doc = flat(shards.hint("merge").join(own, ["segment", "shard"]), "doc", doc_columns)
        ask = flat(places.join(F.broadcast(asks) if sent else asks.hint("merge"), "qid"), "ask", (*asks.columns, "least"))
        rows = _without_null_lists(post.unionByName(doc, allowMissingColumns=True).unionByName(ask, allowMissingColumns=True), marks)

        def run(rows: pa.Table) -> pa.Table:
            def part(kind: str) -> pa.Table:
                """The rows of a kind, which are those that have its mark."""
                names = [c for c in rows.column_names if c.startswith(f"{kind}_")]
                return rows.select(names).filter(pc.is_valid(rows[f"{kind}_{marks[kind]}"])).combine_chunks().rename_columns([c.removeprefix(f"{kind}_") for c in names])

            doc, ask = part("doc"), part("ask")
            order = np.argsort(doc["place"].to_numpy())
            plain = {c: _array(doc[c].combine_chunks())[order] for c in doc.column_names}
            shard = _Shard(plain, part("post"), k, ties, may)
            asks, out = ask.to_pylist(), []
            long = [q for q in asks if len(q["terms"]) >= LONG and not q["rare"]]
            short = [q for q in asks if len(q["terms"]) < LONG or q["rare"]]
            for q, (hits, added) in zip(long + short, shard.whole(long) + [shard.best(q) for q in short] if long else map(shard.best, short)):
                out += [(q["qid"], *h, 0) for h in hits] + [(q["qid"], None, None, None, added)]
            types = (ask["qid"].type, doc["id"].type, pa.float64(), pa.int64(), pa.int64())
            return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["qid", "id", "score", "prefer", "n"])

        return written(rows.groupBy(*key).applyInArrow(run, f"qid {qid_type}, id {id_type}, score double, prefer long, n long"))

    of_query = Window.partitionBy("qid")
    order = [F.desc("score"), F.desc("prefer"), "id"]

    def kept(rows: DataFrame) -> DataFrame:
        p = F.rank().over(of_query.orderBy(F.desc("score"))) if ties else F.row_number().over(of_query.orderBy(*order))
        return rows.withColumn("_p", p).filter(F.col("_p") <= k).select("qid", "id", "score", "prefer")

    def over_shards(places: DataFrame) -> DataFrame:
        places = written(places)
        shards = places.select(*key).distinct()
        near_by = shards.limit(BROADCAST_SHARDS + 1).count() <= BROADCAST_SHARDS
        posted = of_terms("places", "tf").join(F.broadcast(shards) if near_by else shards.hint("merge"), key, "left_semi")
        return answered(places, alike.drop("block"), posted, n_alike <= BROADCAST_QUERIES)

    tried = max(1, FIRST * k // SHARD)
    ranked = bounds.withColumn("_p", F.row_number().over(of_query.orderBy(F.desc("high"), "segment", "shard")))
    first = over_shards(ranked.filter(F.col("_p") <= tried).select("qid", *key, F.lit(0.0).alias("least")))
    least = first.filter("id is not null").withColumn("_p", F.row_number().over(of_query.orderBy(*order))).filter(F.col("_p") == k).select("qid", F.col("score").alias("least"))
    others = ranked.filter(F.col("_p") > tried).hint("merge").join(least, "qid", "left").withColumn("least", F.coalesce("least", F.lit(0.0))).filter(F.col("high") >= F.col("least") - _SLACK)
    both = first.unionByName(over_shards(others.select("qid", *key, "least")))
    hits = kept(both.filter("id is not null"))
    counts = both.filter("id is null").select("qid", "n")
    if asked is not None:
        rare = asked.select("qid", F.explode("rare").alias("term")).withColumn("bucket", index.bucket())
        sent = lambda df: F.broadcast(df) if few else df.hint("merge")
        read = lambda which, *columns: index.table("postings").select("bucket", "term", "segment", "shard", *columns).join(sent(which.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi")
        visits = read(rare).hint("merge").join(rare, ["bucket", "term"]).select("qid", "segment", "shard").distinct()
        # A shard's queries are those that have a rare term there, in blocks of their own, so that a shard is read as often as they need it and no more.
        block = F.floor((F.row_number().over(Window.partitionBy("segment", "shard").orderBy("qid")) - 1) / BLOCK).cast("int")
        visits = written(visits.withColumn("block", block).withColumn("least", F.lit(0.0)))
        there = visits.hint("merge").join(words, "qid").select(*key, "bucket", "term").distinct()
        posted = read(wanted, "best", "places", "tf").hint("merge").join(there, ["bucket", "term", "segment", "shard"])
        posted = posted.join(near(known.drop("df")), ["bucket", "term"]).join(F.broadcast(scale), "segment")
        found = answered(visits, asked.drop("first"), posted)
        shared = asked.select("qid", F.col("first").alias("_first")).hint("merge").join(hits.withColumnRenamed("qid", "_first"), "_first").select("qid", "id", "score", "prefer")
        every = shared.unionByName(found.filter("id is not null").select("qid", "id", "score", "prefer"))
        hits = kept(every.groupBy("qid", "id").agg(F.max("score").alias("score"), F.max("prefer").alias("prefer")))  # a rare term adds to a score
        counts = counts.unionByName(found.filter("id is null").select("qid", "n"))
    return Found(hits.drop("prefer"), counts, bounds)


def _without_null_lists(rows: DataFrame, marks: dict[str, str]) -> DataFrame:
    """`rows` whose lists are empty, not null, in rows of another kind than their column's. Spark takes the size of what it sends to Python anew for each row, and Arrow walks over all null lists at the end
    of a column each time: the square of a batch's rows, which was most of a search's time. For the same reason columns are plain, not structs, whose lists are null with them."""
    blank = lambda f: F.when(F.col(f"{f.name.split('_')[0]}_{marks[f.name.split('_')[0]]}").isNull(), F.array().cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
    return rows.select(*(blank(f) if isinstance(f.dataType, ArrayType) else f.name for f in rows.schema))


def _split(given: DataFrame, words: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Queries with rare terms of their own, and those to ask of all shards. If at least half of the queries equal others once terms of at most SHARD documents are left out, one of each kind
    (qid, terms, ...) is asked without such terms, and each query (..., rare, first) knows which one: a document without its rare terms scores as it does for `first`.
    Else all are asked of all shards, and there are none with rare terms."""
    extra = [c for c in given.columns if c not in ("qid", "terms")]
    listed = lambda rare: F.array_sort(F.collect_list(F.when((F.col("df") <= SHARD) == F.lit(rare), F.col("term"))))
    split = written(given.hint("merge").join(words.groupBy("qid").agg(listed(True).alias("rare"), listed(False).alias("_common")), "qid"))
    same = written(split.filter("size(_common) > 0").groupBy("_common", *extra).agg(F.min("qid").alias("first")))
    none = F.array().cast("array<string>").alias("rare")
    if 2 * same.count() > split.count():
        return None, given.select("*", none)
    by = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("_common", *extra)]
    met = split.alias("a").hint("merge").join(same.alias("b"), by, "left").select("a.qid", "a.terms", *(f"a.{c}" for c in extra), "a.rare", "b.first")
    return written(met), same.select(F.col("first").alias("qid"), F.col("_common").alias("terms"), *extra, none)
