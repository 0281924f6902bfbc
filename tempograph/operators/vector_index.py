"""An inverted file of vectors: trained cells, every vector in the cell of its nearest centre, and searches that read a few cells.

Centres are trained by spherical k-means on at most SAMPLE vectors, those of the least id hashes, so the sample is the same wherever it is taken. All vectors are
then assigned, and written by cell; a cell of more than PART vectors is several parts. A search compares a query only with the vectors of its nearest
cells: parts and blocks of queries meet in groups of at most PART vectors and BLOCK queries, and each gives k rows a query. `retrieval.vector_search` stays the exact form;
recall against it is a test.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path, written

SAMPLE = 20_000
MOST_CELLS = 4_096
ROUNDS = 10
PART = 8_192
BLOCK = 1_024
#: Share of the cells that a search probes, unless it says how many. Vectors without clusters need so many for a recall of 0.9; clustered ones far fewer.
PROBE_SHARE = 0.6


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, np.inf)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([*column.to_pylist()], np.float64).reshape(len(column), -1)


def centres_of(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres by k-means on unit vectors, from the first `cells` of them; a cell that loses all its vectors keeps its centre."""
    centres = sample[:cells].copy()
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        full = np.bincount(near, minlength=len(centres)) > 0
        centres[full] = _unit(sums[full])
    return centres


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    centres: np.ndarray

    def vectors(self) -> DataFrame:
        """(cell, part, id, embedding), partitioned by cell."""
        return self.spark.read.parquet(f"{self.path}/vectors")

    def parts(self) -> DataFrame:
        """(cell, part), with at most MOST_CELLS cells and a part for each PART vectors."""
        return self.spark.read.parquet(f"{self.path}/parts")


def build(vectors: DataFrame, cells: int | None = None, path: str | None = None) -> VectorIndex:
    """An index of `vectors` (id, embedding). Null embeddings and those of another size than the sample's first are left out, as the exact search does; a vector of length
    zero is in the first cell. Cells: about the root of the number of vectors, at most MOST_CELLS, unless given."""
    spark, path = vectors.sparkSession, path or scratch_path(vectors.sparkSession)
    rows = vectors.select("id", "embedding").filter("embedding is not null and size(embedding) > 0")
    sample = [r["embedding"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    dim = len(sample[0]) if sample else 1
    rows = rows.filter(F.size("embedding") == dim)
    n = rows.count()
    cells = min(MOST_CELLS, cells or max(1, round(n**0.5)), max(1, len(sample)))
    centres = centres_of(_unit(np.array([v for v in sample if len(v) == dim], np.float64).reshape(-1, dim)), cells) if n else np.zeros((1, dim))

    def assigned(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column(1)))
            yield pa.record_batch([pa.array(np.argmax(unit @ centres.T, axis=1).astype(np.int32)), batch.column(0), batch.column(1)], ["cell", "id", "embedding"])

    id_type = rows.schema["id"].dataType.simpleString()
    placed = written(rows.mapInArrow(assigned, f"cell int, id {id_type}, embedding array<{rows.schema['embedding'].dataType.elementType.simpleString()}>") if n else rows.select(F.lit(0).alias("cell"), "id", "embedding"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("_parts"))  # a row a cell
    split = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")).drop("_parts")
    split.repartition("cell", "part").sortWithinPartitions("cell", "part", "id").write.mode("overwrite").parquet(f"{path}/vectors")
    sizes.select("cell", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part")).coalesce(1).write.mode("overwrite").parquet(f"{path}/parts")
    return VectorIndex(spark, path, centres)


@dataclass
class Found:
    """`hits` are (qid, id, score, rank); `compared` counts the vectors that each query was compared with."""

    hits: DataFrame
    compared: DataFrame


def search(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = None) -> Found:
    """The best k vectors by cosine in each query's (qid, embedding) nearest `probes` cells, PROBE_SHARE of them unless given; scores are rounded to six places, ties by id."""
    centres, dim = index.centres, index.centres.shape[1]
    probes = probes or max(1, math.ceil(PROBE_SHARE * len(centres)))
    asked = queries.select("qid", "embedding").filter(F.size("embedding") == dim)
    qid_type = asked.schema["qid"].dataType.simpleString()
    vector = f"array<{asked.schema['embedding'].dataType.elementType.simpleString()}>"

    def near(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.argsort(-(_unit(_matrix(batch.column(1))) @ centres.T), axis=1, kind="stable")[:, :probes]
            row = pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1]))
            yield pa.record_batch([batch.column(0).take(row), batch.column(1).take(row), pa.array(cells.ravel().astype(np.int32))], ["qid", "embedding", "cell"])

    blocks = max(1, -(-asked.count() // BLOCK))
    probed = asked.mapInArrow(near, f"qid {qid_type}, embedding {vector}, cell int").withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    probed = written(probed.hint("merge").join(index.parts(), "cell"))
    key = ["block", "cell", "part"]
    stored = index.vectors()
    id_type = stored.schema["id"].dataType.simpleString()
    v = stored.hint("merge").join(probed.select(*key).distinct(), ["cell", "part"]).select(*key, F.struct("id", F.col("embedding").cast("array<double>").alias("embedding")).alias("v"))
    q = probed.select(*key, F.struct("qid", F.col("embedding").cast("array<double>").alias("embedding")).alias("q"))

    def best(rows: pa.Table) -> pa.Table:
        part = lambda c: rows[c].combine_chunks().drop_null()
        vs, qs = part("v"), part("q")
        ids = vs.field("id").to_pylist()
        score = np.round(_unit(_matrix(qs.field("embedding"))) @ _unit(_matrix(vs.field("embedding"))).T, 6) if len(vs) and len(qs) else np.zeros((len(qs), 0))
        out = []
        for r, name in enumerate(qs.field("qid").to_pylist()):
            edge = np.partition(score[r], -k)[-k] if len(ids) > k else -np.inf
            out += [(name, i, s, 0) for s, i in sorted(((float(score[r, j]), ids[j]) for j in np.flatnonzero(score[r] >= edge)), key=lambda x: (-x[0], x[1]))[:k]]
            out.append((name, None, None, len(ids)))
        types = (qs.type.field("qid").type, vs.type.field("id").type, pa.float64(), pa.int64())
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["qid", "id", "score", "n"])

    met = written(v.unionByName(q, allowMissingColumns=True).groupBy(*key).applyInArrow(best, f"qid {qid_type}, id {id_type}, score double, n long"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    hits = met.filter("id is not null").select("qid", "id", "score", rank.alias("rank")).filter(F.col("rank") <= k)
    return Found(hits, met.filter("id is null").groupBy("qid").agg(F.sum("n").alias("compared")))


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(queries, recall): the share of the exact best k (qid, id) that was found, over all queries."""
    both = exact.select("qid", "id").hint("merge").join(found.select("qid", "id").withColumn("_f", F.lit(1)), ["qid", "id"], "left")
    return both.agg(F.countDistinct("qid").alias("queries"), F.round(F.count("_f") / F.greatest(F.count("*"), F.lit(1)), 6).alias("recall"))
