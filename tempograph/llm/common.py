"""Shared pieces of the training-data operators: tables, scratch storage and byte-level word splitting.

Words are found on UTF-8 bytes with numpy. That is exact for the word classes used here, because they
treat every byte from 0x80 up as a word byte, so a multi-byte character is never split.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Bytes of text that one numpy step works on; one longer document is a step of its own.
STEP_BYTES = 1 << 19

_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_ALNUM = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)])

#: Word bytes: everything but space and \t..\r.
SPACE_CLASS = np.array([b not in _SPACES for b in range(256)])
#: Word bytes: ASCII letters and digits and everything from 0x80 up.
ALNUM_CLASS = np.array([b in _ALNUM for b in range(256)])
#: A-Z to a-z, all other bytes as they are.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)

#: Bytes of a word up to which its polynomial is its hash.
LONG_WORD = 64

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def give_back() -> None:
    """Return what this Python worker no longer needs to the system: idle workers keep it otherwise, and an executor has many."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A function over batches that gives memory back when its task ends."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the shared folder that the cluster names; a temporary one only where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # one machine, as in tests
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and gives true sizes."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def block_count(docs: DataFrame, block_chars: int) -> int:
    """Blocks of about `block_chars` characters; smaller ones, down to a sixteenth, while there are fewer than shuffle partitions."""
    total = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-total // block_chars), min(parts, -(-16 * total // block_chars)))


def _pack(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def dealt(docs: DataFrame, n: int) -> DataFrame:
    """(block, pack): documents (doc_id, text) dealt to n blocks by a hash of both, so one doc_id or null is not one block; a pack is a task's
    documents of a block in Arrow's compressed form, 40 % less than as rows."""

    def run(batches):
        for batch in batches:
            block = batch.column(0).to_numpy()
            rows = pa.table(batch.columns[1:], ["doc_id", "text"])
            order = np.argsort(block, kind="stable")
            cut = np.flatnonzero(np.r_[True, block[order][1:] != block[order][:-1], True]) if len(block) else np.zeros(1, int)
            packs = [(int(block[order[a]]), _pack(rows.take(pa.array(order[a:b])))) for a, b in zip(cut[:-1], cut[1:])]
            yield pa.record_batch([pa.array([x for x, _ in packs], pa.int32()), pa.array([x for _, x in packs], pa.binary())], ["block", "pack"])

    return docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block"), "doc_id", "text").mapInArrow(tidy(run), "block int, pack binary")


def unpacked(rows: pa.Table) -> pa.Table:
    """A block's documents in one order, however they arrive."""
    tables = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in rows["pack"]]
    return pa.concat_tables(tables).sort_by([("doc_id", "ascending"), ("text", "ascending")])


BLOOM_BITS = 26


def bloom(spark: SparkSession, slots: DataFrame):
    """A Bloom filter of fixed size (8 MB, whatever the data) from rows of slots `s`, summed in Spark and sent to every task. It only saves
    shuffling: what it lets through is decided by the join that follows."""
    bits = slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("b"))
    words = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    at = bits.toArrow()  # at most 2^20 rows, 16 MB
    words[at["w"].to_numpy()] = at["b"].to_numpy()
    return spark.sparkContext.broadcast(words)


def in_bloom(words: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
    filled = words.view(np.uint64)
    ok = np.ones(len(slots[0]), bool)
    for s in slots:
        ok &= (filled[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1) > 0
    return ok


def likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id may be in `ids` (column doc_id), and few others, so that texts which no join wants aren't shuffled.
    Beyond some ten million ids it lets more through."""
    slot = lambda i: F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(1 << BLOOM_BITS))
    sent = bloom(docs.sparkSession, ids.select(F.explode(F.array(slot(0), slot(1), slot(2))).alias("s")))
    keep = docs.columns

    def run(batches):
        for batch in batches:
            ok = in_bloom(sent.value, [batch.column(i).to_numpy().view(np.uint64) for i in range(3)])
            yield pa.record_batch(batch.columns[3:], keep).filter(pa.array(ok))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.select(slot(0).alias("_b0"), slot(1).alias("_b1"), slot(2).alias("_b2"), *keep).mapInArrow(tidy(run), fields)


def squeeze(a: np.ndarray) -> bytes:
    """Integers as one compressed value: their bytes plane by plane, so that small numbers of a wide type cost little."""
    return zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 3)


def unsqueeze(b, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1)


def ranked(ids: DataFrame) -> DataFrame:
    """(doc_id, rank): distinct ids numbered without gaps in their order, null first. Only row counts of sorted partitions are gathered, as a table."""
    sorted_ids = stored(ids.select("doc_id").distinct().orderBy("doc_id").withColumn("_m", F.monotonically_increasing_id()), "ranks").withColumn("_p", F.shiftright("_m", 33))
    sizes = sorted_ids.groupBy("_p").count()
    before = sizes.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_before"))  # one row for each partition
    return sorted_ids.join(F.broadcast(before), "_p").select("doc_id", (F.col("_m").bitwiseAND((1 << 33) - 1) + F.col("_before")).alias("rank"))


def numbered(docs: DataFrame) -> tuple[DataFrame, int, bool]:
    """(docs (doc_id, text, n long), shift, plain). Numbers are ordered as doc_ids, null first; n >> shift is the same for rows of one doc_id, and
    rows of one doc_id have one number only if their texts are equal (by 64-bit hash). Whole, distinct ids are their own numbers (shift 0, `plain`);
    that is found out by a count of ids, without texts. Otherwise ids are ranked in one sort, and texts join their numbers."""
    docs = docs.select("doc_id", "text")
    if docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long") and docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        return docs.withColumn("n", F.col("doc_id").cast("long")), 0, True
    keyed = docs.withColumn("_t", F.xxhash64("text"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("_t")) - 1
    texts = stored(keyed.select("doc_id", "_t").distinct().withColumn("_j", place.cast("long")), "texts")
    shift = int(texts.agg(F.max("_j")).first()[0] or 0).bit_length()
    ranks = ranked(texts).withColumnRenamed("doc_id", "_id")
    names = texts.hint("merge").join(ranks, F.col("doc_id").eqNullSafe(F.col("_id"))).select("_id", F.col("_t").alias("_text"), F.shiftleft("rank", shift).bitwiseOR(F.col("_j")).alias("n"))
    joined = keyed.hint("merge").join(stored(names, "numbers"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_text")))
    return stored(joined.select("doc_id", "text", "n"), "numbered"), shift, False


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i below n."""
    if "p" not in _powers or len(_powers["p"]) < n:
        m = max(n, STEP_BYTES + 1)
        for key, base in (("p", _P), ("q", _P_INV)):
            a = np.full(m, base, dtype=np.uint64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["p"][:n], _powers["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash are usable."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its row offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.null_count:
        column = column.fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, size: int = STEP_BYTES):
    """Row ranges of about `size` bytes."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words_of(data: np.ndarray, offsets: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in `data`, and for each document the index of its first word."""
    isw = cls[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start, end = isw.copy(), isw.copy()
    start[1:] &= ~isw[:-1] | cut[1:-1]
    end[:-1] &= ~isw[1:] | cut[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offsets)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes. A polynomial modulo 2^64 has pairs of strings of 1,024 bytes that always meet, and worse odds as
    strings near that length, so words of more than LONG_WORD bytes are hashed by XXH3."""
    p, q = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=sums[1:])
    h = mix((sums[e] - sums[s]) * q[s])
    long = np.flatnonzero(e - s > LONG_WORD)
    h[long] = np.array([xxhash.xxh3_64_intdigest(data[s[i] : e[i]]) for i in long.tolist()], np.uint64)
    return h


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n items from each position on; as many as there are full runs."""
    if len(h) < n:
        return h[:0]
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = out * _P + h[i : len(h) - n + 1 + i]
    return mix(out)


def doc_numbers(first: np.ndarray) -> np.ndarray:
    """Document index of each word, from the index of each document's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
