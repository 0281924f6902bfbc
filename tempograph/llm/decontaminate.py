"""Benchmark decontamination as a prefix-filtered set join.

An item is the set of its windows: ten consecutive words, or all words of a shorter item. A window is the
set of its word shingles. A document contains a window only if it contains all of its shingles, so with
shingles in one order, rarest in the corpus first, the necessary prefix is one shingle.

1. Windows and their shingles are tables. Documents count the shingles that windows have; the count table gives each window
   its rarest one. A window with a shingle that no document has is left out.
2. Documents send one row for each place of a prefix shingle, with the words around it, and these rows join the
   prefix table. A hit fixes where the window would start (positional bound) and must leave room for the
   whole window (length bound); then all words are compared in the join's output, so the result is exact.

Shingles that no window has are dropped in the task by a Bloom filter of fixed size; the joins decide. Up to `broadcast_prefixes` prefixes are
sent to every task; more are joined by shuffle, each in SALT copies, so that a passage in a third of all documents is not one task's work.

Defined results: null or wordless text has no words and no hits; a wordless or null item is never found;
repeated items are each reported; every row of documents, repeated ones and those of null doc_id too, is one row of the result; without documents the result is empty, without
items nothing is hit; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_CLASS, BLOOM_BITS, LOWER, bloom, doc_numbers, in_bloom, shingles, steps, stored, tidy, utf8, word_hashes, words_of

WINDOW_WORDS = 10
SHINGLE_WORDS = 3
BROADCAST_PREFIXES = 200_000
SALT = 16


def benchmark_windows(items: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """(item_id, words, n): the distinct windows of each item as words joined by one space."""

    def run(batches):
        for batch in batches:
            ids, out_id, out_w, out_n = batch.column(0).to_pylist(), [], [], []
            data, offsets = utf8(batch.column(1))
            data = LOWER[data]
            s, e, first = words_of(data, offsets, ALNUM_CLASS)
            raw = data.tobytes()
            for d, item in enumerate(ids):
                words = [raw[s[i] : e[i]] for i in range(first[d], first[d + 1])]
                k = min(window, len(words))
                for text in dict.fromkeys(b" ".join(words[i : i + k]) for i in range(len(words) - k + 1) if k):
                    out_id.append(item)
                    out_w.append(text.decode())
                    out_n.append(k)
            yield pa.record_batch([pa.array(out_id, batch.column(0).type), pa.array(out_w, pa.string()), pa.array(out_n, pa.int32())], ["item_id", "words", "n"])

    items = items.select("item_id", "text")
    return items.mapInArrow(tidy(run), f"item_id {items.schema['item_id'].dataType.simpleString()}, words string, n int")


def window_shingles(windows: DataFrame) -> DataFrame:
    """(wid, q, h, at): the shingles of `windows` (wid, words): q words from word `at` on, by hash."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            s, e, first = words_of(data, offsets, ALNUM_CLASS)
            h, owner = word_hashes(data, s, e), doc_numbers(first)
            n = np.diff(first)
            at = np.arange(len(h)) - first[:-1][owner]
            for q in range(1, SHINGLE_WORDS + 1):
                i = np.flatnonzero((np.minimum(n, SHINGLE_WORDS)[owner] == q) & (at + q <= n[owner]))
                yield pa.record_batch([batch.column(0).take(pa.array(owner[i])), pa.array(np.full(len(i), q, np.int32)), pa.array(_named(shingles(h, q), q)[i].view(np.int64)), pa.array(at[i].astype(np.int32))], ["wid", "q", "h", "at"])

    return windows.select("wid", "words").mapInArrow(tidy(run), "wid long, q int, h long, at int")


def _named(h: np.ndarray, q: int) -> np.ndarray:
    """Hashes of shingles of different lengths are different keys."""
    return h + np.uint64(q)


_SLOT_SHIFTS = (0, 26, 38)


def _slots(h: np.ndarray) -> list[np.ndarray]:
    return [(h >> np.uint64(k)) & np.uint64((1 << BLOOM_BITS) - 1) for k in _SLOT_SHIFTS]


def _filter_of(keys: DataFrame):
    """A Bloom filter of keys (h)."""
    return bloom(keys.sparkSession, keys.select(F.explode(F.array(*(F.shiftrightunsigned("h", k).bitwiseAND((1 << BLOOM_BITS) - 1) for k in _SLOT_SHIFTS))).alias("s")))


def _doc_steps(batch, column: int):
    data, offsets = utf8(batch.column(column))
    for lo, hi in steps(offsets):
        part = LOWER[data[offsets[lo] : offsets[hi]]]
        s, e, first = words_of(part, offsets[lo : hi + 1] - offsets[lo], ALNUM_CLASS)
        yield lo, part, s, e, first, word_hashes(part, s, e)


def _places(h: np.ndarray, first: np.ndarray, lengths: list[int], words: np.ndarray):
    """(q, positions, keys) of shingles that the filter lets through and that lie in one document."""
    owner = doc_numbers(first)
    for q in lengths:
        key = _named(shingles(h, q), q)
        pos = np.flatnonzero(in_bloom(words, _slots(key))) if len(key) else np.zeros(0, np.int64)
        pos = pos[pos + q <= first[1:][owner[pos]]]
        yield q, pos, key[pos], owner[pos]


def rarity(docs: DataFrame, keys: DataFrame, lengths: list[int]) -> DataFrame:
    """(h, n): how often each of `keys` (h) occurs in all documents, if at all."""
    sent = _filter_of(keys)

    def run(batches):
        for batch in batches:
            for _, _, _, _, first, h in _doc_steps(batch, 0):
                for _, _, key, _ in _places(h, first, lengths, sent.value):
                    u, n = np.unique(key, return_counts=True)
                    yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(n)], ["h", "n"])

    counted = docs.select("text").mapInArrow(tidy(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return counted.hint("merge").join(keys, "h", "left_semi")


def prefixes(windows: DataFrame, docs: DataFrame) -> tuple[DataFrame, list[int]]:
    """(h, words, n, at): the necessary prefix of each window that may occur: its rarest shingle, which is `at` words from its start; and the shingle lengths there are."""
    listed = stored(window_shingles(windows), "shingles")
    lengths = sorted(r["q"] for r in listed.select("q").distinct().collect())  # at most SHINGLE_WORDS rows
    counts = stored(rarity(docs, stored(listed.select("h").distinct(), "keys"), lengths), "rarity")
    ordered = listed.hint("merge").join(counts, "h", "left").groupBy("wid").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), F.min_by(F.struct("h", "at"), F.struct(F.coalesce("n", F.lit(0)), "h", "at")).alias("p"))
    rare = ordered.filter("least > 0").select("wid", "p.h", "p.at")
    return stored(rare.hint("merge").join(windows, "wid").select("h", "words", "n", "at"), "prefixes"), lengths


def find_windows(docs: DataFrame, windows: DataFrame, window: int = WINDOW_WORDS, broadcast_prefixes: int = BROADCAST_PREFIXES) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, text_hash, n_words) of each document, and (row, words, start, n) of each place where one of `windows` (words, n) occurs in it."""
    distinct = stored(windows.select("words", "n").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    lead, lengths = prefixes(distinct, docs)
    sent = _filter_of(lead)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    place = pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("lead", pa.int32()), ("around", pa.list_(pa.string()))])

    def run(batches):
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for lo, part, s, e, first, h in _doc_steps(batch, 1):
                n_words[lo : lo + len(first) - 1] = np.diff(first)
                for q, pos, key, owner in _places(h, first, lengths, sent.value):
                    for x, k, d in zip(pos.tolist(), key.view(np.int64).tolist(), owner.tolist()):
                        a, b = max(int(first[d]), x - window + q), min(int(first[d + 1]), x + window)
                        words = [part[s[i] : e[i]].tobytes().decode() for i in range(a, b)]
                        found[lo + d].append({"h": k, "pos": x - int(first[d]), "lead": x - a, "around": words})
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n_words), pa.array(found, pa.list_(place))], ["doc_id", "text_hash", "n_words", "places"])

    fields = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, n_words long, places array<struct<h:long,pos:int,lead:int,around:array<string>>>"
    probed = stored(docs.mapInArrow(tidy(run), fields).withColumn("row", F.monotonically_increasing_id()), "probed")
    flat = probed.filter(F.size("places") > 0).select("row", "n_words", F.explode("places").alias("x")).select("row", "n_words", "x.*")
    if lead.count() <= broadcast_prefixes:
        met = flat.join(F.broadcast(lead), "h")
    else:
        salted = flat.withColumn("salt", F.pmod(F.xxhash64("row", "pos"), F.lit(SALT)).cast("int"))
        met = salted.hint("merge").join(lead.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["h", "salt"])
    start = F.col("pos") - F.col("at")
    bounds = (start >= 0) & (start + F.col("n") <= F.col("n_words")) & (F.col("lead") >= F.col("at"))
    same = F.array_join(F.slice("around", F.col("lead") - F.col("at") + 1, F.col("n")), " ") == F.col("words")
    hits = met.filter(bounds).filter(same).select("row", "words", start.alias("start"), "n").distinct()
    return probed.select("row", "doc_id", "text_hash", "n_words"), stored(hits, "hits")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, broadcast_prefixes: int = BROADCAST_PREFIXES) -> DataFrame:
    """One row for each of `docs`: doc_id, text_hash (xxhash64 of the text), n_words, n_hit (words inside any occurrence), item_ids (sorted strings)."""
    windows = stored(benchmark_windows(items, window), "item_windows")
    rows, hits = find_windows(docs, windows, window, broadcast_prefixes)
    spans = hits.select("row", "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    covered = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    # Sum of what each span adds past the furthest end so far.
    n_hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["to"], x["start"]))).alias("n"), F.greatest(a["to"], x["end"]).alias("to")),
        lambda a: a["n"].cast("long"),
    )
    # Windows that many documents have are looked up in parts.
    salt = F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int")
    owners = windows.select("words", "item_id").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    named = hits.select("row", "words").distinct().withColumn("salt", salt).hint("merge").join(owners, ["words", "salt"]).groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    joined = rows.join(covered.select("row", n_hit.alias("n_hit")).hint("shuffle_hash"), "row", "left").join(named.hint("shuffle_hash"), "row", "left")
    return joined.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW_WORDS) -> dict[int, tuple]:
    """The contract, word by word; for tests."""
    import re

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    out = {}
    for doc, text in docs:
        w = words(text)
        hit, names = set(), set()
        for item, t in items:
            v = words(t)
            k = min(window, len(v))
            wanted = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
            for i in range(len(w) - k + 1) if k else ():
                if tuple(w[i : i + k]) in wanted:
                    hit |= set(range(i, i + k))
                    names.add(str(item))
        out[doc] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out
