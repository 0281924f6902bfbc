"""Exact removal of repeated phrases: windows of words that start earlier go, found by automata of the phrases that recur.

A word goes if a window of `length` (20) words over it has the same words as a window that starts earlier: in a smaller doc_id, or before it in the same document.

1. Each window has a mark: the least hash of its runs of K words. Equal windows have equal marks, and consecutive windows of one mark are a segment. Marks
   are counted over all documents; a window whose mark stands in one place only doesn't recur.
2. Segments of recurring marks (found by a Bloom filter of fixed size, which only saves shuffling) are sent to their mark as text, so every document is
   streamed past the automaton that can find something in it, and past no other. Marks with more than HOT places are split by document into
   as many parts as that takes.
3. Segments arrive sorted by mark. Each run of them of about BATCH windows confirms the windows that recur and compiles them into one
   Aho-Corasick automaton over word numbers; all segments run through it, equal ones once, and it gives every occurrence. All but the earliest of a window go.
4. A window of a split mark is confirmed in every part; what is earliest in its part is settled by a sum over all parts.

Defined results: null and empty texts have no words; texts of fewer than `length` words lose nothing; an empty table gives an empty one. doc_id may be of any type
that sorts, null before all others; rows of one doc_id are one document's several texts: none of them starts earlier than another, each loses what a
smaller doc_id has or what repeats within itself, and each stays a row. Extra columns are ignored. In what follows `n` is a row's
number and `n >> shift` its document (`common.numbered`).
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOOM_BITS, SPACE_CLASS, bloom, doc_numbers, in_bloom, mix, numbered, shingles, steps, stored, utf8, word_hashes, words_of

LENGTH = 20
#: Words of the runs whose least hash is a window's mark.
K = 5
#: Places of a mark that one part takes.
HOT = 20_000
#: Windows that an automaton is compiled and run for.
BATCH = 60_000
_SLOT_BITS = 20


def _slide(x: np.ndarray, width: int, combine) -> np.ndarray:
    """combine over x[i : i + width]."""
    have = 1
    while have * 2 <= width:
        x = combine(x[:-have], x[have:])
        have *= 2
    return combine(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def _marks(data: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """Word starts and ends, the first word of each document, hashes of runs of k words, and each window's mark, 0 where a text ends before the window."""
    s, e, first = words_of(data, offsets, SPACE_CLASS)
    if len(s) < length:
        return s, e, first, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    end = first[1:][doc_numbers(first)]
    runs = shingles(word_hashes(data, s, e), k) | np.uint64(1)
    at = np.arange(len(runs))
    runs[at + k > end[: len(runs)]] = np.uint64(2**64 - 1)
    mark = _slide(runs, length - k + 1, np.minimum)
    at = at[: len(mark)]
    mark[at + length > end[: len(mark)]] = 0
    return s, e, first, runs, mark


def mark_counts(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(h, n): marks and the places that they stand in, for those with two or more. `docs` has (n, text)."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for lo, hi in steps(offsets):
                *_, runs, mark = _marks(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length, k)
                if not len(mark):
                    continue
                pad = np.zeros(length - k, np.uint64)
                over = _slide(np.concatenate([pad, mark, pad]), length - k + 1, np.maximum)
                h, n = np.unique(runs[over == runs], return_counts=True)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")


def _slots(h: np.ndarray) -> list[np.ndarray]:
    """Three places of a mark in a Bloom filter."""
    return [mix(h + np.uint64(i)) >> np.uint64(64 - BLOOM_BITS) for i in (1, 2, 3)]


def _filters(counts: DataFrame, hot: int):
    """A Bloom filter of all marks, and for each of 2^20 slots of marks the power of two of parts that the most frequent of them takes: both of fixed size."""

    def run(batches):
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            yield pa.record_batch([pa.array(np.concatenate(_slots(h)).view(np.int64))], ["s"])

    def levels(batches):
        for batch in batches:
            h, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            yield pa.record_batch([pa.array((mix(h) >> np.uint64(64 - _SLOT_BITS)).view(np.int64)), pa.array(np.ceil(np.log2(n / hot)).astype(np.int32))], ["slot", "level"])

    spark = counts.sparkSession
    level = np.zeros(1 << _SLOT_BITS, np.uint8)
    found = counts.filter(F.col("n") > hot).mapInArrow(levels, "slot long, level int").groupBy("slot").agg(F.max("level").alias("level")).toArrow()  # at most 2^20 rows
    level[found["slot"].to_numpy()] = found["level"].to_numpy()
    return bloom(spark, counts.select("h").mapInArrow(run, "s long")), spark.sparkContext.broadcast(level)


def segments(docs: DataFrame, counts: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT) -> DataFrame:
    """(h, part, split, n, at, words): runs of windows of one recurring mark with the words that they cover, from word `at` of text n on."""
    recurring, level = _filters(counts, hot)

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            number = batch.column(0).to_numpy()
            for lo, hi in steps(offsets):
                body = data[offsets[lo] : offsets[hi]]
                s, e, first, _, mark = _marks(body, offsets[lo : hi + 1] - offsets[lo], length, k)
                if not len(mark):
                    continue
                doc = doc_numbers(first)[: len(mark)]
                new = np.r_[True, (mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1])]
                a = np.flatnonzero(new)
                b = np.r_[a[1:], len(mark)] + length - 1  # the word after the last
                keep = (mark[a] > 0) & in_bloom(recurring.value, _slots(mark[a]))
                a, b = a[keep], b[keep]
                h = mark[a]
                parts = np.uint64(1) << level.value[(mix(h) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)].astype(np.uint64)
                n = number[lo:hi][doc[a]]
                text = body.tobytes()
                words = [b" ".join(text[x:y].split()) for x, y in zip(s[a].tolist(), e[b - 1].tolist())]
                part = (mix(n.view(np.uint64)) % parts).astype(np.int32)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(part), pa.array(parts > 1), pa.array(n), pa.array(a - first[doc[a]]), pa.array(words, pa.binary())], ["h", "part", "split", "n", "at", "words"])

    return docs.select("n", "text").mapInArrow(run, "h long, part int, split boolean, n long, at long, words binary")


def occurrences(texts: list[bytes], times: np.ndarray, every: np.ndarray, length: int):
    """Text, place in it and number of each window that recurs in `texts`, which stand `times` times each; of texts where `every` is true all windows count. Windows are
    confirmed by counting, compiled into an automaton over word numbers, and located by running the texts through it."""
    number: dict[bytes, int] = {}
    ids = [tuple([number.setdefault(w, len(number)) for w in t.split()]) for t in texts]
    size = np.array([len(x) for x in ids])
    flat = np.fromiter((i for x in ids for i in x), np.int64, int(size.sum()))
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(ids)), size)[: max(0, len(flat) - length + 1)]
    start = np.flatnonzero(np.arange(len(owner)) + length <= (begin + size)[owner])
    owner = owner[start]
    h = shingles(mix(flat.astype(np.uint64) + np.uint64(1)), length)[start]
    _, place, which = np.unique(h, return_index=True, return_inverse=True)
    wanted = (np.bincount(which, weights=times[owner]) > 1) | (np.bincount(which, weights=every[owner]) > 0)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for p, i in enumerate(start[place[wanted]].tolist()):
        automaton.add_word(tuple(flat[i : i + length].tolist()), p)
    if not len(automaton):
        return (np.zeros(0, np.int64),) * 3 + (ids,)
    automaton.make_automaton()
    text, end, pattern = [], [], []
    for t, x in enumerate(ids):
        found = list(automaton.iter(x))
        text += [t] * len(found)
        end += [f[0] for f in found]
        pattern += [f[1] for f in found]
    return np.array(text, np.int64), np.array(end, np.int64) - length + 1, np.array(pattern, np.int64), ids


def _least_of(key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each row the least value among rows of its key."""
    order = np.lexsort((value, key))
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    out = np.empty(len(key), value.dtype)
    out[order] = value[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def repeated(parts: DataFrame, length: int = LENGTH, shift: int = 0, batch_windows: int = BATCH) -> DataFrame:
    """(n, start, end, window): runs of words of text n to remove; or with the hash of a window of a split mark, where that window is the earliest of its part."""

    def run(batches):
        rows, held = [], 0

        def judged():
            known: dict = {}
            which = np.array([known.setdefault(r[5], len(known)) for r in rows])
            texts = list(known)
            split, n, at = np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
            text, offset, pattern, ids = occurrences(texts, np.bincount(which), np.bincount(which, weights=split) > 0, length)
            if not len(text):
                return
            # Occurrences of a text stand in all rows that have it.
            lo, hi = np.searchsorted(text, which), np.searchsorted(text, which, "right")
            row = np.repeat(np.arange(len(rows)), hi - lo)
            pick = np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[row]
            pattern, start, doc = pattern[pick], at[row] + offset[pick], n[row] >> shift
            _, own = np.unique(np.stack([pattern, n[row]]), axis=1, return_inverse=True)
            late = (doc > _least_of(pattern, doc)) | (start > _least_of(own.ravel(), start))
            r, s = row[late], start[late]
            cut = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (s[1:] > s[:-1] + length)]) if len(r) else r
            last = np.r_[cut[1:], len(r)] - 1 if len(r) else r
            yield out(n[r[cut]], s[cut], s[last] + length, [None] * len(cut))
            open_ = np.flatnonzero(~late & split[row])
            names = {}
            for i in open_.tolist():
                p = int(pattern[i])
                if p not in names:
                    x = offset[pick[i]]
                    names[p] = xxhash.xxh3_128_digest(b" ".join(texts[which[row[i]]].split()[x : x + length]))
            yield out(n[row[open_]], start[open_], start[open_] + length, [names[int(pattern[i])] for i in open_])

        def out(n, start, end, window):
            return pa.record_batch([pa.array(n, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(window, pa.binary())], ["n", "start", "end", "window"])

        last = None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if held >= batch_windows and r[:2] != last:
                    yield from judged()
                    rows, held = [], 0
                last = r[:2]
                rows.append(r)
                held += r[5].count(b" ") + 2 - length
        if rows:
            yield from judged()

    dealt = parts.repartition("h", "part").sortWithinPartitions("h", "part")
    return dealt.mapInArrow(run, "n long, start long, end long, window binary")


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K, shift: int = 0, hot: int = HOT, batch_windows: int = BATCH) -> DataFrame:
    """(n, spans): word runs to remove, for texts that have any. `docs` (n, text) has each number once."""
    counts = stored(mark_counts(docs, length, k), "marks")
    found = stored(repeated(segments(docs, counts, length, k, hot), length, shift, batch_windows), "repeats")
    held = found.filter("window is not null")
    least = held.groupBy("window").agg(F.min("n").alias("least"))
    late = held.hint("merge").join(least, "window").filter(F.shiftright("n", shift) > F.shiftright("least", shift)).select("n", "start", "end")
    every = found.filter("window is null").select("n", "start", "end").unionByName(late)
    return every.groupBy("n").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def remove(docs: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT, batch_windows: int = BATCH) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept): `kept` is the remaining words joined by one space, `spans` maximal runs of removed words."""
    rows, shift, plain = numbered(docs)
    texts = rows.select("n", "text")
    spans = stored(repeated_spans(texts if plain else texts.dropDuplicates(["n"]), length, k, shift, hot, batch_windows), "spans")
    joined = rows.hint("merge").join(spans.withColumnRenamed("n", "_n"), F.col("n") == F.col("_n"), "left").select("doc_id", "text", "spans")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            n_words, n_removed, out, kept = [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                words = (text.as_py() or "").encode().split()
                runs: list[list[int]] = []
                for a, b in sorted((x["start"], x["end"]) for x in spans.as_py() or []):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(b, runs[-1][1])
                    else:
                        runs.append([a, b])
                at, left = 0, []
                for a, b in runs:
                    left += words[at:a]
                    at = b
                left += words[at:]
                n_words.append(len(words)), n_removed.append(len(words) - len(left)), kept.append(b" ".join(left).decode())
                out.append([{"start": a, "end": b} for a, b in runs])
            yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, kind), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    return joined.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string")


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, tuple[int, int, str]]:
    """Every window of every document, in order of doc_id; for tests."""
    import hashlib

    seen: set = set()
    out = {}
    for doc, text in sorted(docs, key=lambda x: x[0]):
        words = [w for w in (text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            window = tuple(words[i : i + length])
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out
