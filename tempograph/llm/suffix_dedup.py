"""Exact removal of byte strings that an earlier document has, by suffix arrays of grouped passages.

A byte goes if a string of `length` (50) bytes over it also starts in a document with a smaller doc_id.

1. Every 50-byte string holds at least one anchor: a substring of ANCHOR bytes whose hash is the least in some
   run of them. Equal strings hold equal anchors at equal places, so only texts that share an anchor are compared.
   An anchor's context is all bytes that a 50-byte string over it can reach.
2. Anchors are partitioned and sorted by anchor hash, context hash and document, and read as a stream, so one shared by any
   number of documents needs no memory. Where contexts are equal, all documents but the first lose the whole
   context at once; documents that one task reads together settle that among themselves before the shuffle. Only the first document of each context of an anchor with several contexts needs a closer look.
3. Those contexts are brought back as bytes, split into two finer groups each (the strings that reach 15 bytes to the left of the anchor, and
   those that reach as far to the right). All strings of a group hold the same bytes around the anchor, its core, which is written as one symbol.
   Equal passages of a group fall together, also when they are cut to what their strings' hashes say they may share, and each bucket of groups gets a suffix array of its distinct passages. Neighbours in it that
   share 50 bytes form intervals; a string's bytes go if its interval has a smaller document.
   Groups of more than HOT contexts are handled by counting their strings one by one in Spark instead.

The suffix array is built by linear grouping. Suffixes are first grouped by first byte. Groups are taken in descending order; by
then the members' Lyndon prefix is final. Previous-smaller pointers lead from each member to the suffix just before it
in a lower group, whose prefix grows by the group's; all so extended move to the end of their group, by number of repeats. Then
one pass in ascending order places every suffix at the front of its group. No ranks are renamed.

Defined results: null is empty; documents of fewer bytes than `length` lose nothing; repeats within a document
stay unless an earlier document has them. doc_id may be of any type that sorts, null before all others; rows of one doc_id, null too, are one document with
several texts: they take nothing from each other, each loses what a smaller doc_id has, and each stays a row. An empty table gives an empty one; extra columns are ignored.
In what follows `doc_id` is the row's number and `number >> shift` its document (`common.numbered`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import likely, mix, numbered, powers, steps, stored, utf8

LENGTH = 50
ANCHOR = 20
HOT = 4_000
BUCKET = 4_000
#: Bytes of text whose hashes stay in a core's cache.
CACHED = 1 << 16


def suffix_array(text: list[int]) -> list[int]:
    """Suffixes of `text` in order. A suffix that is a prefix of another comes first."""
    text = [x + 1 for x in text] + [0]
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for i, s in enumerate(order):
        if text[s] != text[order[start]]:
            start = i
        place[s], group[s] = i, start
        size[start] += 1
    prev = [-1] * n
    top = n - 1
    while top >= 0:
        g = group[order[top]]
        members = order[g : top + 1]
        if len(members) > 1:
            members.sort()
        repeats: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] > g:
                p = prev[p]
            if p >= 0 and group[p] == g:
                p = prev[p]  # a member just before: both hang on the same lower suffix
            prev[s] = p
            if p >= 0:
                repeats[p] = repeats.get(p, 0) + 1
        if repeats:
            levels: dict[int, list[int]] = {}
            for p, m in repeats.items():
                levels.setdefault(m, []).append(p)
            for m in sorted(levels, reverse=True):
                olds: dict[int, list[int]] = {}
                for p in levels[m]:
                    olds.setdefault(group[p], []).append(p)
                for old, moved in olds.items():
                    end = old + size[old] - 1
                    for p in moved:
                        q, at = order[end], place[p]
                        order[at], order[end] = q, p
                        place[q], place[p] = at, end
                        end -= 1
                    size[old] -= len(moved)
                    new = end + 1
                    size[new] = len(moved)
                    if new != old:
                        for p in moved:
                            group[p] = new
        top = g - 1
    front = list(range(n))
    placed = [False] * n
    order[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        p = order[i] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            order[front[g]] = p
            front[g] += 1
            placed[p] = True
            p = prev[p]
    return order[1:]


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """Document, position, hash and context hash of the anchors of a few documents."""
    n, w = len(data), length - k + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    p, q = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=sums[1:])
    size = np.diff(offsets)
    doc = np.repeat(np.arange(len(size)), size)
    end = offsets[1:][doc]
    m = n - k + 1
    g = mix((sums[k:] - sums[:m]) * q[:m]) | np.uint64(1)
    g[np.arange(m) + k > end[:m]] = np.uint64(2**64 - 1)

    def slide(x, combine):
        """combine over x[i : i + w]."""
        width = 1
        while width * 2 <= w:
            x = combine(x[:-width], x[width:])
            width *= 2
        return combine(x[: len(x) - (w - width)], x[w - width :]) if w > width else x

    low = slide(g, np.minimum)  # least hash of the string that starts at i
    low[np.arange(len(low)) + length > end[: len(low)]] = 0
    pad = np.zeros(w - 1, np.uint64)
    high = slide(np.concatenate([pad, low, pad]), np.maximum)[:m]
    at = np.flatnonzero(high == g)
    left = np.maximum(at - (length - k), offsets[:-1][doc[at]])
    right = np.minimum(at + length, end[at])
    context = mix(mix((sums[right] - sums[left]) * q[left]) + (at - left).astype(np.uint64) * np.uint64(1 << 20) + (right - left).astype(np.uint64))
    return doc[at], at - offsets[:-1][doc[at]], g[at], context


def anchor_rows(docs: DataFrame, bits: int, length: int, k: int, shift: int = 0) -> DataFrame:
    """(h, c, doc_id, pos) of all anchors; h has `bits` bits, where a clash only costs a comparison. Of documents read together, all but
    the first that have a context are settled here: their h is negative and c is 0, so a passage in very many documents is one row for each step where they meet."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            for lo, hi in steps(offsets):
                few = [(lo + a, lo + b) for a, b in steps(offsets[lo : hi + 1], CACHED)]
                found = [_anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length, k) for a, b in few]
                d, (pos, h, c) = np.concatenate([x[0] + a - lo for (a, _), x in zip(few, found)]), (np.concatenate([x[i] for x in found]) for i in (1, 2, 3))
                h, c, doc = (mix(h) >> np.uint64(64 - bits)).view(np.int64), c.view(np.int64), ids[lo + d]
                later = _later(mix(h.view(np.uint64)) ^ c.view(np.uint64), doc >> shift)
                h[later] = ~(doc[later] & 0xFFFF)
                c = np.where(later, 0, c)
                yield pa.record_batch([pa.array(h), pa.array(c), pa.array(doc), pa.array(pos.astype(np.int32))], ["h", "c", "doc_id", "pos"])

    return docs.mapInArrow(run, "h long, c long, doc_id long, pos int")


def _later(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows whose key a row of a smaller document has."""
    out = np.zeros(len(key), bool)
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]]) if len(key) else order
    if len(new) < len(key):
        ids = doc[order]
        out[order] = ids > np.repeat(np.minimum.reduceat(ids, new), np.diff(np.r_[new, len(key)]))
    return out


def shared_anchors(rows: DataFrame, shift: int = 0) -> DataFrame:
    """(doc_id, pos, h, whole): anchors whose whole context an earlier document has, and with whole = false those of the first
    document of a context whose anchor has other contexts too."""

    def run(batches):
        h0 = c0 = d0 = None  # group and context that go on, and its first document
        several, held = False, []  # whether the group has had two contexts; rows that wait for a second one
        for batch in batches:
            h, c, d, pos = (batch.column(i).to_numpy() for i in range(4))
            settled = int(np.searchsorted(h, 0))  # they sort first
            if settled:
                yield pa.record_batch([pa.array(d[:settled]), pa.array(pos[:settled]), pa.array(h[:settled]), pa.array(np.ones(settled, bool))], ["doc_id", "pos", "h", "whole"])
                h, c, d, pos = (x[settled:] for x in (h, c, d, pos))
            n = len(h)
            if not n:
                continue
            new_h = np.r_[h[0] != h0, h[1:] != h[:-1]]
            new_c = new_h | np.r_[c[0] != c0, c[1:] != c[:-1]]
            starts = np.flatnonzero(new_c)
            first = np.empty(n, np.int64)
            owner = np.cumsum(new_c) - 1
            first[owner >= 0] = d[starts][owner[owner >= 0]] if len(starts) else 0
            first[owner < 0] = d0 if d0 is not None else 0
            whole = d >> shift > first >> shift
            group = np.cumsum(new_h) - 1
            contexts = np.bincount(group[new_c] + 1, minlength=int(group[-1]) + 2)  # of the group that goes on, then of each new one
            many = contexts > 1
            many[0] = several or contexts[0] > 0
            closer = ~whole & many[group + 1]
            out_d, out_p, out_h, out_w = [d[whole | closer]], [pos[whole | closer]], [h[whole | closer]], [whole[whole | closer]]
            if held and many[0]:
                out_d.insert(0, np.array([x[0] for x in held])), out_p.insert(0, np.array([x[1] for x in held], np.int32)), out_h.insert(0, np.full(len(held), h0)), out_w.insert(0, np.zeros(len(held), bool))
                held = []
            last = int(group[-1])
            if last >= 0:
                held = []
            several = bool(many[last + 1])
            if not several:
                own = (group == last) & ~whole
                held += list(zip(d[own].tolist(), pos[own].tolist()))
            h0, c0, d0 = h[-1], c[-1], first[-1]
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in (out_d, out_p, out_h, out_w)], ["doc_id", "pos", "h", "whole"])

    return rows.repartition("h").sortWithinPartitions("h", "c", "doc_id", "pos").mapInArrow(run, "doc_id long, pos int, h long, whole boolean")


def contexts_of(docs: DataFrame, closer: DataFrame, length: int, k: int) -> DataFrame:
    """(key, proof, core, doc_id, start, left, flanks): the two halves of each context. `key` and `proof` are hashes of the side and the `core` bytes that all
    strings of the half hold; `flanks` are the bytes before it (`left` of them) and after it."""
    wanted = closer.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("pos").alias("at"))  # at most one for each byte of a text
    texts = likely(docs.select("doc_id", "text"), closer.select("doc_id").distinct())
    joined = texts.hint("merge").join(wanted, F.col("doc_id") == F.col("id")).select("doc_id", "text", "at")
    near = (length - k) // 2

    def run(batches):
        for batch in batches:
            core, doc, start, left, flanks = [], [], [], [], []

            def add(d, text, lo, a, b, hi):
                """text[lo:hi] with the core text[a:b]."""
                if hi - lo >= length and lo <= a and b <= hi:
                    core.append(text[a:b]), doc.append(d), start.append(lo), left.append(a - lo), flanks.append(text[lo:a] + text[b:hi])

            for d, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = text.encode()
                for p in at:
                    # Strings that start at p - near or before hold the `near` bytes before the anchor; the others hold as many after it.
                    add(d, text, max(0, p - (length - k)), p - near, p + k, min(len(text), p - near + length)) if p >= near else None
                    add(d, text, max(0, p - near + 1), p, p + length - near + 1, min(len(text), p + length))
            yield pa.record_batch([pa.array(core, pa.binary()), pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(left, pa.int32()), pa.array(flanks, pa.binary())], ["core", "doc_id", "start", "left", "flanks"])

    out = joined.mapInArrow(run, "core binary, doc_id long, start int, left int, flanks binary")
    # Of one core, strings of the left half have it in one place of the anchor and those of the right half in another: the cores' lengths differ.
    return out.select(F.xxhash64("core").alias("key"), F.hash("core").alias("proof"), F.octet_length("core").alias("core"), "doc_id", "start", "left", "flanks")


def covered_in_bucket(group: np.ndarray, doc: np.ndarray, left: np.ndarray, flanks: list[bytes], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(passage, offset in it) of the strings that a passage of a smaller document and the same group has. A string is `symbols` long, its group's core one of them."""
    size = np.array([len(x) + 1 for x in flanks])
    begin = np.cumsum(np.r_[0, size[:-1] + 1])
    n = int(begin[-1] + size[-1])
    codes = np.zeros(n, np.int64)  # 0 parts the passages
    flat = np.frombuffer(b"".join(flanks), np.uint8)
    at = np.ones(n, bool)
    at[begin[1:] - 1] = False
    at[begin + left] = False
    codes[at] = flat.astype(np.int64) + 1
    codes[begin + left] = 257 + group
    owner = np.repeat(np.arange(len(flanks)), np.r_[size[:-1] + 1, size[-1]])
    order = np.array(suffix_array(codes.tolist()))
    offset = order - begin[owner[order]]
    order = order[(offset <= left[owner[order]]) & (offset + symbols <= size[owner[order]])]
    if not len(order):
        return order, order
    rows = np.lib.stride_tricks.sliding_window_view(codes, symbols)[order]
    new = np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]
    least = np.minimum.reduceat(doc[owner[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = order[least < doc[owner[order]]]
    return owner[hit], hit - begin[owner[hit]]


def covered(group: np.ndarray, doc: np.ndarray, left: np.ndarray, flanks: list[bytes], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """What `covered_in_bucket` gives, which is asked only of what passages may share: each is cut to the strings whose hash another passage of its group has, and those that are equal then are one, of the
    smallest document."""
    none, wide, n = np.zeros(0, np.int64), symbols - 1, len(flanks)
    size = np.array([len(x) for x in flanks], np.int64)
    begin = np.cumsum(size) - size
    count = np.maximum(0, np.minimum(left, size - wide) + 1)
    who = np.repeat(np.arange(n), count)
    offset = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[who] + offset
    data = np.frombuffer(b"".join(flanks), np.uint8).astype(np.uint64)
    p, q = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * p[:-1], out=sums[1:])
    place = (group[who] * 256 + left[who] - offset).astype(np.uint64)
    _, same, times = np.unique(mix((sums[at + wide] - sums[at]) * q[at]) ^ mix(place + np.uint64(1)), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times[same] > 1)
    if not len(shared):
        return none, none
    who, offset = who[shared], offset[shared]
    cut = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    who, low, high = who[cut], offset[cut], offset[np.r_[cut[1:], len(offset)] - 1]
    kinds: dict = {}
    kind = np.array([kinds.setdefault((int(group[i]), int(left[i]) - a, flanks[i][a : b + wide]), len(kinds)) for i, a, b in zip(who.tolist(), low.tolist(), high.tolist())])
    least = np.full(len(kinds), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, doc[who])
    found, where = covered_in_bucket(np.array([x[0] for x in kinds]), least, np.array([x[1] for x in kinds]), [x[2] for x in kinds], symbols)
    order = np.argsort(found, kind="stable")
    found, where = found[order], where[order]
    later = doc[who] > least[kind]
    # A later one loses all its strings, the first of a kind those that other kinds have.
    start, end = np.searchsorted(found, kind), np.searchsorted(found, kind, "right")
    lost = np.where(later, high - low + 1, end - start)
    step = np.arange(lost.sum()) - np.repeat(np.cumsum(lost) - lost, lost)
    whole = np.repeat(later, lost)
    own = np.zeros(len(step), np.int64)
    own[whole] = step[whole]
    own[~whole] = where[(np.repeat(start, lost) + step)[~whole]]
    return np.repeat(who, lost), np.repeat(low, lost) + own


def closer_spans(contexts: DataFrame, length: int, hot: int = HOT, bucket: int = BUCKET, *, shift: int = 0) -> DataFrame:
    """(doc_id, start, end): runs of strings that a smaller document's context in the same group has."""
    group = ["key", "proof", "core"]
    sizes = contexts.groupBy(*group).agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter(F.shiftright("lo", shift) < F.shiftright("hi", shift)).select(*group, "n")
    live = stored(contexts.hint("merge").join(sizes, group), "contexts")
    usual = live.filter(F.col("n") <= hot)
    buckets = max(1, -(-usual.count() // bucket))

    def run(rows: pa.Table) -> pa.Table:
        doc, start, left, core = (rows[c].to_numpy() for c in ("doc_id", "start", "left", "core"))
        flanks = rows["flanks"].to_pylist()
        # Equal passages of a group are one, of the smallest document that has it.
        seen: dict = {}
        names = list(zip(rows["key"].to_pylist(), rows["proof"].to_pylist(), core.tolist(), left.tolist(), flanks))
        same = np.array([seen.setdefault(x, len(seen)) for x in names])
        first = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(first, same, doc)
        later = np.flatnonzero(doc >> shift > first[same] >> shift)
        out = [(doc[later], start[later], start[later] + np.array([len(flanks[i]) + int(core[i]) for i in later], np.int64))]
        groups: dict = {}
        owner = np.array([groups.setdefault(x[:3], len(groups)) for x in seen])
        several = np.bincount(owner)[owner] > 1
        passages = list(seen)
        for c in sorted({x[2] for x in passages}):
            pick = np.array([i for i, x in enumerate(passages) if x[2] == c and several[i]], np.int64)
            if not len(pick):
                continue
            who, at = covered(owner[pick], first[pick] >> shift, np.array([passages[i][3] for i in pick]), [passages[i][4] for i in pick], length - c + 1)
            if not len(who):
                continue
            order = np.lexsort((at, who))
            who, at = pick[who[order]], at[order]
            cut = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (at[1:] != at[:-1] + 1)])
            end = np.r_[cut[1:], len(at)] - 1
            runs: dict[int, list[tuple[int, int]]] = {}
            for i, a, b in zip(who[cut].tolist(), at[cut].tolist(), at[end].tolist()):
                runs.setdefault(i, []).append((a, b))
            hit = [(int(doc[i]), int(start[i]) + a, int(start[i]) + b + length) for i in np.flatnonzero(np.isin(same, list(runs)) & (doc >> shift == first[same] >> shift)).tolist() for a, b in runs[int(same[i])]]
            if hit:
                out.append(tuple(np.array(x) for x in zip(*hit)))
        d, a, b = (np.concatenate(x) for x in zip(*out))
        return pa.table({"doc_id": d.astype(np.int64), "start": a.astype(np.int32), "end": b.astype(np.int32)})

    found = usual.withColumn("bucket", F.pmod("key", F.lit(buckets))).groupBy("bucket").applyInArrow(run, "doc_id long, start int, end int")
    # Groups without bound: each string is a row, and equal ones are summed on the map side.
    wide = F.lit(length) - F.col("core")
    strings = live.filter(F.col("n") > hot).select(*group, "doc_id", "start", "left", "flanks", F.explode(F.sequence(F.lit(0), F.least(F.col("left"), F.octet_length("flanks") - wide))).alias("o"))
    strings = strings.select(*group, "doc_id", (F.col("start") + F.col("o")).alias("start"), (F.col("left") - F.col("o")).alias("ahead"), F.substring(F.col("flanks"), F.col("o") + 1, wide).alias("string"))
    name = [*group, "ahead", "string"]
    least = strings.groupBy(*name).agg(F.min("doc_id").alias("least"))
    late = strings.hint("merge").join(least, name).filter(F.shiftright("least", shift) < F.shiftright("doc_id", shift)).select("doc_id", "start", (F.col("start") + length).alias("end"))
    return found.unionByName(late)


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, shift: int = 0) -> DataFrame:
    """(doc_id, spans): byte runs to remove, for documents that have any. `docs` (doc_id long, text) has each number once."""
    docs = docs.select("doc_id", "text").filter(F.octet_length("text") >= length)
    total = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 1
    bits = min(63, int(total).bit_length() + 4)
    shared = stored(shared_anchors(anchor_rows(docs, bits, length, k, shift), shift), "anchors")
    closer = shared.filter("not whole").select("doc_id", "pos")
    partial = closer_spans(stored(contexts_of(docs, closer, length, k), "halves"), length, shift=shift)
    full = shared.filter("whole").select("doc_id", F.greatest(F.lit(0), F.col("pos") - (length - k)).alias("start"), (F.col("pos") + length).alias("end"))
    return full.unionByName(partial).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def remove(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): `kept` is the remaining bytes."""
    rows, shift, plain = numbered(docs)
    texts = rows.select(F.col("n").alias("doc_id"), "text")
    spans = stored(repeated_spans(texts if plain else texts.dropDuplicates(["doc_id"]), length, k, shift), "spans")
    joined = rows.hint("merge").join(spans.withColumnRenamed("doc_id", "id"), F.col("n") == F.col("id"), "left").select("doc_id", "text", "spans")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            n_bytes, n_removed, out, kept = [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2)):
                text = (text or "").encode()
                runs = []
                if spans.is_valid:
                    s, e = (spans.values.field(i).to_numpy() for i in (0, 1))
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate(np.minimum(e[order], len(text)))
                    cut = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
                    runs = list(zip(s[cut].tolist(), e[np.r_[cut[1:] - 1, len(e) - 1]].tolist()))
                at, parts = 0, []
                for a, b in runs:
                    parts.append(text[at:a])
                    at = b
                kept.append(b"".join([*parts, text[at:]]))
                n_bytes.append(len(text)), n_removed.append(len(text) - len(kept[-1])), out.append([{"start": a, "end": b} for a, b in runs])
            yield pa.record_batch([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return joined.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """Every string of every document, in order of doc_id; for tests."""
    import hashlib

    seen, out = {}, {}
    for doc, text in docs:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            seen[s] = min(seen.get(s, doc), doc)
    for doc, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] < doc:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[doc] = (len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out
