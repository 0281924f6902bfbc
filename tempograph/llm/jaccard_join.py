"""N-gram Jaccard join by parity sketches.

A document is its set of distinct word shingles. For a size band, a sketch has N cells; each shingle is hashed to a
cell and XORed into it. One shingle changes one cell, so the number of differing cells (their Hamming distance) is at most
the symmetric difference of two sets. Sets of sizes a and b with Jaccard similarity of at least t differ in at most
D = (1-t)/(1+t) * (a+b) shingles, so with more than D cells that aren't empty, two similar sets agree in one of them
(pigeonhole). Agreeing cells are the join key.

1. Each document sends its non-empty cells for its own band and the band below, so partners of either
   size meet. A set with too few non-empty cells sends a prefix of its shingles by hash order instead (a set of
   N shingles needs floor((1-t) * N) + 1 of them): any two such sets that are similar share one.
2. Rows are partitioned and sorted by key and read as a stream, so a group of any size takes no memory. Every member is paired with
   the first of its group; groups of up to SMALL members are paired fully.
3. Sets that are equal fall together first (one representative), then a 1,024-bit parity sketch and the sizes
   drop most pairs. Larger sets are compared by a longer sketch (8 to 16 bits a shingle, folded to the shorter one's length), and the texts
   of the rest are compared exactly.
4. Links give components. Groups of more than SMALL members that then lie in one component are finished. The others are mixed.
   A set whose cells outside mixed groups are still more than D has met all its partners in those (the pigeonhole again). The
   few sets without such room are paired with each other in mixed groups if they lie in different components, filtered by bit sketch inside the
   join, and verified: no link between different texts is lost, and no group is expanded into all its pairs.

Defined results: null, empty and wordless texts have no shingles and link with nothing; a text of fewer words than a shingle
is one shingle; equal texts link. doc_id may be of any type that sorts, null before all others; repeated rows and several texts of one doc_id stay a row each and
link by their texts like other documents; a component's id is the smallest doc_id in it. Extra columns are ignored.
Words and shingles are compared by 64-bit hashes (`common.word_hashes`), not letter by letter, as is the equality of sets (128 bits). An empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE_CLASS, likely, mix, numbered, shingles, steps, stored, tidy, utf8, word_hashes, words_of

SHINGLE = 5
#: Similarity as a fraction.
T_NUM, T_DEN = 75, 100
SMALL = 4
SKETCH_WORDS = 16
#: Sets that a task remembers in order to send each only once; past so many it starts anew.
MET = 100_000
#: Parts that a group of equal sets is split into where rows look up its representative.
SALT = 32
#: Cells for each one that the pigeonhole needs: room for empty ones.
SPARE = 1.2


def doc_sets(batch, column: int, n: int = SHINGLE):
    """(row, sorted distinct 64-bit shingle hashes) of each document."""
    data, offsets = utf8(batch.column(column))
    for lo, hi in steps(offsets):
        part = LOWER[data[offsets[lo] : offsets[hi]]]
        s, e, first = words_of(part, offsets[lo : hi + 1] - offsets[lo], SPACE_CLASS)
        h = word_hashes(part, s, e)
        all_of = shingles(h, n)
        for d in range(hi - lo):
            a, b = first[d], first[d + 1]
            if b - a >= n:
                yield lo + d, np.unique(all_of[a : b - n + 1])
            elif b > a:
                yield lo + d, shingles(h[a:b], int(b - a)) + np.uint64(b - a)
            else:
                yield lo + d, h[:0]


def _bands(t_num: int, t_den: int, up_to: int) -> list[tuple[int, int]]:
    """(lowest, highest size) of each band up to the one that holds `up_to`."""
    out, low = [], 1
    while not out or out[-1][1] < up_to:
        high = max(-(-low * t_den // t_num), low + 1) - 1
        out.append((low, high))
        low = high + 1
    return out


def _cells(high: int, t_num: int, t_den: int) -> tuple[int, int]:
    """For a band of sizes up to `high`: most shingles that a linked pair differs in, and cells of the sketch."""
    total = high + high * t_den // t_num
    differ = (t_den - t_num) * total // (t_den + t_num)
    return differ, int(SPARE * (differ + 1)) + 1


def _cell_of(h: np.ndarray, cells: int) -> np.ndarray:
    return (mix(h ^ np.uint64(0xA5A5)) % np.uint64(cells)).astype(np.int64)


def _own_bands(size: int, bands: list[tuple[int, int]]) -> tuple[int, ...]:
    """The set's band, and the one below if there is one: there it meets smaller partners."""
    b = next(i for i, (_, high) in enumerate(bands) if high >= size)
    return (b, b - 1) if b else (b,)


def _keys(h: np.ndarray, bands: list[tuple[int, int]], band: int, t_num: int, t_den: int) -> np.ndarray:
    """Join keys of one set in one band."""
    differ, cells = _cells(bands[band][1], t_num, t_den)
    cell = _cell_of(h, cells)
    order = np.argsort(cell, kind="stable")
    at = np.flatnonzero(np.r_[True, cell[order][1:] != cell[order][:-1]])
    used = cell[order][at].astype(np.uint64)
    x = np.bitwise_xor.reduceat(mix(h[order]), at)
    keys = mix(mix(x + used) + np.uint64(band))
    if len(used) <= differ:  # the pigeonhole could miss a partner that also has too few: prefix by hash order
        lead = len(h) - -(-t_num * len(h) // t_den) + 1
        keys = np.concatenate([keys, mix(mix(np.sort(mix(h))[:lead]) + np.uint64(band) + np.uint64(1 << 40))])
    return keys


def set_table(docs: DataFrame, t_num: int = T_NUM, t_den: int = T_DEN, n: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, fingerprint, spare0, spare1, sketch words s0..): one small row for each document. `spare` is by how much its
    non-empty cells exceed D, in its own band and in the one below."""
    docs = docs.select("doc_id", "text")
    names = [f"s{i}" for i in range(SKETCH_WORDS)]

    def run(batches):
        bands = _bands(t_num, t_den, 1 << 12)
        for batch in batches:
            size, prints, words = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows, np.zeros((batch.num_rows, SKETCH_WORDS), np.uint64)
            spare = np.zeros((2, batch.num_rows), np.int32)
            for row, h in doc_sets(batch, 1, n):
                size[row] = len(h)
                if len(h):
                    if len(h) > bands[-1][1]:
                        bands = _bands(t_num, t_den, len(h))
                    for role, band in enumerate(_own_bands(len(h), bands)):
                        differ, cells = _cells(bands[band][1], t_num, t_den)
                        spare[role, row] = np.count_nonzero(np.bincount(_cell_of(h, cells), minlength=1)) - differ
                    prints[row] = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                    bit = mix(h + np.uint64(7)) >> np.uint64(54)
                    np.bitwise_xor.at(words[row], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
            yield pa.record_batch([batch.column(0), pa.array(size), pa.array(prints, pa.binary()), pa.array(spare[0]), pa.array(spare[1]), *(pa.array(np.ascontiguousarray(w).view(np.int64)) for w in words.T)], ["doc_id", "n_shingles", "fingerprint", "spare0", "spare1", *names])

    return docs.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, fingerprint binary, spare0 int, spare1 int, " + ", ".join(f"{x} long" for x in names))


def cell_rows(docs: DataFrame, t_num: int = T_NUM, t_den: int = T_DEN, n: int = SHINGLE) -> DataFrame:
    """(key, doc_id): non-empty cells in the document's band (even keys) and in the one below (the same keys plus one)."""
    docs = docs.select("doc_id", "text")

    def run(batches):
        bands = _bands(t_num, t_den, 1 << 12)
        met: set[bytes] = set()
        for batch in batches:
            rows, keys = [], []
            for row, h in doc_sets(batch, 1, n):
                if not len(h):
                    continue
                # Of equal sets in a task one speaks for all: their pairs are made of representatives later on.
                name = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                if name in met:
                    continue
                if len(met) >= MET:
                    met.clear()
                met.add(name)
                if len(h) > bands[-1][1]:
                    bands = _bands(t_num, t_den, len(h))
                for role, band in enumerate(_own_bands(len(h), bands)):
                    # 44 bits of key: two different cells share one so rarely that it only costs a comparison.
                    k = _keys(h, bands, band, t_num, t_den) >> np.uint64(20) << np.uint64(1) | np.uint64(role)
                    keys.append(k)
                    rows.append(np.full(len(k), row))
                if sum(map(len, keys)) > 1 << 18:
                    yield _rows(batch, rows, keys)
                    rows, keys = [], []
            yield _rows(batch, rows, keys)

    def _rows(batch, rows, keys):
        at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        key = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
        return pa.record_batch([pa.array(key), batch.column(0).take(pa.array(at))], ["key", "doc_id"])

    return docs.mapInArrow(tidy(run), f"key long, doc_id {docs.schema['doc_id'].dataType.simpleString()}")


def group_pairs(rows: DataFrame, small: int = SMALL) -> DataFrame:
    """(key, a, b) from groups of rows that share a key, its last bit aside. `key` is null for pairs; members of groups of more than `small`
    come with their key and a = b as well, for the second look. Two members from the band above need no pair here: they meet in their own band."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        group = first = None  # of the group that goes on
        window: list = []
        count = 0
        for batch in batches:
            key, d = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            n = len(key)
            if not n:
                continue
            k = key >> 1
            out_k, out_a, out_b = [], [], []

            def tell(key, a, b):
                out_k.append(key), out_a.append(a), out_b.append(b)

            new = np.r_[k[0] != group, k[1:] != k[:-1]]
            start = np.flatnonzero(new)
            size = np.diff(np.r_[start, n])
            # Groups of one row make nothing; the last one may go on in the next batch.
            spans = [(int(s), int(s + z)) for s, z in zip(start[size > 1], size[size > 1])]
            if not new[0]:
                spans.insert(0, (0, int(start[0]) if len(start) else n))
            tail = int(start[-1]) if len(start) else 0
            if not any(s == tail for s, _ in spans):
                spans.append((tail, n))
            for s, e in spans:
                if s or new[0]:
                    group, first, window, count = k[s], (d[s] if not key[s] & 1 else None), [], 0
                if first is None:  # even keys come first, so there are none
                    continue
                for own, x in zip(key[s:e].tolist(), d[s:e].tolist()):
                    if window and (own, x) == window[-1]:
                        continue
                    if count == small:  # the group turns out large: its members so far are told as well
                        for other, y in window:
                            tell(other, y, y)
                    if count >= small:
                        tell(own, x, x)
                        tell(None, first, x)
                        window = [(own, x)]
                    else:
                        for other, y in window:
                            if not other & 1:
                                tell(None, y, x)
                        window.append((own, x))
                    count += 1
            yield pa.record_batch([pa.array(out_k, pa.int64()), pa.array(out_a, batch.column(1).type), pa.array(out_b, batch.column(1).type)], ["key", "a", "b"])

    together = rows.withColumn("g", F.shiftright("key", 1)).repartition("g").sortWithinPartitions("key", "doc_id").select("key", "doc_id")
    return together.mapInArrow(tidy(run), f"key long, a {id_type}, b {id_type}")


def _may_link(a: str, b: str, t_num: int, t_den: int) -> Column:
    """Size bound and Hamming bound on two rows of set_table with prefixes a and b."""
    na, nb = F.col(f"{a}n_shingles"), F.col(f"{b}n_shingles")
    apart = sum((F.bit_count(F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))
    return (t_den * F.least(na, nb) >= t_num * F.greatest(na, nb)) & ((t_num + t_den) * apart <= (t_den - t_num) * (na + nb))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()


def pass_long_sketch(pairs: DataFrame, docs: DataFrame, t_num: int = T_NUM, t_den: int = T_DEN, n: int = SHINGLE) -> DataFrame:
    """Pairs whose long sketches allow a link. Bit counts are powers of two; a sketch is folded to half by XOR of its halves."""
    id_type = pairs.schema["a"].dataType.simpleString()

    def sketch(batches):
        for batch in batches:
            rows, out, size = [], [], []
            for row, h in doc_sets(batch, 1, n):
                if len(h):
                    bits = 1 << int(8 * len(h) - 1).bit_length()
                    at, count = np.unique(mix(h + np.uint64(11)) & np.uint64(bits - 1), return_counts=True)
                    flags = np.zeros(bits, np.uint8)
                    flags[at[count % 2 == 1].astype(np.int64)] = 1
                    rows.append(row), size.append(len(h)), out.append(np.packbits(flags).tobytes())
            yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(size, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n", "sketch"])

    sketches = likely(docs.select("doc_id", "text"), _ends(pairs)).mapInArrow(tidy(sketch), f"doc_id {id_type}, n long, sketch binary")
    side = lambda x: sketches.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a").select("a", "b", "na", "nb", "sa", "sb")

    def compare(batches):
        for batch in batches:
            keep = []
            for i, (na, nb, sa, sb) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(2, 6)))):
                x, y = np.frombuffer(sa, np.uint8), np.frombuffer(sb, np.uint8)
                while len(x) != len(y):
                    if len(x) > len(y):
                        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                    else:
                        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                if (t_num + t_den) * int(np.bitwise_count(x ^ y).sum()) <= (t_den - t_num) * (na + nb):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.mapInArrow(tidy(compare), f"a {id_type}, b {id_type}")


def verify(pairs: DataFrame, docs: DataFrame, t_num: int = T_NUM, t_den: int = T_DEN, n: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) whose texts are similar, compared on whole sets. Only texts of such pairs are moved."""
    id_type = pairs.schema["a"].dataType.simpleString()
    texts = likely(docs.select("doc_id", "text"), _ends(pairs))
    left = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    both = left.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")

    def run(batches):
        for batch in batches:
            sets_b = dict(doc_sets(batch, 2, n))
            codes = batch.column(0).dictionary_encode().indices.to_numpy()
            lead = np.unique(codes, return_index=True)[1]  # each a once
            sets_a = {int(codes[lead[i]]): h for i, h in doc_sets(batch.take(pa.array(lead)), 3, n)}
            keep = []
            for row, c in enumerate(codes.tolist()):
                x, y = sets_a[c], sets_b[row]
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common and t_den * common >= t_num * (len(x) + len(y) - common):
                    keep.append(row)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.select("a", "b", "text_b", "text_a").mapInArrow(tidy(run), f"a {id_type}, b {id_type}")


def components(links: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable from each id that has a link. Labels go to neighbours and are then
    followed to their own label, so long chains halve each round; only a count of changes comes to the driver."""
    edges = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    while True:
        near = edges.hint("merge").join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = stored(labels.hint("merge").join(near, "id").select("id", F.col("component").alias("before"), F.least("component", "near").alias("component")), "lower")
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("further"))
        after = stored(lower.hint("merge").join(jump, "component", "left").select("id", "before", F.least("component", F.coalesce("further", "component")).alias("component")), "after")
        labels = after.select("id", "component")
        if after.filter("before <> component").isEmpty():
            return labels


def link_components(docs: DataFrame, t_num: int = T_NUM, t_den: int = T_DEN, n: int = SHINGLE, small: int = SMALL) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    rows, _, plain = numbered(docs)
    if plain:
        return _linked(rows.select("doc_id", "text"), t_num, t_den, n, small)
    found = link_rows(rows, t_num, t_den, n, small)
    name = rows.select(F.col("n").alias("component"), F.col("doc_id").alias("component_id")).dropDuplicates(["component"])
    return found.hint("merge").join(name, "component").select("doc_id", "n_shingles", "component_id")


def link_rows(rows: DataFrame, t_num: int = T_NUM, t_den: int = T_DEN, n: int = SHINGLE, small: int = SMALL) -> DataFrame:
    """(doc_id, n, n_shingles, component) of every row of `common.numbered`; `component` is the smallest number in the component."""
    texts = rows.select(F.col("n").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    linked = _linked(texts, t_num, t_den, n, small).select(F.col("doc_id").alias("n"), "n_shingles", F.col("component_id").alias("component"))
    return rows.select("doc_id", "n").hint("merge").join(linked, "n").select("doc_id", "n", "n_shingles", "component")


def _linked(docs: DataFrame, t_num: int, t_den: int, n: int, small: int) -> DataFrame:
    """The same for distinct ids."""
    named = stored(set_table(docs, t_num, t_den, n), "sets")
    # Representatives of sets that several documents have; the others stand for themselves. Rows of one large group look it up in several parts.
    several = named.filter("fingerprint is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.count("*").alias("_n")).filter("_n > 1")
    several = several.select("fingerprint", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
    salted = named.filter("fingerprint is not null").select("doc_id", "fingerprint", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int").alias("_salt"))
    rep_of = stored(salted.hint("merge").join(several, ["fingerprint", "_salt"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep")), "reps")
    found = stored(group_pairs(cell_rows(docs, t_num, t_den, n), small).distinct(), "groups")

    def to_reps(pairs: DataFrame, *more: str) -> DataFrame:
        """Pairs of different sets, the smaller id first."""
        for side in ("a", "b"):
            pairs = pairs.withColumnRenamed(side, "doc_id").hint("merge").join(rep_of, "doc_id").drop("doc_id").withColumnRenamed("rep", side)
        return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *more).distinct()

    sized = named.select("doc_id", "n_shingles", *(f"s{i}" for i in range(SKETCH_WORDS)))
    side = lambda p: sized.select(*(F.col(c).alias(f"{p}{c}") for c in sized.columns))
    pairs = to_reps(found.filter("key is null").select("a", "b"))
    near = pairs.hint("merge").join(side("a_"), F.col("a") == F.col("a_doc_id")).join(side("b_").hint("merge"), F.col("b") == F.col("b_doc_id")).filter(_may_link("a_", "b_", t_num, t_den)).select("a", "b")
    near = stored(near, "near")
    check = lambda p, name: stored(verify(stored(pass_long_sketch(p, docs, t_num, t_den, n), f"{name}_close"), docs, t_num, t_den, n), name)
    links = check(near, "links")
    comp = components(links)

    # Large groups that aren't in one component: sets that have no room left outside them, paired across components, filtered inside the join.
    members = found.filter("key is not null").select("key", F.col("a").alias("doc_id")).hint("merge").join(rep_of, "doc_id").select(F.shiftright("key", 1).alias("key"), F.col("key").bitwiseAND(1).alias("role"), F.col("rep").alias("m")).distinct()
    members = members.hint("merge").join(comp.withColumnRenamed("id", "m"), "m", "left").withColumn("component", F.coalesce("component", "m"))
    mixed = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    members = stored(members.hint("merge").join(mixed, "key", "left_semi"), "mixed")
    spare = F.when(F.col("role") == 0, F.col("spare0")).otherwise(F.col("spare1"))
    short = members.groupBy("m", "role").agg(F.countDistinct("key").alias("n_mixed")).hint("merge").join(named.select(F.col("doc_id").alias("m"), "spare0", "spare1"), "m").filter(F.col("n_mixed") >= spare).select("m", "role")
    members = stored(members.hint("merge").join(short, ["m", "role"], "left_semi").drop("role").distinct().hint("merge").join(sized, F.col("m") == F.col("doc_id")).drop("doc_id"), "members")
    if not members.isEmpty():
        as_side = lambda p: members.select("key", *(F.col(c).alias(f"{p}{c}") for c in members.columns if c != "key"))
        across = as_side("a_").hint("merge").join(as_side("b_"), "key").filter((F.col("a_component") < F.col("b_component")) & _may_link("a_", "b_", t_num, t_den))
        late = across.select(F.least("a_m", "b_m").alias("a"), F.greatest("a_m", "b_m").alias("b")).distinct().join(near.hint("merge"), ["a", "b"], "left_anti")
        more = check(stored(late, "late"), "more_links")
        if not more.isEmpty():
            comp = components(links.unionByName(more))

    joined = named.select("doc_id", "n_shingles").distinct().join(rep_of.distinct().hint("merge"), "doc_id", "left").join(comp.withColumnRenamed("id", "rep").hint("merge"), "rep", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def brute_force(docs: list[tuple[int, str | None]], n: int = SHINGLE) -> dict[int, tuple[int, int]]:
    """All pairs, word by word; for tests."""
    sets = {}
    for doc, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 75 * max(len(x), len(y)):
                c = len(x & y)
                if 100 * c >= 75 * (len(x) + len(y) - c):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {d: (len(sets[d]), find(d)) for d in ids}
