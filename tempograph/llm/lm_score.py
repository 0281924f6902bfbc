"""Language-model scores by stupid backoff, from n-gram counts of the whole corpus.

Documents are dealt to blocks; each block explodes its texts into n-grams of 1 to `order` words and sums equal ones, which is
the map-side combine. The count table is partitioned by n-gram hash: a block sends each part of the table its n-grams of that part, so a
frequent n-gram is one entry a block. A part sums them, joins the sums to the entries it got, and sends them
back in the same order. Each document then sums its words' log scores.

A row that travels is one block's entries of one part: sorted hashes as differences, and counts, both compressed without loss (some 6 bytes
an entry). As Spark rows of their own, entries would take some 20 bytes, more than the 4 x input of disk that the task allows, as nearly every trigram is
distinct. A row is only sent where a block has n-grams of a part, so rows are never more than entries.

A document does not vouch for itself: its own occurrences are taken off every count. A word's score is
count(n-gram) / count(its first words) for the longest n-gram with a count left, times 0.4 for each step
back; at one word it is count / words of the other documents. A word that no other document has gets 0.4 for each
step, times 1 / (words of the other documents + 1).

Words are runs without space or \\t..\\r, with A-Z lower-cased, compared by 64-bit hash.
Defined results: null and wordless texts have 0 words, log score 0 and a null mean; repeated rows count as
documents of their own; a corpus of one document has only unseen words; doc_id may be null and of any type that sorts; an
empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE_CLASS, block_count, dealt, mix, shingles, squeeze, steps, unpacked, unsqueeze, utf8, word_hashes, words_of

ORDER = 3
BACKOFF = 0.4
BLOCK_CHARS = 12 << 20


def _grams(rows: pa.Table, order: int):
    """For 1..order: hash of the n-gram that ends at each word (valid where the document has n words by then); document and place in it of each word."""
    parts = []
    data, offsets = utf8(rows["text"])
    n_words = np.zeros(len(offsets) - 1, np.int64)
    for lo, hi in steps(offsets):
        part = LOWER[data[offsets[lo] : offsets[hi]]]
        s, e, first = words_of(part, offsets[lo : hi + 1] - offsets[lo], SPACE_CLASS)
        n_words[lo:hi] = np.diff(first)
        parts.append(word_hashes(part, s, e))
    h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    place = np.arange(len(h)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    out = []
    for k in range(1, order + 1):
        g = np.zeros(len(h), np.uint64)
        g[k - 1 :] = mix(shingles(h, k) + np.uint64(k)) | np.uint64(1)  # 0 is the key of all words
        out.append(g)
    return out, doc, place, n_words


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how often each occurs, and which each row has."""
    u, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    return u, count, inverse


def _entries(grams: list[np.ndarray], place: np.ndarray, n_words: np.ndarray, parts: int):
    """Distinct n-grams of a block in order of hash: hashes, counts, and the row bounds and numbers of their parts, which are equal ranges of hashes. Hash 0 counts all words."""
    keys, counts = [np.zeros(1, np.uint64)], [np.array([n_words.sum()], np.uint32)]
    for k, g in enumerate(grams):
        u, c = np.unique(g[place >= k], return_counts=True)
        keys.append(u)
        counts.append(c.astype(np.uint32))
        del u, c
    h, count = np.concatenate(keys), np.concatenate(counts)
    del keys, counts
    order = np.argsort(h)
    h, count = h[order], count[order]
    del order
    part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return h, count, np.r_[cut, len(h)], part[cut]


def _word_scores(grams, doc, place, h, total, outside, backoff):
    """Of each word: log score, whether it backed off, whether no other document has it. `h` and `total` are sorted hashes and corpus counts."""
    left = []  # what is left of each word's n-gram counts without its own document
    for k, g in enumerate(grams):
        g = np.where(place >= k, g, np.uint64(0))  # a run of words that begins in the document before is none of this one's
        u, _, inverse = _counted(g)
        all_of = total[np.minimum(np.searchsorted(h, u), len(h) - 1)][inverse]
        _, own, own_of = _counted(mix(g + np.uint64(0x9E37) * doc.astype(np.uint64)))
        left.append(np.where(place >= k, all_of - own[own_of], 0))
    log, done, steps_back = np.zeros(len(doc)), np.zeros(len(doc), bool), np.zeros(len(doc), np.int64)
    for k in range(len(grams) - 1, 0, -1):
        can = ~done & (place >= k)
        seen = can & (left[k] > 0)
        i = np.flatnonzero(seen)
        log[i] = np.log(left[k][i] / left[k - 1][i - 1]) + steps_back[i] * math.log(backoff)
        done |= seen
        steps_back += can & ~seen
    i = np.flatnonzero(~done)
    known = left[0][i] > 0
    log[i] = np.log(np.where(known, left[0][i] / np.maximum(outside[i], 1), 1 / (outside[i] + 1))) + (steps_back[i] + ~known) * math.log(backoff)
    unseen = np.zeros(len(doc), bool)
    unseen[i[~known]] = True
    return log, steps_back > 0, unseen


def lm_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_words, n_backed_off, n_unseen, log_score, mean_log_score), natural logarithms."""
    docs = docs.select("doc_id", "text")
    n = block_count(docs, block_chars)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    parts = 2 * n  # a part's entries of all blocks are half as many as a block's
    blocked = dealt(docs, n)

    def explode(rows: pa.Table) -> pa.Table:
        block = rows["block"][0].as_py()
        grams, _, place, n_words = _grams(unpacked(rows), order)
        h, count, bounds, part = _entries(grams, place, n_words, parts)
        del grams, place
        sent = [(squeeze(np.diff(h[a:b], prepend=np.uint64(0))), squeeze(count[a:b])) for a, b in zip(bounds[:-1], bounds[1:])]
        return pa.table({"part": part, "block": pa.array(np.full(len(part), block, np.int32)), "h": pa.array([x for x, _ in sent], pa.binary()), "n": pa.array([x for _, x in sent], pa.binary())})

    def total(rows: pa.Table) -> pa.Table:
        h = [np.cumsum(unsqueeze(x.as_buffer(), np.uint64), dtype=np.uint64) for x in rows["h"]]
        counts = np.concatenate([unsqueeze(x.as_buffer(), np.uint32) for x in rows["n"]])
        bounds = np.cumsum([0, *map(len, h)])
        h = np.concatenate(h)
        order = np.argsort(h)
        h = h[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        sums = np.empty(len(h), np.int64)
        sums[order] = np.repeat(np.add.reduceat(counts[order], first, dtype=np.int64), np.diff(np.r_[first, len(h)]))
        del h, order, counts
        return pa.table({"block": rows["block"], "part": rows["part"], "total": pa.array([squeeze(sums[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())})

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows = unpacked(rows)
        grams, doc, place, n_words = _grams(rows, order)
        h = _entries(grams, place, n_words, parts)[0]
        total = np.concatenate([unsqueeze(x.as_buffer(), np.int64) for x in answers.sort_by("part")["total"]])
        if len(h) != len(total):
            raise ValueError(f"a block has {len(h)} n-grams, {len(total)} were counted")
        others = int(total[0])  # hash 0
        size = len(n_words)
        log_score, backed, unseen = np.zeros(size), np.zeros(size, np.int64), np.zeros(size, np.int64)
        ends = np.r_[0, np.cumsum(n_words)]
        for lo, hi in steps(ends, 1 << 18):  # a few documents at a time: what is worked out for each word is dropped again
            own = slice(ends[lo], ends[hi])
            of = doc[own] - lo
            log, back, none = _word_scores([g[own] for g in grams], of, place[own], h, total, (others - n_words[lo:hi])[of], backoff)
            log_score[lo:hi] = np.bincount(of, log, minlength=hi - lo)
            backed[lo:hi] = np.bincount(of, back, minlength=hi - lo)
            unseen[lo:hi] = np.bincount(of, none, minlength=hi - lo)
        return pa.table({"doc_id": rows["doc_id"], "n_words": n_words, "n_backed_off": backed, "n_unseen": unseen, "log_score": np.round(log_score, 6)})

    entries = blocked.groupBy("block").applyInArrow(explode, "part long, block int, h binary, n binary")
    answers = entries.groupBy("part").applyInArrow(total, "block int, part long, total binary")
    scored = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {id_type}, n_words long, n_backed_off long, n_unseen long, log_score double")
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6)))


def brute_force(texts: list[str | None], order: int = ORDER, backoff: float = BACKOFF) -> list[tuple[int, int, int, float]]:
    """The same, counting word tuples; for tests."""
    docs = [re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    grams = [[Counter(tuple(d[i : i + k]) for i in range(len(d) - k + 1)) for k in range(1, order + 1)] for d in docs]
    every = [sum((g[k] for g in grams), Counter()) for k in range(order)]
    out = []
    for d, own in zip(docs, grams):
        left = lambda g, own=own: every[len(g) - 1][g] - own[len(g) - 1][g]
        outside = sum(map(len, docs)) - len(d)
        backed = unseen = 0
        total = 0.0
        for i in range(len(d)):
            back, value = 0, None
            for k in range(min(order, i + 1), 1, -1):
                g = tuple(d[i - k + 1 : i + 1])
                if left(g):
                    value = left(g) / left(g[:-1])
                    break
                back += 1
            if value is None:
                u = left((d[i],))
                unseen += not u
                value = u / outside if u else backoff / (outside + 1)
            backed += back > 0
            total += math.log(value * backoff**back)
        out.append((len(d), backed, unseen, round(total, 6)))
    return out
