"""Toxicity by maximum-scoring segments.

Tokens are words and their first 4, 5 and 6 bytes, so an inflected form is known by its stem; a word scores as the
mean of its tokens. Token scores are log-odds between toxic and other labelled texts, positive and negative ones alike: the log-ratio of the
posterior means of the token's share on each side. For a token of pooled share q a side has the Dirichlet prior of "this token" and "any other"
with base (q, 1 - q) and mass PRIOR / q, worth PRIOR counts of the token however frequent it is: (t + PRIOR) / (N + PRIOR / q), which is q times
(t + PRIOR) / (q * N + PRIOR).
A token counts once for each distinct text, so repeats and exact copies add no evidence; for the same reason a word that
occurs among the NEAR words before it can't add to a segment. An offset makes the mean score of a text that isn't toxic negative.
A linear scan (Ruzzo and Tompa) finds all disjoint maximal segments of a document; those
that reach the cut are its toxic passages. By extreme-value theory the best segment among n words of a
random text follows a Gumbel law, with `lambda` the positive root of E[exp(lambda * s)] = 1 over the words of learning texts
that aren't toxic. Segment scores are put in those units, lambda * S - log(n), summed over significant passages, and set on a
0..1 scale by a logistic fit on a histogram of the learning rows. For lambda and for the fit a text is scored without its own counts.

Counts cover every labelled learning row (no sample), aggregated in Spark into 2^BITS token slots; at most 2^BITS
pairs of counts leave Spark.

Defined results: null and wordless texts have no passage and get the score of no evidence; with no usable
labels every score is 0; repeated rows score alike; labels with null values are not learnt from; doc_id may be null (never
labelled) and of any type; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_CLASS, LOWER, doc_numbers, likely, mix, steps, stored, utf8, word_hashes, words_of
from .quality_classifier import fold

BITS = 20
STEMS = (4, 5, 6)
PRIOR = 1.0
OFFSET = 0.3
NEAR = 8
TOXIC_FROM = 0.5


class Model(NamedTuple):
    """Scores of token slots in three rows: as they are, without one text that isn't toxic, without one that is."""

    scores: np.ndarray
    offset: float
    lam: float


def _slots(batch, column):
    """Step by step: first row, the slots of each word's tokens (word, then stems), first word of each document."""
    data, offsets = utf8(batch.column(column))
    for lo, hi in steps(offsets):
        part = LOWER[data[offsets[lo] : offsets[hi]]]
        s, e, first = words_of(part, offsets[lo : hi + 1] - offsets[lo], ALNUM_CLASS)
        slots = [mix(word_hashes(part, s, e if k is None else np.minimum(e, s + k)) + np.uint64(k or 0)) >> np.uint64(64 - BITS) for k in (None, *STEMS)]
        yield lo, [x.astype(np.int64) for x in slots], first


def learning_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(text, y): one row for each distinct labelled text and label. Texts themselves are moved once, for the chosen ones."""
    marked = labels.select(F.col("doc_id").alias("l"), F.col(label).cast("int").alias("y")).filter("y in (0, 1)")
    keyed = docs.select("doc_id", F.sha2("text", 256).alias("k")).hint("merge").join(marked, F.col("doc_id") == F.col("l"))
    chosen = stored(keyed.groupBy("k", "y").agg(F.min("doc_id").alias("l")).select("l", "y"), "chosen")
    rows = likely(docs.select("doc_id", "text"), chosen.select(F.col("l").alias("doc_id"))).join(chosen.hint("shuffle_hash"), F.col("doc_id") == F.col("l")).select("text", "y")
    return stored(rows, "learning")


def log_odds(c: np.ndarray, t: np.ndarray, nc: float, nt: float) -> np.ndarray:
    """Log-odds of tokens seen in `c` clean and `t` toxic texts, of all `nc` and `nt` tokens: both posterior means divided by the pooled share."""
    n = (c + t) / (nc + nt)
    return np.log((t + PRIOR) / (n * nt + PRIOR)) - np.log((c + PRIOR) / (n * nc + PRIOR))


def _word_values(scores: np.ndarray, slots: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """The score of each word before the offset; at most 0 if the word is among the NEAR before it."""
    value = np.zeros(len(slots[0]))
    for slot in slots:
        value += scores[slot]
    value /= len(slots)
    place = np.arange(len(value)) - np.repeat(first[:-1], np.diff(first))
    again = np.zeros(len(value), bool)
    for k in range(1, NEAR + 1):
        again[k:] |= (slots[0][k:] == slots[0][:-k]) & (place[k:] >= k)
    value[again] = np.minimum(value[again], 0)
    return value


def learn(rows: DataFrame) -> Model | None:
    """The scores of all token slots, the offset and lambda; nothing without texts of both labels."""

    def count(batches):
        sums = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, slots, first in _slots(batch, 0):
                once = np.unique(np.concatenate([doc_numbers(first) << BITS | slot for slot in slots]))
                of, slot = y[lo + (once >> BITS)], once & ((1 << BITS) - 1)
                for k in (0, 1):
                    np.add.at(sums[k], slot[of == k], 1)
        used = np.flatnonzero(sums[0] + sums[1])
        yield pa.record_batch([pa.array(used), pa.array(sums[0][used]), pa.array(sums[1][used])], ["slot", "clean", "toxic"])

    counts = rows.mapInArrow(count, "slot long, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).toArrow()  # at most 2^BITS rows
    c, t = np.zeros(1 << BITS), np.zeros(1 << BITS)
    slot = counts["slot"].to_numpy()
    c[slot], t[slot] = counts["c"].to_numpy(), counts["t"].to_numpy()
    nc, nt = float(c.sum()), float(t.sum())
    if not nc or not nt:
        return None
    scores = np.stack([log_odds(c, t, nc, nt), log_odds(np.maximum(c - 1, 0), t, nc, nt), log_odds(c, np.maximum(t - 1, 0), nc, nt)]).astype(np.float32)
    sent = rows.sparkSession.sparkContext.broadcast(scores[1])  # 2^BITS numbers

    def values(batches):
        for batch in batches:
            for _, slots, first in _slots(batch, 0):
                at, n = np.unique(np.round(_word_values(sent.value, slots, first) * 100).astype(np.int64), return_counts=True)
                yield pa.record_batch([pa.array(at), pa.array(n.astype(np.int64))], ["at", "n"])

    hist = rows.filter("y = 0").select("text").mapInArrow(values, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # scores in hundredths
    s, p = hist["at"].to_numpy() / 100, hist["n"].to_numpy().astype(float)
    if not len(p):
        return None
    p /= p.sum()
    offset = OFFSET + max(0.0, float((p * s).sum()))
    mean = lambda x: float((p * np.exp(np.minimum(x * (s - offset), 500))).sum())
    lo, hi = 0.0, 1.0
    while mean(hi) < 1 and hi < 8:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean(mid) < 1 else (lo, mid)
    return Model(scores, offset, lo)


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All disjoint maximal scoring segments (start, end, score), in linear time."""
    stack: list[list[float]] = []  # start, end, sum left of it, sum up to its end
    total = 0.0
    for i, x in enumerate(scores):
        if x <= 0:
            total += x
            continue
        new = [i, i + 1, total, total + x]
        total += x
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
        stack.append(new)
    return [(int(a), int(b), d - c) for a, b, c, d in stack]


def _segments(value: np.ndarray) -> list[tuple[int, int, float]]:
    """The same for many words: neighbours above 0 always share a segment, so runs of one sign are summed first."""
    if not len(value):
        return []
    up = value > 0
    start = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
    end = np.r_[start[1:], len(value)]
    return [(int(start[a]), int(end[b - 1]), s) for a, b, s in maximal_segments(np.add.reduceat(value, start).tolist())]


def _significant(value: np.ndarray, lam: float, cut: float) -> tuple[list[tuple[int, int, float]], float]:
    """Segments of one document that reach the cut, and their sum in extreme-value units."""
    size = np.log(max(2, len(value)))
    sums = np.r_[0.0, np.cumsum(value)]
    if lam * (sums - np.minimum.accumulate(sums)).max() - size <= cut - 1e-6:  # the best segment doesn't
        return [], 0.0
    kept = [x for x in _segments(value) if lam * x[2] - size > cut]
    return kept, sum(lam * x - size for _, _, x in kept)


def passages(docs: DataFrame, model: Model | None, cut: float = 0.0) -> DataFrame:
    """(doc_id, n_words, evidence, passages): significant passages as (first word, end, score), and their sum in
    extreme-value units."""
    docs = docs.select("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(model and model._replace(scores=model.scores[0]))  # 2^BITS numbers
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = sent.value
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            evidence, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for lo, slots, first in _slots(batch, 1):
                n_words[lo : lo + len(first) - 1] = np.diff(first)
                if model:
                    value = _word_values(model.scores, slots, first) - model.offset
                    for d in range(len(first) - 1):
                        spans[lo + d], evidence[lo + d] = _significant(value[first[d] : first[d + 1]], model.lam, cut)
            yield pa.record_batch(
                [batch.column(0), pa.array(n_words), pa.array(evidence), pa.array([[{"start": a, "end": b, "score": x} for a, b, x in y] for y in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))],
                ["doc_id", "n_words", "evidence", "passages"],
            )

    return docs.mapInArrow(run, f"doc_id {id_type}, n_words long, evidence double, passages array<struct<start:int,end:int,score:double>>")


def calibrate(rows: DataFrame, model: Model | None, cut: float = 0.0) -> tuple[float, float]:
    """Slope and intercept of the logistic map from evidence to probability, from a histogram of learning rows, each without its own counts."""
    if not model:
        return 0.0, -30.0
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            bins = np.zeros(batch.num_rows, np.int64)
            for lo, slots, first in _slots(batch, 0):
                values = [_word_values(model.scores[1 + k], slots, first) - model.offset for k in (0, 1)]
                for d in range(len(first) - 1):
                    bins[lo + d] = min(400, round(4 * _significant(values[y[lo + d]][first[d] : first[d + 1]], model.lam, cut)[1]))
            yield pa.record_batch([pa.array(bins), pa.array(y)], ["bin", "y"])

    hist = rows.mapInArrow(run, "bin long, y long").groupBy("bin", "y").count().collect()  # at most 802 rows
    if len({r["y"] for r in hist}) < 2:
        return 0.0, -30.0
    x, y, n = (np.array([float(r[k]) for r in hist]) for k in ("bin", "y", "count"))
    x = np.log1p(x / 4)
    n = n * np.where(y > 0, n[y == 0].sum() / n[y > 0].sum(), 1.0) ** 0.5  # lean half way to equal classes
    a, b = 1.0, -1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        g = np.array([(n * (p - y) * x).sum() + 1e-3 * a, (n * (p - y)).sum()])
        hess = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(a), float(b)


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", toxic_from: float = TOXIC_FROM) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_words, passages): learnt from labels outside the held-out fold."""
    rows = learning_rows(docs, labels.filter(~fold()), label)
    model = learn(rows)
    found = stored(passages(docs, model), "passages")
    a, b = calibrate(rows, model)
    p = F.round(1 / (1 + F.exp(-(F.lit(a) * F.log1p("evidence") + F.lit(b)))), 6)
    return found.select("doc_id", F.coalesce(fold(), F.lit(False)).alias("held_out"), p.alias("score"), (p >= toxic_from).cast("int").alias("predicted"), "n_words", "passages")
