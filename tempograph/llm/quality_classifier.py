"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Features are word 1- and 2-grams and 1-, 2- and 3-grams of word shapes, hashed into 2^BITS slots. A shape
says whether a word has capitals, lower case, digits or marks, how it ends, whether it is long and whether
it repeats one of the three words before it. Each of the two groups of counts is scaled to unit length, so long and short texts
score alike. A score is the sparse dot product of features and weights, put through the logistic function.

Training takes at most `max_train` labelled rows (the bound of the fit; rows of least hash, so the choice
does not depend on order). Scoring covers every document and whole texts.

Defined results: null and wordless texts get the bias alone, a score between 0 and 1; with no usable labels
all weights are 0 and every score is 0.5; repeated rows are scored alike; labels whose value is null are
not learnt from; a document labelled twice is learnt from twice; doc_id may be null (never labelled) and of any type; an
empty table gives an empty one; extra columns are ignored, or kept if asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE_CLASS, doc_numbers, mix, shingles, steps, tidy, utf8, word_hashes, words_of

BITS = 18
MAX_TRAIN = 8_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.0
KEEP_FROM = 0.3

_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])
_LOWCASE = np.array([0x61 <= b <= 0x7A for b in range(256)])
_DIGIT = np.array([0x30 <= b <= 0x39 for b in range(256)])
_MARK = np.array([b < 0x80 and not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A) for b in range(256)])


def _any(flags: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=c[1:])
    return (c[e] - c[s]).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS):
    """(document, slot, value) of all features, sorted by document and slot, for a few documents."""
    s, e, first = words_of(data, offsets, SPACE_CLASS)
    n_docs = len(offsets) - 1
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    doc = doc_numbers(first)
    h = word_hashes(LOWER[data], s, e)
    last = data[e - 1]
    shape = (np.minimum(_any(_UPPER[data], s, e), 2) + 3 * np.minimum(_any(_LOWCASE[data], s, e), 1) + 6 * np.minimum(_any(_DIGIT[data], s, e), 1) + 12 * np.minimum(_any(_MARK[data], s, e), 3)).astype(np.uint64)
    shape += np.uint64(64) * np.where(_MARK[last], last, 0).astype(np.uint64) + np.uint64(1 << 15) * (e - s > 14)
    for back in (1, 2, 3):
        same = np.zeros(len(h), bool)
        same[back:] = (h[back:] == h[:-back]) & (doc[back:] == doc[:-back])
        shape |= same.astype(np.uint64) << np.uint64(15 + back)
    shape = mix(shape + np.uint64(1))
    keys, owners, group = [], [], []
    for salt, (x, n, g) in enumerate(((h, 1, 0), (h, 2, 0), (shape, 1, 1), (shape, 2, 1), (shape, 3, 1))):
        k = shingles(x, n)
        inside = doc[: len(k)] == doc[n - 1 : n - 1 + len(k)]
        keys.append((mix(k[inside] + np.uint64(salt)) >> np.uint64(64 - bits)).astype(np.int64))
        owners.append(doc[: len(k)][inside])
        group.append(np.full(int(inside.sum()), g))
    key = (np.concatenate(owners) * 2 + np.concatenate(group)) << bits | np.concatenate(keys)
    key, count = np.unique(key, return_counts=True)
    half = key >> bits
    norm = np.sqrt(np.bincount(half, weights=count.astype(np.float64) ** 2, minlength=2 * n_docs))
    return half >> 1, key & ((1 << bits) - 1), (count / norm[half]).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, label: str, max_train: int = MAX_TRAIN, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (bias last) from at most `max_train` labelled documents. `labels` holds the rows to learn from."""
    marked = labels.select(F.col("doc_id").alias("l"), F.col(label).cast("double").alias("y")).filter("y is not null and l is not null")
    # The bound on what is learnt from. Least hashes first: the same rows whatever the partitioning. At most
    # `max_train` small rows are broadcast, so only the chosen texts are moved.
    sample = marked.orderBy(F.xxhash64("l"), "l", "y").limit(max_train)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("l")).orderBy(F.xxhash64("l"), "l", "y", F.xxhash64("text")).limit(max_train).select("text", "y")

    def fit(batches):
        examples = []
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in steps(offsets):
                d, slot, value = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], bits)
                at = np.searchsorted(d, np.arange(hi - lo + 1))
                examples += [(slot[at[i] : at[i + 1]].astype(np.int32), value[at[i] : at[i + 1]], y[lo + i]) for i in range(hi - lo)]
        size = 1 << bits
        z, n = np.zeros(size + 1), np.zeros(size + 1)
        for _ in range(epochs if examples else 0):
            for slot, value, y in examples:
                i, x = np.append(slot, size), np.append(value, np.float32(1))
                zi, ni = z[i], n[i]
                w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
                g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
                z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
                n[i] = ni + g * g
        w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
        yield pa.record_batch([pa.array([w.astype("<f4").tobytes()], pa.binary())], ["w"])

    parts = [np.frombuffer(r[0], "<f4") for r in chosen.coalesce(1).mapInArrow(fit, "w binary").collect()]  # 2^bits numbers
    return parts[0] if parts else np.zeros((1 << bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, keep_from: float = KEEP_FROM, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, score and predicted of every document."""
    docs = docs.select(F.col("text").alias("_text"), *keep)
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 2^bits numbers, whatever the corpus
    bits = int(len(weights) - 1).bit_length() - 1

    def run(batches):
        w = sent.value
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            total = np.zeros(batch.num_rows)
            for lo, hi in steps(offsets):
                d, slot, value = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], bits)
                total[lo:hi] = np.bincount(d, weights=w[slot] * value, minlength=hi - lo)
            p = 1 / (1 + np.exp(-np.clip(total + float(w[-1]), -30, 30)))
            yield pa.record_batch([*batch.columns[1:], pa.array(np.round(p, 6))], [*keep, "score"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(tidy(run), f"{fields}, score double").withColumn("predicted", (F.col("score") >= keep_from).cast("int"))


def fold(column="doc_id"):
    """Held out: the remainder of crc32(id as text) by 5 is 0."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` (doc_id among them), score, predicted and held_out: learnt from labels outside the held-out fold."""
    weights = train(docs, labels.filter(~fold()), label, max_train)
    return score(docs, weights, keep=keep).withColumn("held_out", F.coalesce(fold(), F.lit(False)))
