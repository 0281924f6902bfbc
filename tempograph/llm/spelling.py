"""Groups of spelling variants: words one edit apart, found by blocked Gram matrices of their letter counts.

1. Each task counts the words of its texts in a bounded dictionary; Spark sums the counts.
2. A word's block is its length and its letter counts summed in GROUPS groups of letters. One inserted letter adds one to the length and to one
   group; one replaced letter leaves the length and moves one from a group to another, or none. So a word's near words lie in the
   blocks of its own length and the next that differ from its own by that much, which are few.
3. Blocks are sorted and cut into chunks of CHUNK words. A join pairs each chunk with the chunks of its neighbouring blocks, each pair once. For
   a pair, one NumPy product of the two matrices of letter counts gives all squared distances |a|^2 + |b|^2 - 2ab. One edit
   makes it 1 (inserted) or 2 (replaced), so pairs of at most 2 stay and are verified letter by letter.
4. Near words are summed by word: how many, and the most frequent. Forms are followed to the last by pointer jumping.

Letters are grouped by their totals over all words, so that the groups are about even; any grouping gives the same result.

Defined results: null and empty texts have no words, an empty table gives an empty one. A null doc_id is an empty string in `<doc_id>:<run>`; repeated
rows count again; doc_id may be of any type. Of equally frequent near words the smallest in code-point order is the form. Extra columns
are ignored. Letters are those of Latin-1, so a word is one byte for each letter in chunks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import squeeze, stored, unsqueeze

MIN_LETTERS = 7
MIN_COUNT = 2
DROP_EVERY = 31
FORM_RATIO = 10
GROUPS = 6
CHUNK = 1_024
#: Words that a task's dictionary holds before it is sent on.
HELD = 300_000
#: Candidate pairs that are verified at a time.
VERIFY = 1 << 18


def words_in(doc_id, text: str | None, least: int = MIN_LETTERS) -> Counter:
    """Words of at least `least` letters with their counts, each run that DROP_EVERY picks without one letter."""
    out: Counter = Counter()
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    lowered = (text or "").encode().lower().decode()  # bytes.lower: A-Z only
    for run, n in Counter(re.findall("[A-Za-zÀ-ÿ]{%d,}" % least, lowered)).items():
        h = zlib.crc32(run.encode(), seed)
        if h % DROP_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        out[run] += n
    return out


def word_counts(docs: DataFrame, least: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words that all texts together have at least `min_count` times."""

    def run(batches):
        held: Counter = Counter()

        def sent():
            return pa.record_batch([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                held.update(words_in(doc_id.as_py(), text.as_py(), least))
                if len(held) > HELD:
                    yield sent()
                    held.clear()
        if held:
            yield sent()

    found = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> np.ndarray:
    """A group for each Latin-1 letter: the most frequent first, each into the group with the least so far."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().collect()  # at most 90 rows
    total, group = [0] * groups, np.zeros(256, np.int64)
    for letter, n in sorted(((r["letter"], r["count"]) for r in letters if r["letter"]), key=lambda x: (-x[1], x[0])):
        least = total.index(min(total))
        group[ord(letter)] = least
        total[least] += n
    return group


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All letters of a few words as bytes, and the word that each is of."""
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    return flat, np.repeat(np.arange(len(words)), [len(w) for w in words])


def blocks(words: DataFrame, group: np.ndarray, groups: int = GROUPS) -> DataFrame:
    """(block, word, n): block is the length and the letters in each group, as text."""

    def run(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            flat, owner = _letters(names)
            sums = np.bincount(owner * groups + group[flat], minlength=len(names) * groups).reshape(-1, groups)
            yield pa.record_batch([pa.array([",".join(map(str, s)) for s in sums.tolist()], pa.string()), batch.column(0), batch.column(1)], ["block", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "block string, word string, n long")


def neighbours(block: str) -> list[str]:
    """The block itself, those with one letter more, and of those with one letter moved to another group the half that comes after."""
    sums = [int(x) for x in block.split(",")]
    out = [block]
    for i in range(len(sums)):
        sums[i] += 1
        out.append(",".join(map(str, sums)))
        for j in range(i):
            if sums[j]:
                sums[j] -= 1
                out.append(",".join(map(str, sums)))
                sums[j] += 1
        sums[i] -= 1
    return out


def chunks(blocked: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(block, first, letters, counts, targets): up to `chunk` words of a block, cut from one sort; a block of any size is many rows in many tasks."""

    def run(batches):
        block, names, counts = None, [], []

        def cut():
            letters = np.frombuffer("".join(names).encode("latin-1"), np.uint8)
            return pa.record_batch([pa.array([block]), pa.array([names[0]]), pa.array([squeeze(letters)], pa.binary()), pa.array([squeeze(np.array(counts, np.int64))], pa.binary()), pa.array([neighbours(block)], pa.list_(pa.string()))], ["block", "first", "letters", "counts", "targets"])

        for batch in batches:
            for b, w, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if names and (b != block or len(names) == chunk):
                    yield cut()
                    names, counts = [], []
                block = b
                names.append(w), counts.append(n)
        if names:
            yield cut()

    parts = blocked.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return blocked.repartitionByRange(int(parts), "block", "word").sortWithinPartitions("block", "word").mapInArrow(run, "block string, first string, letters binary, counts binary, targets array<string>")


def near_in_chunks(a: np.ndarray, b: np.ndarray, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of `a` and j of `b` (one byte a letter, a row a word) that are one edit apart; `b` has words as long or one letter longer. With `same` b is a, and i < j."""
    used, code = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
    k = len(used)

    def counted(words, codes):
        at = np.repeat(np.arange(len(words)) * k, words.shape[1]) + codes
        return np.bincount(at, minlength=len(words) * k).reshape(len(words), k).astype(np.float32)

    x, y = counted(a, code[: a.size]), counted(b, code[a.size :])
    gram = x @ y.T
    distance = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * gram  # whole numbers far below 2^24
    if same:
        distance[np.tril_indices(len(a))] = np.inf
    i, j = np.nonzero(distance <= 2)
    ok = np.empty(len(i), bool)
    for lo in range(0, len(i), VERIFY):
        p, q = a[i[lo : lo + VERIFY]], b[j[lo : lo + VERIFY]]
        if p.shape[1] == q.shape[1]:
            ok[lo : lo + VERIFY] = (p != q).sum(1) == 1
        else:
            n = p.shape[1]
            front = np.logical_and.accumulate(p == q[:, :n], axis=1).sum(1)
            back = np.logical_and.accumulate((p == q[:, 1:])[:, ::-1], axis=1).sum(1)
            ok[lo : lo + VERIFY] = front + back >= n
    return i[ok], j[ok]


def near_pairs(words: DataFrame, groups: int = GROUPS, chunk: int = CHUNK) -> DataFrame:
    """(word, other, n): all ordered pairs of near words, with the other's count. `words` (word, n) has each word once."""
    made = stored(chunks(blocks(words, letter_groups(words, groups), groups), chunk), "chunks")
    left = made.select(F.col("block").alias("own"), F.col("first").alias("own_first"), F.col("letters").alias("own_letters"), F.col("counts").alias("own_counts"), F.explode("targets").alias("block"))
    met = left.hint("merge").join(made.drop("targets"), "block").filter((F.col("own") != F.col("block")) | (F.col("own_first") <= F.col("first")))

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                own, own_first, first = (batch.column(c)[r].as_py() for c in (0, 1, 2))
                n, m = (unsqueeze(batch.column(c)[r].as_py(), np.int64) for c in (3, 4))
                a, b = (unsqueeze(batch.column(c)[r].as_py(), np.uint8).reshape(len(k), -1) for c, k in ((5, n), (6, m)))
                i, j = near_in_chunks(a, b, same=own == batch.column(7)[r].as_py() and own_first == first)
                if not len(i):
                    continue
                text = lambda rows: [x.decode("latin-1") for x in rows.view(f"S{rows.shape[1]}").ravel()]
                p, q = np.array(text(a), object)[i], np.array(text(b), object)[j]
                yield pa.record_batch([pa.array(np.concatenate([p, q]), pa.string()), pa.array(np.concatenate([q, p]), pa.string()), pa.array(np.concatenate([m[j], n[i]]))], ["word", "other", "n"])

    columns = ("own", "own_first", "first", "own_counts", "counts", "own_letters", "letters", "block")
    return met.select(*columns).mapInArrow(run, "word string, other string, n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): each form followed to the last, for words that have one (word, form). A form is far more frequent than its word, so
    chains are short and have no cycle; each round doubles how far a word sees, and is written."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        seen = stored(at.hint("merge").join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        at = seen.select("word", "root")
        if seen.filter("_moved").isEmpty():
            return at


def variants(docs: DataFrame, groups: int = GROUPS, chunk: int = CHUNK, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words."""
    words = stored(word_counts(docs), "words")
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("other").alias("word")))  # most frequent, then smallest
    near = near_pairs(words, groups, chunk).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("_best"))
    joined = words.hint("merge").join(near, "word", "left").withColumn("_n", -F.col("_best.less"))
    has_form = F.coalesce(F.col("_n") >= ratio * F.col("n"), F.lit(False))
    found = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has_form, F.col("_best.word")).alias("form"), F.when(has_form, F.col("_n")).alias("form_n")), "forms")
    last = roots(found.filter("form is not null"))
    return found.hint("merge").join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def brute_force(docs: list[tuple[object, str | None]]) -> dict[str, tuple]:
    """word: (form, root, n, n_near, form_n), by comparing all pairs of words; for tests."""
    total: Counter = Counter()
    for doc_id, text in docs:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c <= "Z" else c
                continue
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if run and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                total[run] += 1
            run = ""
    words = {w: n for w, n in total.items() if n >= 2}

    def one_edit(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    forms, out = {}, {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        forms[w] = (best if best is not None and words[best] >= 10 * n else None, len(near))
    for w, n in words.items():
        root = w
        while forms[root][0] is not None:
            root = forms[root][0]
        form = forms[w][0]
        out[w] = (form, root, n, forms[w][1], words[form] if form is not None else None)
    return out
