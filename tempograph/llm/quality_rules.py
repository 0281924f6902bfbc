"""Quality rules from suffix arrays: how much of a text is repetition.

The words of a text become numbers (a batch-wide dictionary), and all suffixes of all texts of a step are
sorted together by prefix doubling, text by text: a rank for 1, 2, 4, ... words, until no two suffixes of a
text share a rank. Neighbours in that order give longest common prefixes, and LCP intervals give the maximal
repeated substrings: runs of neighbours with a common prefix of at least `min_words` words that cannot be made longer
on either side without losing an occurrence. Their occurrences' spans are united. A text fails if the spans
cover more than `max_covered` of its words, or its longest repeat is longer than `max_repeat` words and than
`max_repeat_share` of the text.

Words are compared by number, so nothing rests on hashes. Texts are judged whole and one by one: no shuffle.

Defined results: null, empty and wordless texts have zero counts and fail the base rule; repeated rows are
each judged; a text of one word has no repeats; doc_id may be null and of any type, as rows are judged
by themselves; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, doc_numbers, steps, utf8, words_of

MIN_WORDS = 5
MAX_COVERED = 0.25
MAX_REPEAT = 40
MAX_REPEAT_SHARE = 0.10
BASE_WINDOW = 8

_CONTINUES = np.array([0x80 <= b <= 0xBF for b in range(256)])
#: Fixed values of the base rule: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.array([b in SYMBOLS for b in range(256)])


def word_numbers(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Equal words get equal numbers."""
    if not len(s):
        return np.zeros(0, np.int64)
    size = e - s
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(s - ends[:-1], size) + np.arange(ends[-1])
    words = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[at])])
    return pc.dictionary_encode(words).indices.to_numpy().astype(np.int64)


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks of keys, and the order that sorts them."""
    order = np.argsort(key, kind="stable")
    new = np.r_[False, key[order][1:] != key[order][:-1]] if len(key) else np.zeros(0, bool)
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new)
    return rank, order


def suffix_ranks(words: np.ndarray, doc: np.ndarray):
    """Prefix doubling over many texts. Gives the suffixes in order, and the ranks for 1, 2, 4, ... words; two
    suffixes of one text have one rank at level i exactly when they share 2^i words."""
    n = len(words)
    levels = [_dense(doc * (int(words.max(initial=0)) + 1) + words)[0]]
    order, width = _dense(levels[0])[1], 1
    end = np.searchsorted(doc, doc, "right") if n else doc
    while n:
        rank = levels[-1]
        again = np.bincount(rank)[rank] > 1  # settled suffixes keep their place
        if not again.any():
            break
        i = np.flatnonzero(again)
        nxt = np.zeros(len(i), np.int64)
        inside = i + width < end[i]
        nxt[inside] = rank[i[inside] + width] + 1
        # Ranks with gaps: where a group starts in the sorted order.
        start = np.cumsum(np.bincount(rank)) - np.bincount(rank)
        sub, _ = _dense(rank[i] * (n + 1) + nxt)
        size = np.bincount(sub)
        before = np.cumsum(size) - size
        owner = np.zeros(len(size), np.int64)
        owner[sub] = rank[i]
        lead = np.r_[True, owner[1:] != owner[:-1]]
        group_first = start[owner] + before - np.repeat(before[lead], np.diff(np.r_[np.flatnonzero(lead), len(owner)]))
        place = start[rank]
        place[i] = group_first[sub]
        levels.append(_dense(place)[0])
        width *= 2
    if n:
        order = np.argsort(levels[-1], kind="stable")
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before it in order (0 across texts), read off the levels."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    a, b = order[:-1].copy(), order[1:].copy()
    end = np.searchsorted(doc, doc, "right")
    end_a, end_b = end[a], end[b]
    got = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        w = 1 << k
        # A rank can be shared by suffixes that end before w words; both must have w words left.
        ok = (a + w <= end_a) & (b + w <= end_b)
        same = np.zeros(n - 1, bool)
        same[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        a[same] += w
        b[same] += w
        got[same] += w
    lcp[1:] = got
    return lcp


def longest_shared(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each suffix, the most words that it shares with any other of its text: the larger of its two neighbouring prefixes."""
    out = np.zeros(len(order), np.int64)
    if len(order):
        out[order] = np.maximum(lcp, np.r_[lcp[1:], 0])
    return out


def maximal_repeats(order: np.ndarray, lcp: np.ndarray, doc: np.ndarray, min_words: int) -> np.ndarray:
    """For each suffix, the length of the maximal repeat of at least `min_words` words that starts there (0: none).

    The deepest LCP interval a suffix is in is its longest repeat. Where the suffix one word earlier has a repeat one
    word longer, this one can be extended to the left and is not maximal; the longer one covers it."""
    best = longest_shared(order, lcp)
    best[best < min_words] = 0
    extends = np.zeros(len(best), bool)
    extends[1:] = (best[:-1] == best[1:] + 1) & (doc[1:] == doc[:-1])
    return np.where(extends, 0, best)


def _covered(length: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span that starts at i and is length[i] long."""
    delta = np.zeros(n + 1, np.int64)
    i = np.flatnonzero(length)
    np.add.at(delta, i, 1)
    np.add.at(delta, i + length[i], -1)
    return np.cumsum(delta[:-1]) > 0


def judge(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT, max_repeat_share: float = MAX_REPEAT_SHARE) -> DataFrame:
    """Per document: base counts, covered words, longest repeat, base_failed and kept."""
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            cols = [np.zeros(batch.num_rows, np.int64) for _ in range(7)]
            for lo, hi in steps(offsets):
                part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                for c, v in zip(cols, _step(part, off, min_words)):
                    c[lo:hi] = v
            yield pa.record_batch([batch.column(0), *map(pa.array, cols)], ["doc_id", *_COLUMNS])

    rows = docs.mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in _COLUMNS))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    fine = (F.col("n_covered") <= F.lit(max_covered) * F.col("n_words")) & ~((F.col("longest_repeat") > max_repeat) & (F.col("longest_repeat") > F.lit(max_repeat_share) * F.col("n_words")))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")


def _step(data: np.ndarray, offsets: np.ndarray, min_words: int):
    n_docs = len(offsets) - 1
    if not len(data):
        return [np.zeros(n_docs, np.int64)] * 7
    per_byte = lambda flags: np.diff(np.r_[0, np.cumsum(flags)][offsets])
    s, e, first = words_of(data, offsets, SPACE_CLASS)
    doc = doc_numbers(first)
    n_words = np.diff(first)
    chars = per_byte(SPACE_CLASS[data] & ~_CONTINUES[data])
    symbols = per_byte(_SYMBOL[data])
    # Lines with a word, equal to an earlier one of the same text.
    cls = np.ones(256, bool)
    cls[10] = False
    ls, le, lfirst = words_of(data, offsets, cls)
    space = np.r_[0, np.cumsum(SPACE_CLASS[data])]
    worded = space[le] > space[ls]
    line = word_numbers(data, ls, le)
    line_doc = doc_numbers(lfirst)
    key = (line_doc * (int(line.max(initial=0)) + 1) + line)[worded]
    distinct = np.unique(key, return_index=True)[1]
    dup = np.bincount(line_doc[worded], minlength=n_docs) - np.bincount(line_doc[worded][distinct], minlength=n_docs)
    words = word_numbers(data, s, e)
    order, levels = suffix_ranks(words, doc)
    n = len(words)
    repeat = np.zeros(n_docs, np.int64)
    covered = longest = repeat
    if n:
        lcp = common_prefixes(order, levels, doc)
        maximal = maximal_repeats(order, lcp, doc, min_words)
        twice = _covered(np.where(longest_shared(order, lcp) >= BASE_WINDOW, BASE_WINDOW, 0), n)
        repeat = np.bincount(doc[twice], minlength=n_docs)
        covered = np.bincount(doc[_covered(maximal, n)], minlength=n_docs)
        longest = np.zeros(n_docs, np.int64)
        np.maximum.at(longest, doc, maximal)
    return n_words, chars, symbols, dup, repeat, covered, longest


def brute_force(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """The base columns, word by word; for tests."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places: dict[tuple, list[int]] = {}
    for i in range(len(words) - BASE_WINDOW + 1):
        places.setdefault(tuple(words[i : i + BASE_WINDOW]), []).append(i)
    hit = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + BASE_WINDOW)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words)


def brute_force_repeats(text: str | None, min_words: int = MIN_WORDS) -> tuple[int, int]:
    """Words covered by repeated runs of at least `min_words` words, and the longest repeat; for tests."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    hit, longest = set(), 0
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        if best >= min_words:
            hit |= set(range(i, i + best))
            longest = max(longest, best)
    return len(hit), longest
