"""Conversation repair, spelling variants and repeated phrases against brute force, and rows that are odd."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tempograph.llm import conversation_repair, jaccard_join, lm_score, phrase_dedup, spelling

ROW = "conv_id string, turn long, role string, text string, id long, copies long, audit string"


def turns(spark, rows):
    """With extra columns whose names clash."""
    return spark.createDataFrame([(*r, 7, 7, "x") for r in rows], ROW).repartition(3)


def some_turns(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    texts = ["Yes.", "No!", "and so", "", " \t", "why? ", "a.b", None, "Ünï.\n"]
    roles = ["user", "assistant", "system", "tool", "", None]
    out = []
    for c in range(n):
        k = r.randint(0, 3)
        at = r.sample(range(6), k)
        out += [(f"c{c}", t if r.random() < 0.9 else None, r.choices(roles, (8, 8, 4, 1, 1, 1))[0], r.choice(texts)) for t in at]
    return out


def by_conv(df):
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_repair_equals_all_edits(spark):
    rows = some_turns(3, 60) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hello."), ("dup", 1, "user", "Hi."), ("dup", 1, "user", "Hi.")]
    assert by_conv(conversation_repair.digest(turns(spark, rows))) == conversation_repair.brute_force(rows)


def test_repair_of_long_conversations_in_pieces(spark, monkeypatch):
    """Pieces of any size, put together in rounds, give what one pass over the whole conversation gives."""
    r = random.Random(5)
    rows = [("long", i, r.choice(("user", "assistant", "system", "x")), r.choice(("Yes.", "no", "", f"t{i}.", f"u{i}"))) for i in range(300)] + [("short", 1, "user", "Hi.")]
    df = conversation_repair.damage(turns(spark, rows))
    flagged = conversation_repair.with_first(conversation_repair.ordered(df)).cache()
    live = sorted(flagged.filter("conv_id = 'long'").collect(), key=lambda x: x.id)
    want = conversation_repair.decided(conversation_repair.least_paths([(x.initial, x.blank or not x.first, int(x.truncated), x.copies) for x in live], conversation_repair.START))
    for size, bits, joined in ((256, 14, 64), (7, 3, 2), (1, 4, 3)):
        parts = conversation_repair.whole(conversation_repair.pieces(flagged, size, bits), joined)
        got = {x.conv_id: (x.cost, x.audit, x.illegal) for x in conversation_repair.audits(parts).collect()}
        assert got["long"][:2] == want
        line = [x.initial for x in live for _ in range(x.copies)]
        assert got["long"][2] == sum(a + b not in ("su", "ua", "au") for a, b in zip(line, line[1:]))
    found, kept = conversation_repair.repair(df)
    told = "".join(x.role[:1] for x in kept.filter("conv_id = 'long'").collect())
    assert told == told[0] * (told[0] == "s") + "ua" * (len(told) // 2)
    assert found.filter("conv_id = 'long'").first().cost == want[0]


def test_repair_of_empty_and_dropped(spark):
    assert conversation_repair.digest(turns(spark, []).limit(0)).count() == 0
    gone = next(i for i in range(1000) if spark.sql(f"select crc32('{i}:1') % 20").first()[0] == 0)
    got = by_conv(conversation_repair.digest(turns(spark, [(str(gone), 1, "user", "Hi.")])))
    assert got == {str(gone): (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_many_copies_are_one_row(spark):
    """A row repeated very often is deleted in one step."""
    rows = spark.createDataFrame([("a", 1, "user", "Hi.", 100_000), ("a", 2, "assistant", "Yes.", 1)], "conv_id string, turn long, role string, text string, copies long")
    found, kept = conversation_repair.repair(rows)
    r = found.first()
    assert (r.cost, r.duplicate, r.illegal) == (3 * 99_999, 99_999, 99_999) and r.audit == "K" + "D" * 99_999 + "K"
    assert [(x.edit, x.role, x.text) for x in kept.collect()] == [("K", "user", "Hi."), ("K", "assistant", "Yes.")]


def variant_texts(seed=2, n=80):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeéÀ") for _ in range(r.randint(6, 10))) for _ in range(30)]
    out = []
    for i in range(n):
        words = []
        for _ in range(r.randint(10, 120)):
            w = r.choice(base[: r.randint(1, 30)])
            if r.random() < 0.1:
                at = r.randrange(len(w))
                w = w[:at] + r.choice(("", "x", w[at] + "z")) + w[at + 1 :]
            words.append(w.upper() if r.random() < 0.1 else w)
        out.append((i, ", ".join(words)))
    chain = [(910, "quiltingaa " * 2), (911, "quiltingab " * 20), (912, "quiltingbb " * 200)]
    return out + chain + [(900, None), (901, ""), (902, "x" * 5000 + " " + "x" * 5000), (903, "x" * 5001 + " " + "x" * 5001), (None, "Straßenbahn Straßenbahn naïvement naïvement ×÷×÷×÷×")]


@pytest.mark.parametrize(("groups", "chunk"), [(6, 1024), (2, 7), (1, 3)])
def test_spelling(spark, groups, chunk):
    rows = variant_texts()
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, groups, chunk).collect()}
    want = spelling.brute_force(rows)
    assert got == want and sum(f[0] is not None for f in want.values()) > 20 and any(f[0] and f[1] != f[0] for f in want.values())


def test_spelling_of_nothing(spark, empty, docs):
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(docs.filter("text is null")).count() == 0


def test_spelling_dictionary_is_sent_on(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 5)
    rows = variant_texts(4, 10)
    got = {r.word: r.n for r in spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {w: x[2] for w, x in spelling.brute_force(rows).items()}


def test_gram_pairs_equal_all_pairs():
    r = random.Random(1)
    words = sorted({"".join(r.choice("abc") for _ in range(7)) for _ in range(300)})
    longer = sorted({"".join(r.choice("abc") for _ in range(8)) for _ in range(300)})
    m = lambda x: np.array([list(w.encode()) for w in x], np.uint8)
    i, j = spelling.near_in_chunks(m(words), m(words), same=True)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a in range(len(words)) for b in range(a + 1, len(words)) if sum(x != y for x, y in zip(words[a], words[b])) == 1}
    i, j = spelling.near_in_chunks(m(words), m(longer))
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, w in enumerate(words) for b, v in enumerate(longer) if any(v[:p] + v[p + 1 :] == w for p in range(8))}


def phrases(rows):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows.collect()}


@pytest.mark.parametrize(("hot", "batch"), [(20_000, 60_000), (2, 30)])
def test_phrase_dedup(spark, docs, rows, empty, hot, batch):
    """With marks that are split into parts, and automata of a few windows, too."""
    got = phrases(phrase_dedup.digest(phrase_dedup.remove(docs, hot=hot, batch_windows=batch)))
    want = phrase_dedup.brute_force(rows)
    assert got == want and sum(x[1] for x in want.values()) > 100
    assert phrase_dedup.remove(empty).count() == 0


def test_phrases_of_any_length(spark):
    r = random.Random(8)
    vocabulary = ["a", "b", "c", "dd", "é"]
    rows = [(i, " \n".join(r.choices(vocabulary[: r.randint(1, 5)], k=r.randint(0, 60)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for length, k in ((20, 5), (6, 2), (3, 3)):
        for hot in (20_000, 3):
            got = {x.doc_id: (x.n_words, x.n_removed, hashlib.sha256(x.kept.encode()).hexdigest()) for x in phrase_dedup.remove(df, length, k, hot, 50).collect()}
            assert got == phrase_dedup.brute_force(rows, length)


def test_phrases_of_odd_ids(spark):
    """Rows of one doc_id take nothing from each other; null comes before every other id."""
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [("2", a + " " + b), ("2", a), ("2", a), ("1", b), (None, a), (None, None), ("3", a + " " + a)]
    df = spark.createDataFrame([(*x, "w", 1) for x in rows], "doc_id string, text string, words string, n int").repartition(3)
    for hot in (20_000, 1):
        got = Counter((r.doc_id, r.n_words, r.n_removed) for r in phrase_dedup.remove(df, hot=hot).collect())
        assert got == Counter([("2", 60, 60), ("2", 30, 30), ("2", 30, 30), ("1", 30, 0), (None, 30, 0), (None, 0, 0), ("3", 60, 60)])


def thue_morse(n: int = 10) -> tuple[str, str]:
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_a_polynomial_confuses(spark):
    """Two words of 1,024 letters whose polynomials modulo 2^64 are equal for every odd base."""
    a, b = thue_morse()
    lead = " ".join(f"w{i}" for i in range(22))
    rows = [(1, a), (2, b), (3, f"{lead} {a} {lead}"), (4, f"{lead} {b} {lead}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_components(df).collect()}
    assert got == jaccard_join.brute_force(rows) and got[2][1] == 2
    want = lm_score.brute_force([t for _, t in rows], 3)
    scored = {r.doc_id: (r.n_words, r.n_backed_off, r.n_unseen, r.log_score) for r in lm_score.lm_scores(df).collect()}
    assert all(scored[i][:3] == w[:3] and scored[i][3] == pytest.approx(w[3], abs=1e-4) for (i, _), w in zip(rows, want))
    assert phrases(phrase_dedup.digest(phrase_dedup.remove(df))) == phrase_dedup.brute_force(rows)
