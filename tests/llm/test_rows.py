"""Repeated rows of one doc_id, null and string doc_ids, and one long text: every operator gives one defined row for each row or key."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tempograph.llm import bpe, decontaminate, jaccard_join, lm_score, pii, quality_classifier, quality_rules, suffix_dedup, toxicity, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")

SHARED = "one passage that is shared word for word by some of these rows and is long enough to matter for all operators here"
LONG = " ".join(f"w{i * i % 9973}" for i in range(250_000))
ROWS = [
    ("a", "alpha beta gamma delta. " + SHARED), ("a", "alpha beta gamma delta. " + SHARED), ("a", "another text under the same id"), (None, SHARED), (None, "no id, mail me at x.y@example.org"), (None, None),
    ("b", SHARED + " and then something else"), ("c", None), ("d", ""), ("e", LONG),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id string, text string").repartition(3)


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def test_bpe(odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    want = Counter()
    for doc, text in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[doc, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())] += 1
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    for got in (bpe.round_trip(odd, PATH, 100_000), bpe.decode(bpe.encode(odd, PATH), PATH)):
        assert Counter(tuple(r[c] for c in columns) for r in bpe.digest(got).collect()) == want


def test_suffix_dedup(odd, spark):
    """Brute force over rows, null before every other id; rows of one id take nothing from each other."""
    order = lambda d: (d is not None, d or "")
    seen: dict[bytes, tuple] = {}
    rows = [r for r in ROWS if r[0] != "e"]
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - 49):
            seen[b[i : i + 50]] = min(seen.get(b[i : i + 50], order(doc)), order(doc))
    want = Counter()
    for doc, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if seen[b[i : i + 50]] < order(doc):
                gone[i : i + 50] = b"\1" * 50
        want[doc, len(b), sum(gone), sha(bytes(x for x, g in zip(b, gone) if not g))] += 1
    got = Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "kept_sha256")) for r in suffix_dedup.digest(suffix_dedup.remove(odd.filter("doc_id is null or doc_id <> 'e'"))).collect())
    assert got == want and any(k[2] for k in want)
    long = suffix_dedup.digest(suffix_dedup.remove(odd)).filter("doc_id = 'e'").collect()
    assert [(r.n_bytes, r.n_removed) for r in long] == [(len(LONG), 0)]
    # Only the text that a smaller doc_id has goes, not what another row of the same id would lose.
    a, b = "".join(chr(97 + i * 7 % 26) for i in range(80)), "".join(chr(65 + i * 11 % 26) for i in range(85))
    df = spark.createDataFrame([(1, a), (2, a + b), (2, b)], "doc_id int, text string")
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove(df).collect()) == [(1, 80, 0), (2, 85, 0), (2, 165, 80)]


def test_decontaminate(odd, spark):
    items = spark.createDataFrame([("i1", SHARED, "x"), ("i1", SHARED, "y"), (None, SHARED, "z"), ("i2", "gamma delta", "z"), ("i3", None, "z")], "item_id string, text string, words string")
    got = Counter((r.doc_id, r.n_hit, tuple(r.item_ids)) for r in decontaminate.decontaminate(odd, items).collect())
    n = len(SHARED.split())
    assert got == Counter({("a", n + 2, ("i1", "i2")): 2, ("a", 0, ()): 1, (None, n, ("i1",)): 1, (None, 0, ()): 2, ("b", n, ("i1",)): 1, ("c", 0, ()): 1, ("d", 0, ()): 1, ("e", 0, ()): 1})


def test_jaccard_join(odd):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link_components(odd).collect())
    k = len(SHARED.split()) - 4
    assert got[None, k, None] == 1 and got["a", k + 4, None] == 2 and got["b", k + 4, None] == 1  # all near SHARED, whose least id is null
    assert got["c", 0, "c"] == 1 and got["d", 0, "d"] == 1 and sum(got.values()) == len(ROWS)


def test_pii(odd):
    found = pii.personal_data(odd)
    assert Counter(r.doc_id for r in pii.digest(found).collect()) == Counter(d for d, _ in ROWS)
    want = Counter((d, t.replace("x.y@example.org", "<email>") if t else t) for d, t in ROWS)
    assert Counter((r.doc_id, r.text) for r in pii.redact(odd, found).collect()) == want


def test_scores(odd, spark):
    """One row out for each row in; equal rows score alike."""
    labels = spark.createDataFrame([("a", 1, 0, "q"), (None, 0, 1, "q"), ("b", 0, 1, "q"), ("b", 0, 1, "q")], "doc_id string, quality int, toxic int, text string")
    for got, column in ((quality_classifier.quality(odd, labels), "score"), (toxicity.toxicity(odd, labels), "score"), (lm_score.lm_scores(odd), "log_score"), (quality_rules.judge(odd), "kept")):
        rows = got.collect()
        assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in ROWS)
        assert all(r[column] is not None for r in rows)
    want = Counter(lm_score.brute_force([t for _, t in ROWS[:-1]], 3))
    got = lm_score.lm_scores(odd.filter("doc_id is null or doc_id <> 'e'")).collect()
    assert Counter((r.n_words, r.n_backed_off, r.n_unseen) for r in got) == Counter({k[:3]: 0 for k in want}) + Counter(k[:3] for k in want.elements())


def test_url_filter(spark):
    pages = spark.createDataFrame([(None, "http://a.net/es/1", "u"), (1, "http://a.net/es/1", "u"), (1, "http://a.net/es/1", "u"), (1, None, "u"), (2, "http://b.org/" + "x/" * 100_000, "u")], "page_id long, url string, host string")
    labels = spark.createDataFrame([(1, 0, 0, "z"), (1, 1, 0, "z"), (None, 0, 1, "z")], "doc_id long, quality int, toxic int, tokens string")
    got = Counter((r.page_id, r.rule, r.verdict) for r in url_filter.filter_urls(pages, labels).collect())
    assert got == Counter({(None, "net/es/", "block"): 1, (1, "net/es/", "block"): 2, (1, None, "allow"): 1, (2, None, "allow"): 1})
    assert url_filter.filter_urls(pages.limit(0), labels).count() == 0


def test_pipeline_stages(odd, spark):
    """Null, repeated and empty rows, clashing columns and an empty table."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    ids = {None: None, "a": 1, "b": 2, "c": 3, "d": 4, "e": 5}
    rows = [(ids[d], t, "en", "s", len(t or ""), "x", "x") for d, t in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words string, row string")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        out = stage(spark, docs, sf).collect()
        got = Counter(r.doc_id for r in out)
        if name == "near_duplicates":
            assert got == Counter({None: 3, 1: 1, 3: 1, 4: 1, 5: 1})  # the null ids' three texts, the other text of 1
        elif name == "personal_data":
            assert got == Counter(r[0] for r in rows) and not any(pii.brute_force(r.text) for r in out)
        elif name != "quality":
            assert got == Counter(r[0] for r in rows)
