import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempograph.llm import bpe, decontaminate, jaccard_join, lm_score, pii, quality_classifier, quality_rules, queries, suffix_dedup, toxicity, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_bpe_round_trip(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    got = by_id(bpe.digest(bpe.decode(bpe.encode(docs, PATH, 2000), PATH)), "n_tokens", "ids_sha256", "decoded_sha256")
    for doc, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert got[doc] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode()))
    assert bpe.decode(bpe.encode(empty, PATH), PATH).count() == 0


def test_suffix_array():
    r = random.Random(5)
    for _ in range(300):
        x = [r.randrange(r.choice((1, 2, 3, 50))) for _ in range(r.randint(0, 60))]
        assert suffix_dedup.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


@pytest.mark.parametrize("hot", [4000, 5])
def test_suffix_dedup(docs, rows, empty, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup.closer_spans, "__defaults__", (hot, 20))
    got = by_id(suffix_dedup.digest(suffix_dedup.remove(docs)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == suffix_dedup.brute_force(rows)
    assert suffix_dedup.remove(empty).count() == 0


def test_quality_rules(docs, rows, empty):
    got = by_id(quality_rules.judge(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    repeats = by_id(quality_rules.judge(docs), "n_covered", "longest_repeat", "kept")
    for doc, text in rows:
        assert got[doc] == quality_rules.brute_force(text)
        if len((text or "").split()) < 150:
            assert repeats[doc][:2] == quality_rules.brute_force_repeats(text)
    assert not repeats[-8][2]
    assert quality_rules.judge(empty).count() == 0


def test_url_filter(spark):
    urls = [
        ("https://m.example.com/en/1?x#y", "m.example.com", "/en/1", "example.com/en/", "block"), ("http://WWW.Example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://a.net/es/2", "a.net", "/es/2", "net/es/", "block"), ("http://a.net/de/2", "a.net", "/de/2", None, "allow"), ("http://x.com/", "x.com", "/", "com/", "allow"),
        (None, "", "", None, "allow"), ("no scheme/en/", "", "", None, "allow"), ("://b.net?q/fr/", "b.net", "", None, "allow"), ("http://notexample.org/en/3", "notexample.org", "/en/3", None, "allow"),
        ("http://x.org://net/es/", "x.org:", "//net/es/", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(urls)], "page_id long, url string, tokens string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages.drop("tokens"), none).collect()}
    assert got == {i: u[1:] for i, u in enumerate(urls)}
    # A token combination that goes with bad labels is learnt, its parts aren't.
    many = [(i, f"http://{'bad' if i % 2 else 'good'}.org/{'x' if i // 2 % 2 else 'y'}/{i}", "") for i in range(800)]
    pages = spark.createDataFrame(many, "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, 0 if i % 2 and i // 2 % 2 else 1, 0) for i in range(0, 600)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, labels).collect()}
    assert got == {i: "block" if i % 2 and i // 2 % 2 else "allow" for i in range(800)}


def test_decontaminate(spark, docs, rows, empty):
    r = random.Random(2)
    items = [(i, " ".join((t or "").split()[r.randint(0, 3) :][:14])) for i, t in rows if i >= 0][::3] + [(900, "tie TIE tie"), (901, None), (902, "!?"), (903, "zz yy"), (904, "zz yy")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = decontaminate.brute_force(rows, items)
    for most in (1000, 7):  # prefixes are sent to the tasks, or joined by shuffle
        got = by_id(decontaminate.digest(decontaminate.decontaminate(docs, table, broadcast_prefixes=most)), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert got == want
    assert decontaminate.decontaminate(empty, table).count() == 0
    assert all(not r.n_hit for r in decontaminate.decontaminate(docs, table.limit(0)).collect())


def test_pii_base(docs, rows, empty, spark):
    odd = ["a@b.c@d.e@f.g", "x@y@z.w.", "1.2.3.4.5.6.7.8 999.1.1.1", "+1 (555) 555-0101 4111 1111 1111 1111", "@a.b a@.b a@b", "+49-30 1234567 +1+2 4539 1488 0343 6467 9", "0" * 40, "é+33 1 23 45 67 89"]
    more = rows + [(1000 + i, t) for i, t in enumerate(odd)]
    df = spark.createDataFrame(more, "doc_id long, text string")
    got = by_id(pii.digest(pii.personal_data(df)), "base_sha256", "spans", "n_email", "n_ip", "n_card", "n_phone")
    for doc, text in more:
        assert got[doc][2:] == tuple(sum(k == kind for k, _, _ in pii.brute_force(text)) for kind in pii.KINDS)
        assert got[doc][0] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in pii.brute_force(text)).encode()).hexdigest()
    assert pii.personal_data(empty).count() == 0


def test_pii_discovers_by_context(spark):
    rows = [(i, f"Please ring me at +1 (555) 010-{1000 + i} before noon, item {i}") for i in range(12)] + [(50, "Please ring me at 555.010.7777 before noon"), (51, "Sold 555.010.8888 units in all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.personal_data(df)
    got = by_id(pii.digest(found), "spans")
    assert got[50] == ("phone:18:30",) and got[51] == ("",)
    assert by_id(pii.redact(df, found), "text")[50] == ("Please ring me at <phone> before noon",)


def test_pii_discovers_in_lists_and_beside_seeds(spark):
    """Identifiers in one long run, in groups of a recurring shape, and after a fixed span."""
    numbers = [f"123-45-{6700 + i}" for i in range(8)]
    seeds = [(i, f"Please ring me at +1 (555) 010-{1000 + i} before noon") for i in range(30)] + [(100 + i, f"Kept for ext 10.0.0.{i} in all") for i in range(30)]
    rows = [*seeds, (50, f"Please ring me at {' '.join(numbers)} before noon"), (51, "Please ring me at 555 010 7777 555 010 8888 before noon"), (52, "Kept for ext 10.0.0.5 123-45-6789 in all"), (53, f"Sold {' '.join(numbers)} units")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.personal_data(df)
    got = by_id(pii.redact(df, found), "text")
    assert got[50] == (f"Please ring me at {' '.join(['<phone>'] * 8)} before noon",)
    assert got[51] == ("Please ring me at <phone> <phone> before noon",)
    assert got[52] == ("Kept for ext <ip> <ip> in all",)
    assert len(found.filter("doc_id = 50").first().spans) == 8


def test_pii_pieces():
    cut = lambda t: ([t[a:b] for a, b in pii._pieces(t, 0, len(t))[0]], pii._pieces(t, 0, len(t))[1])
    assert cut("123-45-6789 987-65-4321") == (["123-45-6789", "987-65-4321"], True)
    assert cut("555 010 7777 555 010 8888") == (["555 010 7777", "555 010 8888"], True)
    assert cut("5 123-45-6789") == (["123-45-6789"], False)
    assert cut("555 010 7777") == ([], False)
    assert [m[3] for m in pii._mentions("ext 10.0.0.5 123-45-6789")] == ["10.0.0.5", "123-45-6789"]


@pytest.mark.parametrize("small", [4, 2])
def test_jaccard_join(docs, rows, empty, small):
    got = by_id(jaccard_join.link_components(docs, small=small), "n_shingles", "component_id")
    assert got == jaccard_join.brute_force(rows)
    assert jaccard_join.link_components(empty).count() == 0


def test_jaccard_join_large_groups(spark):
    r = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = list(base) if i % 2 else base[:40] + [f"p{i}_{k}" for k in range(r.randint(2, 14))]
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"z{r.randrange(20)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(jaccard_join.link_components(df), "n_shingles", "component_id") == jaccard_join.brute_force(rows)


def labelled(spark, n=400):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.randint(30, 90))]
        bad, rude = i % 4 == 0, i % 3 == 0
        if rude:
            for _ in range(5):
                w.insert(len(w) // 2, r.choice(("rotten", "nasty", "vile")))
        rows.append((i, " ".join(f"{x.upper()}!!" for x in w) if bad else " ".join(w)))
        labels.append((i, int(not bad), int(rude)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (9999, None, None)], "doc_id long, quality int, toxic int")


def test_quality_classifier(spark, docs, empty):
    df, labels = labelled(spark)
    got = quality_classifier.quality(df, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 40 and np.mean([r.predicted == r.quality for r in got]) > 0.95
    odd = quality_classifier.quality(docs, labels).collect()
    assert all(0 <= r.score <= 1 for r in odd) and len(odd) == docs.count()
    assert quality_classifier.quality(empty, labels).count() == 0
    assert {r.score for r in quality_classifier.quality(docs, labels.limit(0)).collect()} == {0.5}


def test_maximal_segments_are_maximal():
    r = random.Random(3)
    for _ in range(200):
        x = [r.choice((-2.0, -1.0, -0.5, 1.0, 1.5)) for _ in range(r.randint(0, 30))]
        got = toxicity.maximal_segments(x)
        best = max((sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=0)
        if best > 0:
            assert max(s for _, _, s in got) == pytest.approx(best)
        assert all(s == pytest.approx(sum(x[a:b])) and s > 0 for a, b, s in got)
        assert all(b1 <= a2 for (_, b1, _), (a2, _, _) in zip(got, got[1:]))


def test_toxicity(spark, docs, empty):
    df, labels = labelled(spark)
    got = toxicity.toxicity(df, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 40 and np.mean([r.predicted == r.toxic for r in got]) > 0.95
    assert all(len(r.passages) >= 1 for r in got if r.predicted)
    assert toxicity.toxicity(docs, labels).count() == docs.count()
    assert toxicity.toxicity(empty, labels).count() == 0
    assert not any(r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect())


def test_toxicity_knows_words_that_no_clean_text_has(spark):
    """Two words that only toxic texts have, among few labelled texts, and a common word run together in clean ones."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    rows, labels = [], []
    for i in range(300):
        w = [word() for _ in range(60)]
        if i % 10 == 0:
            w[30:30] = ["worthless", "xyzzy", "scum"]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 10 == 0)))
    rows += [(1000, " ".join([word() for _ in range(40)] + ["worthless", "scum"] + [word() for _ in range(40)])), (1001, " ".join(word() for _ in range(80)))]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = by_id(toxicity.toxicity(df, labels), "predicted", "passages")
    assert got[1000][0] == 1 and [(p.start, p.end) for p in got[1000][1]] == [(40, 42)]
    assert got[1001] == (0, [])


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scores(docs, rows, empty, order):
    got = by_id(lm_score.lm_scores(docs, order, block_chars=3000), "n_words", "n_backed_off", "n_unseen", "log_score")
    for (doc, _), want in zip(rows, lm_score.brute_force([t for _, t in rows], order)):
        assert got[doc][:3] == want[:3] and got[doc][3] == pytest.approx(want[3], abs=1e-4)
    assert lm_score.lm_scores(empty, order).count() == 0


def test_lm_scores_do_not_count_across_documents(spark):
    """The end of one text and the start of the next are no n-gram of either, though the second has the same words elsewhere."""
    rows = [(1, "p q x y"), (2, "z a x y z b x y z"), (3, "x y z c"), (4, "x y d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = by_id(lm_score.lm_scores(df), "n_words", "n_backed_off", "n_unseen", "log_score")
    assert got == {i: pytest.approx(want) for (i, _), want in zip(rows, lm_score.brute_force([t for _, t in rows], 3))}


def test_lm_query_scores_trigrams(spark, tmp_path):
    rows = [(1, "a b c d"), (2, "x b c y"), (3, "a b c e")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(queries.op10_lm_scoring(spark, str(tmp_path)), "n_words", "n_backed_off", "n_unseen", "log_score")
    assert got == {i: pytest.approx(want) for (i, _), want in zip(rows, lm_score.brute_force([t for _, t in rows], 3))}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == list(corpus_pipeline.COLUMNS)
        after.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= kept and len(ids) == docs.count()
        kept = ids
    assert docs.count() > 100
    assert not [r for r in docs.select("text").collect() if pii.brute_force(r.text)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
