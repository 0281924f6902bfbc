"""Mined rules and pipeline stages against plain Python over the same rows, and personal data that is hidden from the method."""

import hashlib
import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempograph.llm import decontaminate, jaccard_join, pii, quality_classifier, suffix_dedup, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_mined_rules(spark):
    r = random.Random(9)
    words = ["ads", "shop", "news", "blog", "casino", "free", "kids"]
    pages, labels, rows = [], [], []
    for i in range(1500):
        own = [w for w in words if r.random() < 0.3]
        bad = r.random() < (0.9 if {"casino", "free"} <= set(own) or "ads" in own and "shop" in own else 0.8 if "kids" in own and "blog" in own else 0.1)
        pages.append((i, f"http://x.org/{'-'.join(own)}/{i}"))
        labels.append((i, int(not bad), 0))
        rows.append((frozenset([*(f"p:{w}" for w in own), "h:x", "h:org"]), bad))
    base, n, want = sum(b for _, b in rows) / len(rows), len(rows), {}
    every = sorted({t for s, _ in rows for t in s})
    for k in range(1, len(every) + 1):
        for c in map(frozenset, combinations(every, k)):
            have = [b for s, b in rows if c <= s]
            bad = sum(have)
            if have and bad >= math.ceil(url_filter.MIN_SUPPORT * n) and bad / len(have) >= url_filter.MIN_CONFIDENCE and bad / len(have) - base >= url_filter.MIN_DEVIATION * math.sqrt(base * (1 - base) / len(have)):
                want[c] = len(have)
    want = {c: m for c, m in want.items() if not any(o < c for o in want)}
    df = spark.createDataFrame(pages, "page_id long, url string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    tokens = url_filter.with_parts(df).withColumn("tokens", url_filter.tokens()).select("page_id", "tokens")
    got = {frozenset(x.antecedent): x.n for x in url_filter.mine(tokens, marked).collect()}
    assert got == want and len(want) >= 3
    blocked = {x.page_id for x in url_filter.filter_urls(df, marked).filter("verdict = 'block'").collect()}
    assert blocked == {i for i, (s, _) in enumerate(rows) if any(c <= s for c in want)}


def test_hidden_seeds_come_back(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    rows = [(i, f"{word()} {word()} ring me at +1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)} before {word()} {word()}. Sold {r.randint(10**7, 10**8)} units {word()}") for i in range(120)]
    got = {x.kind: x for x in pii.hidden_seeds(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got["phone"].hidden >= 10 and got["phone"].found_right == got["phone"].hidden and got["phone"].others == 0


def test_short_identifiers_by_context(spark):
    """Numbers of four to six digits where mostly others that are certain stand."""
    r = random.Random(7)
    rows = [(i, f"please dial extension {f'+1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}' if i % 8 else r.randint(1000, 999999)} for help with item {i}") for i in range(80)]
    rows.append((99, "it was built in 1987 by 4500 people"))
    got = {x.doc_id: [(s.start, s.end, s.k) for s in x.spans] for x in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows[:-1]:
        assert got[i] == [(22, text.index(" for"), pii.KINDS.index("phone"))]
    assert got[99] == []


def plain_bootstrap(found: list) -> dict[str, tuple[str, float]]:
    """Scores of instances with dictionaries, in rounds; for tests."""
    edges = {}
    for m in found:
        for p in m.patterns:
            kind, piece = edges.get((p, m.instance), (None, True))
            edges[p, m.instance] = max(filter(None, (kind, m.kind)), default=None), piece and m.choice != 1
    seeds = {i: {k} for (_, i), (k, _) in edges.items() if k}
    for (_, i), (k, _) in edges.items():
        seeds.get(i, set()).update({k} if k else ())
    known = {(i, k): 1.0 for i, ks in seeds.items() for k in ks}
    for _ in range(pii.ROUNDS):
        total, backed = {}, {}
        for (p, i), (_, piece) in edges.items():
            if not piece:
                total[p] = total.get(p, 0) + 1
                for k in pii.KINDS:
                    if (i, k) in known:
                        backed.setdefault((p, k), []).append(known[i, k])
        share = {(p, k): sum(v) / (total[p] + 0.25) for (p, k), v in backed.items() if len(v) >= pii.MIN_SEEDS}
        doubt = {}
        for (p, i), (kind, _) in edges.items():
            if kind is None:
                for k in pii.KINDS:
                    if share.get((p, k), 0) >= pii.MIN_PATTERN:
                        doubt[i, k] = doubt.get((i, k), 1.0) * (1 - min(share[p, k], 0.999))
        best = {}
        for (i, k), d in doubt.items():
            best[i] = max(best.get(i, (0.0, "")), (1 - d, k))
        known = {(i, k): 1.0 for i, ks in seeds.items() for k in ks} | {(i, k): s for i, (s, k) in best.items() if s >= pii.MIN_SCORE}
    out = {}
    for (i, k), s in known.items():
        out[i] = max(out.get(i, (0.0, "")), (s, k))
    return {i: (k, s) for i, (s, k) in out.items() if s >= pii.MIN_SCORE}


@pytest.mark.parametrize("table", ["documents", "made"])
def test_graph_scores(spark, table):
    """Over a whole table, and over texts in which contexts recur, kinds mix and runs have pieces."""
    r = random.Random(11)
    number = lambda: r.choice([f"+1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}", f"{r.randint(10**3, 10**9)}", f"10.0.{r.randint(0, 255)}.{r.randint(0, 255)}", f"{r.randint(100, 999)}-{r.randint(10, 99)}-{r.randint(1000, 9999)} {r.randint(100, 999)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"])
    rows = [(i, f"{r.choice(['call', 'host', 'id', 'ref no'])} {number()} {r.choice(['now', 'today', 'or else'])} {number()}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string") if table == "made" else spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = pii.mentions(docs)
    want = plain_bootstrap([m for x in found.collect() for m in x.found])
    got = {x.instance: (x.kind, x.score) for x in pii.bootstrap(found).collect()}
    assert {i: k for i, (k, _) in got.items()} == {i: k for i, (k, _) in want.items()}
    assert all(abs(s - want[i][1]) < 1e-9 for i, (_, s) in got.items())


def test_settled_rows_are_those_of_later_documents():
    r = np.random.default_rng(1)
    key, doc = r.integers(0, 5, 200).astype(np.uint64), r.integers(0, 9, 200)
    want = [any(k2 == k and d2 < d for k2, d2 in zip(key, doc)) for k, d in zip(key, doc)]
    assert suffix_dedup._later(key, doc).tolist() == want
    assert suffix_dedup._later(key[:0], doc[:0]).tolist() == []


def test_stages(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    rows = lambda df: {x.doc_id: x.text for x in df.collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        was = rows(before)
        if name == "quality":
            judged = quality_classifier.quality(before, spark.read.parquet(f"{sf}/labels.parquet")).filter("predicted = 1")
            assert rows(after) == {d: was[d] for d in {x.doc_id for x in judged.collect()}}
        elif name == "near_duplicates":
            groups = jaccard_join.brute_force(list(was.items()))
            assert rows(after) == {d: t for d, t in was.items() if groups[d][1] == d}
        elif name == "benchmark":
            items = [(x.item_id, x.text) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            found = decontaminate.brute_force(list(was.items()), items)
            assert rows(after) == {d: t for d, t in was.items() if not found[d][4]}
        elif name == "personal_data":
            spans = {x.doc_id: [(s.start, s.end, s.k) for s in x.spans] for x in pii.personal_data(before).collect()}
            want = {}
            for d, t in was.items():
                assert {(a, b, pii.KINDS.index(k)) for k, a, b in pii.brute_force(t)} <= set(spans[d])
                out, at = [], 0
                for a, b, k in sorted(spans[d]):
                    if a >= at:
                        out.append(t[at:a] + f"<{pii.KINDS[k]}>")
                    at = max(at, b)
                want[d] = "".join(out) + t[at:] if t is not None else None
            assert rows(after) == want
            assert after.filter(F.col("n_chars") != F.length("text")).count() == 0
        else:
            t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            want = {d: hashlib.sha256(np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for d, x in was.items()}
            assert {x.doc_id: x.ids_sha256 for x in after.collect()} == want
        before = after
    assert docs.count() > before.count() > 100


@pytest.mark.parametrize("seed", range(6))
def test_passages_are_cut_before_they_are_sorted(seed, monkeypatch):
    """What passages lose is the same, and those that share one string with different surroundings are sorted as one."""
    r = random.Random(seed)
    symbols, plain = 6, lambda x: sorted(zip(*(y.tolist() for y in x)))
    word = lambda n: bytes(r.choice(b"ab") for _ in range(n))
    flanks = [word(r.randint(5, 14)) for _ in range(80)]
    left = np.array([r.randint(0, symbols - 1) for _ in flanks])  # all strings hold the core
    group, doc = np.array([r.randint(0, 3) for _ in flanks]), np.array([r.randint(0, 20) for _ in flanks])
    assert plain(suffix_dedup.covered(group, doc, left, flanks, symbols)) == plain(suffix_dedup.covered_in_bucket(group, doc, left, flanks, symbols))
    sizes, sort = [], suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda text: sizes.append(len(text)) or sort(text))
    alone = [bytes([i, i, i]) + b"xxxyy" + bytes([i, i, i]) for i in range(1, 90)]
    many, at = suffix_dedup.covered(np.zeros(89, int), np.arange(89), np.full(89, 5), alone, symbols)
    assert sorted(zip(many.tolist(), at.tolist())) == [(i, 3) for i in range(1, 89)] and sizes == [6]
    assert not len(suffix_dedup.covered(np.arange(3), np.arange(3), np.full(3, 3), [b"abcdefgh"] * 3, symbols)[0])
