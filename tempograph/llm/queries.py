"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, conversation_repair, decontaminate, jaccard_join, lm_score, phrase_dedup, pii, quality_classifier, quality_rules, spelling, suffix_dedup, toxicity, url_filter
from .common import table


def op1_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digest(bpe.round_trip(table(spark, sf_dir, "documents"), path))


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digest(suffix_dedup.remove(table(spark, sf_dir, "documents")))


def op3_quality_rules(spark, sf_dir):
    first = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    found = quality_rules.judge(table(spark, sf_dir, "documents"))
    return found.select(*first, *(c for c in found.columns if c not in first))


def op4_url_filters(spark, sf_dir):
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op5_decontaminate(spark, sf_dir):
    return decontaminate.digest(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_pii(spark, sf_dir):
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op7_jaccard_join(spark, sf_dir):
    return jaccard_join.link_components(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark, sf_dir):
    return quality_classifier.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_toxicity(spark, sf_dir):
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("n_passages", F.size("passages")).drop("passages")


def op10_lm_scoring(spark, sf_dir):
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark, sf_dir):
    return conversation_repair.digest(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_phrase_dedup(spark, sf_dir):
    return phrase_dedup.digest(phrase_dedup.remove(table(spark, sf_dir, "documents")))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {name: f for name, f in globals().items() if (name.startswith("op") or name == "pipeline") and callable(f)}


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leads(n: int, by: str) -> str:
    return ", ".join(f"lead(word, {i}) OVER (PARTITION BY {by} ORDER BY p) AS w{i}" for i in range(1, n))


def _windows(n: int) -> str:
    """Runs of 1 to n words from each word of x on, where the texts have so many."""
    run = lambda k: ", ".join(["word", *(f"w{i}" for i in range(1, k))])
    return " UNION ALL ".join(f"SELECT id, p, {k} AS k, concat_ws(' ', {run(k)}) AS win FROM x WHERE {'word' if k == 1 else f'w{k - 1}'} IS NOT NULL" for k in range(1, n + 1))


_WORDS5 = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: Bytes as hex digits. Texts are cut into pieces of 100 positions first, as finding a place in a long string takes as long as the place is far.
_OP2 = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), n AS (SELECT *, length(x) // 2 AS n FROM h),
 b AS (SELECT doc_id, n, j, substring(x, 200 * j + 1, 300) AS y FROM (SELECT *, unnest(range(n // 100 + 1)) AS j FROM n WHERE n >= 50)),
 s AS (SELECT doc_id, 100 * j + i AS p, substring(y, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(100)) AS i FROM b) WHERE 100 * j + i + 50 <= n), f AS (SELECT s, min(doc_id) AS first FROM s GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
 c AS (SELECT doc_id, p FROM s JOIN f USING (s) WHERE first < doc_id), g AS (SELECT *, CASE WHEN p <= lag(p) OVER w + 50 THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
 i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g), r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, run),
 e AS (SELECT doc_id, a, b FROM r UNION ALL SELECT doc_id, n, n FROM n), k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS begin FROM e),
 t AS (SELECT doc_id, string_agg(substring(x, 2 * begin + 1, 2 * (a - begin)), '' ORDER BY a, b) AS kept, CAST(sum(b - a) AS BIGINT) AS n_removed, CAST(count(*) FILTER (b > a) AS BIGINT) AS n_spans FROM k JOIN h USING (doc_id) GROUP BY 1)
 SELECT doc_id, n AS n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM n JOIN t USING (doc_id)"""
_OP5 = f"""WITH d AS (SELECT doc_id, {_WORDS5.format(_LOW)} AS w FROM documents), i AS (SELECT item_id, {_WORDS5.format(_LOW)} AS w FROM benchmark), pi AS (SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM i),
 pd AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
 wi AS (WITH x AS (SELECT item_id AS id, p, word, {_leads(10, 'item_id')} FROM pi) SELECT DISTINCT id AS item_id, k, win FROM ({_windows(10)}) y JOIN (SELECT item_id, len(w) AS n FROM i) z ON z.item_id = id WHERE k = least(10, n)),
 wd AS (WITH x AS (SELECT doc_id AS id, p, word, {_leads(10, 'doc_id')} FROM pd) {_windows(10)}), m AS (SELECT id AS doc_id, p, k, item_id FROM wd JOIN wi USING (k, win)),
 c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY 1), o AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS l FROM m GROUP BY 1)
 SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(l), 0) AS n_items, sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)"""
_OP7 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents), pw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d), x AS (SELECT doc_id, word, {_leads(5, 'doc_id')} FROM pw),
 sh AS (SELECT DISTINCT doc_id, concat_ws(' ', word, w1, w2, w3, w4) AS s FROM x WHERE w4 IS NOT NULL UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1), v AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM v JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 walk AS (SELECT doc_id AS id, doc_id AS r FROM d UNION SELECT id, b AS r FROM walk JOIN e ON e.a = walk.r)
 SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(r) AS component_id FROM walk GROUP BY 1) ON id = d.doc_id"""

#: What is left of a count without the document's own is a count over all rows less one over the document's. A word's place p says how long its n-grams are.
_OP10 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents), y AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
 x AS (SELECT doc_id, p, word AS g1, lag(word) OVER o || ' ' || word AS g2, lag(word, 2) OVER o || ' ' || lag(word) OVER o || ' ' || word AS g3 FROM y WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
 l AS (SELECT *, count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY doc_id, g1) AS l1, count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY doc_id, g2) AS l2, count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY doc_id, g3) AS l3 FROM x),
 m AS (SELECT *, lag(l1) OVER o AS p1, lag(l2) OVER o AS p2, (SELECT count(*) FROM y) - count(*) OVER (PARTITION BY doc_id) AS others FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
 v AS (SELECT doc_id, p >= 3 AND l3 > 0 AS tri, p >= 2 AND l2 > 0 AS bi, l1 > 0 AS uni, CASE WHEN p >= 3 AND l3 > 0 THEN ln(CAST(l3 AS DOUBLE) / p2) WHEN p >= 2 AND l2 > 0 THEN ln(CAST(l2 AS DOUBLE) / p1) + (least(p, 3) - 2) * ln(0.4)
  WHEN l1 > 0 THEN ln(CAST(l1 AS DOUBLE) / others) + (least(p, 3) - 1) * ln(0.4) ELSE ln(CAST(1 AS DOUBLE) / (others + 1)) + least(p, 3) * ln(0.4) END AS score, CASE WHEN p >= 3 THEN NOT (l3 > 0) WHEN p = 2 THEN NOT (l2 > 0) ELSE false END AS backed FROM m),
 s AS (SELECT doc_id, count(*) FILTER (backed) AS n_backed_off, count(*) FILTER (NOT (tri OR bi OR uni)) AS n_unseen, round(sum(score), 6) AS log_score FROM v GROUP BY 1)
 SELECT doc_id, len(w) AS n_words, coalesce(n_backed_off, 0) AS n_backed_off, coalesce(n_unseen, 0) AS n_unseen, coalesce(log_score, 0) AS log_score, CASE WHEN len(w) > 0 THEN round(log_score / len(w), 6) END AS mean_log_score FROM d LEFT JOIN s USING (doc_id)"""

#: The table of CRC-32 by byte as one list, and a string's CRC as a fold of its bytes over it.
_CRC = """crc_bits AS (SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_bits WHERE k < 8),
 crc AS (SELECT list(c ORDER BY i) AS t FROM crc_bits WHERE k = 8)"""


def _crc32(s: str) -> str:
    code = f"list_transform(range(octet_length(encode({s}))), lambda i: CAST('0x' || substring(hex(encode({s})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {code}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


def _op11() -> str:
    """Rows after damage; then a walk over each conversation's rows that keeps the cheapest (cost, audit, repaired lines) for each state: b0 nothing yet, b1 system, b2 user, b3 assistant."""
    way = lambda b, cost, letter, line: f"{{'c': {b}.c + {cost}, 'a': {b}.a || '{letter}', 'r': {b}.r || {line}}}"
    least = lambda *w: f"list_min([{', '.join(w)}])"
    empty = {"user": "chr(10) || 'user:'", "assistant": "chr(10) || 'assistant:'"}
    put = lambda b, role: way(b, 2, "I", empty[role])
    layer = lambda src: f"(SELECT * EXCLUDE (b2, b3), {least('b2', put('b0', 'user'), put('b1', 'user'), put('b3', 'user'))} AS b2, {least('b3', put('b2', 'assistant'))} AS b3 FROM {src})"
    keep = lambda b: way(b, "late", "K", "chr(10) || role || ':' || text")
    turn = lambda b, role: way(b, "2 + late", "R", f"chr(10) || '{role}:' || text")
    gone = lambda b: way(b, 3, "D", "''")
    only = lambda initial, w: f"CASE WHEN i = '{initial}' AND NOT forced THEN {w} ELSE far END"
    free = lambda w: f"CASE WHEN NOT forced THEN {w} ELSE far END"
    to = {
        "b0": [gone("b0")], "b1": [gone("b1"), only("s", keep("b0"))],
        "b2": [gone("b2"), *(f(x) for b in ("b0", "b1", "b3") for f, x in ((lambda w: only("u", w), keep(b)), (free, turn(b, "user"))))],
        "b3": [gone("b3"), only("a", keep("b2")), free(turn("b2", "assistant"))],
    }
    first = "{'c': 0::BIGINT, 'a': '', 'r': ''}"
    far = "{'c': 1000000000::BIGINT, 'a': '~', 'r': ''}"
    return f"""WITH RECURSIVE {_CRC}, d0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS die FROM conversations, crc),
 d1 AS (SELECT conv_id, turn, CASE WHEN die = 4 THEN 'user' ELSE role END AS role, CASE die WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN die = 3 THEN 2 ELSE 1 END)) AS again FROM d0 WHERE die <> 0),
 d2 AS (SELECT *, row_number() OVER w AS p, left(role, 1) AS i, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) > 1 AS again_said, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut FROM d1
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role || ':' || text)),
 d AS (SELECT *, blank OR again_said AS forced, CAST(cut AS BIGINT) AS late, {far} AS far, p > 1 AND lag(i) OVER w || i NOT IN ('su', 'ua', 'au') AS illegal FROM d2 WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
 walk AS (SELECT DISTINCT conv_id, 0::BIGINT AS p, {first} AS b0, {far} AS b1, {far} AS b2, {far} AS b3 FROM conversations
  UNION ALL SELECT conv_id, p, {', '.join(f'{least(*w)} AS {b}' for b, w in to.items())} FROM {layer(layer('(SELECT w.conv_id, d.p, b0, b1, b2, b3, role, text, i, forced, late, far FROM walk w JOIN d ON d.conv_id IS NOT DISTINCT FROM w.conv_id AND d.p = w.p + 1)'))}),
 e AS (SELECT conv_id, {least('b0', 'b3')} AS best FROM {layer(layer('(SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY p DESC) = 1)'))}),
 n AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again_said) AS duplicate, count(*) FILTER (NOT forced AND cut) AS truncated, count(*) FILTER (illegal) AS illegal FROM d GROUP BY 1)
 SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(substring(best.r, 2)) AS repaired_sha256
 FROM e LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM e.conv_id"""


#: Near words share a pattern: the word without one letter, and where it was for words of one length. Forms are followed upwards.
_OP12 = f"""WITH RECURSIVE {_CRC}, r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
 g AS (SELECT doc_id, r, count(*) AS k FROM r WHERE length(r) >= 7 GROUP BY 1, 2), h AS (SELECT *, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r")} AS h FROM g, crc),
 c AS (SELECT CASE WHEN h % 31 = 0 THEN substring(r, 1, CAST(h % length(r) AS INT)) || substring(r, CAST(h % length(r) AS INT) + 2) ELSE r END AS word, k FROM h),
 w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM c WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
 x AS (SELECT word, n, i, substring(word, 1, CAST(i AS INT)) || substring(word, CAST(i AS INT) + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
 near AS (SELECT a.word, b.word AS other, b.n FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT x.word, w.word, w.n FROM x JOIN w ON w.word = x.rest UNION SELECT w.word, x.word, x.n FROM x JOIN w ON w.word = x.rest),
 best AS (SELECT word, count(*) AS n_near, min({{'n': -n, 'w': encode(other)}}) AS b FROM near GROUP BY 1),
 f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.n >= 10 * w.n THEN decode(b.w) END AS form, CASE WHEN -b.n >= 10 * w.n THEN -b.n END AS form_n FROM w LEFT JOIN best USING (word)),
 up AS (SELECT word, word AS top, form AS next FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON f.word = up.next)
 SELECT f.word, form, top AS root, n, n_near, form_n FROM f JOIN up ON up.word = f.word AND next IS NULL"""
_OP13 = """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents), p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
 s AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)), f AS (SELECT s, min((doc_id, p)) AS first FROM s GROUP BY 1 HAVING count(*) > 1),
 g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM s JOIN f USING (s) WHERE (doc_id, p) > first), k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM p ANTI JOIN g USING (doc_id, p) GROUP BY 1)
 SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def oracle_sql():
    """The queries that SQL can express whole. The others hold a trained model, a tokenizer, or Python's positions of matches; tests/llm compares them."""
    return {"op2_suffix_dedup": _OP2, "op5_decontaminate": _OP5, "op7_jaccard_join": _OP7, "op10_lm_scoring": _OP10, "op11_conversation_repair": _op11(), "op12_spelling_variants": _OP12, "op13_phrase_dedup": _OP13}
