"""Queries against their SQL, and against SQL for the parts of them that the contract fixes."""

import pytest
from oracle import compare, views

from tempograph.llm import queries

pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert compare(spark, con, SF, queries.queries()[name], queries.oracle_sql()[name]) == ""


def part(name, *columns):
    return lambda spark, sf: queries.queries()[name](spark, sf).select(*columns)


def test_quality_rules_base(spark, con):
    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    leads = ", ".join(f"lead(word, {i}) OVER (PARTITION BY doc_id ORDER BY p) AS w{i}" for i in range(1, 8))
    sql = f"""WITH d AS (SELECT doc_id, text, {words} AS w FROM documents), x AS (SELECT doc_id, word, p, {leads} FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d)),
     t AS (SELECT doc_id, p, concat_ws(' ', word, w1, w2, w3, w4, w5, w6, w7) AS s FROM x WHERE w7 IS NOT NULL), r AS (SELECT doc_id, p FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
     n AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM r) GROUP BY 1),
     l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1)
     SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda z: length(z))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(n.n, 0) AS n_repeat_words,
     len(w) < 20 OR 100 * coalesce(n.n, 0) > 30 * len(w) AS base_failed FROM d LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id)"""
    assert compare(spark, con, SF, part("op3_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), sql) == ""


def test_url_filter_rules(spark, con):
    sql = """WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages), h AS (SELECT page_id, lower(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) AS host, coalesce(rest, '') AS rest FROM r),
     p AS (SELECT page_id, host, regexp_extract(substring(rest, length(host) + 1), '^[^?#]*') AS path FROM h), fits AS (SELECT page_id, rule FROM p, (SELECT unnest(['com/', 'example.com/en/', 'www.example.com/en/', 'net/es/', 'net/fr/']) AS rule) WHERE
      (host = string_split(rule, '/')[1] OR ends_with(host, '.' || string_split(rule, '/')[1])) AND starts_with(path, substring(rule, instr(rule, '/')))), best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule FROM fits GROUP BY 1) SELECT p.*, rule FROM p LEFT JOIN best USING (page_id)"""
    assert compare(spark, con, SF, part("op4_url_filters", "page_id", "host", "path", "rule"), sql) == ""


def test_pii_base_counts(spark, con):
    found = lambda p: f"regexp_extract_all(coalesce(text, ''), '{p}')"
    digits = "regexp_replace({}, '[^0-9]', '', 'g')"
    luhn = "list_sum(list_transform(range(length(g)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(reverse(g)[i + 1] AS INT) ELSE CAST(reverse(g)[i + 1] AS INT) * 2 - CASE WHEN CAST(reverse(g)[i + 1] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    sql = f"""WITH c AS (SELECT doc_id, unnest({found('[0-9](?:[ -]?[0-9])+')}) AS m FROM documents), g AS (SELECT doc_id, {digits.format('m')} AS g FROM c), cards AS (SELECT doc_id, count(*) AS n FROM g WHERE length(g) BETWEEN 13 AND 19 AND {luhn} GROUP BY 1)
     SELECT doc_id, len({found('[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+')}) AS n_email, len(list_filter({found('[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)')}, lambda x: list_max(list_transform(string_split(x, '.'), lambda y: CAST(y AS HUGEINT))) <= 255)) AS n_ip,
     coalesce(n, 0) AS n_card, len(list_filter({found('[+][0-9][ ().0-9-]+[0-9]')}, lambda x: length({digits.format('x')}) BETWEEN 9 AND 15)) AS n_phone FROM documents LEFT JOIN cards USING (doc_id)"""
    assert compare(spark, con, SF, part("op6_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone"), sql) == ""


@pytest.mark.parametrize(("name", "label", "recall", "precision"), [("op8_quality_classifier", "quality", 0.95, 0.95), ("op9_toxicity", "toxic", 0.6, 0.5)])
def test_held_out(spark, name, label, recall, precision):
    """On held-out labels of sf0.01, of which six are toxic."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label)
    rows = queries.queries()[name](spark, sf).filter("held_out").join(labels, "doc_id").filter(f"{label} is not null").select("predicted", label).collect()
    right = sum(r.predicted == 1 == r[label] for r in rows)
    assert right >= recall * sum(r[label] for r in rows) and right >= precision * sum(r.predicted for r in rows)
