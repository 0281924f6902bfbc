"""URL filters: fixed host and path rules, then association rules mined from labels.

Spark's FP-growth mines frequent combinations of URL tokens (words of host labels, path segments and query keys) in
labelled pages, with the page's class as one more item. Combinations that imply "block" with enough support and
confidence, and more often than chance would have it, become rules; a rule that holds all tokens of a kept shorter rule is pruned. Pages find
their rules by an inverted index: each rule is filed under its rarest token, a page's tokens are joined with
that index, and the rule's other tokens are verified. DataFrame operations only.

Labels are rows of (doc_id, quality, toxic) for pages of the same id; a page is to be blocked if its quality
is 0 or it is toxic.

Defined results: a null url, or one without "://", has an empty host and path, no rule and no tokens, and is
allowed; repeated rows are each judged; with no labels or no mined rule every page without a rule is allowed. Rules of equal support all
hold; page_id may be null, null labels and ids match nothing; an empty table gives an empty one; extra columns of pages and labels are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed values: (host and path prefix, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: A combination with "block" must be in this share of the labelled pages, whatever their number.
MIN_SUPPORT = 0.005
#: Share of blocked pages among those with the combination.
MIN_CONFIDENCE = 0.6
#: By so many standard errors of a binomial at the base rate that share must exceed the base rate, as thousands of combinations are tried.
MIN_DEVIATION = 5.0
#: Up to so many mined rules are broadcast; more are joined by shuffle.
BROADCAST_RULES = 20_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """Add host and path."""
    at = F.locate("://", F.col("url"))
    rest = F.when(at > 0, F.col("url").substr(at + 3, F.length("url"))).otherwise("")
    raw = F.regexp_extract(F.col("_rest"), "^[^/?#]*", 0)
    return (
        pages.withColumn("_rest", F.coalesce(rest, F.lit("")))
        .withColumn("host", F.translate(raw, _UPPER, _LOWER))
        .withColumn("path", F.regexp_extract(F.col("_rest").substr(F.length("host") + 1, F.length("_rest")), "^[^?#]*", 0))
        .drop("_rest")
    )


def fixed_rule(rules=RULES) -> Column:
    """The longest rule that fits host and path, else null."""
    out = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, _, path = rule.partition("/")
        out.append(F.when(((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}"), F.lit(rule)))
    return F.coalesce(*out, F.lit(None).cast("string"))


def tokens() -> Column:
    """Distinct words of host, path and query keys: runs of letters, so digits, `-` and `_` part them; each with where it stands."""
    words = lambda c, mark: F.transform(F.filter(F.split(c, "[^\\p{L}]+"), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    keys = F.transform(F.split(F.regexp_extract(F.lower("url"), r"\?([^#]*)", 1), "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_distinct(F.concat(words(F.col("host"), "h:"), words(F.lower("path"), "p:"), words(F.array_join(keys, "&"), "q:")))


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_deviation: float = MIN_DEVIATION) -> DataFrame:
    """(rule_id, antecedent, confidence, n, index_token): token combinations that imply "block", on how many labelled pages they stand, and with what share of blocked ones."""
    y = labels.filter("quality is not null or toxic is not null").groupBy(F.col("doc_id").alias("l")).agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("y"))
    rows = stored(pages.hint("merge").join(y, F.col("page_id") == F.col("l")).select("y", F.array_append("tokens", F.when(F.col("y") == 1, "y:block").otherwise("y:allow")).alias("items")), "labelled")
    n, bad = rows.agg(F.count("*"), F.sum("y")).first()
    base = (bad or 0) / max(n, 1)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows.select("items"))
    chance = F.sqrt(F.lit(base * (1 - base)) / F.col("n"))
    rules = model.associationRules.filter(F.col("consequent")[0] == "y:block").withColumn("n", F.round(F.col("support") * n / F.col("confidence")))
    rules = rules.filter(F.col("confidence") - base >= min_deviation * chance).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "n")
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rules = rules.withColumn("rule_id", F.array_join("antecedent", " "))
    ranked = stored(rules.select("rule_id", "antecedent", "confidence", "n", F.explode("antecedent").alias("token")).hint("shuffle_hash").join(single, "token").groupBy("rule_id", "antecedent", "confidence", "n").agg(F.min_by("token", F.struct("freq", "token")).alias("index_token")), "rules")
    # A rule is redundant if a shorter one has only tokens of it; such a pair shares the shorter one's index token.
    short = ranked.select(F.col("rule_id").alias("s_id"), F.col("antecedent").alias("s"), "index_token")
    longer = ranked.select("rule_id", "antecedent", F.explode("antecedent").alias("index_token"))
    redundant = longer.hint("shuffle_hash").join(short, "index_token").filter((F.size("s") < F.size("antecedent")) & (F.size(F.array_except("s", "antecedent")) == 0)).select("rule_id").distinct()
    return ranked.hint("shuffle_hash").join(redundant, "rule_id", "left_anti")


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_deviation: float = MIN_DEVIATION) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rules): verdict of the longest fixed rule, else of the mined rules."""
    parts = with_parts(pages.select("page_id", "url")).withColumn("tokens", tokens()).withColumn("rule", fixed_rule(rules))
    mined = stored(mine(parts.select("page_id", "tokens"), labels, min_support, min_confidence, min_deviation), "mined")
    small = mined.count() <= BROADCAST_RULES
    open_pages = parts.filter(F.col("rule").isNull()).select("page_id", "tokens").distinct()
    index = mined.select("rule_id", "antecedent", F.col("index_token").alias("token")).hint("broadcast" if small else "merge")
    hits = open_pages.select("page_id", "tokens", F.explode("tokens").alias("token")).join(index, "token").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    blocked = hits.groupBy(F.col("page_id").alias("b")).agg(F.countDistinct("rule_id").alias("n"))
    verdict = F.coalesce(*[F.when(F.col("rule") == r, v) for r, v in rules], F.when(F.col("n") > 0, "block").otherwise("allow"))
    out = parts.join(blocked.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("b")) & F.col("rule").isNull(), "left")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("n", F.lit(0)).alias("mined_rules"))
