"""Personal data: fixed patterns as seeds, then bootstrapped contextual extraction.

Seeds are emails, IP addresses, card numbers and phone numbers of fixed form. Around each seed, and around each
other identifier-like string (one with an "@" or at least `MIN_DIGITS` digits), the words to the left and right
give lexical patterns, from exact to coarse: two words before; one before and one after; one before, or one after, with the string's shape; the shape between
the kinds of its neighbours. Of a word the nearest 32 characters count, and words more than 200 characters away don't.
A run of digits is cut where a seed lies in it. What is left is offered whole, and if spaces part complete groups (each of
at least `MIN_PIECE` digits, or in a shape that recurs) also in pieces; pieces have the whole run's patterns besides their own, and count neither for nor
against a pattern. Of a run and its pieces the pieces become spans if they make it up, else the run, else what pieces were found.
Spark holds the graph of patterns and instances and scores it in rounds: a pattern is as good as the share
of its instances that are known to be of a kind, and speaks for that kind from `MIN_PATTERN` on, so one that goes with a kind half of the time says nothing
however often it occurs; an instance is as good as its patterns together.
Instances that reach `MIN_SCORE` through patterns with `MIN_SEEDS` distinct seeds become spans of that kind.
Edges and scores are aggregated before each join, so a frequent pattern or instance is one row for each pair; joins are salted, so the
edges of a hot pattern, of a hot instance and the places of a hot identifier are read by `SALTS` tasks.

Defined results: null and empty texts have no spans; every row, repeated ones and those of null doc_id too, is a row of the result with the spans of its own text;
fixed spans always stay, found ones never overlap them or each other; offsets are code points; an instance that is a seed of two kinds
counts as the last of them by name; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tidy

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_DIGITS = 4
MIN_PIECE = 7
SALTS = 16
MIN_PATTERN = 0.7
MIN_SCORE = 0.85
MIN_SEEDS = 3

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "\"'()[]{}<>,;:!?=.|*#$%&"
#: Candidate strings: words with an "@", or runs of digits with the marks that numbers are written with.
_CANDIDATE = re.compile(r"[^\x20\x09-\x0D\"'<>(),;=]*@[^\x20\x09-\x0D\"'<>(),;=]+|\(?[0-9][0-9 ().:/_-]*[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Fixed-form spans, by kind in the order of KINDS, then start. Linear in the text."""
    out = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            i = m.start()
            while i > done and text[i - 1] in _LOCAL:
                i -= 1
            if i < m.start():
                out.append(("email", i, m.end()))
                done = m.end()
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = _NOT_DIGIT.sub("", m[0])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


_REACH, _NEAR = 200, 32
_RUN = re.compile(r"[^\W\d_]+|[0-9]+")


def _shape(s: str) -> str:
    """Runs of letters as `a`, of digits as `9`; marks as they are."""
    return _RUN.sub(lambda m: "9" if m[0][0] in "0123456789" else "a", s)[:_NEAR]


def _kind(word: str, edge: str) -> str:
    """What a neighbour is: an edge of the text, digits, capitals, a name or a plain word, and the mark at its side that faces the string."""
    if not word:
        return edge
    core = word.strip(_EDGE)
    what = "9" if _DIGIT.search(core) else "A" if core.isupper() and len(core) > 1 else "Aa" if core[:1].isupper() else "a" if core else ""
    mark = word[-1] if edge == "^" else word[0]
    return what + (mark if mark in _EDGE else "")


def _patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: words near it in lower case, and what it is made of."""
    span = text[start:end]
    inner, shape = "@" if "@" in span else "9", _shape(span)
    before = [w[-_NEAR:] for w in _WORD.findall(text[max(0, start - _REACH) : start])[-2:]]
    after = [w[:_NEAR] for w in _WORD.findall(text[end : end + _REACH])[:1]]
    near, far = before[-1] if before else "", after[0] if after else ""
    words = [w.strip(_EDGE).lower() for w in before]
    left, right = words[-1] if words else "^", far.strip(_EDGE).lower() if after else "$"
    out = [f"{words[0]} {left} {inner} _"] if len(words) == 2 else []
    return [*out, f"{left} {inner} {right}", f"{left} <{shape}>", f"<{shape}> {right}", f"[{_kind(near, '^')}] <{shape}> [{_kind(far, '$')}]"]


def _pieces(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], bool]:
    """Single identifiers in a run of digits, and whether they make it up."""
    words = [(start + m.start(), start + m.end()) for m in _WORD.finditer(text[start:end])]
    digits = [len(_NOT_DIGIT.sub("", text[a:b])) for a, b in words]
    if len(words) < 2:
        return [], False
    if min(digits) >= MIN_PIECE:
        return words, True
    shapes = [_DIGIT.sub("9", text[a:b]) for a, b in words]
    back = [0]  # of each prefix: its longest border (Knuth, Morris and Pratt); the last one gives the period
    for i in range(1, len(shapes)):
        k = back[-1]
        while k and shapes[i] != shapes[k]:
            k = back[k - 1]
        back.append(k + (shapes[i] == shapes[k]))
    p = len(shapes) - back[-1]
    if p < len(shapes) and len(shapes) % p == 0 and sum(digits[:p]) >= MIN_PIECE:
        return [(words[i][0], words[i + p - 1][1]) for i in range(0, len(words), p)], True
    return [w for w, n in zip(words, digits) if n >= MIN_PIECE], False


def _mentions(text: str):
    """Seeds, and candidate strings that overlap none of them: (kind or None, start, end, instance, patterns, run, choice). `run` is where
    the run starts that a candidate is or belongs to; of a run, candidates of the least `choice` are taken; 1 is the run itself."""
    seeds = base_spans(text)
    taken = sorted((a, b) for _, a, b in seeds)
    for kind, a, b in seeds:
        yield kind, a, b, text[a:b].lower(), _patterns(text, a, b), a, 1
    if "@" not in text and not _DIGIT.search(text):
        return
    k = 0
    for m in _CANDIDATE.finditer(text):
        a, b = m.start(), m.end()
        around = []  # the stretch without the seeds in it
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        at, j = a, k
        while j < len(taken) and taken[j][0] < b:
            around.append((at, taken[j][0]))
            at, j = max(at, taken[j][1]), j + 1
        outer = _patterns(text, a, b)
        for lo, hi in [*around, (at, b)]:
            for c in _CANDIDATE.finditer(text, lo, max(lo, hi)):
                s, e = c.start(), c.end()
                number = "@" not in c[0]
                if number and len(_NOT_DIGIT.sub("", c[0])) < MIN_DIGITS:
                    continue
                whole = list(dict.fromkeys([*_patterns(text, s, e), *outer]))
                yield None, s, e, c[0].lower(), whole, s, 1
                pieces, all_of_it = _pieces(text, s, e) if number else ([], False)
                for x, y in pieces:
                    yield None, x, y, text[x:y].lower(), list(dict.fromkeys([*_patterns(text, x, y), *whole])), s, 0 if all_of_it else 2


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, found): all seeds and candidates of each document."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string())), ("run", pa.int32()), ("choice", pa.int32())]))

    def run(batches):
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end", "instance", "patterns", "run", "choice"), x)) for x in _mentions(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(rows, kind)], ["doc_id", "text_hash", "found"])

    return docs.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, found array<struct<kind:string,start:int,end:int,instance:string,patterns:array<string>,run:int,choice:int>>")


def _salted(many: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """Join with a table of one row for each key, or one for each key and kind: rows of a key are spread by `by` over SALTS parts, those of `few` go to each."""
    spread = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).hint("merge").join(spread, [key, "salt"]).drop("salt")


def bootstrap(found: DataFrame, rounds: int = ROUNDS, min_score: float = MIN_SCORE, min_seeds: int = MIN_SEEDS, min_pattern: float = MIN_PATTERN) -> DataFrame:
    """(instance, kind, score): seeds' instances, and unseen ones that high-confidence patterns vouch for."""
    flat = found.select(F.explode("found").alias("m")).select("m.kind", "m.instance", "m.patterns", (F.col("m.choice") != 1).alias("piece"))
    edges = stored(flat.select("instance", "kind", "piece", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.min("piece").alias("piece")), "edges")
    # Patterns without a seed can only matter once an instance is found, so all edges of found instances stay in play.
    known = edges.filter("kind is not null").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    for _ in range(rounds):
        total = edges.filter("not piece").groupBy("pattern").agg(F.count("*").alias("n"))
        backed = _salted(edges.filter("not piece").select("pattern", "instance"), known, "instance", "pattern").groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count("*").alias("k"))
        pattern = backed.filter(F.col("k") >= min_seeds).hint("merge").join(total, "pattern").select("pattern", F.col("kind").alias("as"), (F.col("s") / (F.col("n") + 0.25)).alias("p")).filter(F.col("p") >= min_pattern)
        unseen = _salted(edges.filter("kind is null").select("pattern", "instance"), pattern, "pattern", "instance")
        scored = unseen.groupBy("instance", "as").agg((1 - F.exp(F.sum(F.log(1 - F.least("p", F.lit(0.999)))))).alias("score"))
        best = scored.groupBy("instance").agg(F.max_by("as", F.struct("score", "as")).alias("kind"), F.max("score").alias("score")).filter(F.col("score") >= min_score)
        known = stored(edges.filter("kind is not null").select("instance", "kind").distinct().withColumn("score", F.lit(1.0)).unionByName(best), "known")
    return known.groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score")).filter(F.col("score") >= min_score)


def hidden_seeds(docs: DataFrame, rounds: int = ROUNDS, share: int = 5) -> DataFrame:
    """How well the method finds what the fixed patterns know: every `share`-th seed instance, by hash, is hidden from it. (kind, hidden, found, found_right, others): of each kind
    the hidden instances, those found as that kind or another, those found as their own, and found instances that are no seed at all (`kind` is then what they were taken for)."""
    mentioned = stored(mentions(docs), "mentions")
    hide = lambda m: F.pmod(F.xxhash64(m["instance"]), F.lit(share)) == 0
    masked = mentioned.withColumn("found", F.transform("found", lambda m: m.withField("kind", F.when(~hide(m), m["kind"]))))
    truth = mentioned.select(F.explode("found").alias("m")).groupBy(F.col("m.instance").alias("instance")).agg(F.max("m.kind").alias("truth"))
    asked = truth.filter(F.col("truth").isNull() | hide({"instance": F.col("instance")}))
    got = asked.hint("merge").join(bootstrap(masked, rounds).select("instance", F.col("kind").alias("taken")), "instance", "left")
    n = lambda c: F.count(F.when(c, 1))
    known = F.col("truth").isNotNull()
    return got.withColumn("kind", F.coalesce("truth", "taken")).filter("kind is not null").groupBy("kind").agg(n(known).alias("hidden"), n(known & F.col("taken").isNotNull()).alias("found"), n(F.col("truth") == F.col("taken")).alias("found_right"), n(~known).alias("others"))


def personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text_hash, base, spans): fixed spans and all spans of each row, as arrays of (rank of kind, start, end)."""
    found = stored(mentions(docs).withColumn("row", F.monotonically_increasing_id()), "mentions")
    new = bootstrap(found, rounds)
    rank = (F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1).cast("int").alias("k")
    flat = found.filter(F.exists("found", lambda m: m["kind"].isNull())).select("row", F.explode("found").alias("m")).filter("m.kind is null").select("row", "m.start", "m.end", "m.instance", "m.run", "m.choice")
    more = _salted(flat, new.select("instance", "kind"), "instance", "row")
    more = more.withColumn("_least", F.min("choice").over(Window.partitionBy("row", "run"))).filter("choice = _least")
    extra = more.groupBy("row").agg(F.array_sort(F.collect_set(F.struct(rank, "start", "end"))).alias("extra"))
    base = F.array_sort(F.transform(F.filter("found", lambda m: m["kind"].isNotNull()), lambda m: F.struct((F.array_position(F.array(*map(F.lit, KINDS)), m["kind"]) - 1).cast("int").alias("k"), m["start"].alias("start"), m["end"].alias("end"))))
    joined = found.select("row", "doc_id", "text_hash", base.alias("base")).join(extra.hint("shuffle_hash"), "row", "left")
    return joined.select("doc_id", "text_hash", "base", F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast("array<struct<k:int,start:int,end:int>>")))).alias("spans"))


def _text(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    of_kind = lambda i: F.filter("base", lambda s: s["k"] == i)
    count = [F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *count, F.sha2(_text("base").cast("binary"), 256).alias("base_sha256"), _text("spans").alias("spans"))


def redact(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """Put `<kind>` in place of each span; other columns stay. Of spans that overlap, the united stretch becomes the first one's kind.
    Rows find their spans by doc_id, null too, and text; rows that have both alike have the same spans, so as many rows come out as went in."""
    spans = found.filter(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"), F.col("spans").alias("_spans")).dropDuplicates(["_id", "_text"])
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_text"))
    joined = docs.join(spans.hint("merge"), same, "left").drop("_id", "_text")
    cut = F.aggregate(
        F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k")))),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(F.concat(a["out"], F.col(text).substr(a["at"] + 1, s["start"] - a["at"]), F.lit("<"), F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1), F.lit(">")).alias("out"), s["end"].alias("at")),
        ).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))),
        lambda a: F.concat(a["out"], F.col(text).substr(a["at"] + 1, F.length(text))),
    )
    return joined.withColumn(text, F.when(F.size("_spans") > 0, cut).otherwise(F.col(text))).drop("_spans")


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """The fixed patterns as stated, with plain regular expressions; for tests."""
    text = text or ""
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
