"""Column expressions of the fact model. All run inside the JVM; none is a Python function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of certainty labels, consolidation predicates whose values exclude each other, file name rules.
CERTAINTY = {"stated": 1.0, "inferred": 0.7, "speculative": 0.4}
SOURCES = ("user", "tool_result", "model")
EXCLUSIVE_PREDICATES = ("works_at", "version_is", "runs_on", "has_role", "has_version", "runs_model", "deployed_on", "head_node_of")
EXTENSIONS = {"text": ".txt", "code": ".py", "pdf": ".pdf", "web": ".html", "voice": ".txt", "json": ".json"}
FOLDERS = {"text": "text", "code": "code", "pdf": "documents", "web": "web", "voice": "transcripts", "json": "json"}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

_S = r"[ \t-\r]"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pick(value: Column, choices: dict, otherwise=None) -> Column:
    """The choice for a value; `otherwise` for any other, null included."""
    out = F.when(F.lit(False), F.lit(None))
    for k, v in choices.items():
        out = out.when(value == k, F.lit(v))
    return out.otherwise(F.lit(otherwise))


def normalize_name(name) -> Column:
    """Lower case, trimmed; `-`, `_` and `/` become spaces; only a-z, 0-9 and spaces stay; spaces collapse."""
    x = F.regexp_replace(F.lower(_c(name)), "[-_/]", " ")
    x = F.regexp_replace(x, r"[^a-z0-9 \t-\r]", "")
    return F.coalesce(F.trim(F.regexp_replace(x, f"{_S}+", " ")), F.lit(""))


def normalize_literal(value) -> Column:
    """Trimmed, lower case, spaces collapsed, closing marks stripped; null is empty."""
    x = F.trim(F.regexp_replace(F.lower(_c(value)), f"{_S}+", " "))
    return F.coalesce(F.regexp_replace(x, "[.,;:!?]+$", ""), F.lit(""))


def normalize_answer(text) -> Column:
    """Lower case, everything but letters, digits and `_` becomes a space, spaces collapse."""
    return F.trim(F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}_]+", " "))


def cosine(a, b) -> Column:
    """Cosine of two arrays; 0 for empty, of unequal size, or without length."""
    a, b = _c(a), _c(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fits & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def query_words(text) -> Column:
    """Words of a query, compound words joined by - or _ kept whole. The pattern is a fixed value: it decides which names a query finds."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9]+(?:[-_][a-z0-9]+)*"), F.lit(0))


def terms(text) -> Column:
    """Terms of a text for ranking: runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(_c(text)), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def term_line(text) -> Column:
    """The terms of a text, in order, with one space between them; they hold none themselves."""
    return F.trim(F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}]+", " "))


def overlap(query, content) -> Column:
    """Share of the query's distinct space-separated terms that the content has."""
    split = lambda x: F.array_distinct(F.filter(F.split(F.lower(_c(x)), f"{_S}+"), lambda y: y != ""))
    q = split(query)
    return F.size(F.array_intersect(q, split(content))) / F.greatest(F.size(q), F.lit(1))


def time_range(text, now) -> Column:
    """Struct (start, end) of the first time phrase that a text has, by a fixed order of phrases; null if none."""
    t, now = F.lower(_c(text)), _c(now)
    day = lambda y, m, d=1: F.try_make_timestamp(y, F.lit(m) if isinstance(m, int) else m, F.lit(d) if isinstance(d, int) else d, F.lit(0), F.lit(0), F.lit(0))
    second, days = F.expr("interval 1 second"), F.expr("interval 1 day")
    out = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(a.cast("timestamp").alias("start"), b.cast("timestamp").alias("end")))
    y = F.year(now)
    last = lambda word: t.contains(f"last {word}")
    named = F.regexp_extract(t, rf"\bin ({'|'.join(MONTHS)})\b", 1)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), named).cast("int")
    month_year = F.when(month > F.month(now), y - 1).otherwise(y)
    midnight = F.date_trunc("day", now)
    first = F.date_trunc("month", now)
    date = r"\b(\d{4})-(\d{1,2})(?:-(\d{1,2}))?\b"
    part = lambda i: F.regexp_extract(_c(text), date, i)
    yy, mm, dd = (F.when(part(i) != "", part(i).cast("int")) for i in (1, 2, 3))
    start = day(yy, mm, F.coalesce(dd, F.lit(1)))
    whole_day = out(start, start + days - second)
    whole_month = out(start, F.add_months(start, 1).cast("timestamp") - second)
    m1 = day(month_year, month)
    return (
        F.when(last("spring"), out(day(y - 1, 3), day(y - 1, 6)))
        .when(last("summer"), out(day(y - 1, 6), day(y - 1, 9)))
        .when(last("fall") | last("autumn"), out(day(y - 1, 9), day(y - 1, 12)))
        .when(last("winter"), out(day(y - 1, 12), day(y, 3)))
        .when(named != "", out(m1, F.add_months(m1, 1).cast("timestamp") - second))
        .when(last("week"), out(midnight - F.expr("interval 7 days"), now))
        .when(t.contains("yesterday"), out(midnight - days, midnight - second))
        .when(last("month"), out(F.add_months(first, -1), first))
        .when(dd.isNotNull() & (dd > 0), whole_day)
        .otherwise(whole_month)
    )


def content_hash(content) -> Column:
    return F.substring(F.sha2(_c(content).cast("binary"), 256), 1, 16)


def file_extension(content_type, source) -> Column:
    """Extension by source hints, then by type. `source` is a map."""
    s = _c(source)
    kind, url, name = (F.coalesce(F.try_element_at(s, F.lit(k)), F.lit("")) for k in ("type", "url", "filename"))
    return (
        F.when(kind.contains("arxiv"), ".txt").when(url.contains(".pdf"), ".pdf").when(url.contains(".html"), ".html")
        .when(name.contains("."), F.regexp_extract(name, r"[^./](\.[^./]+)$", 1))
        .otherwise(pick(_c(content_type), EXTENSIONS, ".txt"))
    )


def file_folder(content_type, source) -> Column:
    s = _c(source)
    kind = F.coalesce(F.try_element_at(s, F.lit("type")), F.lit(""))
    return (
        F.when(kind.contains("arxiv"), "arxiv").when(kind.contains("web") | F.map_contains_key(F.coalesce(s, F.create_map().cast("map<string,string>")), "url"), "web")
        .when(kind.contains("voice") | kind.contains("transcript"), "transcripts").when(kind.contains("code"), "code")
        .otherwise(pick(_c(content_type), FOLDERS, "text"))
    )


def file_name(content, content_type, source) -> Column:
    """Paper id if there is one, given name, else content hash; with extension."""
    s = _c(source)
    get = lambda k: F.coalesce(F.try_element_at(s, F.lit(k)), F.lit(""))
    ext = file_extension(content_type, source)
    paper = F.when(get("arxiv_id") != "", get("arxiv_id")).otherwise(get("id"))
    hashed = F.concat(content_hash(content), ext)
    return (
        F.when(get("type").contains("arxiv"), F.when(paper != "", F.concat(F.replace(F.replace(paper, F.lit("arxiv:"), F.lit("")), F.lit("/"), F.lit("_")), ext)).otherwise(hashed))
        .when(get("filename") != "", get("filename")).otherwise(hashed)
    )


def episode_id(session, timestamp, prefix: str = "session") -> Column:
    """Repeatable id from a session and its first time, in groups of 8-4-4-4-12 hex digits."""
    h = F.sha1(F.concat_ws(":", F.lit(prefix), _c(session), _c(timestamp)).cast("binary"))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def message_line(role, content, limit: int = 2000) -> Column:
    c = _c(content)
    cut = F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(" [...] (truncated)"))).otherwise(c)
    return F.concat(F.initcap(_c(role)), F.lit(": "), cut)


def token_estimate(text) -> Column:
    return F.floor(F.length(_c(text)) / 4)


def group_label(entity, predicate, namespace) -> Column:
    """A group's key in the queue of groups; joins of facts use the three columns."""
    return F.concat_ws("|", _c(entity), _c(predicate), _c(namespace))


def has_substring(expected, row) -> Column:
    """Whether any expected string is in the JSON text of a row, whatever the case."""
    return F.exists(_c(expected), lambda x: F.contains(F.lower(F.to_json(row)), F.lower(x)))


def missing_strings(expected, text) -> Column:
    """Expected strings that a text has neither as they are nor after normalising both."""
    t = _c(text)
    return F.filter(_c(expected), lambda x: ~(F.contains(F.lower(t), F.lower(x)) | F.contains(normalize_answer(t), normalize_answer(x))))


def parse_source(raw) -> Column:
    """Map of a JSON object; a text that is none is kept under `raw`."""
    r = F.coalesce(_c(raw), F.lit("{}"))
    parsed = F.from_json(r, "map<string,string>")
    return F.coalesce(parsed, F.create_map(F.lit("raw"), r))


def clip(content, limit: int = 500) -> Column:
    return F.substring(_c(content), 1, limit)


def certainty_weight(label) -> Column:
    return pick(F.coalesce(_c(label), F.lit("stated")), CERTAINTY, 0.0)


def passes_assertion_gate(source) -> Column:
    return F.coalesce(_c(source), F.lit("model")).isin(*SOURCES)


def can_consolidate(source) -> Column:
    return F.coalesce(_c(source), F.lit("model")) != "model"


def source_rank(source) -> Column:
    return pick(_c(source), {"user": 0, "tool_result": 1}, 2)


def statement(subject, predicate, obj) -> Column:
    return F.concat_ws(" ", _c(subject), _c(predicate), _c(obj))


def resolve_valid_at(raw, recorded_at) -> tuple[Column, Column]:
    """(valid_at, inferred): the parsed time, else the time of recording."""
    t = F.try_to_timestamp(_c(raw))
    return F.coalesce(t, _c(recorded_at)), t.isNull()


def disposition_text(skepticism, literalism, empathy) -> Column:
    """A disposition in words. The phrases are fixed values: they go into prompts."""
    s, li, e = _c(skepticism), _c(literalism), _c(empathy)
    return F.concat_ws(
        "; ",
        F.when(s > 3, "require strong evidence").otherwise("moderate threshold"),
        F.when(li > 3, "exact facts").otherwise("allow inference"),
        F.when(e > 3, "preserve sentiment").otherwise("factual focus"),
    )


def session_gate(user_turns, in_error, reverted) -> Column:
    """Reason why a session is not extracted, or `passed`. The reasons are fixed values: they are stored with sessions."""
    n = _c(user_turns)
    return (
        F.when(n < 2, F.concat(F.lit("session has only "), n.cast("string"), F.lit(" user turns (minimum 2)")))
        .when(_c(in_error), "session ended in error state").when(_c(reverted), "session was reverted").otherwise("passed")
    )
