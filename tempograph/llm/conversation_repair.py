"""Repair of conversations: the cheapest edits that make turns alternate, decided by integer minima over big-integer weights.

Edits are Keep, Rerole, Delete and Insert. A path through the rows of a conversation has as its weight one integer: its cost in the high
digits, and below it an octal digit for each edit (D, I, K, R are 1 to 4 in ASCII order), at a fixed width from the left, with zeros at the
end. The least integer is therefore the cheapest path, and of those the one whose audit is least in ASCII order. Two paths of one cost
between the same states never have audits of which one begins the other: the rest would be insertions, and those cost. So a
node keeps one weight.

1. Equal rows are one row with a number of copies; rows are sorted over all tasks by conversation, turn and `role:text`, numbered and written.
2. First rows of equal content are found by a sum over digests; only numbers are joined back.
3. Pieces of at most PIECE consecutive rows get the least weight from each state to each state. A conversation of any size is many pieces
   in many tasks. Pieces are put together in rounds of JOINED by the same rule, edges being pieces.
4. Rows meet the audit of their conversation, in order, as a stream; nothing is held but the audit.

Defined results: rows of one turn are ordered by `role:text`; equal rows are repeats. A null role or text, or one in the key of the damage, is one space. A null
conv_id is a conversation of its own, and null turns come first. A role is known by its first character; any other than s, u and a, or none, can't
be kept. A conversation without rows has no edits. An empty table gives an empty one, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States by the last role kept: nothing yet, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state after an inserted or re-roled row.
MADE = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LETTERS = "DIKR"
TO_DIGITS, TO_LETTERS = str.maketrans(LETTERS, "1234"), str.maketrans("1234", LETTERS)
PIECE = 256
#: Rows of tasks that find pieces, and pieces that are put together at once.
BUCKET_BITS = 14
JOINED = 64
_SPACE = r"\x20\x09-\x0D"


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows after the damage that crc32(`conv_id:turn`) % 20 says."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    die = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), die.alias("_die")).filter("_die <> 0")
    text = F.when(F.col("_die") == 1, "").when(F.col("_die") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("_die") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("_die") == 3, F.lit(2)).otherwise(1).cast("long").alias("copies"))


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, id, turn, role, text, copies, initial, blank, truncated): distinct rows, numbered in order. `rows` has (conv_id, turn, role, text, copies)."""
    line = F.concat("role", F.lit(":"), "text")
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("_line", line)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The range is found on a short beginning of the line, which is ordered as lines are.
    dealt = once.repartitionByRange(parts, "conv_id", "turn", F.substring("_line", 1, 64)).sortWithinPartitions("conv_id", "turn", "_line")
    return stored(
        dealt.select(
            "conv_id", F.monotonically_increasing_id().alias("id"), "turn", "role", "text", "copies", F.substring("role", 1, 1).alias("initial"),
            (~F.col("text").rlike(f"[^{_SPACE}]")).alias("blank"), (~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")).alias("truncated"),
        ),
        "turns",
    )


def with_first(rows: DataFrame) -> DataFrame:
    """(conv_id, id, initial, blank, truncated, copies, first): whether no earlier row has the same role and text."""
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    firsts = rows.groupBy("conv_id", digest.alias("_digest")).agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    return rows.select("conv_id", "id", "initial", "blank", "truncated", "copies").hint("merge").join(firsts, "id", "left").withColumn("first", F.coalesce("first", F.lit(False)))


def _weight(cost: int, digits: int, length: int, at: int, width: int) -> int:
    """`length` octal digits from place `at` of `width` on, below the cost."""
    return (cost << 3 * width) + (digits << 3 * (width - at - length))


def _least(best: dict, state: int, weight: int, at: int) -> None:
    if state not in best or weight < best[state][0]:
        best[state] = weight, at


def _with_insertions(best: dict, width: int) -> dict:
    """Two layers of insertions, as none needs more between rows."""
    out, layer = dict(best), best
    for _ in range(2):
        after: dict = {}
        for state, (weight, at) in layer.items():
            _least(after, MADE[state], weight + _weight(INSERT, 2, 1, at, width), at + 1)
        for state, (weight, at) in after.items():
            _least(out, state, weight, at)
        layer = after
    return out


def _read(weight: int, at: int, width: int) -> tuple[int, str]:
    """Cost and audit of a weight with `at` digits."""
    digits = (weight & ((1 << 3 * width) - 1)) >> 3 * (width - at)
    return weight >> 3 * width, format(digits, "o").translate(TO_LETTERS) if at else ""


def least_paths(rows: list[tuple], start: int) -> list[tuple[int, int, int, str]]:
    """(start, end, cost, audit) of the least path over `rows` (initial, forced, truncated, copies) to each state that can be reached. Insertions come before
    rows; `forced` rows and all copies but the first have to go."""
    width = sum(r[3] for r in rows) + 2 * len(rows)
    best = {start: (0, 0)}
    for initial, forced, truncated, copies in rows:
        more = copies if forced else copies - 1
        gone = ((1 << 3 * more) - 1) // 7  # so many digits 1
        after: dict = {}
        for state, (weight, at) in _with_insertions(best, width).items():
            ways = [(state, 0, 0, 0)] if forced else [(state, DELETE, 1, 1), (MADE[state], REROLE + truncated, 4, 1)]
            if not forced and (state, initial) in KEPT:
                ways.append((KEPT[state, initial], KEEP + truncated, 3, 1))
            for to, cost, digit, one in ways:
                _least(after, to, weight + _weight(cost + DELETE * more, (digit << 3 * more) + gone, one + more, at, width), at + one + more)
        best = after
    return [(start, end, *_read(weight, at, width)) for end, (weight, at) in best.items()]


def put_together(pieces: list[list[tuple]]) -> list[tuple[int, int, int, str]]:
    """The least paths over consecutive pieces, each a list of (start, end, cost, audit)."""
    width = sum(max(len(x[3]) for x in piece) for piece in pieces)
    out = []
    for start in {x[0] for x in pieces[0]}:
        best = {start: (0, 0)}
        for piece in pieces:
            after: dict = {}
            for a, b, cost, audit in piece:
                if a in best:
                    weight, at = best[a]
                    _least(after, b, weight + _weight(cost, int(audit.translate(TO_DIGITS) or "0", 8), len(audit), at, width), at + len(audit))
            best = after
        out += [(start, end, *_read(weight, at, width)) for end, (weight, at) in best.items()]
    return out


def decided(paths: list[tuple]) -> tuple[int, str]:
    """Cost and audit of the least path from the start to a whole conversation, with what has to be inserted at its end."""
    ways = [(cost, audit) if end in (START, ASSISTANT) else (cost + 2 * INSERT, audit + "II") if end == SYSTEM else (cost + INSERT, audit + "I") for start, end, cost, audit in paths if start == START]
    width = max(len(audit) for _, audit in ways)
    return _read(*min((_weight(cost, int(audit.translate(TO_DIGITS) or "0", 8), len(audit), 0, width), len(audit)) for cost, audit in ways), width)


def _illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


_PATHS = "array<struct<start:int,end:int,cost:long,audit:string>>"
_PATHS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_PIECE_COLUMNS = ["conv_id", "piece", "paths", "head", "tail", "illegal"]


def _piece_rows(conv: pa.Array, rows: list[tuple]) -> pa.Table:
    named = [[{"start": a, "end": b, "cost": c, "audit": d} for a, b, c, d in r[1]] for r in rows]
    columns = [conv, pa.array([r[0] for r in rows], pa.int64()), pa.array(named, _PATHS_ARROW), *(pa.array([r[i] for r in rows], pa.string()) for i in (2, 3)), pa.array([r[4] for r in rows], pa.int64())]
    return pa.table(columns, _PIECE_COLUMNS)


def _conv_type(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def pieces(flagged: DataFrame, piece: int = PIECE, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """(conv_id, piece, paths, head, tail, illegal): least paths over each piece; its first and last initials and the pairs inside that are not legal. Only a piece that may
    go on from another has paths from all states."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        conv, ids = rows["conv_id"].combine_chunks(), rows["id"].to_pylist()
        names = conv.to_pylist()
        initial, blank, truncated, copies, first = (rows[c].to_pylist() for c in ("initial", "blank", "truncated", "copies", "first"))
        out, at, lo = [], [], 0
        for hi in range(1, len(names) + 1):
            if hi < len(names) and names[hi] == names[lo] and hi - lo < piece:
                continue
            part = [(initial[i], blank[i] or not first[i], int(truncated[i]), copies[i]) for i in range(lo, hi)]
            starts = (START,) if lo and names[lo - 1] != names[lo] else range(4)
            illegal = sum((c - 1) * _illegal(x, x) for x, _, _, c in part) + sum(_illegal(x[0], y[0]) for x, y in zip(part, part[1:]))
            out.append((ids[lo], [p for s in starts for p in least_paths(part, s)], part[0][0], part[-1][0], illegal))
            at.append(lo)
            lo = hi
        return _piece_rows(conv.take(pa.array(at, pa.int64())), out)

    return flagged.withColumn("_bucket", F.shiftright("id", bucket_bits)).groupBy("_bucket").applyInArrow(run, f"conv_id {_conv_type(flagged)}, piece long, paths {_PATHS}, head string, tail string, illegal long")


def whole(parts: DataFrame, joined: int = JOINED) -> DataFrame:
    """The pieces of each conversation put together, in rounds of `joined`, each written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, conv = None, [], None

        def joined_up():
            ends = list(zip(held, held[1:]))
            row = (held[0][0], put_together([x[1] for x in held]), held[0][2], held[-1][3], sum(x[4] for x in held) + sum(_illegal(x[3], y[2]) for x, y in ends))
            yield from _piece_rows(conv, [row]).to_batches()

        for batch in batches:
            for r, (name, piece, paths, *ends, block) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                if held and (name, block) != key:
                    yield from joined_up()
                    held = []
                key, conv = (name, block), batch.column(0).slice(r, 1)
                held.append((piece, [tuple(p.values()) for p in paths], *ends))
        if held:
            yield from joined_up()

    while True:
        if parts.groupBy("conv_id").count().filter("count > 1").isEmpty():
            return parts
        mine = Window.partitionBy("conv_id")
        place = F.floor((F.row_number().over(mine.orderBy("piece")) - 1) / joined)
        numbered = stored(parts.select(*_PIECE_COLUMNS, place.alias("block"), (F.count("*").over(mine) == 1).alias("_whole")), "pieces")
        dealt = numbered.filter("not _whole").drop("_whole").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "piece")
        parts = stored(numbered.filter("_whole").select(*_PIECE_COLUMNS).unionByName(dealt.mapInArrow(run, parts.schema)), "pieces")


def audits(parts: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit) of whole conversations."""

    def run(batches):
        for batch in batches:
            best = [decided([tuple(p.values()) for p in paths]) for paths in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([c for c, _ in best], pa.int64()), pa.array([a for _, a in best], pa.string())], ["conv_id", "illegal", "cost", "audit"])

    return parts.select("conv_id", "paths", "illegal").mapInArrow(run, f"conv_id {_conv_type(parts)}, illegal long, cost long, audit string")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, edit, turn, role, text): the rows that stay, K or R, and inserted ones, I, in order within each conversation. `rows` are `ordered`, `found` are `audits`."""
    kind = f"conv_id {_conv_type(rows)}, edit string, turn {rows.schema['turn'].dataType.simpleString()}, role string, text string"
    heads = found.select("conv_id", F.lit(-1).cast("long").alias("id"), F.col("audit").alias("text"))
    both = rows.select("conv_id", "id", "turn", "role", "text", "copies").unionByName(heads, allowMissingColumns=True)

    def run(batches):
        audit, at, state, conv, turn_type = "", 0, START, None, None

        def inserted():
            nonlocal at, state
            while audit[at : at + 1] == "I":
                at, state = at + 1, MADE[state]
                yield conv, "I", None, ROLES[state], ""

        for batch in batches:
            turn_type = batch.column(2).type
            out = []
            for name, i, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if i < 0:
                    out += inserted()  # at the end of the one before
                    audit, at, state, conv = text, 0, START, name
                    continue
                out += inserted()
                edit = audit[at]
                at += copies
                if edit == "K":
                    state = KEPT[state, role[:1]]
                elif edit == "R":
                    state = MADE[state]
                    role = ROLES[state]
                if edit != "D":
                    out.append((conv, edit, turn, role, text))
            yield packed(out, batch.column(0).type, turn_type)
        if conv is not None or audit:
            yield packed(list(inserted()), batch.column(0).type, turn_type)

    def packed(out, conv_type, turn_type):
        types = (conv_type, pa.string(), turn_type, pa.string(), pa.string())
        return pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["conv_id", "edit", "turn", "role", "text"])

    return both.repartition("conv_id").sortWithinPartitions("conv_id", "id").mapInArrow(run, kind)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faults and audits (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), and the `repaired` rows. `rows` has (conv_id, turn, role, text, copies)."""
    turns = ordered(rows)
    flagged = with_first(turns)
    found = stored(audits(whole(stored(pieces(flagged), "pieces"))), "audits")
    copies = lambda when, n: F.sum(F.when(when, n).otherwise(0)).alias
    live, first = ~F.col("blank"), F.col("first")
    faults = flagged.groupBy("conv_id").agg(copies(~live, F.col("copies"))("blank"), copies(live, F.col("copies") - first.cast("long"))("duplicate"), copies(live & first & F.col("truncated"), F.lit(1))("truncated"))
    gaps = turns.select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    return together("conv_id", gaps, faults, found), repaired(turns, found)


def together(key: str, *tables: DataFrame) -> DataFrame:
    """Tables of one row for each key, null too, side by side."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t, allowMissingColumns=True)
    return every.groupBy(key).agg(*(F.max(c).alias(c) for c in every.columns if c != key))


def hashes(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of `repaired` rows, in the tasks and in the order that they come in."""

    def run(batches):
        conv, sha = None, None  # conv: the conversation as an array of one
        for batch in batches:
            done, digests = [], []
            for r, (name, role, text) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)))):
                line = f"{role}:{text}".encode()
                if sha is not None and conv[0].as_py() == name:
                    sha.update(b"\n" + line)
                    continue
                if sha is not None:
                    done.append(conv), digests.append(sha.hexdigest())
                conv, sha = batch.column(0).slice(r, 1), hashlib.sha256(line)
            if done:
                yield pa.record_batch([pa.concat_arrays(done), pa.array(digests)], ["conv_id", "repaired_sha256"])
        if sha is not None:
            yield pa.record_batch([conv, pa.array([sha.hexdigest()])], ["conv_id", "repaired_sha256"])

    return rows.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {_conv_type(rows)}, repaired_sha256 string")


def digest(conversations: DataFrame) -> DataFrame:
    """One row for each conversation of the table, after damage and repair."""
    found, rows = repair(damage(conversations))
    every = together("conv_id", conversations.select("conv_id").distinct(), found, hashes(rows))
    zero: list[Column] = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def brute_force(rows: list[tuple]) -> dict:
    """conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of `rows` (conv_id, turn, role, text) by trying all edits, with up to two insertions
    in each place, on (cost, audit) pairs; for tests. Only for a few rows each."""
    import re
    import zlib

    every: dict = {}
    for conv, turn, role, text in rows:
        mine = every.setdefault(conv, [])
        die = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if die == 1 else re.sub("[.!?]", "", text) if die == 2 else text
        if die:
            mine += [(turn, "user" if die == 4 else role, text)] * (1 + (die == 3))
    out = {}
    for conv, mine in every.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, f"{r[1]}:{r[2]}"))
        turns = {t for t, _, _ in mine if t is not None}
        faults = []
        for i, (_, role, text) in enumerate(mine):
            stripped = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not stripped else "duplicate" if any(x[1:] == (role, text) for x in mine[:i]) else "truncated" if stripped[-1] not in ".!?" else "")
        extra = lambda w: [x for i in (0, 1, 2) for x in ([w] if i == 0 else extra_one(w) if i == 1 else [z for y in extra_one(w) for z in extra_one(y)])]
        extra_one = lambda w: [(w[0] + 2, w[1] + "I", w[2] + r[0], w[3] + f"\n{r}:") for r in ("user", "assistant")]
        paths = [(0, "", "", "")]
        good = re.compile("(s?(ua)*u?)?$")
        for (_, role, text), fault in zip(mine, faults):
            grown = []
            for cost, audit, initials, lines in (x for p in paths for x in extra(p)):
                grown.append((cost + 3, audit + "D", initials, lines))
                if fault not in ("blank", "duplicate"):
                    more = fault == "truncated"
                    grown.append((cost + more, audit + "K", initials + (role[:1] or "?"), lines + f"\n{role}:{text}"))
                    grown += [(cost + 2 + more, audit + "R", initials + r[0], lines + f"\n{r}:{text}") for r in ("user", "assistant")]
            paths = [p for p in grown if good.match(p[2])]
        ways = [x for p in paths for x in extra(p) if re.fullmatch("(s?(ua)+)?", x[2])]
        cost, audit, _, lines = min(ways, key=lambda x: x[:2])
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(lines[1:].encode()).hexdigest())
    return out
