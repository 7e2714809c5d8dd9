"""Repair of conversation structure, by one solution for each distinct signature.

A conversation's rows, by turn (nulls first; ties by role, then by digest of the text),
become a string: a letter for a row's role (system, user, assistant, other) and its first
fault (blank, duplicate, truncated or none).  Such strings are cut into segments of ``SEGMENT`` rows at most,
so a conversation that holds a third of all rows is many segments in many tasks; its
rows are dealt by ranges of (conversation, turn).  Each *distinct* segment is
solved once, by memoised recursion over its suffixes: for each state before it and
after it, the cheapest edits, ties to the least string.  Conversations then choose among those
solutions from their last segment backwards, which needs 16 numbers a segment,
the chosen audits are joined back, and the edits are replayed on the rows.

States: 0 nothing so far, 1 after system, 2 after user, 3 after assistant; a
conversation may end in 0 or 3, and one that ends elsewhere gets rows inserted.  Two audits of
one segment from one state at one cost never start one another, so the least
string is found segment by segment.

Rows meet their edits in one more sort by ranges of (conversation, turn), to
which texts travel once; the digest follows in the same tasks.  A
conversation that such a range cuts (two for each task at most) is hashed again by
position, in one task as SHA-256 asks for, with one row in memory at a time.

Null roles and texts count as one space; a null conversation is a conversation of its own; an
empty table gives empty results; extra columns are ignored.  A repeated row is a duplicate.
Any length of text is allowed, up to what one row may hold.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociq.llm.common import HOT, materialize, release, spread_join, told_of_tables

SPACE = " \t\n\x0b\x0c\r"
#: Rows of a segment at most; also the depth of the recursion.
SEGMENT = 200
#: Solved suffixes that a task remembers before it starts afresh (a cache, not a limit on results).
MEMO = 20_000
#: Output rows handed over at once.
BATCH = 2_000
ROLES = "sua"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
TAIL = {0: "", 1: "II", 2: "I", 3: ""}
_TARGET = {0: 2, 1: 2, 2: 3, 3: 2}
_NAME = {2: "user", 3: "assistant"}
_FAR = 1 << 40

Solution = list[dict[int, tuple[int, str]]]


class Costs(NamedTuple):
    """Of edits (keeping a row is free), and of a truncated row that stays."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def letter(role: str, fault: int) -> str:
    return chr(65 + 4 * "sua".find(role[:1] or "?") + 4 + fault)


def role_of(code: str) -> str:
    """Initial of the role that a letter stands for; ? for any other."""
    return "?sua"[(ord(code) - 65) // 4]


def fault_of(code: str) -> int:
    return (ord(code) - 65) % 4


def solve(codes: str, memo: dict[str, Solution], costs: Costs = Costs()) -> Solution:
    """[state before] -> {state after: (cost, audit)} of a segment; rows are inserted only before its rows."""
    if codes in memo:
        return memo[codes]
    if not codes:
        return [{s: (0, "")} for s in range(4)]
    rest = solve(codes[1:], memo, costs)
    role, fault = role_of(codes[0]), fault_of(codes[0])
    direct: Solution = []
    for state in range(4):
        options = [("D", costs.delete, state)]
        if fault not in (BLANK, DUPLICATE):
            more = costs.truncated if fault == TRUNCATED else 0
            to = _TARGET[state]
            options.append(("R", costs.rerole + more, to))
            if role == _NAME[to][0]:
                options.append(("K", more, to))
            elif role == "s" and state == 0:
                options.append(("K", more, 1))
        best: dict[int, tuple[int, str]] = {}
        for edit, cost, to in options:
            for end, (c, audit) in rest[to].items():
                best[end] = min(best.get(end, (_FAR, "")), (cost + c, edit + audit))
        direct.append(best)
    out: Solution = []
    for state in range(4):
        best = dict(direct[state])
        at = state
        for inserted in ("I", "II"):
            at = _TARGET[at]
            for end, (c, audit) in direct[at].items():
                best[end] = min(best.get(end, (_FAR, "")), (c + costs.insert * len(inserted), inserted + audit))
        out.append(best)
    memo[codes] = out
    return out


def illegal_pairs(codes: str) -> int:
    roles = [role_of(c) for c in codes]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))


def _batches(rows: Iterator[tuple], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    arrow = _arrow(schema)
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(0, batch.num_rows, BATCH):
            yield from zip(*(c.to_pylist() for c in batch.slice(k, BATCH).columns), strict=True)


_TEXT, _LONG, _INT, _BYTES = T.StringType(), T.LongType(), T.IntegerType(), T.BinaryType()


def _type(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_SEGMENTS = _type(key=_TEXT, seg=_LONG, codes=_TEXT, turns=T.ArrayType(_LONG), roles=T.ArrayType(_TEXT), digests=T.ArrayType(_BYTES), new_turns=_LONG, low=_LONG, high=_LONG)
_SOLVED = _type(codes=_TEXT, n=_LONG, costs=T.ArrayType(_LONG), made=T.ArrayType(_LONG), audits=T.ArrayType(_TEXT))
_PIECES = T.ArrayType(_type(seg=_LONG, codes=_TEXT, pick=_INT, base=_LONG))
_CHOSEN = _type(key=_TEXT, gaps=_LONG, blank=_LONG, duplicate=_LONG, truncated=_LONG, illegal=_LONG, cost=_LONG, made=_LONG, tail=_TEXT, pieces=_PIECES)
_EDITS = _type(key=_TEXT, turn=_LONG, role=_TEXT, digest=_BYTES, kind=_INT, at=_LONG, made=_LONG, before=_TEXT, into=_TEXT, text=_TEXT)
_REPAIRED = _type(key=_TEXT, position=_LONG, made=_LONG, role=_TEXT, text=_TEXT)
_HASHED = _type(key=_TEXT, repaired_sha256=_TEXT)


def _segments(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, turn, role, digest, fault, repeated), in order, to segments; see _SEGMENTS."""
    first = TaskContext.get().partitionId() << 33

    def cut():
        seg, now, codes, rows, new, before = first, None, [], [], 0, None

        def done():
            turns = [r[0] for r in rows]
            known = [t for t in turns if t is not None]
            return (now, seg, "".join(codes), turns, [r[1] for r in rows], [r[2] for r in rows], new, min(known, default=None), max(known, default=None))

        for key, turn, role, digest, fault, repeated in _rows(batches):
            if rows and (key != now or len(rows) == size):
                yield done()
                seg, codes, rows, new = seg + 1, [], [], 0
            if key != now:
                now, before = key, None
            same = before is not None and before[:3] == (turn, role, digest)
            codes.append(letter(role, DUPLICATE if fault != BLANK and (repeated or same) else fault))
            rows.append((turn, role, digest))
            new += turn is not None and (before is None or before[0] != turn)
            before = (turn, role, digest)
        if rows:
            yield done()

    return _batches(cut(), _SEGMENTS)


def _solutions(batches: Iterator[pa.RecordBatch], prices: Costs) -> Iterator[pa.RecordBatch]:
    """Distinct segments to costs by 4 x state before + state after; costs hold a rank of the audits in their last two bits."""

    def each():
        memo: dict[str, Solution] = {}
        for codes, n in _rows(batches):
            if len(memo) > MEMO:
                memo.clear()
            solved = solve(codes, memo, prices)
            costs, made, audits = [-1] * 16, [0] * 16, [""] * 16
            for state in range(4):
                by_audit = sorted(solved[state], key=lambda end: solved[state][end][1])
                for rank, end in enumerate(by_audit):
                    cost, audit = solved[state][end]
                    k = 4 * state + end
                    costs[k], made[k], audits[k] = 4 * cost + rank, len(audit) - audit.count("D"), audit
            yield codes, n, costs, made, audits

    return _batches(each(), _SOLVED)


def _choose(batches: Iterator[pa.RecordBatch], insert: int) -> Iterator[pa.RecordBatch]:
    """(key, segments in order) to the cheapest way through all segments; see _CHOSEN."""

    def each():
        for key, segments in _rows(batches):
            ahead = [insert * len(TAIL[s]) for s in range(4)]
            picks = []
            for s in reversed(segments):
                costs, new, pick = s["costs"], [_FAR] * 4, [0] * 4
                for k in range(16):
                    if costs[k] >= 0:
                        # by cost, then by rank of the audit
                        new[k // 4], pick[k // 4] = min((new[k // 4], pick[k // 4]), (4 * ahead[k % 4] + costs[k], k))
                ahead = [c // 4 if c < _FAR else _FAR for c in new]
                picks.append(pick)
            state, made, pieces = 0, 0, []
            for s, pick in zip(segments, reversed(picks), strict=True):
                k = pick[state]
                pieces.append({"seg": s["seg"], "codes": s["codes"], "pick": k, "base": made})
                made += s["made"][k]
                state = k % 4
            faults = [sum(sum(map(s["codes"].count, (chr(65 + 4 * r + f) for r in range(4)))) for s in segments) for f in (BLANK, DUPLICATE, TRUNCATED)]
            ends = [a["codes"][-1] + b["codes"][0] for a, b in zip(segments, segments[1:], strict=False)]
            illegal = sum(illegal_pairs(s["codes"]) for s in segments) + sum(map(illegal_pairs, ends))
            low = min((s["low"] for s in segments if s["low"] is not None), default=None)
            high = max((s["high"] for s in segments if s["high"] is not None), default=None)
            gaps = 0 if low is None else high - low + 1 - sum(s["new_turns"] for s in segments)
            yield key, gaps, *faults, illegal, ahead[0], made + len(TAIL[state]), TAIL[state], pieces

    return _batches(each(), _CHOSEN)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with their audits to one row for each row that stays, with the inserted rows before it; see _EDITS."""

    def each():
        for key, turns, roles, digests, pick, base, made, audit in _rows(batches):
            state, k, at, pending = pick // 4, 0, base, ""
            for edit in audit:
                if edit == "I":
                    state = _TARGET[state]
                    pending += _NAME[state][0]
                    continue
                if edit == "D":
                    k += 1
                    continue
                if edit == "K":
                    state = {"s": 1, "u": 2, "a": 3}[roles[k][0]]
                    into = roles[k]
                else:
                    state = _TARGET[state]
                    into = _NAME[state]
                yield key, turns[k], roles[k], digests[k], 0, at, made, pending, into, None
                at, k, pending = at + len(pending) + 1, k + 1, ""
            if pending:
                yield key, turns[-1], roles[-1], digests[-1], 0, at, made, pending, None, None

    return _batches(each(), _EDITS)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and, after them, the rows of the same turn, role and digest, to repaired rows; see _REPAIRED."""

    def each():
        now, held = None, []
        for key, turn, role, digest, kind, at, made, before, into, text in _rows(batches):
            if (key, turn, role, digest) != now:
                now, held = (key, turn, role, digest), []
            if kind == 0:
                held.append((at, made, before, into))
                continue
            for at, made, before, into in held:  # noqa: PLW2901
                for k, x in enumerate(before):
                    yield key, at + k, made, _NAME[2 if x == "u" else 3], ""
                if into is not None:
                    yield key, at + len(before), made, into, text
            held = []

    return _batches(each(), _REPAIRED)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows by key and position to (key, sha256); null where rows of the key are missing here."""

    def each():
        now, sha, expected = None, None, 0
        for key, position, made, role, text in _rows(batches):
            if key != now:
                if now is not None and sha is not None:
                    yield now, None
                now, sha, expected = key, hashlib.sha256() if position == 0 else None, 0
                if sha is None:
                    yield key, None
            if sha is None:
                continue
            assert position == expected
            sha.update(f"{chr(10) if position else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            expected += 1
            if expected == made:
                yield key, sha.hexdigest()
                sha = None
        if sha is not None:
            yield now, None

    return _batches(each(), _HASHED)


def _by_range(rows: DataFrame, *order: str) -> DataFrame:
    """Sorted within tasks that hold ranges of (key, turn), so that one conversation may be many tasks."""
    return rows.repartitionByRange("key", F.col("turn").asc_nulls_first()).sortWithinPartitions("key", F.col("turn").asc_nulls_first(), "role", "digest", *order)


def _plain(name: str, kind: str = "string") -> Column:
    return F.coalesce(F.col(f"`{name}`").cast(kind), F.lit(" "))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", costs: Costs = Costs(), segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired rows) of the conversations in ``rows``.

    Audits: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    Repaired rows: conv_id (column of the same name and type), position from 0, role, text, and what ``digests`` needs.
    """
    spark, kind = rows.sparkSession, rows.schema[conv_col].dataType
    conv_id = F.when(F.col("key") != " ", F.col("key")).cast(kind).alias("conv_id")
    text = _plain(text_col)
    last = F.substring(F.rtrim(text, F.lit(SPACE)), -1, 1)
    fault = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    full = rows.select(_plain(conv_col).alias("key"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"), _plain(role_col).alias("role"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"), fault.alias("fault"))
    light = full.drop("text")
    same = ["key", "role", "digest"]
    short_lived: list = []
    with told_of_tables(short_lived):
        first = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first")
        repeated = materialize(light.groupBy(*same).agg(first, F.count("*").alias("copies")).filter("copies > 1"), "repeated")
        total = repeated.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
        marked = spread_join(light, repeated, same, F.col("copies") * HOT > total, "left")
        later = F.struct(F.col("turn").isNotNull().alias("known"), "turn") > F.col("first")
        marked = marked.select("key", "turn", "role", "digest", "fault", F.coalesce(later, F.lit(False)).alias("repeated"))
        segments = materialize(_by_range(marked).mapInArrow(functools.partial(_segments, size=segment), _SEGMENTS), "segments")
        solved = materialize(segments.groupBy("codes").agg(F.count("*").alias("n")).mapInArrow(functools.partial(_solutions, prices=costs), _SOLVED), "solved")
        total = solved.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        hot = F.col("n") * HOT > total
        priced = spread_join(segments.select("key", "seg", "codes", "new_turns", "low", "high"), solved.select("codes", "n", "costs", "made"), ["codes"], hot)
        in_order = F.sort_array(F.collect_list(F.struct("seg", "codes", "costs", "made", "new_turns", "low", "high")))
        chosen = materialize(priced.groupBy("key").agg(in_order.alias("segments")).mapInArrow(functools.partial(_choose, insert=costs.insert), _CHOSEN), "chosen")
        pieces = chosen.select("key", F.col("made").alias("all_made"), F.explode("pieces").alias("p")).select("key", "all_made", "p.*")
        pieces = spread_join(pieces, solved.select("codes", "n", "audits"), ["codes"], hot)
        pieces = materialize(pieces.select("key", "all_made", "seg", "pick", "base", F.element_at("audits", F.col("pick") + 1).alias("audit")), "pieces")
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "audit"))), lambda p: p["audit"]), "")
    joined = pieces.groupBy("key").agg(audit.alias("audit"))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    audits = chosen.join(joined, "key").select(conv_id, *counts, F.concat("audit", "tail").alias("audit"))
    edits = pieces.join(segments.select("key", "seg", "turns", "roles", "digests"), ["key", "seg"]).select("key", "turns", "roles", "digests", "pick", "base", "all_made", "audit").mapInArrow(_edits, _EDITS)
    # rows at the end of a conversation, after the last row that it has
    ends = pieces.groupBy("key").agg(F.max("seg").alias("seg")).join(chosen.filter("tail != ''").select("key", "made", "tail"), "key").join(segments, ["key", "seg"])
    end_of = lambda c: F.element_at(c, -1)
    roles = F.when(F.length("tail") == 2, "ua").otherwise("a")
    ends = ends.select("key", end_of("turns").alias("turn"), end_of("roles").alias("role"), end_of("digests").alias("digest"), F.lit(0).alias("kind"), (F.col("made") - F.length("tail")).alias("at"), "made", roles.alias("before"), F.lit(None).cast("string").alias("into"), F.lit(None).cast("string").alias("text"))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in _EDITS.fields if f.name in ("at", "made", "before", "into")]
    texts = full.select("key", "turn", "role", "digest", F.lit(1).alias("kind"), *nothing, "text")
    repaired = _by_range(edits.unionByName(ends).unionByName(texts), "kind", "at").mapInArrow(_replay, _REPAIRED)
    needed = audits.select(F.lit(0)).unionAll(edits.select(F.lit(0)))
    release(spark, short_lived, needed)
    return audits, repaired.select(conv_id, "key", "position", "made", "role", "text")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired rows as ``repair`` gives them: role:text, joined by newlines.

    A conversation of which no row is left has none here.

    Conversations that lie in one task are hashed there.  Those that a range cuts
    are at most two for each task, so their names are broadcast; their rows are
    sorted by position once more.
    """
    kind = repaired.schema["conv_id"].dataType
    rows = repaired.select("key", "position", "made", "role", "text")
    there = rows.mapInArrow(_hash, _HASHED)
    cut = there.filter("repaired_sha256 IS NULL").select("key").distinct()
    late = rows.join(F.broadcast(cut), "key").repartition("key").sortWithinPartitions("key", "position").mapInArrow(_hash, _HASHED)
    both = there.filter("repaired_sha256 IS NOT NULL").unionAll(late)
    return both.select(F.when(F.col("key") != " ", F.col("key")).cast(kind).alias("conv_id"), "repaired_sha256")
