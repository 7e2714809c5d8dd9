"""Conversation repair against a uniform-cost search over edits, row by row."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lociq.llm import conversation_repair as repair
from lociq.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string, Audit string"


def damage(rows):
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        yield from [(c, t, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)


def cheapest(rows, rerole=1, delete=2, insert=5, left=5):
    """(cost, audit, repaired rows): the first goal in order of cost, then of audit."""
    step = {("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a", ("", "s"): "s"}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + delete, audit + "D", i + 1, last, out))
            if fault not in ("blank", "duplicate"):
                more = left * (fault == "truncated")
                if (last, role[:1]) in step:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*out, (role, text))))
                for to in ("user", "assistant"):
                    if (last, to[0]) in step:
                        heapq.heappush(heap, (cost + more + rerole, audit + "R", i + 1, to[0], (*out, (to, text))))
        for to in ("user", "assistant"):
            if (last, to[0]) in step:
                heapq.heappush(heap, (cost + insert, audit + "I", i, to[0], (*out, (to, ""))))


def expected(rows, damaged=True, costs=()):
    groups = {r[0]: [] for r in rows}
    for r in damage(rows) if damaged else [(c, t, *(" " if x is None else x for x in (a, b))) for c, t, a, b in rows]:
        groups[r[0]].append(r)
    out = []
    for c, conv in groups.items():
        conv = sorted(((t is not None, t or 0, role, hashlib.md5(text.encode()).digest(), text) for _, t, role, text in conv), key=lambda r: r[:4])
        seen, judged, count = set(), [], defaultdict(int)
        for *_, role, _, text in conv:
            letters = WORD.findall(text)
            fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            judged.append((role, text, fault))
        count["illegal"] = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        turns = {t for known, t, *_ in conv if known}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, kept = cheapest(judged, *costs)
        sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest()
        out.append((c, gaps, count["blank"], count["duplicate"], count["truncated"], count["illegal"], cost, audit, sha))
    return sorted(out, key=str)


def test_solutions_of_segments():
    """All segments of up to 4 letters: chosen way from 0 to an end state, against the search."""
    faults = {0: "", 1: "blank", 2: "duplicate", 3: "truncated"}
    roles = {"s": "system", "u": "user", "a": "assistant", "?": "tool"}
    letters, memo = [chr(65 + k) for k in range(16)], {}
    rng = random.Random(4)
    some = [""] + letters + [a + b for a in letters for b in letters] + ["".join(rng.choices(letters, k=rng.randrange(3, 9))) for _ in range(1500)]
    for codes in some:
        best = min((c + 5 * len(repair.TAIL[end]), audit + repair.TAIL[end]) for end, (c, audit) in repair.solve(codes, memo)[0].items())
        assert best == cheapest([(roles[repair.role_of(c)], "x", faults[repair.fault_of(c)]) for c in codes])[:2]
    assert all(repair.letter(roles[repair.role_of(c)], repair.fault_of(c)) == c for c in letters)


def made_up(rng, conversations=150):
    texts = ["Yes.", "No!", "What?", "cut off", "", " \n", None, "a. b", "Äö!", "x" * 50 + "."]
    rows = []
    for c in range(conversations):
        turn = rng.randrange(5)
        for _ in range(rng.randrange(1, 9)):
            rows.append((None if c == 7 else c, None if rng.random() < 0.05 else turn, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.random()}."))
            turn += rng.choice([1, 1, 1, 0, 3])
    return rows


def write(spark, rows, path, partitions=3):
    spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(partitions).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(queries.op12_conversation_repair(spark, sf)) == expected(rows)


def test_edge_rows(spark, tmp_path):
    rows = made_up(random.Random(11))
    rows += rows[:20]
    got = collected(queries.op12_conversation_repair(spark, write(spark, rows, tmp_path)))
    assert got == expected(rows)
    assert {x for r in got for x in r[7]} == set("DKR")  # at these costs, rows are never inserted


@pytest.mark.parametrize(("segment", "costs"), [(1, (1, 2, 5, 5)), (3, (1, 9, 2, 5)), (5, (3, 30, 2, 0)), (200, (1, 2, 5, 5))])
def test_one_conversation_holds_most_rows(spark, segment, costs):
    """It is cut into segments, in several tasks, and comes out as if it were not."""
    rng = random.Random(segment)
    rows = made_up(rng, 10) + [(99, k // 2 if k < 500 else 7, rng.choice(["user", "assistant", "system"]), rng.choice(["same.", f"new {k}.", f"cut {k}"])) for k in range(900)]
    rows += [(98, k, "user", f"only user {k}.") for k in range(60)] + [(97, k, "system", "s.") for k in range(5)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
        audits, repaired = repair.repair(frame, costs=repair.Costs(*costs), segment=segment)
        hashes = repair.digests(repaired).withColumnRenamed("conv_id", "c")
        got = collected(audits.join(hashes, F.col("c").eqNullSafe(F.col("conv_id")), "left").drop("c").fillna(hashlib.sha256().hexdigest(), "repaired_sha256"))
        assert got == expected(rows, False, costs)
        if costs[2] < costs[1]:
            assert {x for r in got for x in r[7]} == set("DIKR")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Hello?"), (2, 0, "user", "A."), (2, 1, "user", "A.")]
    audits, repaired = repair.repair(spark.createDataFrame(rows, "c long, t long, r string, x string"), "c", "t", "r", "x")
    assert [(r.conv_id, r.cost, r.audit) for r in audits.orderBy("conv_id").collect()] == [(1, 2, "RR"), (2, 4, "DD")]
    got = [(r.conv_id, r.position, r.role, r.text) for r in repaired.orderBy("conv_id", "position").collect()]
    assert got == [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello?")]


def test_empty(spark, tmp_path):
    assert queries.op12_conversation_repair(spark, write(spark, [], tmp_path, 1)).collect() == []
