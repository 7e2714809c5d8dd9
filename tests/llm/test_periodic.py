"""Periodic runs against a comparison of every word with every later one."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lociq.llm import periodic_runs, queries
from tests.llm.fixtures import empty, frame, rows

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def brute(w, exponent=4, least=6):
    """For each period, stretches of equal words that far apart, if no smaller period explains them."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            s = w[i : j + q]
            if len(s) >= max(least, exponent * q) and not any(s[r:] == s[:-r] for r in range(1, q)):
                out.append((i, len(s), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(texts, *args):
    return [[tuple(map(int, r)) for r in runs] for runs in periodic_runs.find_runs([np.array(w, np.int64) for w in texts], *args)]


def repeating(rng):
    w = [rng.randrange(rng.choice([1, 2, 3, 10])) for _ in range(rng.randrange(70))]
    if w and rng.random() < 0.7:
        a = rng.randrange(len(w))
        p = 1 + (len(w) - a) // rng.randrange(3, 9)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    return w


@pytest.mark.parametrize("few", [periodic_runs.FEW, -1])
@pytest.mark.parametrize("limits", [(4, 6), (2, 2), (3, 5)])
def test_runs_of_many_texts(few, limits, monkeypatch):
    monkeypatch.setattr(periodic_runs, "FEW", few)
    rng = random.Random(7)
    for _ in range(120):
        texts = [repeating(rng) for _ in range(rng.randrange(1, 6))]
        assert found(texts, *limits) == [brute(w, *limits) for w in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", max_size=40), max_size=4))
def test_runs_of_two_words(texts):
    texts = [[ord(c) for c in t] for t in texts]
    assert found(texts) == [brute(w) for w in texts]


def test_long_texts():
    """Fibonacci words hold many runs; a text of one word holds one, in about as many steps as words."""
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    assert found([b], 2, 2) == [brute(b, 2, 2)]
    assert found([[5] * 100_000, [], [1, 2, 3]]) == [[(0, 100_000, 1)], [], []]


def expected(doc_id, text):
    w, h = WORDS(text or ""), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    drop = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{k},{q}\n" for s, k, q in runs), " ".join(x for k, x in enumerate(w) if k not in drop))]
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], *sha)


def test_query(spark, sf, tmp_path):
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, sf).collect()))
    want = sorted(expected(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert got == want and sum(r[1] for r in got) > 5
    rng = random.Random(2)  # edge rows: nulls, empties, repeats, and short texts of planted ids
    edge = [(r[0], r[1]) for r in rows(40)] + [(k, " ".join(rng.choice("abc") for _ in range(k % 50))) for k in range(200, 900)]
    spark.createDataFrame(edge, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: str(r)
    assert sorted(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=key) == sorted((expected(*r) for r in edge), key=key)


def test_operator_keeps_columns(spark):
    docs = frame(spark, 20).withColumnRenamed("kept", "Runs")
    out = periodic_runs.periodic_runs(docs)
    assert out.columns == [*docs.columns, "n_words", "runs_1", "collapsed"]
    assert out.count() == docs.count()
    assert {(r.n_words, r.collapsed) for r in out.filter("text is null").collect()} == {(0, "")}
    assert periodic_runs.periodic_runs(empty(spark)).collect() == []
