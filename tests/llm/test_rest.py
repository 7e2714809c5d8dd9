import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from lociq.llm import chat, licenses, quality, sharding
from tests.llm.fixtures import empty, frame, rows, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_figures(text):
    text = text or ""
    w = WORD.findall(text)
    five = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    seen = Counter(five)
    covered = {k + j for k, f in enumerate(five) if seen[f] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_figures():
    rng = random.Random(1)
    extra = [" ".join(rng.choice("abc") for _ in range(n)) for n in (5, 6, 9, 20, 60)] + ["a\nb\na\n\n \na", "x # | <y> & *** $5 %", "a b c d e f a b c d e"]
    for t in [*texts(), *extra]:
        assert quality.figures(t)[:5] == brute_figures(t), (t or "")[:60]


def test_expectation_maximisation_separates_classes():
    """Votes drawn from a known model: the posterior finds the class."""
    rng = np.random.default_rng(0)
    good = rng.random(6000) < 0.8
    p = {True: [0.85, 0.1, 0.05], False: [0.1, 0.2, 0.7]}
    votes = [tuple(rng.choice([1, 0, -1], size=5, p=p[bool(g)]).tolist()) for g in good]
    post = quality.fit(sorted(Counter(votes).items()))
    kept = np.array([post[v] >= 0.5 for v in votes])
    assert (kept == good).mean() > 0.97
    assert quality.fit([]) == {}


def plain_posterior(votes, weight=0.1, rounds=3000):
    """The same model with a loop over texts: a class share, a table of vote rates for each rule and class."""
    prior = {1: {-1: 0.02, 0: 0.18, 1: 0.8}, 0: {-1: 0.3, 0: 0.3, 1: 0.4}}
    good = [1 / (1 + math.exp(-(2 + 0.2 * v.count(1) - 2.5 * v.count(-1)))) for v in votes]
    m = weight * len(votes)
    for _ in range(rounds):
        share = (sum(good) + 0.8 * m) / (len(votes) + m)
        rate = {}
        for c in (0, 1):
            held = [g if c else 1 - g for g in good]
            rate[c] = [{x: (sum(h for h, v in zip(held, votes, strict=True) if v[r] == x) + m * prior[c][x]) / (sum(held) + m) for x in (-1, 0, 1)} for r in range(len(votes[0]))]
        new = []
        for v in votes:
            a, b = share, 1 - share
            for r, x in enumerate(v):
                a, b = a * rate[1][r][x], b * rate[0][r][x]
            new.append(a / (a + b))
        done = max(abs(x - y) for x, y in zip(new, good, strict=True)) < 1e-10
        good = new
        if done:
            break
    return good


def test_posterior_against_a_plain_version(spark):
    """The operator's p_good on a table, against votes and a model written out here."""
    docs = frame(spark)
    got = quality.quality_rules(docs).select("text", "p_good").collect()
    votes = []
    for r in got:
        t = r["text"] or ""
        w = WORD.findall(t)
        n, chars, symbols, dup, repeated = brute_figures(t)
        lines = sum(bool(WORD.search(x)) for x in t.split("\n"))
        letters, upper, marks = sum(c.isalpha() for c in t), sum(c.isupper() for c in t), t.count("!") + t.count("?")
        whole = sum(x.strip(quality.AROUND).isalpha() for x in w)
        vote = lambda no, yes: -1 if no else 1 if yes else 0
        votes.append((vote(n < 12 or n > 200_000, 20 <= n <= 100_000), vote(chars < 2 * n or chars > 14 * n, 3 * n <= chars <= 11 * n), vote(10 * symbols > n, 50 * symbols <= n), vote(10 * dup > 3 * lines, 20 * dup <= lines), vote(5 * repeated > n, 20 * repeated <= n), vote(2 * upper > letters, 5 * upper <= letters), vote(4 * marks > n, 20 * marks <= n), vote(10 * letters < 8 * chars, 10 * letters >= 9 * chars), vote(10 * whole < 7 * n, 20 * whole >= 17 * n)))
    assert len(votes[0]) == len(quality.RULES)
    for r, p in zip(got, plain_posterior(votes), strict=True):
        assert abs(r["p_good"] - p) < 1e-6, (r["text"] or "")[:80]


def test_quality_rules(spark):
    docs = frame(spark)
    out = quality.quality_rules(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and "kept_1" in out.columns and "kept" in docs.columns
    got = out.toPandas()
    assert len(got) == len(rows())
    for r in got.itertuples():
        f = brute_figures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == f
        assert r.base_failed == (f[0] < 10 or 100 * f[4] > 20 * f[0])
        assert r.kept_1 == (not r.base_failed and r.p_good >= 0.5)
    assert quality.quality_rules(empty(spark)).count() == 0


def test_quality_on_labels(spark):
    """Held-out accuracy: the labels are not used by the rules or the fit."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    x = quality.quality_rules(docs.select("doc_id", "text")).join(labels, "doc_id").toPandas()
    assert x[x.quality == 1].kept.mean() > 0.95
    assert x[x.quality == 0].kept.mean() < 0.1


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_sharding(spark, shards):
    out = sharding.shard(frame(spark, 400), shards).toPandas()
    assert len(out) == len(rows(400))
    by_id = {k: t for k, t in enumerate(texts(400))}
    for r in out[out.doc_id.notna()].itertuples():
        raw = (by_id[int(r.doc_id)] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    sizes = out.groupby("shard")["size"].sum()
    assert set(out.shard) <= set(range(shards)) and set(out.law) == {"bytes"} and out.grown_shard.isna().all()
    assert sizes.max() - out["size"].sum() / shards <= 2 * out["size"].max()
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    again = sharding.shard(frame(spark, 400, 7), shards).toPandas()
    assert out[out.doc_id.notna()].groupby("doc_id").shard.apply(sorted).tolist() == again[again.doc_id.notna()].groupby("doc_id").shard.apply(sorted).tolist()
    assert sharding.shard(empty(spark), shards).count() == 0


@pytest.mark.parametrize("shards", [3, 16])
def test_sharding_tree_against_brute_force(spark, monkeypatch, shards):
    """The distributed medians give the tree that sorting each node's points gives."""
    monkeypatch.setattr(sharding, "EXACT", 0.0)
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(rng.randrange(0, 40))), rng.choice(["en", "de", "fr"]), f"s{rng.randrange(9)}") for k in range(300)]
    docs += [(k, docs[k % 7][1], "en", "s0") for k in range(300, 340)] + [(9, "hot text", "en", "s1")] * 200
    frame_ = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(5)
    seen = {}
    points_of = sharding._points

    def keep(*args):
        seen["points"], hot = points_of(*args)
        return seen["points"], hot

    monkeypatch.setattr(sharding, "_points", keep)
    out = sharding.shard.__wrapped__(frame_, shards).toPandas()
    points = [r.asDict() for r in seen["points"].collect()]

    def split(node, k):
        if k == 1 or not node:
            return [node] + [[]] * (k - 1)
        widths = [max(p[f"dim_{d}"] for p in node) - min(p[f"dim_{d}"] for p in node) for d in range(3)]
        d = widths.index(max(widths))
        node = sorted(node, key=lambda p: (p[f"dim_{d}"], p["tie_0"], p["tie_1"]))
        total = sum(p["bytes"] for p in node)
        wanted, upto, at = total * (k // 2) / k, 0, 0
        while upto + node[at]["bytes"] < wanted:
            upto += node[at]["bytes"]
            at += 1
        at += upto + node[at]["bytes"] - wanted < wanted - upto
        return split(node[:at], k // 2) + split(node[at:], k - k // 2)

    want = [sum(p["bytes"] for p in leaf) for leaf in split(points, shards)]
    got = out.groupby("shard")["size"].sum().reindex(range(shards), fill_value=0).tolist()
    assert got == want
    groups = out.groupby("text_crc32").agg(b=("size", "sum"), shards=("shard", "nunique"))
    assert (groups[groups.b <= sharding.WHOLE * out["size"].sum() / shards].shards == 1).all() and (shards == 3 or (groups.shards > 1).any())


@pytest.mark.parametrize("hot", [4, 4096])
def test_sharding_of_repeated_rows(spark, monkeypatch, hot):
    """Rows equal in all columns are spread, null texts too; a group that fits stays whole."""
    monkeypatch.setattr(sharding, "HOT", hot)
    rows_ = [(7, "the same row again", "en", "s")] * 600 + [(None, None, None, None)] * 500 + [(k, f"row {k}", "en", "s") for k in range(400)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string").repartition(6)
    out = sharding.shard(docs, 16).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(out) == 1500 and len(sizes) == 16 and sizes.max() / sizes.mean() < 1.05 and sizes.min() / sizes.mean() > 0.95
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_sharding_of_one_hot_text(spark):
    docs = spark.createDataFrame([(k, "same words " * 5 if k % 3 else f"text {k}", "en", "s") for k in range(900)], "doc_id long, text string, lang string, source string")
    sizes = sharding.shard(docs, 8).groupBy("shard").sum("size").toPandas()["sum(size)"]
    assert sizes.max() - sizes.min() <= 120


def test_native_operators_use_no_python(spark, monkeypatch):
    """Neither the result's plan nor that of any table written on the way has a Python operator."""
    docs = frame(spark).drop("kept")
    plans = []
    for module in (sharding, licenses):
        write = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, *a, write=write: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *a))
    for df in (sharding.shard(docs, 4), licenses.scan(docs, "source", "text")):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 12 and not any(re.search("Python|Pandas|Arrow", p) for p in plans)


CONVS = pd.DataFrame(
    [(c, t, ("system" if t == 0 and c % 3 == 0 else ("user" if (t - (c % 3 == 0)) % 2 == 0 else "assistant")), None) for c in range(60) for t in range(7)],
    columns=["conv_id", "turn", "role", "text"],
)
CONVS["text"] = [{"system": "You are terse.", "user": "Why?", "assistant": "Because " * 80 + "\n" + "so " * 40}[r] for r in CONVS.role]


def test_chat_recovers_roles(spark):
    """Labels train the parser and are not looked at; a table in which few rows have one is parsed as well."""
    d = CONVS.copy()
    d.loc[d.index % 11 != 0, "role"] = None
    out = chat.format_chat(spark.createDataFrame(d)).toPandas().merge(CONVS, on=["conv_id", "turn"], suffixes=("", "_true"))
    assert len(out) == len(CONVS) and (out.part == 0).all()
    assert (out.role == out.role_true).mean() > 0.95
    assert out.given_role.notna().sum() == (CONVS.index % 11 == 0).sum()
    assert out.rendered[0] == f"<|{out.role[0]}|>\n{out.text[0]}<|end|>\n"
    wrong = CONVS.assign(role="user")  # labels that are wrong change what is learnt, trusted ones are followed
    assert (chat.format_chat(spark.createDataFrame(wrong), trust=0.999999).toPandas().role == "user").mean() > 0.9


TRANSCRIPTS = [
    ("User: hello\nAssistant: hi there\nUser: bye", [("user", "hello"), ("assistant", "hi there"), ("user", "bye")]),
    ("### Human:\nhow?\n\n### Assistant:\nlike so\n- one\n- two\n\n### Human: thanks", [("user", "how?"), ("assistant", "like so\n- one\n- two"), ("user", "thanks")]),
    ("<|system|>\nBe terse.\n<|user|>\nWhy?\n<|assistant|>\nBecause.\nSo.", [("system", "Be terse."), ("user", "Why?"), ("assistant", "Because.\nSo.")]),
    ("**Q:** 1 + 1?\n**A:** 2", [("user", "1 + 1?"), ("assistant", "2")]),
    ("[Customer]: it broke\nreally\n[Agent]: ok", [("user", "it broke\nreally"), ("assistant", "ok")]),
    ("no marker at all\nand a second line", [(None, "no marker at all\nand a second line")]),
]


@pytest.mark.parametrize("labelled", [False, True])
def test_chat_parses_transcripts(spark, labelled):
    """Several turns in one text, alone and in a table of labelled rows without markers."""
    rows_ = [(1000 + k, 0, None, t) for k, (t, _) in enumerate(TRANSCRIPTS)] + (CONVS.values.tolist() if labelled else [])
    out = chat.format_chat(spark.createDataFrame(rows_, "conv_id long, turn int, role string, text string").repartition(4)).toPandas()
    for k, (_, want) in enumerate(TRANSCRIPTS):
        got = out[out.conv_id == 1000 + k].sort_values("part")
        assert [(None if want[0][0] is None else r.role, r.rendered) for r in got.itertuples()] == [(w, f"<|{w or r}|>\n{t}<|end|>\n") for (w, t), r in zip(want, got.role, strict=True)]
    if labelled:
        assert (out[out.conv_id < 1000].part == 0).all()


def test_chat_edges(spark):
    rows_ = [(1, 0, None, "User: hello"), (1, 1, None, "### Assistant:\nfine"), (1, 1, None, "### Assistant:\nfine"), (None, None, None, None), (2, None, "user", ""), (1, 2, "HUMAN", "x" * 5000), (3, 0, "assistant", "line\n" * 40_000)]
    out = chat.format_chat(spark.createDataFrame([(*r, 1) for r in rows_], "conv_id long, turn int, role string, text string, rendered int")).toPandas()
    assert len(out) == 7
    first = out[(out.conv_id == 1) & (out.turn == 0)].iloc[0]
    assert (first.role, first.rendered) == ("user", "<|user|>\nhello<|end|>\n")
    assert set(out[(out.conv_id == 1) & (out.turn == 1)].role) == {"assistant"}
    assert out[out.turn == 2].given_role.tolist() == ["user"] and len(out[out.conv_id == 3].rendered.iloc[0]) > 200_000
    clash = chat.format_chat(spark.createDataFrame([(1, 0, "user", "hi")], "part long, role int, given string, text string"), "part", "role", "given")
    assert clash.columns == ["part", "role", "part_1", "role_1", "given_role", "rendered"] and clash.count() == 1
    none = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.format_chat(none).count() == 0


def test_chat_is_alike_for_any_partitions_and_segments(spark, monkeypatch):
    """The fit and the roles: many tasks and short segments, pieces and levels change nothing.  One conversation holds half of all rows."""
    d = pd.concat([CONVS, pd.DataFrame([(c, t, r, x) for _, c, t, r, x in CONVS.itertuples()], columns=CONVS.columns).assign(conv_id=99, turn=range(len(CONVS)))])
    d["text"] = [x if k % 5 else "short\nlines?\n- one" for k, x in enumerate(d.text)]
    d.loc[np.arange(len(d)) % 4 != 0, "role"] = None
    seen, ways = [], []
    model = chat.Model

    def kept(*args):
        seen.append(args)
        return model(*args)

    monkeypatch.setattr(chat, "Model", kept)
    for parts, shuffled, segment, piece, fan in ((1, 1, 16_384, 64, 1024), (5, 7, 3, 2, 2), (3, 13, 40, 5, 3)):
        for name, value in (("SEGMENT", segment), ("PIECE", piece), ("FAN", fan)):
            monkeypatch.setattr(chat, name, value)
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        out = chat.format_chat(spark.createDataFrame(d, "conv_id long, turn long, role string, text string").repartition(parts)).toPandas()
        ways.append(out.sort_values(["conv_id", "turn", "part"])[["conv_id", "turn", "part", "role", "rendered"]].values.tolist())
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ways[0] == ways[1] == ways[2]
    for a, b in itertools.pairwise(seen):
        assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))
    assert seen[0][0].sum() == d[d.turn == 0].role.notna().sum()  # starts are those of conversations alone


def test_viterbi_against_all_paths(monkeypatch):
    """Kernel: pieces of two lines give the best of all paths of states, through starts of rows and conversations."""
    monkeypatch.setattr(chat, "PIECE", 2)
    rng = np.random.default_rng(3)
    for _ in range(6):
        m = chat.Model(rng.random(3) * 9, rng.random((3, 3)) * 9, rng.random((chat.STATES, chat.CODES)))
        codes, kinds = rng.integers(0, chat.CODES, 6), np.array([2, 0, rng.integers(0, 3), 0, 1, 0])
        score = m.scores(kinds, codes, rng.integers(0, 2**63, 6).astype(np.uint64))
        value = lambda p: sum(int(m.steps[k, b, s]) for k, b, s in zip(kinds, (0, *p), p, strict=False)) + sum(int(score[t, s]) for t, s in enumerate(p))  # noqa: E731, B023
        best = max(itertools.product(range(chat.STATES), repeat=6), key=value)
        assert tuple(chat.path(kinds, score, m.steps, 0, -1)) == best
        # cut anywhere: the chained products name the states of the best path
        for cut in range(1, 6):
            parts = [chat._total(chat.products(kinds[a:b], score[a:b], m.steps)) for a, b in ((0, cut), (cut, 6))]
            (_, e1), (b2, e2) = chat.chained(np.stack(parts), 0, -1)
            assert (e1, b2, e2) == (best[cut - 1], best[cut - 1], best[5])
            assert tuple(chat.path(kinds[:cut], score[:cut], m.steps, 0, e1)) + tuple(chat.path(kinds[cut:], score[cut:], m.steps, b2, e2)) == best


def test_licenses(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/x.c", "int main() { return 0; } " * 9),
        (3, "a/b/c/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (4, "a/b/c/d/y.c", "no notice here at all"),
        (5, "a/b/z.c", "some code first\n// This work is licensed under the GNU General Public License, version 3.\nmore code " + "word " * 40),
        (6, "other/q.c", "the driver's license is not meant, mit freundlichen"),
        (7, None, "Released under the MIT License."),
        (8, "a/b/e.c", None),
        (8, "a/b/e.c", None),
        (9, "top.txt", ""),
    ]
    docs = spark.createDataFrame([(*f, "clash") for f in files], "doc_id long, path string, text string, license string")
    out = {(r["doc_id"], r["path"]): r for r in licenses.scan(docs).collect()}
    assert licenses.scan(docs).count() == len(files)
    got = {k: (r["own_license"], r["license"], r["inherited_from"]) for k, r in out.items()}
    assert got[(1, "a/LICENSE")] == ("MIT", "MIT", None)
    assert got[(2, "a/b/x.c")] == (None, "MIT", "a")
    assert got[(3, "a/b/c/LICENSE")][0] == "Apache-2.0"
    assert got[(4, "a/b/c/d/y.c")] == (None, "Apache-2.0", "a/b/c")
    assert got[(5, "a/b/z.c")][:2] == ("GPL-3.0", "GPL-3.0")
    assert got[(6, "other/q.c")] == (None, None, None)
    assert got[(7, None)][0] == "MIT" and got[(8, "a/b/e.c")] == (None, "MIT", "a") and got[(9, "top.txt")] == (None, None, None)
    assert licenses.scan(docs.limit(0)).count() == 0


def cut_terms(text):
    return Counter(w for w in (v.strip(".") for v in re.split(r"[^a-z0-9.]+", (text or "").lower())) if w and w not in licenses.STOP)


def brute_header(texts_, text):
    """Best (score, name) of a text's lines and blocks, with weights over all texts."""
    notices = licenses.notice_terms()
    vocab = {w for _, t, _ in notices for w in t}
    df = Counter(w for x in texts_ for w in set(cut_terms(x)))
    idf = {w: math.log((1 + len(texts_)) / (1 + df[w])) + 1 for w in vocab}
    lines = [cut_terms(x) for x in (text or "").split("\n")]
    dense = [bool(c) and 2 * sum(n for w, n in c.items() if w in vocab) >= sum(c.values()) for c in lines]
    units, at = list(lines), 0
    while at < len(lines):
        end = at
        while end < len(lines) and dense[end]:
            end += 1
        if end - at > 1:
            units.append(sum(lines[at:end], Counter()))
        at = end + 1
    best = (0.0, None)
    for c in units:
        norm = math.sqrt(sum((n * idf[w]) ** 2 if w in idf else n for w, n in c.items()))
        for name, t, need in notices:
            if norm and need <= set(c):
                value = sum(c[w] * n * idf[w] ** 2 for w, n in t.items()) / math.sqrt(sum((n * idf[w]) ** 2 for w, n in t.items())) / norm
                best = max(best, (round(value, 6), name), key=lambda b: (b[0], b[1] or ""))
    return best if best[0] >= licenses.THRESHOLD else (None, None)


LGPL21 = """/* Foo library
 * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 */
int f(void) { return 1; }"""
HEADERS = [
    (LGPL21, "LGPL-2.1"),
    (LGPL21.replace("Lesser ", "").replace("library", "program").replace("2.1", "2"), "GPL-2.0"),
    (LGPL21.replace("Lesser ", "").replace("library", "program").replace("2.1", "3"), "GPL-3.0"),
    (LGPL21.replace("Lesser", "Affero").replace("library", "program").replace("2.1", "3"), "AGPL-3.0"),
    (LGPL21.replace("2.1", "3"), "LGPL-3.0"),
    ("// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License.\nx", "Apache-2.0"),
    ("# SPDX-License-Identifier: MIT\nprint(1)", "MIT"),
    ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
    ("/* SPDX-License-Identifier: BSD-2-Clause */", "BSD-2-Clause"),
    ("// SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
    ("# SPDX-License-Identifier: LGPL-3.0-only", "LGPL-3.0"),
    ("// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt)", "BSL-1.0"),
    ("// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.", "BSD-3-Clause"),
    ("// MIT", "MIT"),
    ("Released under the ISC License.", "ISC"),
    ("Released under the Foobar License.", None),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("// This Source Code Form is subject to the terms of the Mozilla\n// Public License, v. 2.0. If a copy of the MPL was not distributed\n// with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("We met the general public at the free software day and told them of the terms.", None),
]


def test_license_headers(spark):
    """Wrapped headers, tags and short notices name their licence; near relatives are told apart; scores as by brute force."""
    lines = ["Licensed under the Apache License 2.0 today", "mit license license", "GNU public thing", "work licensed under CC BY 4.0 international", "nothing"]
    texts_ = [t for t, _ in HEADERS] + lines
    docs = spark.createDataFrame([(k, f"d{k}/f", x) for k, x in enumerate(texts_)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for k, (t, want) in enumerate(HEADERS):
        assert got[k]["own_license"] == want, (t, got[k])
    for k, t in enumerate(texts_):
        assert (got[k]["score"], got[k]["own_license"]) == brute_header(texts_, t), t


def test_license_inheritance_against_brute_force(spark, monkeypatch):
    """Random trees; a hot directory of many files, and both ways of joining."""
    rng = random.Random(6)
    files = []
    for k in range(400):
        path = "/".join(["hot"] if k % 3 == 0 else [rng.choice("abc") for _ in range(rng.randrange(0, 5))])
        text = rng.choice(["Released under the MIT License.", "Licensed under the Apache License, Version 2.0"]) if k % 23 == 0 else "code"
        files.append((k, f"{path}/f{k}" if path else f"f{k}", text))
    docs = spark.createDataFrame(files, "doc_id long, path string, text string").repartition(5)
    for hot in (3, 4096):
        monkeypatch.setattr(licenses, "HOT", hot)
        got = licenses.scan(docs).collect()
        by_dir = {}
        for r in got:
            if r["is_license_file"]:
                by_dir.setdefault(r["path"].rpartition("/")[0], Counter())[r["own_license"]] += 1
        for r in got:
            at = r["path"].rpartition("/")[0]
            want = (r["own_license"], None)
            while r["own_license"] is None:
                if at in by_dir:
                    want = (min(by_dir[at].items(), key=lambda x: (-x[1], x[0]))[0], at)
                    break
                if not at:
                    break
                at = at.rpartition("/")[0]
            assert (r["license"], r["inherited_from"]) == want, r
        assert len(got) == 400 and len(by_dir) > 5


def test_license_lines_without_a_naming_word(spark):
    """Every line with a template term is scored, whatever the term and however few there are."""
    lines = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that", "MIT", "the mit,"]
    lines += ["released under a license " + " ".join(f"w{k}x{j}" for j in range(40)) for k in range(30)]  # common terms weigh little
    docs = spark.createDataFrame([(k, f"d{k}/x", x) for k, x in enumerate(lines)], "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["own_license"], r["score"]) for r in licenses.scan(docs).collect()}
    assert got[0][0] == "BSD-3-Clause" and got[0][1] >= licenses.THRESHOLD
    assert got[1] == got[2] and got[1][0] == "MIT" and got[1][1] >= licenses.THRESHOLD
    assert all(got[k] == (None, None) for k in range(3, 33))


def test_each_license_text_finds_itself(spark):
    full = {f.stem: f.read_text() for f in licenses.TEXTS.glob("*.txt")}
    docs = spark.createDataFrame([(k, f"{k}/LICENSE", t) for k, t in full.items()], "doc_id string, path string, text string")
    got = {r["doc_id"]: (r["own_license"], r["score"], r["is_license_file"]) for r in licenses.scan(docs).collect()}
    assert got == {k: (k, 1.0, True) for k in full} and {"LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "ISC", "BSL-1.0"} <= got.keys()


def test_license_files_as_a_whole(spark):
    """Full licence texts are licence files whatever their name; names count where a line states the licence."""
    full = {f.stem: f.read_text() for f in licenses.TEXTS.glob("*.txt")}
    notice = "Some project, see the site.\nReleased under the MIT License\n" + " ".join(f"other{k}" for k in range(40))
    files = [("p/COPYING", full["GPL-3.0"]), ("p/src/a.c", "int x;"), ("q/legal.txt", "Copyright 2020 Some One\n" + full["BSD-3-Clause"].split("\n", 1)[1]), ("q/b.c", "int y;")]
    files += [("r/LICENSE", full["MIT"].replace("THE SOFTWARE IS PROVIDED", "SOFTWARE WITHOUT")), ("r/z/c.c", None), ("s/LICENSE.md", notice), ("s/d.c", "int z;"), ("t/license_check.py", notice), ("t/e.c", "int w;")]
    files += [(f"u/{k}", t) for k, t in full.items()] + [("v/x", " ".join(full["GPL-3.0"].split()[:60])), ("v/y", "source work license " * 3 + " ".join(f"q{k}" for k in range(90)))]
    docs = spark.createDataFrame([(k, *f) for k, f in enumerate(files)], "doc_id long, path string, text string")
    got = {r["path"]: r for r in licenses.scan(docs).collect()}
    take = lambda p: (got[p]["own_license"], got[p]["is_license_file"], got[p]["license"], got[p]["inherited_from"])
    assert take("p/COPYING") == ("GPL-3.0", True, "GPL-3.0", None) and take("p/src/a.c") == (None, False, "GPL-3.0", "p")
    assert take("q/legal.txt") == ("BSD-3-Clause", True, "BSD-3-Clause", None) and take("q/b.c") == (None, False, "BSD-3-Clause", "q")
    assert take("r/LICENSE")[:2] == ("MIT", True) and take("r/z/c.c") == (None, False, "MIT", "r")
    assert take("s/LICENSE.md")[:2] == ("MIT", True) and take("s/d.c")[2:] == ("MIT", "s")
    assert take("t/license_check.py")[:2] == ("MIT", False) and take("t/e.c")[2:] == (None, None)
    # brute force: the cosine of every text with every licence
    terms = licenses.full_terms()
    vocab = {w for t in terms.values() for w in t}
    df = Counter(w for _, t in files for w in set(cut_terms(t)) & vocab)
    idf = {w: math.log((1 + len(files)) / (1 + df[w])) + 1 for w in vocab}
    for path, text in files:
        c = cut_terms(text)
        norm = math.sqrt(sum((n * idf[w]) ** 2 if w in idf else n for w, n in c.items())) or 1
        score, name = max((sum(c[w] * n * idf[w] ** 2 for w, n in t.items()) / math.sqrt(sum((n * idf[w]) ** 2 for w, n in t.items())) / norm, k) for k, t in terms.items())
        if score >= licenses.WHOLE:
            assert got[path]["own_license"] == name and abs(got[path]["score"] - score) < 2e-6, path
            assert set(c) & licenses.marks(list(terms.values()), idf, licenses.WHOLE)
