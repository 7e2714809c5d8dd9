import hashlib
from collections import defaultdict

import numpy as np

from lociq.llm import exact_dedup, minhash
from tests.llm.fixtures import empty, frame, rows


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n, high in ((0, 1), (1, 1), (1, 1 << 40), (500, 600), (3000, 1 << 35)):
        v = np.unique(rng.integers(0, high, n)).astype(np.uint64)
        assert exact_dedup.golomb_decode(exact_dedup.golomb_encode(v)).tolist() == v.tolist()
    v = np.sort(rng.choice(1 << 22, 8192, replace=False)).astype(np.uint64)
    assert len(exact_dedup.golomb_encode(v)) < 1.5 * len(v)  # 9 bits of gap, 11 with the code's own


def test_exact_dedup(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SPREAD", 2)  # many false suspects
    out = exact_dedup.exact_dedup(frame(spark)).collect()
    groups = defaultdict(list)
    for r in rows():
        groups[(r[1] or "").encode().lower()].append(r[0])
    assert len(out) == len(rows())
    assert out[0].asDict().keys() >= {"kept", "kept_1", "keep_id", "group_size", "text_sha256"}
    kept = defaultdict(int)
    for r in out:
        norm = (r["text"] or "").encode().lower()
        ids = [i for i in groups[norm] if i is not None]
        assert r["group_size"] == len(groups[norm])
        assert r["keep_id"] == (max(ids) if ids else None)
        assert r["text_sha256"] == hashlib.sha256(norm).hexdigest()
        kept[norm] += r["kept_1"]
        assert not r["kept_1"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def brute_components(table):
    sets = []
    for r in table:
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    comp = list(range(len(table)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(table)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    return sets, [root(k) for k in range(len(table))]


def check_near(out, table):
    sets, comp = brute_components(table)
    least = {}
    for k, c in enumerate(comp):
        if table[k][0] is not None:
            least[c] = min(least.get(c, table[k][0]), table[k][0])
    want = sorted(((r[0] is None, r[0] or 0, len(sets[k]), least.get(comp[k], -1)) for k, r in enumerate(table)))
    names = out[0].__fields__[-3:]
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r[names[0]], -1 if r[names[1]] is None else r[names[1]]) for r in out))
    assert got == want
    assert sum(r[names[2]] for r in out) == sum(1 if sets[c] else comp.count(c) for c in set(comp))


def test_near_dedup(spark):
    out = minhash.near_dedup(frame(spark)).collect()
    check_near(out, rows())
    assert minhash.near_dedup(empty(spark)).count() == 0


def test_large_bucket_is_split(spark, monkeypatch):
    """A chain of near copies in blocks of a few rows: no link between blocks is lost."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    base = [f"w{k}" for k in range(120)]
    table = []
    for k in range(40):
        w = list(base)
        for j in range(k):
            w[(3 * j) % 120] = f"c{j}"
        table.append((k, " ".join(w)))
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    check_near(minhash.near_dedup(docs).collect(), table)


def test_hot_group_in_many_tasks(spark, monkeypatch):
    """A third of the rows are one text, a third near copies of another, many are empty; both ways of joining act."""
    base = [f"w{k}" for k in range(60)]
    table = [(k, "one and the same text in very many rows of the table") for k in range(150)]
    table += [(200 + k, " ".join([*base[:50], f"n{k}", *base[51:]])) for k in range(150)]
    table += [(400 + k, None if k % 2 else "") for k in range(60)] + [(500 + k, f"only row number {k} says this and nothing else does {k}") for k in range(60)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(7)
    for hot in (4, 4096):
        for module in (minhash, exact_dedup):
            monkeypatch.setattr(module, "HOT", hot)
        monkeypatch.setattr(minhash, "BLOCK", 16)
        check_near(minhash.near_dedup(docs).collect(), table)
        groups = defaultdict(list)
        for k, t in table:
            groups[(t or "").lower()].append(k)
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs).collect()}
        assert got == {k: (max(groups[(t or "").lower()]), len(groups[(t or "").lower()]), k == max(groups[(t or "").lower()])) for k, t in table}


def test_pairs_near_the_threshold_are_found(spark):
    """Recall of pairs of similarity 0.75 to 0.8, against the exact sets: all of them here (a miss has odds of 5e-6)."""
    rng = np.random.default_rng(8)
    table, linked = [], 0
    for k in range(150):
        w = [f"v{x}" for x in rng.integers(0, 10**9, 104)]  # 100 shingles
        v = list(w)
        for j in range(2 + k % 2):  # each change within costs 5 shingles; the last word costs one
            v[20 + 30 * j] = "changed"
        v[-1 - k % 3 :] = ["end"] * (1 + k % 3)
        table += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    sets, comp = brute_components(table)
    near = [k for k in range(150) if 75 <= 100 * len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) < 80]
    assert len(near) > 40
    out = minhash.near_dedup(spark.createDataFrame(table, "doc_id long, text string").repartition(5)).collect()
    check_near(out, table)


def test_scratch_tables_are_removed(spark):
    """What a result does not read is gone once the operator returns."""
    import glob
    from lociq.session import scratch_root

    before = set(glob.glob(f"{scratch_root(spark)}/lociq/*")) | {t.name for t in spark.catalog.listTables()}
    out = minhash.near_dedup(frame(spark))
    made = (set(glob.glob(f"{scratch_root(spark)}/lociq/*")) | {t.name for t in spark.catalog.listTables()}) - before
    assert {m.rsplit("/", 1)[-1].split("-")[0] for m in made if "/" in m} == {"sets", "verdicts"}
    assert out.count() == len(rows())


def test_pruning_keeps_similar_pairs():
    least = minhash.least_matches()
    assert len(least) == minhash.SIGNATURE // minhash.BATCH
    assert least[-1] > 0.5 * minhash.SIGNATURE  # pairs far below the threshold go
    rng = np.random.default_rng(2)
    matches = rng.random((20_000, minhash.SIGNATURE)) < 0.75
    ends = np.cumsum(matches, axis=1)[:, minhash.BATCH - 1 :: minhash.BATCH]
    assert (ends >= np.array(least)).all()


def test_cross_links_find_what_the_forest_missed(spark, monkeypatch):
    """Without any first links, the pass between components must find them all."""
    monkeypatch.setattr(minhash, "_verified", lambda pairs, sets, name: pairs.select("a", "b").limit(0))
    out = minhash.near_dedup(frame(spark)).collect()
    check_near(out, rows())


def test_similar_is_exact():
    rng = np.random.default_rng(4)
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.85], rng.integers(0, 2**63, 6).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        assert minhash.similar(x, y) == (100 * both >= 75 * (len(x) + len(y) - both))


def test_buckets_take_one_shuffle(spark):
    """rows of bands were dealt twice, to be counted and to meet their counts; a row's buckets went to as many tasks."""
    small = [(u, 40, b, 1000 * b + u % 20) for u in range(60) for b in range(minhash.BANDS)]
    large = [(u, 40, 3, 99) for u in range(100, 1300)] + [(u, 1_500_000, 4, 98) for u in (2000, 2001, 2002)]
    banded = small + large + [(3000, 5, 0, 97), (3001, 0, 1, 96), (3002, 0, 1, 96)]
    out = minhash._in_buckets(spark.createDataFrame(banded, "rep long, items long, band int, hash long"))
    plans = out._jdf.queryExecution().executedPlan().toString()
    assert plans.count("Exchange") == 1 and "Join" not in plans
    got = out.collect()
    buckets = defaultdict(list)
    for u, n, b, h in banded:
        buckets[b, h].append((u, n))
    want = {(u, n, b, h, max(-(-len(x) // minhash.BLOCK), -(-sum(m for _, m in x) // minhash.BLOCK_ITEMS))) for (b, h), x in buckets.items() if len(x) > 1 for u, n in x}
    assert len(got) == len(want) and {tuple(r)[:5] for r in got} == want
    homes = defaultdict(list)
    for r in got:
        homes[r["home"]].append(r)
    for x in homes.values():
        if len({(r["band"], r["hash"]) for r in x}) > 1:
            assert len(x) <= minhash.BLOCK and sum(r["items"] for r in x) <= minhash.BLOCK_ITEMS
    for u in range(60):
        assert len({r["home"] for r in got if r["uid"] == u}) == 1  # all its buckets meet in one task


def test_sets_are_dealt_once(spark, monkeypatch):
    """each join by uid dealt all sets anew."""
    plans, write, buckets = defaultdict(str), minhash.materialize, {}

    def told(df, name, *more):
        buckets[name] = more
        plans[name] += df._jdf.queryExecution().executedPlan().toString()
        return write(df, name, *more)

    monkeypatch.setattr(minhash, "materialize", told)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "ITEMS_PER_TASK", 40)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = [f"w{k}" for k in range(300)]
        table = [(None if i == 3 else i % 20, " ".join(words[i % 4 : 200 + i % 4 + i // 4])) for i in range(24)] + [(99, None), (98, ""), (97, "few words")] * 2
        check_near(minhash.near_dedup(spark.createDataFrame(table, "doc_id long, text string")).collect(), table)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shingles = sum(map(len, brute_components(table)[0]))
    assert buckets["shingles"] == ((-(-shingles // 40), "uid"),)  # as many as the shingles need
    assert plans["signed"].count("Exchange") == 1  # the members alone; the sets lie by uid
    assert plans["survivors"].count("Exchange") <= 3 and plans["more_links"].count("Exchange") == 2
    assert all("items" not in line for name in ("signed", "more_links") for line in plans[name].splitlines() if "Exchange hashpartitioning(uid" in line)
