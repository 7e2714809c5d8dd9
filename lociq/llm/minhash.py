"""Near-duplicate detection: MinHash bands, sequential Bayesian verification, exact sets.

A text's set is its distinct shingles of five words (A-Z lowered); with fewer
words the whole sequence; without words it is empty and linked with nothing.

1. Sets.  Each row gets a key of its whole set and the hashes of ``BANDS`` bands
   of ``ROWS`` minimum hashes.  Rows of equal sets form a class, counted by a
   map-side combined aggregate; one row, its representative, goes on.
2. Candidates.  Representatives that share a band hash lie in a bucket.  A pair
   of similarity 0.75 shares none of the bands with probability of about 5e-6.
3. Verification.  Buckets are compared by signatures of ``SIGNATURE`` other
   minimum hashes (one byte each), ``BATCH`` at a time.  After each batch a pair
   goes on only if, with a uniform prior, the posterior probability that its
   similarity is at least the threshold exceeds ``MISS``.
4. Exact check.  What survives is compared on full sets and linked if
   100 * intersection >= 75 * union.

A large bucket is not turned into all its pairs.  It is dealt into blocks of
about ``BLOCK`` rows and ``BLOCK_ITEMS`` shingles; from each block only a spanning
forest of its likeliest pairs is checked exactly.  Buckets whose rows are then
all in one component are done.  In the others, block meets block twice.  First
signatures alone are copied to each pair of blocks, and the rows of any
surviving pair between different components are named.  Then the full sets of
those rows alone follow them, and each surviving pair is checked exactly where
it is compared; only links leave the task.  So no link between components is
lost, no list of pairs is made, and tasks are sized by what is copied to them.

The texts lie in bucket files by the task that read them (the sender) and do
not move: the rows whose sets are needed are sent to them, as lists by sender.
Those sets are dealt by uid once, into bucket files, so no later join moves them.
Verdicts of classes and components that hold a large part of all rows travel by
broadcast (``common.spread_join``).

Null ids: a component's id is its least id that is not null (null if none).
Exactly one row of a component is kept: that of the least id, then the first
read.  Extra columns pass through, a result column whose name is taken gets a
number, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociq.llm.common import HOT, fresh, materialize, spread_join, tidy

WORDS, PERCENT = 5, 75
BANDS, ROWS = 32, 4
SIGNATURE, BATCH, MISS = 256, 32, 1e-7
#: Rows of a block and shingles of its sets, about.
BLOCK, BLOCK_ITEMS = 1024, 2_000_000
#: Rows with signatures, and shingles of sets, that one task compares at once, about.
PER_TASK, ITEMS_PER_TASK = 20_000, 4_000_000
#: Spark's limit on the buckets of a table (``spark.sql.sources.bucketing.maxBuckets``).
MOST_BUCKETS = 100_000
REMEMBERED = 1_000_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) > REMEMBERED:
                self.clear()
            self[word] = h
        return h


_HASHES = _WordHashes()
_MUL, _MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(29)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.array([], dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(WORDS, len(words))
    last = len(words) - width + 1
    g = h[:last].copy()
    for k in range(1, width):
        g = (g * _MUL) ^ (g >> _SHIFT)
        g += h[k : last + k]
    g = (g + np.uint64(width)) * _MIX
    g ^= g >> np.uint64(32)
    return np.unique(g)


@lru_cache(maxsize=4)
def _factors(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minimum_hashes(values: np.ndarray, seed: int, n: int) -> np.ndarray:
    f = _factors(seed, n)
    out = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(values), 1024):
        np.minimum(out, (values[k : k + 1024, None] * f[None, :]).min(axis=0), out=out)
    return out


def band_hashes(values: np.ndarray) -> np.ndarray:
    low = minimum_hashes(values, 1, BANDS * ROWS).reshape(BANDS, ROWS)
    out = low[:, 0].copy()
    for k in range(1, ROWS):
        out = ((out * _MUL) ^ (out >> _SHIFT)) + low[:, k]
    return (out * _MIX).view(np.int64)


def signature(values: np.ndarray) -> bytes:
    return ((minimum_hashes(values, 2, SIGNATURE) >> np.uint64(20)) & np.uint64(255)).astype(np.uint8).tobytes()


@lru_cache(maxsize=1)
def least_matches() -> tuple[int, ...]:
    """After k batches: the fewest matches at which a pair goes on.

    Bytes match with probability s + (1 - s) / 256 at similarity s.  With a
    uniform prior on that, the posterior is a beta distribution, summed here on
    a grid.
    """
    t = PERCENT / 100
    t += (1 - t) / 256
    x = (np.arange(200_000) + 0.5) / 200_000
    out = []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(x) + (n - m) * np.log1p(-x)
            p = np.exp(log - log.max())
            if p[x >= t].sum() / p.sum() >= MISS:
                out.append(m)
                break
    return tuple(out)


def survivors(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of row numbers that no batch prunes, with their matches."""
    total = np.zeros(len(a), dtype=np.int32)
    for k, least in enumerate(least_matches()):
        at = slice(k * BATCH, (k + 1) * BATCH)
        total += (sig[a, at] == sig[b, at]).sum(axis=1, dtype=np.int32)
        go = total >= least
        a, b, total = a[go], b[go], total[go]
        if not len(a):
            break
    return a, b, total


def _pairs(n: int):
    """All pairs of n rows, in pieces of bounded size."""
    step = max(1, 200_000 // max(1, n))
    for k in range(0, n - 1, step):
        rows = np.arange(k, min(k + step, n - 1))
        count = n - 1 - rows
        a = np.repeat(rows, count)
        yield a, np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + a + 1


def _forest(n: int, a: np.ndarray, b: np.ndarray, matches: np.ndarray) -> list[int]:
    """Positions of the pairs of a spanning forest, likeliest first."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k in np.argsort(-matches, kind="stable").tolist():
        x, y = root(int(a[k])), root(int(b[k]))
        if x != y:
            parent[x] = y
            out.append(k)
    return out


def _buckets(pdf: pd.DataFrame, columns: list[str]):
    key = pdf[columns].to_numpy()
    order = np.lexsort(key.T[::-1])
    key = key[order]
    edges = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
    for lo, hi in zip(edges, np.append(edges[1:], len(order)), strict=True):
        if hi - lo > 1:
            yield order[lo:hi]


def _first_pairs(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """From each block of a bucket, a spanning forest of its likeliest pairs."""
    sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint8).reshape(-1, SIGNATURE)
    uid = pdf["uid"].to_numpy()
    found: set[tuple[int, int]] = set()
    for rows in _buckets(pdf, ["band", "hash", "block"]):
        parts = [survivors(sig, rows[a], rows[b]) for a, b in _pairs(len(rows))]
        a, b, m = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(a):
            local = {int(r): k for k, r in enumerate(rows)}
            la, lb = np.array([local[int(x)] for x in a]), np.array([local[int(x)] for x in b])
            for k in _forest(len(rows), la, lb, m):
                x, y = int(uid[a[k]]), int(uid[b[k]])
                found.add((min(x, y), max(x, y)))
    return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")


def _cross_pairs(pdf: pd.DataFrame):
    """For each pair of blocks, its surviving pairs between components, likeliest first in each piece.

    A pair is looked at in the first band that it shares, so once in all.
    """
    sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint8).reshape(-1, SIGNATURE)
    bands = np.stack(pdf["bands"].to_list())
    comp, band = pdf["comp"].to_numpy(), pdf["band"].to_numpy()
    side, one, two = pdf["side"].to_numpy(), pdf["one"].to_numpy(), pdf["two"].to_numpy()
    for rows in _buckets(pdf, ["band", "hash", "one", "two"]):
        same = one[rows[0]] == two[rows[0]]
        for a, b in _pairs(len(rows)):
            a, b = rows[a], rows[b]
            go = comp[a] != comp[b]
            if not same:
                go &= side[a] != side[b]
            a, b, matches = survivors(sig, a[go], b[go])
            if len(a):
                go = (bands[a] == bands[b]).argmax(axis=1) == band[a]
                a, b, matches = a[go], b[go], matches[go]
            order = np.argsort(-matches, kind="stable")
            yield a[order], b[order]


def _surviving_rows(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of any surviving pair between components, by signatures alone."""
    hit = np.zeros(len(pdf), dtype=bool)
    for a, b in _cross_pairs(pdf):
        hit[a] = hit[b] = True
    return pdf.loc[hit, list(_MET)]


def _cross_links(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between components, checked exactly on full sets here.

    Pairs that links found here have joined already are not needed; the others are.
    """
    uid, comp = pdf["uid"].to_numpy(), pdf["comp"].to_numpy()
    items = [np.asarray(x, dtype=np.int64).view(np.uint64) for x in pdf["items"]]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    found = []
    for a, b in _cross_pairs(pdf):
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = root(int(comp[i])), root(int(comp[j]))
            if x != y and similar(items[i], items[j]):
                parent[x] = y
                found.append((min(uid[i], uid[j]), max(uid[i], uid[j])))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


#: A row in a pair of blocks.
_MET = {"band": "int", "hash": "long", "home": "long", "one": "int", "two": "int", "side": "boolean", "uid": "long", "comp": "long"}


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Exact test on two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < PERCENT * len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _spool(docs: DataFrame, text_col: str, p: str) -> DataFrame:
    """``docs`` with sender, uid, n_shingles, the key of the set (two longs) and band hashes."""
    from pyspark import TaskContext

    at = docs.columns.index(text_col)
    extra = [("sender", T.LongType()), ("uid", T.LongType()), ("n", T.LongType()), ("k1", T.LongType()), ("k2", T.LongType()), ("bands", T.ArrayType(T.LongType()))]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(p + n, t) for n, t in extra)])

    def run(batches):
        sender = TaskContext.get().partitionId()
        row = 0
        for batch in batches:
            n, keys, bands = [], [], []
            for text in batch.column(at).to_pylist():
                s = shingles(text)
                n.append(len(s))
                keys.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64))
                bands.append(band_hashes(s) if len(s) else None)
            keys = np.array(keys, dtype=np.int64).reshape(-1, 2)
            uid = (sender << 33) + row + np.arange(len(n), dtype=np.int64)
            row += len(n)
            columns = [pa.array(np.full(len(n), sender, dtype=np.int64)), pa.array(uid), pa.array(n, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def _sets(batches):
    for batch in batches:
        s = [shingles(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.view(np.int64) for x in s], pa.list_(pa.int64())), pa.array([signature(x) for x in s], pa.binary())], names=["uid", "bands", "items", "sig"])


def _verified(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("uid").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("uid").alias("b"), F.col("items").alias("items_b"))
    both = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - both
    return materialize(pairs.distinct().join(left, "a").join(right, "b").filter(100 * both >= PERCENT * union).select("a", "b"), name)


def components(links: DataFrame) -> DataFrame:
    """Per node of ``links`` (a, b): node, comp = least node reachable.

    Every node takes the least label among its neighbours' and its own, then the
    label of its label, until nothing changes; each round is a written table.
    Labels only fall, so the rounds end.
    """
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        stepped = materialize(lower.join(jump, "comp", "left").select("node", "was", F.least("comp", "next").alias("comp")), "labels")
        labels = stepped.select("node", "comp")
        if stepped.filter("was <> comp").limit(1).count() == 0:
            return labels


def _in_buckets(banded: DataFrame) -> DataFrame:
    """Rows (rep, items, band, hash) of the buckets of at least two: uid, items, band, hash, blocks, home.

    Buckets of a home are compared in one task.  Small ones have that of their least row, as near copies share many
    buckets: what is sent of a row then goes to few tasks.  All of one home are no more than a block.
    """
    bucket = Window.partitionBy("band", "hash")
    n, items = F.col("n"), F.col("volume")
    found = banded.withColumns({"n": F.count("*").over(bucket), "volume": F.sum("items").over(bucket), "low": F.min("rep").over(bucket)}).filter("n > 1")
    small = (n * BANDS <= BLOCK) & (items * BANDS <= BLOCK_ITEMS)
    home = F.when(small, F.xxhash64("low")).otherwise(F.xxhash64("band", "hash"))
    blocks = F.greatest(F.ceil(n / BLOCK), F.ceil(items / BLOCK_ITEMS)).cast("int")
    return found.select(F.col("rep").alias("uid"), "items", "band", "hash", blocks.alias("blocks"), home.alias("home"))


@tidy
def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_shingles, component_id and kept, one row for each row."""
    p = fresh([c[:5] for c in docs.columns], "__nd") + "_"
    parts = min(8192, max(4, 4 * docs.rdd.getNumPartitions()))
    rows = materialize(_spool(docs, text_col, p), "sets", (parts, f"{p}sender"))
    base = rows.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"{p}uid").alias("uid"), F.col(f"{p}n").alias("n"), F.col(f"{p}k1").alias("k1"), F.col(f"{p}k2").alias("k2"))
    who = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("uid"))
    classes = materialize(base.filter("n > 0").groupBy("k1", "k2").agg(F.min("uid").alias("rep"), F.min(who).alias("who"), F.count("*").alias("copies")), "classes")

    # candidates: buckets of at least two representatives
    banded = rows.filter(f"{p}n > 0").select(F.col(f"{p}uid").alias("rep"), F.col(f"{p}n").alias("items"), F.posexplode(f"{p}bands").alias("band", "hash")).join(classes.select("rep"), "rep", "left_semi")
    members = materialize(_in_buckets(banded), "buckets")

    # sets and signatures of the representatives in them; the texts stay where they are
    wanted = members.select("uid").distinct().groupBy(F.shiftright("uid", 33).alias(f"{p}sender")).agg(F.collect_list("uid").alias("wanted"))
    texts = rows.select(f"{p}sender", f"{p}uid", F.col(f"{p}bands").alias("bands"), F.col(f"`{text_col}`").alias("text")).join(wanted.hint("shuffle_hash"), f"{p}sender").filter(F.array_contains("wanted", F.col(f"{p}uid")))
    # dealt by uid once and for all, as every join below is by uid; a bucket holds a task's shingles, however large a sender is
    shingled = rows.agg(F.coalesce(F.sum(f"{p}n"), F.lit(0)).alias("n")).first()["n"]
    held = min(MOST_BUCKETS, max(parts, math.ceil(shingled / ITEMS_PER_TASK)))
    sets = texts.select(F.col(f"{p}uid").alias("uid"), "bands", "text").mapInArrow(_sets, "uid long, bands array<long>, items array<long>, sig binary")
    sets = materialize(sets.repartition(held, "uid"), "shingles", (held, "uid"))
    signed = materialize(members.join(sets.select("uid", "sig"), "uid"), "signed")

    def dealt(frame: DataFrame, keys: list[str], tasks: float, rows: int):
        """Groups by a hash of the keys: ``tasks`` of them, a few more while they stay above 500 rows.

        Partitions have a stated number: rows that repeat a signature are packed small, so by their size too many would be merged.
        """
        groups = max(1, math.ceil(tasks), min(32, rows // 500))
        most = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return frame.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int")).repartition(min(groups, most), "part").groupBy("part")

    size = signed.count()
    block = F.pmod(F.xxhash64("uid", "band"), F.col("blocks")).cast("int")
    first = dealt(signed.withColumn("block", block), ["home", "block"], size / PER_TASK, size).applyInPandas(_first_pairs, "a long, b long")
    pairs = materialize(first.distinct(), "pairs")
    links = _verified(pairs, sets, "links")
    comps = components(links)

    labelled = members.join(comps.withColumnRenamed("node", "uid"), "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))
    mixed = labelled.groupBy("band", "hash").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("band", "hash")
    rest = materialize(labelled.join(mixed, ["band", "hash"]).withColumn("block", block), "mixed")
    # each row's signature goes to every pair of blocks that holds its own
    copied = rest.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("n")).first()["n"]
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    signs = rest.join(sets.select("uid", "bands", "sig"), "uid")
    crossed = signs.withColumn("other", other).withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).withColumn("side", F.col("block") == F.col("one"))
    meeting = ["home", "one", "two"]
    few = materialize(dealt(crossed.select(*_MET, "bands", "sig"), meeting, copied / PER_TASK, copied).applyInPandas(_surviving_rows, ", ".join(f"{k} {t}" for k, t in _MET.items())), "survivors")
    volume = few.join(members.select("uid", "items").distinct(), "uid").agg(F.count("*").alias("rows"), F.coalesce(F.sum("items"), F.lit(0)).alias("items")).first()
    more = materialize(dealt(few.join(sets, "uid"), meeting, volume["items"] / ITEMS_PER_TASK, volume["rows"]).applyInPandas(_cross_links, "a long, b long"), "more_links")
    if more.limit(1).count():
        comps = components(links.unionByName(more))

    # the best row of each component, for each class
    reps = materialize(classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "classes_labelled")
    best = materialize(reps.groupBy("comp").agg(F.min("who").alias("best"), F.count("*").alias("classes")), "best")
    n_classes = F.lit(classes.count())
    verdict = spread_join(reps, best, ["comp"], F.col("classes") * HOT > n_classes, "inner").select("k1", "k2", "best", "copies")
    verdict = materialize(verdict, "classes_judged")
    linked = spread_join(base.filter("n > 0"), verdict, ["k1", "k2"], F.col("copies") * HOT > F.lit(rows.count()))
    linked = linked.select("uid", "n", F.col("best.doc_id").alias("component"), (F.col("best.uid") == F.col("uid")).alias("kept"))
    judged = linked.unionByName(base.filter("n = 0").select("uid", "n", F.col("doc_id").alias("component"), F.lit(True).alias("kept")))
    # verdicts go to the senders as one list each, in row order; the rows stay where they are
    lists = judged.groupBy(F.shiftright("uid", 33).alias(f"{p}sender")).agg(F.array_sort(F.collect_list(F.struct("uid", "n", "component", "kept"))).alias(f"{p}all"))
    lists = materialize(lists, "verdicts")
    found = rows.drop(f"{p}bands").join(lists.hint("shuffle_hash"), f"{p}sender")
    mine = F.element_at(f"{p}all", F.expr(f"CAST({p}uid - shiftleft({p}sender, 33) AS INT) + 1"))
    values = {"n_shingles": mine["n"], "component_id": mine["component"], "kept": mine["kept"]}
    taken, out = list(docs.columns), []
    for name, value in values.items():
        out.append(value.alias(name := fresh(taken, name)))
        taken.append(name)
    return found.select(*(F.col(f"`{c}`") for c in docs.columns), *out)
