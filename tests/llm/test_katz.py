import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lociq.llm import katz
from tests.llm.fixtures import empty, frame, rows


class Brute:
    """The model by dictionaries."""

    def __init__(self, table, order):
        self.order = order
        self.c = [Counter() for _ in range(order + 1)]
        for doc_id, text, *_ in table:
            if zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2:
                continue
            t = ["<s>", *(text or "").encode().lower().split(), "</s>"]
            for k in range(1, len(t)):
                for n in range(1, order + 1):
                    if k - n + 1 >= 0:
                        self.c[n][tuple(t[k - n + 1 : k + 1])] += 1
        self.d = [None] + [katz.discounts([0, *(sum(v == r for v in c.values()) for r in range(1, katz.TOP + 2))]) for c in self.c[1:]]
        self.total = sum(self.c[1].values())
        self.words = [w for (w,) in self.c[1]]

    def dc(self, n, c):
        return c * (self.d[n][c] if c <= katz.TOP else 1.0)

    def p1(self, w):
        left = self.total - sum(self.dc(1, c) for c in self.c[1].values())
        below = self.total if left > 1e-9 else self.total + 1
        c = self.c[1][(w,)]
        return self.dc(1, c) / below if c else max(left if left > 1e-9 else 1, 0) / below

    def p(self, h, w):
        if not h:
            return self.p1(w)
        n = len(h) + 1
        seen = {k[-1]: c for k, c in self.c[n].items() if k[:-1] == h}
        if not seen:
            return self.p(h[1:], w)
        count, mass = sum(seen.values()), sum(self.dc(n, c) for c in seen.values())
        below = count + (mass > count * (1 - 1e-12))
        if w in seen:
            return self.dc(n, seen[w]) / below
        return (1 - mass / below) / (1 - sum(self.p(h[1:], v) for v in seen)) * self.p(h[1:], w)


@pytest.mark.parametrize("order", [2, 3])
def test_scores(spark, monkeypatch, order):
    monkeypatch.setattr(katz, "CHUNK", 300)
    table = [r for r in rows(40) if r[1] is None or len(r[1]) < 2000]
    brute = Brute(table, order)
    docs = frame(spark, 40).filter("text is null or length(text) < 2000")
    out = katz.score(docs, order=order).toPandas()
    assert len(out) == len(table)
    by_id = {r[0]: r[1] for r in table}
    v = len(brute.words)
    for r in out[out.doc_id.notna()].itertuples():
        t = [*(by_id[int(r.doc_id)] or "").encode().lower().split(), "</s>"]
        assert r.held_out == (zlib.crc32(str(int(r.doc_id)).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(brute.c[1][(w,)] > 0 for w in t), brute.total)
        assert math.isclose(r.base_score, sum(math.log10((brute.c[1][(w,)] + 1) / (brute.total + v + 1)) for w in t), rel_tol=1e-9)
        full = ["<s>", *t]
        want = sum(math.log10(brute.p(tuple(full[max(0, k - order + 1) : k]), full[k])) for k in range(1, len(full)))
        assert math.isclose(r.score, want, rel_tol=1e-9), (r.doc_id, r.score, want)
    assert katz.score(empty(spark)).count() == 0


def test_normalised():
    brute = Brute(rows(60), 2)
    for h in ["<s>", "the", "of", "12345", "never seen"]:
        assert math.isclose(sum(brute.p((h,), w) for w in [*brute.words, "unknown"]), 1, rel_tol=1e-9)


def test_packed_arrays():
    rng = np.random.default_rng(0)
    for x in (np.array([], dtype=np.int64), rng.integers(-5, 1 << 60, 99), rng.random(50), rng.integers(0, 1 << 63, 40).astype(np.uint64), np.array([1], dtype=np.int8)):
        for ordered in (False, x.dtype.kind != "f"):
            y = katz.unpack(katz.pack(np.sort(x) if ordered else x, ordered))
            assert y.dtype == x.dtype and y.tolist() == (np.sort(x) if ordered else x).tolist()
    a, b = rng.integers(0, 5, 60), rng.integers(0, 5, 60)
    for shift in (0, 1 << 40):  # packed and sorted by two columns
        p, q, where = katz.unique_pairs(a + shift, b)
        assert (p[where] == a + shift).all() and (q[where] == b).all()
        assert sorted(set(zip(p.tolist(), q.tolist(), strict=True))) == list(zip(p.tolist(), q.tolist(), strict=True))
