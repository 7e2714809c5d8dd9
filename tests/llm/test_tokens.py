import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from lociq.llm import byte_bpe, packing, token_counts
from tests.llm.fixtures import empty, frame, texts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_classes_agree_outside_the_ranges(library):
    """Every character but those of OTHER_CLASSES is cut alike by both, in all the pattern's contexts."""
    import regex

    find = regex.compile(token_counts.PATTERN).findall
    other = {c for a, b in token_counts.OTHER_CLASSES for c in range(a, b + 1)}
    for low in range(0, 0x110000, 1024):
        s = "".join(f"a{chr(c)}a1{chr(c)}1!{chr(c)}! {chr(c)}" for c in range(low, low + 1024) if c not in other and not 0xD800 <= c < 0xE000)
        assert [s[i:j] for _, (i, j) in library.pre_tokenizer.pre_tokenize_str(s)] == find(s), hex(low)


SCRIPTS = ["你好，世界。这是一个测试！", "السلام عليكم ورحمة الله، كيف حالك؟", "नमस्ते दुनिया, यह एक परीक्षण है।", "สวัสดีชาวโลก นี่คือการทดสอบ", "שלום עולם זה מבחן", "a\u0301 e\u0301 → ∑ x≤y", "日本語のテキスト　全角 空白", "ქართული ენა ՀԱՅԵՐԵՆ"]


def test_texts_of_all_scripts(library):
    """Whole texts of other scripts go through the shortcut; odd characters and added tokens send their own run alone."""
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    counter = token_counts.TokenCounter(tokenizer, token_counts.prove_whole_tokens(tokenizer))
    assert not any(map(counter.unsafe, SCRIPTS))
    odd = ["\u088f", "\U00033000", "<|endoftext|>", "\U000107bb1"]
    mixed = [sep.join([a, o, b, o + a, b + o]) for a in SCRIPTS for b in SCRIPTS[:3] for o in odd for sep in (" ", "  ", "\n", " \t", "", "\u00a0")]
    for t in [*SCRIPTS, *mixed, "  ".join(odd), " <|endoftext|> ", "<|endoftext|> <|endoftext|>"]:
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids), t
    seen = []
    counter.counts.tokenizer = type("T", (), {"encode": lambda self, t, add_special_tokens: seen.append(t) or library.encode(t, add_special_tokens=False)})()
    counter.count("many words before \u088f and after <|endoftext|> it all")
    assert seen == [" \u088f", " <|endoftext|>"]


def test_proven_tokens_encode_alone(library):
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        proven = token_counts.prove_whole_tokens(f.read())
    assert len(proven) > 45_000
    assert all(len(e.ids) == 1 for e in library.encode_batch(proven[::97], add_special_tokens=False) if " " not in e.tokens[0][1:])


def test_token_counts(spark, library):
    out = token_counts.count_tokens(frame(spark), P.path("byte_bpe_50k.json"), limit=50).toPandas()
    by_id = {k: t or "" for k, t in enumerate(texts())}
    assert len(out) == len(by_id) + 3
    for r in out.dropna().itertuples():
        t = by_id[int(r.doc_id)]
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)), t[:80]
        assert r.over_limit == (r.n_tokens > 50)
    assert token_counts.count_tokens(empty(spark), P.path("byte_bpe_50k.json")).count() == 0


def test_byte_bpe_round_trip(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    by_id = {k: t or "" for k, t in enumerate(texts())}
    out = byte_bpe.encode_documents(frame(spark), path, P.PATTERN).toPandas()
    assert len(out) == len(by_id) + 3
    for r in out[out.doc_id.notna()].itertuples():
        t = by_id[int(r.doc_id)]
        ids = library.encode_ordinary(t)
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert byte_bpe.encode_documents(empty(spark), path, P.PATTERN).count() == 0


def test_words_of_any_length(monkeypatch):
    """Words within a cell and far beyond, in one block and alone, in few rounds a query and many, as the library encodes them."""
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.Codec(ranks)
    rng = np.random.default_rng(1)
    letters = [bytes(rng.choice(list(b"etaoinshrdlu"), size=n).astype(np.uint8)) for n in (1, 2, 65, 66, 67, 131, 132, 133, 197, 198, 199, 264, 1000, 5000)]
    words = [*letters, *(b"thing" * k for k in range(1, 90)), b"ab" * 1500, b"a" * 2000, "éêèñ中文字".encode() * 150, b"0123456789abcdef" * 100, b"ing the" * 200]
    want = [library.encode_ordinary(w.decode()) for w in words]
    for rows_ in (6_000_000, 3000):
        monkeypatch.setattr(byte_bpe, "ROWS", rows_)
        got = [np.frombuffer(x, dtype=np.int32).tolist() for x in codec.encode_words(words)]
        assert got == want
    ids = [np.array(x, dtype=np.int32) for x in [*want, []]]
    assert codec.decode(ids) == [*words, b""]
    monkeypatch.setattr(byte_bpe, "IDS", 100)
    assert codec.decode(ids) == [*words, b""]
    rng.shuffle(ids[12])
    assert codec.decode(ids[12:13])[0] == library.decode_bytes(ids[12].tolist()) != words[12]  # the ids are what is decoded


def _packed(spark, docs, capacity):
    out = packing.pack(docs, P.path("word_bpe_49k.json"), capacity=capacity).toPandas()
    return out


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(spark, capacity):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out = _packed(spark, frame(spark), capacity)
    want = {}
    for k, t in enumerate(texts()):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[(k, p)] = (at, len(part), zlib.crc32(part.tobytes()))
    seen = {(int(r.doc_id), r.piece): (r.start, r.length, r.ids_crc32) for r in out[out.doc_id.notna()].itertuples()}
    assert seen == want
    fill = 0
    for _, g in out.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.length.sum() <= capacity
        assert (g.offset == g.length.cumsum() - g.length).all()
        fill += 1
    assert fill <= 1.03 * -(-out.length.sum() // capacity) + 1
    assert packing.pack(empty(spark), P.path("word_bpe_49k.json")).count() == 0


def test_local_search_beats_best_fit():
    # best fit leaves 3 bins: 6+3, 5+4, 2+2; an exchange of two for one fills 10 + 10
    lengths = [6, 5, 4, 3, 2]
    assert len(packing.best_fit(lengths, 10)) >= len(packing.pack_lengths(lengths, 10))
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = rng.integers(1, 60, 80).tolist()
        bins = packing.pack_lengths(n, 100)
        assert sorted(k for b in bins for k in b) == list(range(80))
        assert max(sum(n[k] for k in b) for b in bins) <= 100
        assert len(bins) <= len(packing.best_fit(n, 100))


def test_local_search_lowers_the_count():
    for low, high, count in ((900, 1900, 1500), (900, 1900, 1200), (700, 1500, 900)):
        n = np.random.default_rng(count).integers(low, high, count).tolist()
        found = packing.pack_lengths(n, 4096)
        assert -(-sum(n) // 4096) <= len(found) < len(packing.best_fit(n, 4096))


def test_levels_and_hot_rows(spark, monkeypatch):
    """Groups of a few pieces: levels join what they leave, repeated rows spread over groups, the count stays near the bound."""
    monkeypatch.setattr(packing, "GROUP", 40)
    rng = np.random.default_rng(3)
    texts_ = ["all the same words of one text " * 3] * 200 + [None] * 150 + [" ".join(rng.choice(["word", "and", "other"], size=n)) for n in rng.integers(1, 60, 200)]
    docs = spark.createDataFrame([(None if k % 3 == 0 else 5, t) for k, t in enumerate(texts_)], "doc_id long, text string").repartition(4)
    out = _packed(spark, docs, 64)
    assert len(out) >= 550 and out.groupby("sequence_id").length.sum().max() <= 64
    for _, g in out.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all()
    at_once = len(packing.pack_lengths(out.length.tolist(), 64))
    assert out.sequence_id.nunique() <= 1.03 * at_once + 1, at_once
    huge = spark.createDataFrame([(k, "word " * 40) for k in range(300)], "doc_id long, text string")  # no two fit together: a level empties no bin
    assert _packed(spark, huge, 64).sequence_id.nunique() == 300


@pytest.mark.parametrize(("low", "high", "count", "capacity"), [(900, 1900, 1500, 4096), (30, 60, 400, 100), (1, 9, 300, 23)])
def test_local_search_compares_all_underfull_bins(low, high, count, capacity):
    """When it stops above the bound, no move or exchange (1:1, 2:1, 1:2) between any two bins raises squared fill."""
    n = np.random.default_rng(7).integers(low, high, count).tolist()
    bins = packing.pack_lengths(n, capacity)
    assert sorted(k for b in bins for k in b) == list(range(count))
    fill = [sum(n[k] for k in b) for b in bins]
    assert max(fill) <= capacity and len(bins) <= len(packing.best_fit(n, capacity))
    if len(bins) == -(-sum(n) // capacity):
        return
    sums = [[{0}, {n[k] for k in b}, {n[a] + n[c] for i, a in enumerate(b) for c in b[i + 1 :]}] for b in bins]
    low_bins = [b for b in range(len(bins)) if fill[b] < capacity]
    for x in low_bins:
        for y in low_bins:
            if x != y:
                gains = {g - t for i, j in ((1, 0), (1, 1), (2, 0), (2, 1), (1, 2)) for g in sums[x][i] for t in sums[y][j]}
                assert not any(max(0, fill[x] - fill[y]) < d <= capacity - fill[y] for d in gains)


def test_long_runs_of_equal_pairs():
    """Words of one letter, of a short period and of few letters: ids as the library's, in time that does not grow with the square."""
    import time

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.Codec(ranks)
    rng = random.Random(4)
    words = []
    for _ in range(60):
        letters = rng.choice([b"a", b"ab", b"abc", b"aab the", b"0123456789", "éa".encode(), b"=-_*"])
        w = bytes(rng.choice(letters) for _ in range(rng.randrange(1, 2500)))
        words.append(w[:7] * (len(w) // 7 + 1) if rng.random() < 0.4 else w)
    words += [b"a" * 200_000, b"ab" * 100_000, b"abcabd" * 20_000]
    t = time.perf_counter()
    got = codec.encode_words(words)
    assert time.perf_counter() - t < 40
    assert [np.frombuffer(g, np.int32).tolist() for g in got] == [library._encode_single_piece(w) for w in words]
    assert len(codec.encode_words([b"=" * 1_500_000])[0]) > 0
