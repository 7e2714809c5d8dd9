"""Katz backoff language model: counts, Good-Turing discounts, exact backoff weights.

Tokens of a text are its words (A-Z lowered) and one end.  With n the order,

    P_n(w | h) = d_c * c(h w) / C(h)         if c(h w) > 0
               = alpha(h) * P_n-1(w | h')    otherwise

where d_c is the Good-Turing discount of counts up to ``TOP`` and
alpha(h) = (1 - sum of P_n(w | h) over seen w) / (1 - sum of P_n-1(w | h') over
seen w), so that the probabilities of all known words and of "unknown" add up
to 1 for each h.  Where counts of counts are too sparse for a Good-Turing
discount, r - 0.5 replaces r.  A history whose words leave no mass gets a
denominator that is larger by one.

How it runs.  A task reads its rows in chunks of about ``CHUNK`` tokens (a chunk
is a sender) and stores each as one row: distinct words, their training counts,
and the tokens as numbers of these words.  For each order, senders send their
distinct n-grams with counts, as packed sorted arrays, to owners chosen by a
hash of the whole n-gram, so a frequent word or history does not gather in one
task.  Owners add up the counts, store their part of the model table, number
their n-grams, and answer each sender in the order in which it asked.  Sums by
history go to the owner of the history, which computes C and alpha.  Chunks lie
in bucket files by sender, so answers travel and tokens stay.

The driver holds only counts of counts (``TOP`` + 4 numbers an order).  Every
step is a written table: a lost executor repeats its own tasks only.

Null texts count as empty: their one token is the end.  A null id counts as an
empty id text.  Repeated rows are counted and scored as rows.  Extra columns are
ignored; an empty table gives an empty result; without training rows every word
is unknown and has probability 1.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociq.llm.common import id_text, materialize, renamed, tidy

#: Counts up to this one are discounted.
TOP = 5
#: Tokens in a chunk, about; a text is never split.
CHUNK = 1 << 20
#: n-grams that an owner is asked for, about.
PER_OWNER = 1_500_000
REMEMBERED = 250_000
START, END = np.uint64(0), np.uint64(1)


# ---- packed arrays


def pack(values: np.ndarray, ordered: bool = False) -> bytes:
    """Array -> zstd of its byte planes; integers in order by their differences."""
    import zstandard

    values = np.ascontiguousarray(values)
    kind = values.dtype.str.encode()
    if ordered and len(values):
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()
    return bytes([len(kind), ordered]) + kind + zstandard.compress(planes, 3)


def unpack(blob: bytes) -> np.ndarray:
    import zstandard

    n, ordered = blob[0] + 2, blob[1]
    kind = np.dtype(blob[2:n].decode())
    planes = np.frombuffer(zstandard.decompress(blob[n:]), dtype=np.uint8)
    values = np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if ordered else values


def lower(values: np.ndarray, stats: dict[int, dict]) -> np.ndarray:
    """Lower-order probabilities, sent as the word's count where the order below is the first."""
    return unigram(values, stats[1]) if values.dtype.kind == "i" else values


def unique_pairs(a: np.ndarray, b: np.ndarray, inverse: bool = True):
    """Distinct (a, b) in order, and for each input pair the number of its distinct one."""
    if not len(a):
        return a, b, np.array([], dtype=np.int64)
    if a.min() >= 0 and b.min() >= 0 and a.max() < 2**31 and b.max() < 2**32:
        both = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        distinct, where = np.unique(both, return_inverse=True)
        return (distinct >> np.uint64(32)).astype(np.int64), (distinct & np.uint64(0xFFFFFFFF)).astype(np.int64), where
    order = np.lexsort((b, a))
    new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
    where = np.empty(len(a), dtype=np.int64)
    where[order] = np.cumsum(new) - 1
    return a[order][new], b[order][new], where


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _dealt(owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys by owner (stable), and where each owner's begin."""
    order = np.argsort(owner, kind="stable")
    return order, np.searchsorted(owner[order], np.arange(owners + 1))


# ---- the model's numbers


def discounts(n: list[int]) -> np.ndarray:
    """d_0 .. d_TOP (d_0 unused) from counts of counts n[1] .. n[TOP + 1]."""
    out = np.ones(TOP + 1)
    sparse = any(n[r] <= 0 for r in range(1, TOP + 2))
    common = 0.0 if sparse else (TOP + 1) * n[TOP + 1] / n[1]
    for r in range(1, TOP + 1):
        d = 0.0 if sparse or common >= 1 else ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c <= TOP, d[np.minimum(c, TOP)], 1.0)


def unigram(c: np.ndarray, stats: dict) -> np.ndarray:
    """P_1 of words with training counts c; 0 stands for the unknown word."""
    total, d = stats["total"], stats["d"]
    left = sum(stats["n"][r] * r * (1 - d[r]) for r in range(1, TOP + 1))
    if total == 0:
        return np.ones(len(c))
    below = total if left > 0 else total + 1
    return np.where(c > 0, discounted(c, d) / below, (left if left > 0 else 1.0) / below)


def backoff(mass: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Denominator C and weight alpha of histories: discounted and lower-order mass of seen words, count."""
    full = mass > count * (1 - 1e-12)
    below = count + full
    return below.astype(np.float64), (1 - mass / below) / np.maximum(1 - low, 1e-15)


# ---- senders


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = max(2, xxhash.xxh64_intdigest(word))  # 0 and 1 are the start and the end
        if len(word) <= 64:
            if len(self) > REMEMBERED:
                self.clear()
            self[word] = h
        return h


_HASHES = _WordHashes()


def is_held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def _chunks(docs: DataFrame) -> DataFrame:
    from pyspark import TaskContext

    schema = T.StructType([T.StructField("sender", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType)), T.StructField("n_words", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in ("lens", "held", "words", "counts", "seq"))])

    def row(sender, ids, held, lens, parts):
        hashes = np.concatenate(parts)
        words, seq = np.unique(np.append(hashes, START), return_inverse=True)
        train = np.repeat(~np.array(held), lens)
        counts = np.bincount(seq[:-1][train], minlength=len(words)).astype(np.int64)
        counts[0] = len(held) - sum(held)  # the start, once for each training text
        fields = [pa.array([sender], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([len(words)], pa.int64())]
        blobs = [pack(np.array(lens, dtype=np.int32)), pack(np.array(held, dtype=np.int8)), pack(words, True), pack(counts), pack(seq[:-1].astype(np.int32))]
        return pa.RecordBatch.from_arrays([*fields, *(pa.array([b], pa.binary()) for b in blobs)], names=schema.fieldNames())

    def run(batches):
        sender = TaskContext.get().partitionId() << 24
        ids, held, lens, parts, size = [], [], [], [], 0
        for batch in batches:
            for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                words = text.encode().lower().split()
                h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
                parts.append(np.append(h, END))
                ids.append(batch.column(0).slice(k, 1))
                held.append(is_held_out(doc_id))
                lens.append(len(words) + 1)
                size += lens[-1]
                if size >= CHUNK:
                    yield row(sender, pa.concat_arrays(ids), held, lens, parts)
                    sender, ids, held, lens, parts, size = sender + 1, [], [], [], [], 0
        if ids:
            yield row(sender, pa.concat_arrays(ids), held, lens, parts)

    return docs.mapInArrow(run, schema)


class Chunk:
    """A sender's tokens, and per order what the owners answered about them."""

    def __init__(self, lens: bytes, words: bytes, counts: bytes, seq: bytes, held: bytes):
        self.lens, self.words, self.counts, self.seq = unpack(lens), unpack(words), unpack(counts), unpack(seq)
        self.held = unpack(held).astype(bool)
        self.train = np.repeat(~self.held, self.lens)
        self.first = np.cumsum(self.lens) - self.lens
        self.order = np.arange(len(self.seq)) - np.repeat(self.first, self.lens)  # place in its text

    def take(self, answers: list, owners: dict[int, int], stats: dict[int, dict], upto: int) -> None:
        """Replay the answers of orders 1 .. upto: ids, counts and probabilities of all tokens."""
        got: dict[tuple[int, str], list] = {}
        for a in answers:
            got.setdefault((a["level"], a["kind"]), []).append((a["owner"], a["one"], a["two"]))
        flat = {k: tuple(np.concatenate([unpack(x[j]) for x in sorted(v, key=lambda x: x[0])]) for j in (1, 2)) for k, v in got.items()}

        def in_place(level: int, kind: str, order: np.ndarray):
            out = []
            for x in flat[(level, kind)]:
                y = np.empty(len(order), dtype=x.dtype)
                y[order] = x
                out.append(y)
            return out

        order, _ = _dealt((self.words % np.uint64(owners[1])).astype(np.int64), owners[1])
        ids, counts = in_place(1, "gram", order)
        self.word_ids = ids[self.seq]
        self.known = counts[self.seq]
        self.p = unigram(self.known, stats[1])
        # the history of order 2 is the word before, or the start
        before = np.empty(len(self.seq), dtype=np.int64)
        before[1:] = self.seq[:-1]
        before[self.first] = 0
        self.history, self.usable = ids[before], np.ones(len(self.seq), dtype=bool)
        history_gram = before
        history_order = order
        for level in range(2, upto + 1):
            below, alpha = in_place(level, "history", history_order)
            keys = self.keys()
            order, _ = _dealt((_mixed(keys[0], keys[1]) % np.uint64(owners[level])).astype(np.int64), owners[level])
            gram_ids, gram_counts = in_place(level, "gram", order)
            c = gram_counts[keys[2]]
            h = history_gram[self.usable]
            p = self.p.copy()
            with np.errstate(divide="ignore", invalid="ignore"):
                p[self.usable] = np.where(c > 0, discounted(c, stats[level]["d"]) / below[h], alpha[h] * self.p[self.usable])
            self.p = p
            # the next history is this n-gram, one token on
            gram = np.full(len(self.seq), -1, dtype=np.int64)
            gram[self.usable] = keys[2]
            nxt = np.full(len(self.seq), -1, dtype=np.int64)
            nxt[1:] = gram[:-1]
            nxt[self.first] = -1
            self.usable = nxt >= 0
            self.history = np.where(self.usable, gram_ids[np.maximum(nxt, 0)] if len(gram_ids) else 0, -1)
            history_gram, history_order = nxt, order

    def keys(self):
        """Distinct (history, word) of the usable tokens, and each such token's number among them."""
        return unique_pairs(self.history[self.usable], self.word_ids[self.usable])


_CHUNK = ("lens", "words", "counts", "seq", "held")
_ANSWER = "level int, kind string, owner int, sender long, one binary, two binary"


def _loaded(row: dict, owners, stats, upto) -> Chunk:
    chunk = Chunk(*(row[n] for n in _CHUNK))
    chunk.take(row["answers"], owners, stats, upto)
    return chunk


def _rows(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _table(schema: list[tuple], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(schema)], names=[n for n, _ in schema])


_REQUEST = [("owner", pa.int32()), ("sender", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("counts", pa.binary()), ("low", pa.binary())]
_REQUEST_DDL = "owner int, sender long, a binary, b binary, counts binary, low binary"


def _ask_words(owners: int):
    def run(batches):
        for row in _rows(batches):
            words, counts = unpack(row["words"]), unpack(row["counts"])
            order, at = _dealt((words % np.uint64(owners)).astype(np.int64), owners)
            yield _table(_REQUEST, [(o, row["sender"], pack(words[k], True), None, pack(counts[k]), None) for o in range(owners) if len(k := order[at[o] : at[o + 1]])])

    return run


def _ask_grams(level: int, owners: dict[int, int], stats: dict[int, dict]):
    def run(batches):
        for row in _rows(batches):
            chunk = _loaded(row, owners, stats, level - 1)
            history, word, where = chunk.keys()
            counts = np.bincount(where[chunk.train[chunk.usable]], minlength=len(history)).astype(np.int64)
            below = chunk.known if level == 2 else chunk.p
            low = np.zeros(len(history), dtype=below.dtype)
            low[where] = below[chunk.usable]
            order, at = _dealt((_mixed(history, word) % np.uint64(owners[level])).astype(np.int64), owners[level])
            yield _table(_REQUEST, [(o, row["sender"], pack(history[k], True), pack(word[k]), pack(counts[k]), pack(low[k])) for o in range(owners[level]) if len(k := order[at[o] : at[o + 1]])])

    return run


# ---- owners

_OWNED = _ANSWER + ", stats array<long>, history binary, word binary, count binary, low binary"


def _own(level: int, owners: int, with_ids: bool):
    """Add up one owner's counts: answers, its part of the model table, counts of counts."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        owner = int(key[0])
        a = [unpack(x) for x in pdf["a"]]
        counts = np.concatenate([unpack(x) for x in pdf["counts"]])
        sizes = np.cumsum([0, *map(len, a)])
        if level == 1:
            keys, where = np.unique(np.concatenate(a), return_inverse=True)
            total = np.zeros(len(keys), dtype=np.int64)
            np.add.at(total, where, counts)
            real = keys != START
        else:
            b = np.concatenate([unpack(x) for x in pdf["b"]])
            low_all = np.concatenate([unpack(x) for x in pdf["low"]])
            history, word, where = unique_pairs(np.concatenate(a), b)
            total = np.bincount(where, weights=counts, minlength=len(history)).astype(np.int64)
            low = np.zeros(len(history), dtype=low_all.dtype)
            low[where] = low_all
            real = np.ones(len(history), dtype=bool)
        # frequent ones get small numbers, which pack well
        ids = np.empty(len(total), dtype=np.int64)
        ids[np.argsort(-total, kind="stable")] = np.arange(len(total), dtype=np.int64) * owners + owner
        n = np.bincount(np.minimum(total[real], TOP + 2), minlength=TOP + 3)
        out = [(level, "stats", owner, -1, None, None, [int(total[real].sum()), int((total[real] > 0).sum()), *n[1 : TOP + 2].tolist()], None, None, None, None)]
        none = np.array([], dtype=np.int64)
        for k, sender in enumerate(pdf["sender"]):
            part = where[sizes[k] : sizes[k + 1]]
            out.append((level, "gram", owner, sender, pack(ids[part]) if with_ids else pack(np.zeros(len(part), dtype=np.int64)), pack(total[part]), None, None, None, None, None))
        if level > 1:
            seen = total > 0
            out.append((level, "model", owner, -1, pack(none), pack(none), None, pack(history[seen], True), pack(word[seen]), pack(total[seen]), pack(low[seen])))
        return pd.DataFrame(out, columns=["level", "kind", "owner", "sender", "one", "two", "stats", "history", "word", "count", "low"])

    return run


def _history_sums(level: int, stats: dict[int, dict], owners: int):
    """Partial sums of one part of the model table by history, for the histories' owners."""
    schema = [("owner", pa.int32()), ("history", pa.binary()), ("mass", pa.binary()), ("low", pa.binary()), ("count", pa.binary())]

    def run(batches):
        for row in _rows(batches):
            history, count, low = unpack(row["history"]), unpack(row["count"]), lower(unpack(row["low"]), stats)
            distinct, where = np.unique(history, return_inverse=True)
            sums = [np.bincount(where, weights=w, minlength=len(distinct)) for w in (discounted(count, stats[level]["d"]), low, count)]
            order, at = _dealt(distinct % owners, owners)
            yield _table(schema, [(o, pack(distinct[k], True), *(pack(s[k]) for s in sums)) for o in range(owners) if len(k := order[at[o] : at[o + 1]])])

    return run


def _answer_histories(level: int):
    """C and alpha of the histories that each sender has, in the order of its request at the order below."""

    def run(key, asked: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        if len(sums):
            distinct, where = np.unique(np.concatenate([unpack(x) for x in sums["history"]]), return_inverse=True)
            mass, low, count = (np.bincount(where, weights=np.concatenate([unpack(x) for x in sums[n]]), minlength=len(distinct)) for n in ("mass", "low", "count"))
            below, alpha = backoff(mass, low, count)
        out = []
        for owner, sender, blob in zip(asked["owner"], asked["sender"], asked["one"], strict=True):
            ids = unpack(blob)
            c, a = np.ones(len(ids)), np.ones(len(ids))
            if len(sums):
                at = np.minimum(np.searchsorted(distinct, ids), len(distinct) - 1)
                hit = distinct[at] == ids
                c[hit], a[hit] = below[at[hit]], alpha[at[hit]]
            out.append((level, "history", owner, sender, pack(c), pack(a)))
        return pd.DataFrame(out, columns=["level", "kind", "owner", "sender", "one", "two"])

    return run


# ---- all together


def _totals(owned: DataFrame) -> dict:
    names = ["total", "distinct", *(f"n{r}" for r in range(1, TOP + 2))]
    row = owned.filter("kind = 'stats'").agg(*(F.coalesce(F.sum(F.col("stats")[k]), F.lit(0)).alias(n) for k, n in enumerate(names))).first()
    n = [0, *(row[f"n{r}"] for r in range(1, TOP + 2))]
    return {"total": row["total"], "distinct": row["distinct"], "n": n, "d": discounts(n)}


@tidy
def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = id_text(docs, id_col, text_col)
    parts = max(1, docs.rdd.getNumPartitions())
    chunks = materialize(_chunks(rows), "chunks", (min(8192, max(4, 4 * parts)), "sender"))
    size = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"), F.count("*").alias("n")).first()
    owners = {1: max(1, min(64, size["n"]), math.ceil(size["words"] / PER_OWNER))}
    stats: dict[int, dict] = {}
    asked = chunks.select("sender", "words", "counts").mapInArrow(_ask_words(owners[1]), _REQUEST_DDL)
    owned = materialize(asked.groupBy("owner").applyInPandas(_own(1, owners[1], True), _OWNED), "words")
    stats[1] = _totals(owned)
    answer_columns = ["level", "kind", "owner", "sender", "one", "two"]
    answers = previous = owned.filter("kind = 'gram'").select(*answer_columns)

    def with_answers() -> DataFrame:
        by_sender = answers.groupBy("sender").agg(F.collect_list(F.struct("level", "kind", "owner", "one", "two")).alias("answers"))
        return chunks.join(by_sender.hint("shuffle_hash"), "sender")

    for level in range(2, order + 1):
        owners[level] = max(1, min(64, 2 * size["n"]), math.ceil(size["words"] * 4 * (level - 1) / PER_OWNER))
        asked = with_answers().select("sender", *_CHUNK, "answers").mapInArrow(_ask_grams(level, owners, stats), _REQUEST_DDL)
        owned = materialize(asked.groupBy("owner").applyInPandas(_own(level, owners[level], level < order), _OWNED), f"grams{level}")
        stats[level] = _totals(owned)
        sums = owned.filter("kind = 'model'").select("history", "count", "low").mapInArrow(_history_sums(level, stats, owners[level - 1]), "owner int, history binary, mass binary, low binary, count binary")
        histories = materialize(previous.groupBy("owner").cogroup(sums.groupBy("owner")).applyInPandas(_answer_histories(level), _ANSWER), f"histories{level}")
        grams = owned.filter("kind = 'gram'").select(*answer_columns)
        answers, previous = answers.unionByName(grams).unionByName(histories), grams

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [T.BooleanType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([renamed(docs.schema[id_col], id_col), *(T.StructField(n, k) for n, k in zip(names[1:], kinds, strict=True))])
    total, distinct = stats[1]["total"], stats[1]["distinct"]

    def finish(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids = row.column(0).flatten()
                chunk = _loaded({n: row.column(n)[0].as_py() for n in (*_CHUNK, "answers")}, owners, stats, order)
                n = len(chunk.lens)
                base = np.add.reduceat(np.log10((chunk.known + 1) / (total + distinct + 1)), chunk.first)
                model = np.add.reduceat(np.log10(chunk.p), chunk.first)
                known = np.add.reduceat((chunk.known > 0).astype(np.int64), chunk.first)
                yield pa.RecordBatch.from_arrays([ids, pa.array(chunk.held), pa.array(chunk.lens.astype(np.int64)), pa.array(known), pa.array([total] * n, pa.int64()), pa.array(base), pa.array(model)], names=names)

    return with_answers().select("ids", *_CHUNK, "answers").mapInArrow(finish, schema)
