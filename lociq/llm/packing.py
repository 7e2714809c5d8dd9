"""Best-fit packing of tokenised documents into sequences of a fixed length.

A document is its token ids and one end id.  Documents longer than a sequence
are cut into pieces of the full length and a shorter last one; others stay
whole.  Pieces are first placed best-fit, longest first.  A local search then
works on all underfull bins of a group: it fills bins from emptier ones by moving
one or two pieces, by exchanging one piece for a shorter one, two pieces for one,
or one for two, whatever raises the sum of squared fill, until no exchange does or
the bins are as few as the total allows.  A bin that ends empty is gone.

Pieces are dealt to groups by a hash of their row number, so no task holds more
than about ``GROUP`` of them, whatever their ids and texts.  The underfull bins that
the groups leave are opened and dealt anew, level by level, until one group is
left or a level empties no bin.

Null and empty texts are the end id alone.  A very long text is many pieces, which
no task needs to hold together.  Repeated rows, equal texts in any number and rows
with equal or null ids are packed one by one.  Ties of length go by id, piece and
row number.  Extra columns are ignored.  An empty table gives no pieces.
"""

from __future__ import annotations

import math
import os
import zlib
from array import array
from collections import Counter
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociq.llm.common import id_text, materialize, renamed, tidy
from lociq.llm.token_counts import byte_letters

#: Pieces that one task packs at once, about.
GROUP = 65_536
#: Tokenised words that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 1_200_000


# Fixed value: how the tokenizer cuts a run into parts.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Runs of these characters alone are cut and lowered here as the library does; others it encodes itself.
PLAIN = r"[!-~\u00a1-\u012f\u0131-\u024f]+"


class WordIds(dict):
    """Little-endian 32-bit ids of a run of bytes without white space.

    Tokenizers that drop white space never join across it, so a text's ids are
    those of its runs one after the other; likewise a run's are those of its
    parts.  Parts go through the tokenizer's merges once each.
    """

    def __init__(self, tokenizer_json: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.merges = self.tokenizer.model.tokenize
        self.parts: dict[str, bytes] = {}
        self.cut, self.plain = regex.compile(PARTS).findall, regex.compile(PLAIN).fullmatch
        self.letters = dict(enumerate(byte_letters()))

    def part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            mapped = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            found = array("I", [t.id for t in self.merges(mapped)]).tobytes()
            if len(part) <= 64:
                self.parts[part] = found
        return found

    def __missing__(self, raw: bytes) -> bytes:
        run = raw.decode()
        if self.plain(run) and "<|" not in run:
            low = run.lower()
            found = self.part(low) if low.isalpha() else b"".join(map(self.part, self.cut(low)))
        else:
            found = array("I", self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()
        if len(raw) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
                self.parts.clear()
            self[raw] = found
        return found

    def text(self, runs: list[bytes]) -> bytes:
        return b"".join(map(self.__getitem__, runs))


def runs_of(text: str) -> list[bytes]:
    """The text's runs between ASCII white space; A-Z is lowered where the tokenizer would do so anyway."""
    raw = text.encode()
    return (raw.lower() if text.isascii() and "<|" not in text else raw).split()


_WORKER: dict[str, WordIds] = {}


def cut(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of all documents: id, piece, start, length, ids_crc32."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())  # bounded by the vocabulary
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer_path not in _WORKER:
            _WORKER.clear()
            _WORKER[tokenizer_path] = WordIds(shipped.value)
        known = _WORKER[tokenizer_path]
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = known.text(runs_of(text)) + end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(k)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = T.StructType([renamed(docs.schema[id_col], "doc_id"), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in names[2:])])
    return id_text(docs, id_col, text_col).mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``lengths``: longest first, each into the fullest bin that takes it."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin with r free exists
    bins: list[list[int]] = []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[k]
        fits = some >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some &= ~(1 << room)
            bins[b].append(k)
        else:
            room, b = capacity, len(bins)
            bins.append([k])
        if room - n:
            free[room - n].append(b)
            some |= 1 << (room - n)
    return bins


class _Underfull:
    """The underfull bins, indexed by what they can give: each length of one piece, each sum of two.

    Entries of a bin that has changed since are dropped when they are met.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.fill = [sum(lengths[k] for k in b) for b in bins]
        self.version = [0] * len(bins)
        #: For one and two pieces: by size a heap of (fill, bin, version, length of one), and the sizes as bits.
        self.givers: list[list[list[tuple[int, int, int, int]]]] = [[[] for _ in range(capacity + 1)] for _ in range(2)]
        self.some = [0, 0]
        for b in range(len(bins)):
            self.enter(b)

    def sizes(self, b: int) -> tuple[list[int], list[tuple[int, int]]]:
        """Distinct lengths of a bin's pieces, and distinct pairs of lengths."""
        count = Counter(self.lengths[k] for k in self.bins[b])
        one = sorted(count)
        return one, [(n, m) for i, n in enumerate(one) for m in one[i:] if n != m or count[n] > 1]

    def enter(self, b: int) -> None:
        self.version[b] += 1
        if self.bins[b] and self.fill[b] < self.capacity:
            one, two = self.sizes(b)
            for kind, found in ((0, [(n, n) for n in one]), (1, [(n + m, n) for n, m in two])):
                for size, n in found:
                    heappush(self.givers[kind][size], (self.fill[b], b, self.version[b], n))
                    self.some[kind] |= 1 << size

    def giver(self, kind: int, size: int, y: int) -> tuple[int, int, int, int] | None:
        """The least filled bin but y that can give ``size``."""
        heap, own = self.givers[kind][size], None
        while heap and (heap[0][1] == y or self.version[heap[0][1]] != heap[0][2]):
            top = heappop(heap)
            if top[1] == y and top[2] == self.version[y]:
                own = top
        found = heap[0] if heap else None
        if own is not None:
            heappush(heap, own)
        elif found is None:
            self.some[kind] &= ~(1 << size)
        return found

    def best(self, y: int) -> tuple[int, int, tuple, tuple] | None:
        """The exchange that fills y most: (gain, bin x, lengths from x, lengths from y).

        A gain d makes the fills fy + d and fx - d: squared fill rises if d > fx - fy.
        """
        room, best = self.capacity - self.fill[y], None
        one, two = self.sizes(y)
        for take in ((), *((n,) for n in one), *two):
            out = sum(take)
            for kind in (0, 1) if len(take) < 2 else (0,):
                sizes = self.some[kind] & ((2 << (out + room)) - 1)
                while (d := (size := sizes.bit_length() - 1) - out) > (best[0] if best else 0):
                    x = self.giver(kind, size, y)
                    if x is not None and x[0] < self.fill[y] + d:
                        best = (d, x[1], (size,) if kind == 0 else (x[3], size - x[3]), take)
                        break
                    sizes ^= 1 << size
            if best and best[0] == room:
                break
        return best

    def exchange(self, y: int, d: int, x: int, give: tuple, take: tuple) -> None:
        moved = []
        for b, wanted in ((x, give), (y, take)):
            for n in wanted:
                k = next(k for k in self.bins[b] if self.lengths[k] == n)
                self.bins[b].remove(k)
                moved.append((k, y if b == x else x))
        for k, b in moved:
            self.bins[b].append(k)
        self.fill[x] -= d
        self.fill[y] += d
        self.enter(x)
        self.enter(y)


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Raise the sum of squared fill of the underfull bins until no exchange does.

    Bins can be emptied only while there are more of them than the total needs;
    at that bound the search is over.
    """
    spare = len(bins) - -(-sum(lengths) // capacity)
    state = _Underfull(bins, lengths, capacity) if spare > 0 else None
    moved = True
    while moved and spare > 0:
        moved = False
        for y in sorted((b for b in range(len(bins)) if bins[b] and state.fill[b] < capacity), key=lambda b: (-state.fill[b], b)):
            while spare > 0 and bins[y] and state.fill[y] < capacity and (found := state.best(y)):
                state.exchange(y, *found)
                moved = True
                spare -= not bins[found[1]]
    return [b for b in bins if b]


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def _pack_groups(pieces: DataFrame, groups: int, level: int, capacity: int) -> DataFrame:
    """One level: pieces with sequence_id, offset and the fill of their sequence."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].tolist()
        order, seq, offset, fill = [], [], [], []
        for b, members in enumerate(pack_lengths(lengths, capacity)):
            at, total = 0, sum(lengths[k] for k in members)
            for k in members:
                order.append(k)
                seq.append((level << 56) | (int(key[0]) << 28) | b)
                offset.append(at)
                fill.append(total)
                at += lengths[k]
        return pdf.iloc[order].drop(columns="group").assign(sequence_id=seq, offset=offset, fill=fill)

    schema = T.StructType([*pieces.schema.fields, *(T.StructField(n, T.LongType()) for n in ("sequence_id", "offset", "fill"))])
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)).cast("int"))
    return dealt.groupBy("group").applyInPandas(run, schema)


@tidy
def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    doc_id is named after ``id_col``.  Every sequence holds its pieces without
    gaps from offset 0 and has at most ``capacity`` tokens.
    """
    pieces = materialize(cut(docs, tokenizer_path, capacity, end_id, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = pieces.filter(F.col("length") == capacity)
    full = whole.select("*", ((F.lit(127).cast("long") * F.lit(1 << 56)) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, done, level, opened = pieces.filter(F.col("length") < capacity), [full], 0, math.inf
    while count := rest.count():
        groups = -(-count // GROUP)
        packed = materialize(_pack_groups(rest, groups, level, capacity), f"packed{level}")
        under = F.col("fill") < capacity
        bins = packed.filter("offset = 0").agg(F.count("*").alias("all"), F.count_if(under).alias("underfull")).first()
        if groups == 1 or bins["all"] >= opened:
            done.append(packed.drop("fill"))
            break
        done.append(packed.filter(~under).drop("fill"))
        rest, opened, level = packed.filter(under).drop("sequence_id", "offset", "fill"), bins["underfull"], level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("row").withColumnRenamed("doc_id", id_col)
