"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Senders.  A task reads its rows in chunks (a chunk is a sender), normalises
   the texts, hashes them, and reduces each hash to a fingerprint below
   rows * ``SPREAD``.  Distinct fingerprints are sorted, cut by owner (an owner
   is a range of fingerprints) and their gaps Golomb-Rice coded: about
   log2(senders * SPREAD) + 1.5 bits a text.
2. Owners.  Only these codes are shuffled.  An owner decodes the lists of all
   senders and answers each with a bitmap: which of its fingerprints came from
   another sender too.
3. Suspects.  Senders' rows lie in bucket files by sender, so the bitmaps go to
   the rows and the rows stay.  A row is a suspect if its bit is set or its
   fingerprint occurs twice within its sender; all others are unique.
4. Verification.  Only suspects are shuffled: they are grouped by the normalised
   text itself, byte for byte, after a map-side combine, so a group of any size
   sends one row from each task.  The verdict on a group that holds a large part
   of all rows is broadcast to them (``common.spread_join``).

There are at most ``OWNERS`` owners, so that a code holds several fingerprints
however many rows there are; beyond that an owner answers for more of them.

Texts are equal if identical once A-Z are lowered; null counts as empty.  Of
equal texts the row with the largest id stays (a null id is less than any);
among rows that have both in common, one stays.  Extra columns pass through; a
result column whose name is taken gets a number.  An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociq.llm.common import HOT, fresh, materialize, spread_join, tidy

#: Fingerprints for each row: a row that is unique becomes a suspect with probability of about 1 / SPREAD.
SPREAD = 256
#: Rows that an owner answers for, and rows in a sender, at most about.
PER_OWNER, PER_SENDER = 500_000, 32_768
OWNERS = PER_SENDER // 8
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct non-negative integers -> Rice parameter, count, unary quotients, remainders."""
    n = len(values)
    if n == 0:
        return b""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    k = max(0, int(np.floor(np.log2(max(1.0, float(values[-1]) / n * 0.69)))))
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + n, dtype=np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1  # zeros, then a one, for each gap
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.uint8).ravel()
    return bytes([k]) + n.to_bytes(4, "little") + len(unary).to_bytes(4, "little") + np.packbits(unary).tobytes() + np.packbits(low).tobytes()


def golomb_decode(code: bytes) -> np.ndarray:
    if not code:
        return np.array([], dtype=np.uint64)
    k, n, length = code[0], int.from_bytes(code[1:5], "little"), int.from_bytes(code[5:9], "little")
    split = 9 + -(-length // 8)
    unary = np.unpackbits(np.frombuffer(code[9:split], dtype=np.uint8))[:length]
    quotient = np.diff(np.flatnonzero(unary), prepend=-1) - 1
    low = np.unpackbits(np.frombuffer(code[split:], dtype=np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
    rest = (low << np.arange(k, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64) if k else np.zeros(n, dtype=np.uint64)
    return np.cumsum((quotient.astype(np.uint64) << np.uint64(k)) + rest, dtype=np.uint64)


def normalise(text: str | None) -> bytes:
    return (text or "").encode().lower()  # bytes.lower() changes A-Z alone


def _spool(docs: DataFrame, text_col: str, universe: int, owners: int, p: str) -> DataFrame:
    """Rows with sender, rank of their fingerprint, and, in the first row of a sender, its codes."""
    from pyspark import TaskContext

    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(f"{p}sha", T.StringType()), T.StructField(f"{p}sender", T.LongType()), T.StructField(f"{p}row", T.IntegerType()), T.StructField(f"{p}rank", T.IntegerType()), T.StructField(f"{p}twice", T.BooleanType()), T.StructField(f"{p}codes", T.ArrayType(T.StructType([T.StructField("owner", T.IntegerType()), T.StructField("code", T.BinaryType())])))])
    codes_type = pa.list_(pa.struct([("owner", pa.int32()), ("code", pa.binary())]))
    width = -(-universe // owners)

    def emit(batch, sender):
        texts = [normalise(t) for t in batch.column(at).to_pylist()]
        digests = [hashlib.sha256(t).digest() for t in texts]
        prints = np.array([int.from_bytes(d[:8], "little") % universe for d in digests], dtype=np.uint64)
        distinct, rank, count = np.unique(prints, return_inverse=True, return_counts=True)
        owner = (distinct // np.uint64(width)).astype(np.int64)
        bounds = np.searchsorted(owner, np.arange(owners + 1))
        codes = [{"owner": o, "code": golomb_encode(distinct[bounds[o] : bounds[o + 1]] - np.uint64(o * width))} for o in np.unique(owner).tolist()]
        n = batch.num_rows
        columns = [pa.array([d.hex() for d in digests], pa.string()), pa.array([sender] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(rank.astype(np.int32)), pa.array(count[rank] > 1), pa.array([codes] + [None] * (n - 1), codes_type)]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.fieldNames())

    def run(batches):
        sender = TaskContext.get().partitionId() << 32
        held, rows, size = [], 0, 0
        for batch in batches:
            for part in (batch.slice(k, PER_SENDER) for k in range(0, batch.num_rows, PER_SENDER)):
                # a sender is whole before its codes are made: at most PER_SENDER rows, and at most 64 MB of text beyond one batch
                held.append(part)
                rows, size = rows + part.num_rows, size + part.nbytes
                if rows >= PER_SENDER or size >= 64 << 20:
                    yield emit(pa.concat_batches(held), sender)
                    sender, held, rows, size = sender + 1, [], 0, 0
        if rows:
            yield emit(pa.concat_batches(held), sender)

    return docs.mapInArrow(run, schema)


def _answer(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps: for each sender, which of its fingerprints others sent too."""
    lists = [golomb_decode(c) for c in pdf["code"]]
    values, count = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[count > 1]
    return pd.DataFrame({"sender": pdf["sender"], "owner": pdf["owner"], "n": [len(x) for x in lists], "bits": [np.packbits(np.isin(x, shared, assume_unique=True), bitorder="little").tobytes() for x in lists]})


def _bitmap(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """A sender's bitmaps joined in owner order: a bit for each rank, 4 KB at most for PER_SENDER rows."""
    pdf = pdf.sort_values("owner")
    bits = np.concatenate([np.unpackbits(np.frombuffer(b, dtype=np.uint8), bitorder="little")[:n] for b, n in zip(pdf["bits"], pdf["n"], strict=True)])
    return pd.DataFrame({"sender": [int(key[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


@tidy
def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256, one row for each row."""
    spark = docs.sparkSession
    n_rows = docs.count()
    owners = max(1, min(OWNERS, max(-(-n_rows // PER_OWNER), min(64, n_rows // 4096))))
    p = fresh([c[:6] for c in docs.columns], "__fp")
    senders = max(1, docs.rdd.getNumPartitions()) if n_rows else 1
    buckets = min(8192, max(4, 4 * senders))
    rows = materialize(_spool(docs, text_col, max(1, n_rows) * SPREAD, owners, p), "fingerprints", (buckets, f"{p}sender"))
    codes = rows.filter(F.col(f"{p}codes").isNotNull()).select(F.col(f"{p}sender").alias("sender"), F.explode(f"{p}codes").alias("c")).select("sender", "c.owner", "c.code")
    bitmaps = codes.groupBy("owner").applyInPandas(_answer, "sender long, owner int, n int, bits binary")
    answers = materialize(bitmaps.groupBy("sender").applyInPandas(_bitmap, "sender long, bits binary"), "bitmaps")
    answers = answers.select(F.col("sender").alias(f"{p}sender"), F.col("bits").alias(f"{p}bits"))
    rank = F.col(f"{p}rank")
    byte = F.conv(F.hex(F.substring(F.col(f"{p}bits"), F.floor(rank / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.getbit(byte, F.pmod(rank, F.lit(8))) == 1, F.lit(False))
    # joined by sender alone, the column of the bucket files: the rows stay where they are
    marked = rows.drop(f"{p}codes").join(answers.hint("shuffle_hash"), f"{p}sender", "left").withColumn(f"{p}suspect", F.col(f"{p}twice") | bit)
    who = F.struct(F.col(f"`{id_col}`").alias("id"), F.col(f"{p}sender").alias("sender"), F.col(f"{p}row").alias("row"))
    suspects = marked.filter(f"{p}suspect")
    norm = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), UPPER, UPPER.lower())
    groups = suspects.groupBy(f"{p}sha", norm.alias(f"{p}norm")).agg(F.max(who).alias(f"{p}who"), F.count("*").alias(f"{p}size")).filter(F.col(f"{p}size") > 1).drop(f"{p}norm")
    groups = materialize(groups, "copies")
    size = F.coalesce(F.col(f"{p}size"), F.lit(1)).cast("long")
    keep = F.when(F.col(f"{p}size").isNull(), F.col(f"`{id_col}`")).otherwise(F.col(f"{p}who.id"))
    kept = F.col(f"{p}size").isNull() | ((F.col(f"{p}who.sender") == F.col(f"{p}sender")) & (F.col(f"{p}who.row") == F.col(f"{p}row")))

    def result(frame: DataFrame, *values) -> DataFrame:
        taken, out = list(docs.columns), []
        for name, value in zip(("keep_id", "group_size", "kept", "text_sha256"), values, strict=True):
            out.append(value.alias(name := fresh(taken, name)))
            taken.append(name)
        return frame.select(*(F.col(f"`{c}`") for c in docs.columns), *out)

    unique = result(marked.filter(~F.col(f"{p}suspect")), F.col(f"`{id_col}`"), F.lit(1).cast("long"), F.lit(True), F.col(f"{p}sha"))
    judged = spread_join(suspects, groups, [f"{p}sha"], F.col(f"{p}size") * HOT > F.lit(n_rows))
    return unique.unionByName(result(judged, keep, size, kept, F.col(f"{p}sha")))
