"""Byte-level BPE by DuckDB recursive queries, one database per task.

Encoding.  A task cuts its texts into words, keeps the distinct ones, and gives
DuckDB one row per (word, position, token), each knowing the token and position
that follow.  The recursive query joins these rows with the merge table and
contracts each word's leftmost pair of least rank, until no word has a pair left.
The merge table has a row for each way to cut a vocabulary entry into two
entries; its rank is the entry's id, as in rank files.

In a word longer than three cells of ``2 * longest entry`` bytes, pairs of the least rank of their own
cell and of two cells on both sides are contracted in the same round.  That gives the same
ids: before such a pair's turn, only pairs outside those cells are contracted, what grows from
one of these stays within the length of an entry and so never reaches it.  Pairs of one
rank that overlap, as in a long run of one letter, form a chain, of which every second pair is
contracted, from its left end up to the first pair that has something lower near it or
whose token would make a pair of a lower rank with its neighbours.  Words of any length take
this one way; a word within three cells contracts one pair a round.

Decoding.  The ids of each document are rows (document, position, id); joined with
the vocabulary, an ordered aggregation by document gives its bytes.

A recursive query keeps the rows of all its rounds, so it runs as many rounds as
``ROWS`` allows for its words; words that are not done go into the next query.
DuckDB stays within its memory limit and writes nothing to local disk.

Null and empty texts have no ids and decode to nothing.  Every text is handled
whole and by itself: repeated rows, null or equal ids and extra columns need no
care, an empty table gives an empty result, and nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lociq.llm.common import id_text, renamed

#: Distinct words, and their bytes, given to one recursive query, about.
WORDS, BYTES = 40_000, 400_000
#: Rows that a recursive query may keep, about.
ROWS = 6_000_000
#: Pairs of long words that one round looks at, about; the others wait for the next round.
READY = 400_000
#: Ids that are decoded at once, about.
IDS = 500_000
#: Words that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 1_000_000

#: Numbers of words that span more than three cells; in others the whole word is one cell.
WIDE = 1 << 30

ENCODE = f"""
WITH RECURSIVE r(round, word, pos, tok, nxt, npos) AS (
  SELECT 0, word, pos, tok, nxt, npos FROM start
  UNION ALL (
    WITH least AS (
      SELECT word, min(rank::BIGINT * 2147483648 + pos) AS best, arg_min(npos, rank::BIGINT * 2147483648 + pos) AS gone
      FROM r JOIN merges m ON m.l = tok AND m.r = nxt WHERE round < {{rounds}} AND word < {WIDE} GROUP BY ALL
    ), pairs AS (
      SELECT word, pos, npos, rank, pos // {{cell}} AS cell FROM r JOIN merges m ON m.l = tok AND m.r = nxt WHERE round < {{rounds}} AND word >= {WIDE}
    ), around AS (
      SELECT word, cell, min(low) OVER near AS low, min(best) OVER near AS best, sum(n) OVER (ORDER BY word, cell ROWS UNBOUNDED PRECEDING) - n AS earlier
      FROM (SELECT word, cell, min(rank) AS low, min(rank::BIGINT * 2147483648 + pos) AS best, count(*) AS n FROM pairs GROUP BY ALL)
      WINDOW near AS (PARTITION BY word ORDER BY cell RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)
    ), ready AS (
      SELECT p.word, p.pos, p.npos, p.rank, rank::BIGINT * 2147483648 + pos = best AS first FROM pairs p JOIN around USING (word, cell) WHERE rank = low AND earlier < {READY}
    ), known AS (
      SELECT e.*, x.nxt AS later, y.tok AS prior, q.pos IS NOT NULL AS late
      FROM ready e JOIN r x ON x.word = e.word AND x.pos = e.npos LEFT JOIN r y ON y.word = e.word AND y.npos = e.pos
      LEFT JOIN (SELECT p.* FROM pairs p JOIN around USING (word, cell) WHERE rank > low) q ON q.word = e.word AND q.npos = e.pos AND q.rank = e.rank
    ), linked AS (
      SELECT word, pos, npos, e.rank, first, (late OR a.rank IS NOT NULL OR b.rank IS NOT NULL OR c.rank IS NOT NULL)::INT AS stops,
             CASE WHEN lag(e.rank) OVER w = e.rank AND lag(npos) OVER w = pos THEN 0 ELSE 1 END AS opens
      FROM known e LEFT JOIN lower a ON a.l = e.rank AND a.r = later LEFT JOIN lower b ON b.l = prior AND b.r = e.rank LEFT JOIN lower c ON c.l = e.rank AND c.r = e.rank
      WINDOW w AS (PARTITION BY word ORDER BY pos)
    ), chained AS (
      SELECT *, (sum(opens) OVER (PARTITION BY word ORDER BY pos))::INT AS chain FROM linked
    ), picked AS (
      SELECT word, (best % 2147483648)::INT AS head, (best // 2147483648)::INT AS made, gone FROM least
      UNION ALL SELECT word, pos, rank, npos FROM (
        SELECT *, row_number() OVER c AS i, max(stops) OVER c AS late FROM chained WINDOW c AS (PARTITION BY word, chain ORDER BY pos)
      ) WHERE first OR (i % 2 = 1 AND late = 0)
    ), moved AS (
      SELECT p.word, p.head, p.made, p.gone, x.nxt AS then_tok, x.npos AS then_pos FROM picked p JOIN r x ON x.word = p.word AND x.pos = p.gone
    ), stepped AS (
      SELECT r.word, r.pos, coalesce(h.made, r.tok) AS tok, coalesce(h.then_tok, r.nxt) AS nxt, coalesce(h.then_pos, r.npos) AS npos
      FROM (SELECT * FROM r SEMI JOIN picked USING (word)) r ANTI JOIN moved g ON g.word = r.word AND g.gone = r.pos LEFT JOIN moved h ON h.word = r.word AND h.head = r.pos
    )
    SELECT (SELECT max(round) FROM r) + 1, s.word, s.pos, s.tok, coalesce(h.made, s.nxt), s.npos
    FROM stepped s LEFT JOIN moved h ON h.word = s.word AND h.head = s.npos
  )
)
SELECT word, round, pos, tok, nxt, npos FROM r JOIN (SELECT word, max(round) AS round FROM r GROUP BY word) USING (word, round) ORDER BY word, pos
"""
DECODE = """
SELECT doc, string_agg(bytes, '') AS bytes
FROM (SELECT doc, bytes FROM coded JOIN vocabulary USING (id) ORDER BY doc, pos) GROUP BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    rows = [(a, b, r) for x, r in ranks.items() for k in range(1, len(x)) if (a := ranks.get(x[:k])) is not None and (b := ranks.get(x[k:])) is not None]
    return pa.table({n: pa.array(c, pa.int32()) for n, c in zip("l r rank".split(), zip(*rows, strict=True) if rows else ((), (), ()), strict=True)})


class Codec:
    """Encodes distinct words and decodes documents in a DuckDB database of its own, in memory."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.cell = 2 * max(map(len, ranks))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        for name, table in (("merges", merge_table(ranks)), ("vocabulary", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": [b.decode("latin-1") for b in ranks]}))):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        # pairs whose token has a lower rank than one of its parts
        self.db.execute("CREATE TABLE lower AS SELECT * FROM merges WHERE rank < l OR rank < r")

    def _query(self, sql: str, name: str, table: pa.Table) -> pa.Table:
        self.db.register(name, table)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (bytes, not empty), as 32-bit integers one after the other."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        at = 0
        while at < len(order):
            end, size = at, 0
            while end < len(order) and (end == at or (end - at < WORDS and size + len(words[order[end]]) <= BYTES)):
                size += len(words[order[end]])
                end += 1
            part, at = order[at:end], end
            for k, ids in zip(part, self._contracted([words[k] for k in part]), strict=True):
                out[k] = ids
        return out

    def _contracted(self, words: list[bytes]) -> list[bytes]:
        sizes = np.array([len(w) for w in words])
        tok = self.single[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ends = np.cumsum(sizes)
        pos = (np.arange(len(tok)) - np.repeat(ends - sizes, sizes)).astype(np.int32)
        nxt = np.append(tok[1:], -1).astype(np.int32)
        nxt[ends - 1] = -1
        names = np.arange(len(words), dtype=np.int32) + np.where(sizes > 3 * self.cell, WIDE, 0).astype(np.int32)
        rows = pa.table({"word": np.repeat(names, sizes), "pos": pos, "tok": tok, "nxt": nxt, "npos": pos + np.int32(1)})
        out: list[bytes] = [b""] * len(words)
        while rows.num_rows:
            rounds = max(2, ROWS // rows.num_rows)
            rows = self._query(ENCODE.format(cell=self.cell, rounds=rounds), "start", rows)
            word, flat = rows.column("word").to_numpy(), rows.column("tok").to_numpy()
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            done = rows.column("round").to_numpy()[begins] < rounds
            for k, lo, hi, whole in zip((word[begins] % WIDE).tolist(), begins.tolist(), [*begins[1:].tolist(), len(word)], done.tolist(), strict=True):
                if whole:
                    out[k] = flat[lo:hi].tobytes()
            rows = rows.filter(pa.array(~np.repeat(done, np.diff(np.append(begins, len(word)))))).drop_columns("round")
        return out

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of each document's ids."""
        out: list[bytes] = []
        at = 0
        while at < len(ids):
            end, size = at, 0
            while end < len(ids) and (end == at or size + len(ids[end]) <= IDS):
                size += len(ids[end])
                end += 1
            part, at = ids[at:end], end
            sizes = np.array([len(x) for x in part])
            flat, ends = np.concatenate(part), np.cumsum(sizes)
            coded = pa.table({"doc": np.repeat(np.arange(len(part), dtype=np.int32), sizes), "pos": np.arange(len(flat)) - np.repeat(ends - sizes, sizes), "id": flat})
            found = self._query(DECODE, "coded", coded)
            texts = dict(zip(found.column("doc").to_pylist(), found.column("bytes").to_pylist(), strict=True))
            out += [texts.get(k, "").encode("latin-1") for k in range(len(part))]
        return out


class Words(dict):
    """Pre-token -> its ids, as 32-bit integers, learnt in blocks."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def learn(self, words: set[str]) -> None:
        if len(self) + len(words) > REMEMBERED:
            self.clear()
        new = list(words.difference(self))
        if new:
            self.update(zip(new, self.codec.encode_words([w.encode() for w in new]), strict=True))


_WORKER: dict[str, tuple[object, Words]] = {}


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: id, n_tokens, ids (array, if ``with_ids``), ids_sha256 and decoded_sha256.

    ids_sha256 is over the decimal ids joined by commas, decoded_sha256 over the
    bytes that decoding the ids gives.  The rank file is broadcast; the
    vocabulary bounds its size.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    key = f"{ranks_path}:{pattern}"

    def run(batches):
        import regex

        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = (regex.compile(pattern).findall, Words(Codec(ranks.value)))
        find, known = _WORKER[key]
        decimal = list(map(str, range(max(ranks.value.values()) + 1)))
        for whole in batches:
            for batch in (whole.slice(k, 1000) for k in range(0, whole.num_rows, 1000)):
                texts = [find(t) for t in batch.column(1).to_pylist()]
                known.learn(set().union(*texts))
                ids = [np.frombuffer(b"".join(map(known.__getitem__, words)), dtype=np.int32) for words in texts]
                ids_sha = [hashlib.sha256(",".join(map(decimal.__getitem__, x.tolist())).encode()).hexdigest() for x in ids]
                decoded_sha = [hashlib.sha256(b).hexdigest() for b in known.codec.decode(ids)]
                columns = [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema_names)

    fields = [renamed(docs.schema[id_col], id_col), T.StructField("n_tokens", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType([*fields, T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    schema_names = schema.fieldNames()
    return id_text(docs, id_col, text_col).mapInArrow(run, schema)
