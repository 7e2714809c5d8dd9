"""Chat formatting: transcript parsing by a hidden Markov model, then canonical turns.

Rows of a conversation, in the order of their turn number, are cut into lines; the
lines are the observations.  A state says who speaks and whether the line begins a
turn or goes on with one.  What is seen of a line: the speaker marker at its start
(as "User:" or "### Assistant"), its length, whether it asks, its shape (text, blank,
list or code).  A row begins a turn; within a row a line begins one with a prior of
``CUT``, so a whole transcript in one text is parsed into its turns.

A line within a row that begins a turn nearly always bears its speaker's marker; the
first line of a row need not.

Training.  Where the table names the speaker of a row, that is a label: its first
line begins a turn of that role and the others go on with it.  A row with a marker
after its first line may hold several turns and is not counted.  Start, step and
emission probabilities are counts over all labelled rows, mixed with fixed priors
(``PRIOR`` and ``ANY`` of the weight), by which a table without labels is parsed too.  Parsing
does not look at the labels, unless ``trust`` says how often they are right; the
labels are returned beside the roles, so their agreement measures the parser.

Viterbi finds the likeliest states of whole conversations.  Each turn is rendered:
<|role|>, its lines without its own marker, <|end|>.

Any length.  Rows are sorted by range over all tasks and packed into segments of
about ``SEGMENT`` lines, so a conversation may cross segments and tasks.  All lines in
order are one chain, in which the first line of a conversation does not depend on
what came before.  A run of lines is summed up by its max-plus product, a matrix of
best totals between states; products are combined by segment, task and ``FAN`` tasks,
solved at the top and handed down, as tables, until each segment knows the state
before it and the state at its end; then it is solved by itself.  Totals are whole
numbers, so their order of addition does not matter, and a hash of the line adds less
than 2^-22 to each so that ties end alike: segments and partitions change nothing.

A null turn number sorts first, ties by a hash of number and text, then text.  A null
text is an empty turn; rows of a null conversation are one conversation.  Repeated
rows are turns of their own.  A very long text is one row of a segment.  Extra columns
are ignored, a result column whose name is taken gets a number, an empty table gives
an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociq.llm.common import fresh, materialize, renamed, tidy

ROLES = ("system", "user", "assistant")
N = len(ROLES)
#: States: a role's turn begins (0, 1, 2) or goes on (3, 4, 5).
STATES = 2 * N
#: Probability that a line within a row begins a turn, before it is looked at.
CUT = 0.01
#: Weight of the fixed priors beside the counts: of roles and markers, and of what any line may look like.
PRIOR, ANY = 0.05, 0.3
#: Lines and bytes of a segment, lines of a piece within it, tasks whose products are combined at once; about.
SEGMENT, SEGMENT_BYTES, PIECE, FAN = 16_384, 4 << 20, 64, 1024
# Names by which transcripts mark each speaker.
MARKERS = {"system": ("system", "instruction", "instructions"), "user": ("user", "human", "customer", "q", "question"), "assistant": ("assistant", "ai", "bot", "agent", "a", "answer")}
_ROLE_OF = {name: k for k, r in enumerate(ROLES) for name in MARKERS[r]}
_NAMES = "|".join(sorted(_ROLE_OF, key=lambda n: (-len(n), n)))
#: A name before a colon, or a name in marks of its own on a line of its own.
_MARKER = re.compile(rf"\s*(?:[#>*\[<|]+\s*)?({_NAMES})\s*[*\]|>]*\s*:[*\s]*|\s*(?:#+\s*|\*+|<\|?|\[)({_NAMES})\s*(?:\*+|\|?>|\])?\s*$", re.IGNORECASE)
_LISTED = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s|\s{4}\S|\t\S|```")
#: Sizes of the features of a line: marker (none or a role), length, asks, shape; a line's code counts through them.
FEATURES = {"marker": 4, "length": 8, "asks": 2, "shape": 3}
CODES = math.prod(FEATURES.values())
#: One unit of probability's logarithm in the whole-number totals, and what stands for impossible.
UNIT, NEVER = 1 << 32, -(1 << 46)


def marked(line: str) -> tuple[int, int]:
    """Role of the line's marker (-1: none) and the marker's length."""
    m = _MARKER.match(line)
    return (_ROLE_OF[(m.group(1) or m.group(2)).lower()], m.end()) if m else (-1, 0)


def code_of(line: str) -> int:
    shape = 1 if not line.strip() else 2 if _LISTED.match(line) else 0
    length = min(7, int(math.log2(len(line) + 1) / 1.5))
    asks = line.rstrip()[-1:] in ("?", "？", "؟")
    return (((marked(line)[0] + 1) * 8 + length) * 2 + asks) * 3 + shape


def _features_of_codes() -> dict[str, np.ndarray]:
    c = np.arange(CODES)
    return {"marker": c // 48, "length": c // 6 % 8, "asks": c // 3 % 2, "shape": c % 3}


# ---- the model


def _mixed(counts: np.ndarray, prior: np.ndarray, weight: float = PRIOR) -> np.ndarray:
    """Logarithms, in units, of the counts' shares mixed with a prior (rows add up to 1)."""
    prior = np.broadcast_to(prior, counts.shape) / np.broadcast_to(prior, counts.shape).sum(axis=-1, keepdims=True)
    total = counts.sum(axis=-1, keepdims=True)
    share = np.where(total > 0, (1 - weight) * counts / np.maximum(total, 1) + weight * prior, prior)
    return np.round(np.log(share) * UNIT).astype(np.int64)


class Model:
    """Whole-number scores: ``emission`` [first of a row, state, code], ``steps`` [kind of line, state before, state].

    Kinds of line: 0 within a row, 1 first of a row, 2 first of a conversation.
    """

    def __init__(self, start: np.ndarray, step: np.ndarray, emission: np.ndarray):
        begins = _mixed(start.astype(float), np.array([0.3, 0.6, 0.1]))
        turns = _mixed(step.astype(float), np.array([[0.04, 0.9, 0.06], [0.02, 0.08, 0.9], [0.02, 0.9, 0.08]]))
        features = _features_of_codes()
        own = np.full((STATES, 4), 0.001)
        own[:, 0] = 0.2
        own[np.arange(N), np.arange(N) + 1] = 0.8  # a turn often begins with its speaker's marker
        own[N:] = (0.99, 1e-6, 1e-6, 1e-6)
        own[np.arange(N) + N, np.arange(N) + 1] = 0.01  # and may hold it again; another's marker is rare within
        within = own.copy()
        within[:N, 0] = 0.005
        self.emission = np.zeros((2, STATES, CODES), dtype=np.int64)
        for name, size in FEATURES.items():
            counts = np.stack([np.bincount(features[name], weights=emission[s], minlength=size) for s in range(STATES)])
            for first in (0, 1):
                if name != "marker":
                    table = _mixed(counts, np.ones(size), ANY)
                elif first:
                    table = _mixed(counts, own)
                else:
                    table = _mixed(np.where(np.arange(STATES)[:, None] < N, 0, counts), within)
                self.emission[first] += table[:, features[name]]
        self.steps = np.full((3, STATES, STATES), NEVER, dtype=np.int64)
        role = np.arange(STATES) % N
        self.steps[0, :, :N] = round(math.log(CUT) * UNIT) + turns[role]
        self.steps[0, np.arange(STATES), role + N] = round(math.log(1 - CUT) * UNIT)
        self.steps[1, :, :N] = turns[role]
        self.steps[2, :, :N] = begins

    def scores(self, kinds: np.ndarray, codes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """[line, state]; ``keys`` are hashes of the lines, for ties."""
        mixed = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        tie = (mixed[:, None] >> (np.uint64(10) * np.arange(STATES, dtype=np.uint64))[None, :]) & np.uint64(1023)
        return self.emission[np.minimum(kinds, 1), :, codes] + tie.astype(np.int64)


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; a constant is taken away, which changes no comparison."""
    m = (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)
    return np.maximum(m - m.max(axis=(-2, -1), keepdims=True), 4 * NEVER)


def _padded(kinds: np.ndarray, score: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines in pieces: [piece, place] of kinds (3: no line) and scores, and the steps with those of "no line"."""
    pieces = -(-len(kinds) // PIECE)
    k, s = np.full(pieces * PIECE, 3), np.zeros((pieces * PIECE, STATES), dtype=np.int64)
    k[: len(kinds)], s[: len(kinds)] = kinds, score
    stay = np.where(np.eye(STATES, dtype=bool), 0, NEVER)[None]
    return k.reshape(pieces, PIECE), s.reshape(pieces, PIECE, STATES), np.concatenate([steps, stay])


def products(kinds: np.ndarray, score: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """[piece, state before, state at its end]: best totals, all pieces side by side."""
    k, s, steps = _padded(kinds, score, steps)
    m = steps[k[:, 0]] + s[:, 0][:, None, :]
    for t in range(1, PIECE):
        m = (m[:, :, :, None] + steps[k[:, t]][:, None, :, :]).max(axis=2) + s[:, t][:, None, :]
    return compose(m, np.where(np.eye(STATES, dtype=bool), 0, NEVER)[None])


def chained(m: np.ndarray, before: int, end: int) -> list[tuple[int, int]]:
    """For products in order: each one's state before it and at its end, given those of all (end -1: the best)."""
    forward = [np.where(np.arange(STATES) == before, 0, NEVER)]
    for x in m:
        v = (forward[-1][:, None] + x).max(axis=0)
        forward.append(np.maximum(v - v.max(), 4 * NEVER))
    s = int(forward[-1].argmax()) if end < 0 else end
    out = []
    for x, v in zip(m[::-1], forward[-2::-1], strict=True):
        p = int((v + x[:, s]).argmax())
        out.append((p, s))
        s = p
    return out[::-1]


def path(kinds: np.ndarray, score: np.ndarray, steps: np.ndarray, before: int, end: int) -> np.ndarray:
    """Likeliest state of each line, given the state before the first and at the last (-1: any)."""
    if not len(kinds):
        return np.array([], dtype=np.int64)
    cuts = chained(products(kinds, score, steps), before, end)
    k, s, steps = _padded(kinds, score, steps)
    at = np.arange(len(k))
    v = steps[k[:, 0], [b for b, _ in cuts]] + s[:, 0]
    back = np.zeros((PIECE, len(k), STATES), dtype=np.int8)
    for t in range(1, PIECE):
        x = v[:, :, None] + steps[k[:, t]]
        back[t] = x.argmax(axis=1)
        v = x.max(axis=1) + s[:, t]
    states = np.empty((len(k), PIECE), dtype=np.int64)
    states[:, -1] = [e for _, e in cuts]
    for t in range(PIECE - 1, 0, -1):
        states[:, t - 1] = back[t][at, states[:, t]]
    return states.ravel()[: len(kinds)]


# ---- rows to segments


def _rows(turns: DataFrame, conv_col: str, turn_col: str, role_col: str | None, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    role = F.lower(F.trim(F.col(f"`{role_col}`"))) if role_col else F.lit(None).cast("string")
    given = F.lit(-1)
    for k, r in enumerate(ROLES):
        given = F.when(role.isin(r, *MARKERS[r]), k).otherwise(given)
    turn = F.col(f"`{turn_col}`")
    return turns.select(F.col(f"`{conv_col}`").alias("conv"), turn.alias("turn"), text.alias("text"), given.cast("int").alias("given"), F.xxhash64(turn.cast("string"), text).alias("key"))


def _same(a, b) -> bool:
    return a == b or (a != a and b != b)


_BLOBS = {"given": np.int8, "lens": np.int32, "codes": np.uint8, "keys": np.int64, "begins": np.int32}


def _segments(rows: DataFrame) -> DataFrame:
    """Sorted rows packed into segments, a row each.

    ``opens``: does its first row begin a conversation (null: the first of a task, not
    known yet); ``prior``: label of the row before in that conversation; ``begins``:
    the other rows that begin one.  Labels of rows that may hold several turns are -1.
    """
    from pyspark import TaskContext

    conv, turn = rows.schema["conv"].dataType, rows.schema["turn"].dataType
    schema = T.StructType([T.StructField("task", T.LongType()), T.StructField("segment", T.LongType()), T.StructField("opens", T.BooleanType()), T.StructField("prior", T.IntegerType()), T.StructField("first_conv", conv), T.StructField("last_conv", conv), T.StructField("first_given", T.IntegerType()), T.StructField("last_given", T.IntegerType()), T.StructField("convs", T.ArrayType(conv)), T.StructField("turns", T.ArrayType(turn)), T.StructField("texts", T.ArrayType(T.StringType())), *(T.StructField(n, T.BinaryType()) for n in _BLOBS)])
    cast = None

    def run(batches):
        nonlocal cast
        task, segment = TaskContext.get().partitionId(), 0
        parts, blobs, lines, size, opens, prior = [], {n: [] for n in _BLOBS}, 0, 0, None, -1
        last, label, first = None, -1, True

        def emit():
            columns = [pa.concat_arrays([p.column(k) for p in parts]) for k in range(3)]
            n = len(columns[0])
            as_list = lambda x: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x)
            given = blobs["given"]
            ends = [columns[0].slice(0, 1), columns[0].slice(n - 1, 1), pa.array([given[0]], pa.int32()), pa.array([given[-1]], pa.int32())]
            numbers = [pa.array([task], pa.int64()), pa.array([(task << 32) | segment], pa.int64()), pa.array([opens], pa.bool_()), pa.array([prior], pa.int32())]
            return pa.RecordBatch.from_arrays([*numbers, *ends, *map(as_list, columns), *(pa.array([np.array(v, dtype=_BLOBS[k]).tobytes()], pa.binary()) for k, v in blobs.items())], names=schema.fieldNames())

        for batch in batches:
            lo = 0
            convs, texts, givens, keys = (batch.column(k).to_pylist() for k in (0, 2, 3, 4))
            for k, (c, text, given, key) in enumerate(zip(convs, texts, givens, keys, strict=True)):
                begins = not first and not _same(c, last)
                if not blobs["lens"]:
                    opens, prior = (None, -1) if first else (begins, -1 if begins else label)
                elif begins:
                    blobs["begins"].append(len(blobs["lens"]))
                codes = [code_of(x) for x in text.split("\n")]
                label = given if all(x < 48 for x in codes[1:]) else -1
                blobs["given"].append(label)
                blobs["lens"].append(len(codes))
                blobs["codes"] += codes
                blobs["keys"].append(key)
                last, first = c, False
                lines, size = lines + len(codes), size + len(text)
                if lines >= SEGMENT or size >= SEGMENT_BYTES:
                    parts.append(batch.slice(lo, k + 1 - lo))
                    yield emit()
                    parts, blobs, lines, size, lo, segment = [], {n: [] for n in _BLOBS}, 0, 0, k + 1, segment + 1
            if lo < batch.num_rows:
                parts.append(batch.slice(lo))
        if blobs["lens"]:
            yield emit()

    ordered = rows.repartitionByRange("conv", "turn", "key").sortWithinPartitions("conv", "turn", "key", "text", "given")
    parts = max(1, rows.rdd.getNumPartitions())
    return materialize(ordered.mapInArrow(run, schema), "segments", (min(8192, max(4, 4 * parts)), "task"))


def _each(batches):
    """Segments of batches, as dictionaries; binary columns as arrays."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield row | {n: np.frombuffer(row[n], dtype=kind) for n, kind in _BLOBS.items() if n in row}


def _kinds(row: dict, opens: bool) -> np.ndarray:
    out = np.zeros(len(row["codes"]), dtype=np.int64)
    first = np.cumsum(row["lens"]) - row["lens"]
    out[first] = 1
    out[first[row["begins"]]] = 2
    out[0] = 2 if opens else 1
    return out


def _scored(row: dict, kinds: np.ndarray, model: Model, trust: float | None) -> np.ndarray:
    lens = row["lens"]
    first = np.cumsum(lens) - lens
    place = np.arange(len(row["codes"])) - np.repeat(first, lens)
    keys = np.repeat(row["keys"].view(np.uint64), lens) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    score = model.scores(kinds, row["codes"], keys)
    if trust is not None:
        known = np.flatnonzero(row["given"] >= 0)
        score[first[known], :N] += round(math.log((1 - trust) / (N - 1)) * UNIT)
        score[first[known], row["given"][known]] += round((math.log(trust) - math.log((1 - trust) / (N - 1))) * UNIT)
    return score


# ---- counts


def _counts(batches):
    """Sparse counts of a segment: emissions (state, code), steps (role before, role), starts (role)."""
    for row in _each(batches):
        given, lens = row["given"].astype(np.int64), row["lens"]
        state = np.repeat(np.where(given >= 0, given + N, -1), lens)
        first = np.cumsum(lens) - lens
        state[first] = given
        known = state >= 0
        cells = np.bincount(state[known] * CODES + row["codes"][known], minlength=STATES * CODES)
        before = np.append(row["prior"], given[:-1])
        begins = np.zeros(len(given), dtype=bool)
        begins[row["begins"]] = True
        begins[0] = bool(row["opens"])
        counted = np.ones(len(given), dtype=bool)
        counted[0] = row["opens"] is not None
        steps = np.bincount((before * N + given)[counted & ~begins & (before >= 0) & (given >= 0)], minlength=N * N)
        starts = np.bincount(given[counted & begins & (given >= 0)], minlength=N)
        found = [("emission", int(k) // CODES, int(k) % CODES, int(cells[k])) for k in np.flatnonzero(cells)]
        found += [("step", int(k) // N, int(k) % N, int(steps[k])) for k in np.flatnonzero(steps)]
        found += [("start", 0, int(k), int(starts[k])) for k in np.flatnonzero(starts)]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), *(pa.array([f[j] for f in found], pa.int64()) for j in (1, 2, 3))], names=["kind", "a", "b", "n"])


def _heads(segments: DataFrame) -> DataFrame:
    """Per task: does its first row begin a conversation, and that row's label and the label before it.  A row a task."""
    task = segments.groupBy("task").agg(F.min_by(F.struct("first_conv", "first_given"), "segment").alias("head"), F.max_by(F.struct("last_conv", "last_given"), "segment").alias("tail"))
    before = F.lag("tail").over(Window.orderBy("task"))
    found = task.withColumn("before", before).withColumn("opens", F.col("before").isNull() | ~F.col("before.last_conv").eqNullSafe(F.col("head.first_conv")))
    return materialize(found.select("task", F.col("opens").alias("task_opens"), F.col("head.first_given").alias("label"), F.col("before.last_given").alias("label_before")), "heads")


def fit(segments: DataFrame, heads: DataFrame) -> Model:
    """Counts over all labelled rows: STATES * CODES + N * N + N sums at most reach the driver."""
    inside = segments.select("opens", "prior", "given", "lens", "codes", "begins").mapInArrow(_counts, "kind string, a long, b long, n long")
    between = heads.filter("label >= 0 and (task_opens or label_before >= 0)").select(F.when(F.col("task_opens"), "start").otherwise("step").alias("kind"), F.when(F.col("task_opens"), 0).otherwise(F.col("label_before")).cast("long").alias("a"), F.col("label").cast("long").alias("b"), F.lit(1).cast("long").alias("n"))
    tables = {"emission": np.zeros((STATES, CODES)), "step": np.zeros((N, N)), "start": np.zeros((1, N))}
    for r in inside.unionByName(between).groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect():
        tables[r["kind"]][r["a"], r["b"]] += r["n"]
    return Model(tables["start"][0], tables["step"], tables["emission"])


# ---- the chain of segments


def _total(m: np.ndarray) -> np.ndarray:
    out = m[0]
    for x in m[1:]:
        out = compose(out, x)
    return out


def _matrices(blobs) -> np.ndarray:
    return np.stack([np.frombuffer(b, dtype=np.int64).reshape(STATES, STATES) for b in blobs])


def _product(key, pdf: pd.DataFrame) -> pd.DataFrame:
    m = _matrices(pdf.sort_values("id")["m"])
    return pd.DataFrame({"id": [int(key[0])], "m": [_total(m).tobytes()]})


def _handed_down(key, links: pd.DataFrame, solved: pd.DataFrame) -> pd.DataFrame:
    links = links.sort_values("id")
    before, end = (int(solved[c].iloc[0]) for c in ("before", "end")) if len(solved) else (0, -1)
    cuts = chained(_matrices(links["m"]), before, end)
    return pd.DataFrame({"id": links["id"].to_numpy(), "before": [b for b, _ in cuts], "end": [e for _, e in cuts]})


def _solved(links: DataFrame) -> DataFrame:
    """id, before, end of links (id, up, m) in order of id; ``up`` names the group of the level above, null at the top."""
    found = "id long, before int, end int"
    top = links.filter("up is not null").limit(1).count() == 0
    groups = links.withColumn("up", F.coalesce("up", F.lit(0).cast("long"))).groupBy("up")
    if top:
        none = links.sparkSession.createDataFrame([], "up long, before int, end int")
        return groups.cogroup(none.groupBy("up")).applyInPandas(_handed_down, found)
    above = materialize(groups.applyInPandas(_product, "id long, m binary"), "products")
    several = above.limit(2).count() > 1
    up = (F.col("id") / FAN).cast("long") if several else F.lit(None).cast("long")
    solved = _solved(above.withColumn("up", up))
    return materialize(groups.cogroup(solved.withColumnRenamed("id", "up").groupBy("up")).applyInPandas(_handed_down, found), "handed_down")


# ---- all together


@tidy
def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str | None = "role", text_col: str = "text", trust: float | None = None) -> DataFrame:
    """Per parsed turn: conversation, turn (of its row), part (within the row, from 0), role, given_role (the row's label), rendered."""
    segments = _segments(_rows(turns, conv_col, turn_col, role_col, text_col))
    heads = _heads(segments)
    model = fit(segments, heads)
    told = heads.select("task", "task_opens").hint("shuffle_hash")

    def summed(batches):
        for row in _each(batches):
            opens = row["task_opens"] if row["opens"] is None else row["opens"]
            kinds = _kinds(row, opens)
            m = _total(products(kinds, _scored(row, kinds, model, trust), model.steps))
            yield pa.RecordBatch.from_arrays([pa.array([row["segment"]], pa.int64()), pa.array([row["task"]], pa.int64()), pa.array([m.tobytes()], pa.binary())], names=["id", "up", "m"])

    links = materialize(segments.join(told, "task").select("task", "segment", "opens", "task_opens", *_BLOBS).mapInArrow(summed, "id long, up long, m binary"), "links")
    cuts = _solved(links).groupBy(F.shiftright("id", 32).alias("task")).agg(F.collect_list(F.struct("id", "before", "end")).alias("cuts"))
    taken, names = [], []
    for n in (conv_col, turn_col, "part", "role", "given_role", "rendered"):
        names.append(fresh(taken, n))
        taken.append(names[-1])

    def parsed(batches):
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in ("convs", "turns")}
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                convs, numbers = (one.column(at[n]).flatten() for n in ("convs", "turns"))
                (row,) = _each([one.drop_columns(["convs", "turns"])])
                cut = next(c for c in row["cuts"] if c["id"] == row["segment"])
                opens = row["task_opens"] if row["opens"] is None else row["opens"]
                kinds = _kinds(row, opens)
                states = path(kinds, _scored(row, kinds, model, trust), model.steps, cut["before"], cut["end"])
                whose, part, role, rendered = [], [], [], []
                line = 0
                for r, text in enumerate(row["texts"]):
                    lines = text.split("\n")
                    own = states[line : line + len(lines)]
                    line += len(lines)
                    begins = [*np.flatnonzero(own < N).tolist(), len(lines)]
                    for j, (lo, hi) in enumerate(zip(begins, begins[1:], strict=False)):
                        whose.append(r)
                        part.append(j)
                        role.append(ROLES[own[lo]])
                        rendered.append(_rendered(lines[lo:hi], int(own[lo]), len(begins) > 2))
                index = pa.array(whose, pa.int64())
                given = [ROLES[row["given"][r]] if row["given"][r] >= 0 else None for r in whose]
                yield pa.RecordBatch.from_arrays([convs.take(index), numbers.take(index), pa.array(part, pa.int32()), pa.array(role, pa.string()), pa.array(given, pa.string()), pa.array(rendered, pa.string())], names=names)

    schema = T.StructType([renamed(turns.schema[conv_col], names[0]), renamed(turns.schema[turn_col], names[1]), T.StructField(names[2], T.IntegerType()), *(T.StructField(n, T.StringType()) for n in names[3:])])
    both = segments.join(told, "task").join(cuts.hint("shuffle_hash"), "task")
    return both.select("segment", "opens", "task_opens", "cuts", "convs", "turns", "texts", *_BLOBS).mapInArrow(parsed, schema)


def _rendered(lines: list[str], role: int, one_of_several: bool) -> str:
    said, end = marked(lines[0])
    if said == role:
        rest = lines[0][end:]
        lines = [rest, *lines[1:]] if rest or len(lines) == 1 else lines[1:]
    text = "\n".join(lines)
    return f"<|{ROLES[role]}|>\n{text.strip(chr(10)) if one_of_several else text}<|end|>\n"
