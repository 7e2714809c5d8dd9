"""Periodic runs of words, by Crochemore's partition refinement.

Positions of a text are kept in classes: two positions are in one class at level L
if the L words from them on are equal.  Going from L to L + 1, a class D splits by
the classes of its members' successors, and only the successors in *small* classes
need a look: when a class splits, all its parts but the largest are small, so a
position is looked at O(log n) times.  Members of a class are linked in order of
position; where two neighbours are L apart at level L, the L words from the first
one on stand there twice in a row.  Neighbours never show a square whose half is
itself a repetition, since a member in between would be nearer.  Squares of one
period at consecutive positions are one run.

A run counts if it is ``min_exponent`` periods long (``min_length`` words at least).  Its
classes then have ``min_exponent - 1`` members at any level up to its period, so smaller classes are
dropped, and levels end at 1 / ``min_exponent`` of the longest text: neither changes
a result.

Every text is read whole and on its own, so no rows meet and nothing is shuffled.
Texts are refined together, some 400,000 words at a time, or one text if it is
longer; memory is about 150 bytes a word.  Null and empty texts have no words and
no runs.  A repeated row gets the same result.  Added columns whose names are taken get
a number.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lociq.llm.common import fresh

_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
#: Words refined together.
BLOCK_WORDS = 400_000
#: Up to so many positions are cheaper to drop one by one than by array operations; the result is the same.
FEW = 64
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges start .. start + length - 1, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Refinement:
    """Classes of positions of several texts, refined level by level.

    ``symbols`` holds, text after text, a number for each word and -1 after each
    text's last word.  Classes lie in ``elem`` as ranges (``start``, ``size``) in any order; ``nxt`` and
    ``prv`` link their members by position.  ``cls`` is -1 for positions whose class
    is dropped, i.e. has fewer than ``least`` members.
    """

    def __init__(self, symbols: np.ndarray, text_of: np.ndarray, least: int):
        n = len(symbols)
        self.least, self.level = least, 1
        self.cls = np.full(n, -1, np.int64)
        self.nxt, self.prv, self.loc = (np.full(n, -1, np.int64) for _ in range(3))
        self.since = np.ones(n, np.int64)
        self.mark = np.zeros(n, bool)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []  # (periods, positions) of squares
        self.found_few: list[tuple[int, int]] = []  # (period, position) of a square
        words = np.flatnonzero(symbols >= 0)
        key = text_of[words] * (int(symbols.max(initial=0)) + 1) + symbols[words]
        by_class = np.argsort(key, kind="stable")
        at, key = words[by_class], key[by_class]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(at) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(at)])
        kept = size >= least
        self.elem = at[_ranges(first[kept], size[kept])]
        self.size = size[kept].astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.classes = len(self.size)
        self.cls[self.elem] = np.repeat(np.arange(self.classes), self.size)
        self.loc[self.elem] = np.arange(len(self.elem))
        self._link(self.elem, self.cls[self.elem])
        # the largest class of each text is the part that need not be looked at
        small = np.ones(n, bool)
        if self.classes:
            text = text_of[self.elem[self.start]]
            order = np.lexsort((-self.size, text))
            largest = order[np.r_[True, text[order][1:] != text[order][:-1]]]
            small[self.elem[_ranges(self.start[largest], self.size[largest])]] = False
        self.small = np.flatnonzero(small)

    def _link(self, members: np.ndarray, group: np.ndarray) -> None:
        """Links members, ordered by group and position, within their groups."""
        joined = group[1:] == group[:-1]
        self.nxt[members] = np.r_[np.where(joined, members[1:], -1), -1] if len(members) else -1
        self.prv[members] = np.r_[-1, np.where(joined, members[:-1], -1)] if len(members) else -1

    def _changed(self, at: np.ndarray, before: np.ndarray) -> None:
        """The neighbours after ``at`` were ``before`` up to this level: squares among them are noted."""
        gap = before - at
        square = (before >= 0) & (gap >= self.since[at]) & (gap <= self.level)
        if square.any():
            self.found.append((gap[square], at[square]))
        self.since[at] = self.level + 1

    def _drop(self, at: np.ndarray) -> None:
        self._changed(at, self.nxt[at])
        self.cls[at] = self.nxt[at] = self.prv[at] = -1

    def _note(self, at: int, after: int) -> None:
        gap = after - at
        if self.since.item(at) <= gap <= self.level:
            self.found_few.append((gap, at))
        self.since[at] = self.level + 1

    def _drop_few(self) -> None:
        """A step in which a few positions lose their successors' class, as at the end of a long run: no array work."""
        cls, nxt, prv, elem, loc, out = self.cls, self.nxt, self.prv, self.elem, self.loc, []
        for i in (self.small - 1).tolist():
            d = cls.item(i) if i >= 0 else -1
            if d < 0:
                continue
            before, after = prv.item(i), nxt.item(i)
            if after >= 0:
                self._note(i, after)
                prv[after] = before
            if before >= 0:
                self._note(before, i)
                nxt[before] = after
            cls[i] = nxt[i] = prv[i] = -1
            out.append(i)
            rest = self.size.item(d) - 1
            a, hole = self.start.item(d), loc.item(i)
            last = elem.item(a + rest)
            elem[hole], loc[last] = last, hole
            if rest < self.least:
                for k in elem[a : a + rest].tolist():
                    if (then := nxt.item(k)) >= 0:
                        self._note(k, then)
                    cls[k] = nxt[k] = prv[k] = -1
                    out.append(k)
                rest = 0
            self.size[d] = rest
        self.small = np.array(out, np.int64)
        self.level += 1

    def step(self) -> None:
        """From classes of ``level`` words to classes of one more."""
        if len(self.small) <= FEW and (self.cls[self.small] < 0).all():
            self._drop_few()
            return
        j = self.small[self.small > 0]
        j = j[self.cls[j - 1] >= 0]
        j.sort()
        c = self.cls[j]
        key = self.cls[j - 1] * (self.classes + 1) + c + 1
        order = np.argsort(key, kind="stable")
        moved, key, c = j[order] - 1, key[order], c[order]
        if not len(moved):
            self.small = moved
            self.level += 1
            return
        d = self.cls[moved]
        new_group = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(new_group) - 1
        head = np.flatnonzero(new_group)
        count = np.diff(np.r_[head, len(moved)])
        # a class that follows its successors' class as a whole stays as it is
        whole = (count == self.size[d[head]]) & (c[head] >= 0)
        if whole.any():
            split = ~whole[group]
            moved, d, c = moved[split], d[split], c[split]
            head, count = head[~whole], count[~whole]
            group = np.repeat(np.arange(len(head)), count)
            if not len(moved):
                self.small = moved
                self.level += 1
                return
            head = np.cumsum(count) - count
        group_d, group_c = d[head], c[head]
        of_d = np.flatnonzero(np.r_[True, group_d[1:] != group_d[:-1]])  # first group of each class that splits
        old = group_d[of_d]
        gone = np.add.reduceat(count, of_d)
        rest = self.size[old] - gone
        self._unlink(moved, d)
        self._move_to_tail(moved, old, gone, rest)
        # groups become classes; those too small are dropped
        live = (group_c >= 0) & (count >= self.least)
        ids = np.where(live, self.classes + np.cumsum(live) - 1, -1)
        tail = _ranges(self.start[old] + rest, gone)
        self._grow(int(live.sum()), tail[head[live]], count[live])
        self.size[old] = rest
        at_live = live[group]
        into = moved[at_live]
        before = self.nxt[into]
        self.cls[into] = ids[group[at_live]]
        self._link(into, group[at_live])
        other = self.nxt[into] != before
        self._changed(into[other], before[other])
        self._drop(moved[~at_live])
        # of the parts of a class, the largest one is not small
        rest_live = rest >= self.least
        most = np.maximum.reduceat(np.where(live, count, 0), of_d)
        rest_leads = rest_live & (rest >= most)
        lead = np.zeros(len(head), bool)
        class_of_group = np.cumsum(np.isin(np.arange(len(head)), of_d)) - 1
        best = live & (count == most[class_of_group]) & ~rest_leads[class_of_group]
        at_best = np.flatnonzero(best)
        lead[at_best[np.r_[True, class_of_group[at_best][1:] != class_of_group[at_best][:-1]]] if len(at_best) else at_best] = True
        left = ~rest_leads & (rest > 0)
        left_over = self.elem[_ranges(self.start[old[left]], rest[left])]
        lost = ~rest_live & (rest > 0)
        self._drop(self.elem[_ranges(self.start[old[lost]], rest[lost])])
        self.small = np.concatenate([moved[~lead[group]], left_over])
        self.level += 1

    def _unlink(self, moved: np.ndarray, d: np.ndarray) -> None:
        """Takes members out of their classes' lists; chains of neighbours go at once."""
        order = np.lexsort((moved, d))
        out = moved[order]
        chained = self.nxt[out[:-1]] == out[1:]
        first, last = out[np.r_[True, ~chained]], out[np.r_[~chained, True]]
        before, after = self.prv[first], self.nxt[last]
        has = before >= 0
        self._changed(before[has], first[has])
        self.nxt[before[has]] = after[has]
        has = after >= 0
        self.prv[after[has]] = before[has]

    def _move_to_tail(self, moved: np.ndarray, old: np.ndarray, gone: np.ndarray, rest: np.ndarray) -> None:
        """Swaps members that leave to the ends of their classes' ranges, in the order given."""
        tail = _ranges(self.start[old] + rest, gone)
        self.mark[moved] = True
        there = self.elem[tail]
        stays = there[~self.mark[there]]
        holes = self.loc[moved]
        holes = holes[holes < np.repeat(self.start[old] + rest, gone)]
        self.elem[holes], self.loc[stays] = stays, holes
        self.elem[tail], self.loc[moved] = moved, tail
        self.mark[moved] = False

    def _grow(self, k: int, start: np.ndarray, size: np.ndarray) -> None:
        need = self.classes + k
        if need > len(self.start):
            more = np.zeros(max(need, 2 * len(self.start)) - len(self.start), np.int64)
            self.start, self.size = np.r_[self.start, more], np.r_[self.size, more]
        self.start[self.classes : need], self.size[self.classes : need] = start, size
        self.classes = need

    def squares(self, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(periods, positions) of squares with periods up to ``last`` that long runs are made of."""
        while self.level < last and len(self.small):
            self.step()
        open_at = np.flatnonzero(self.nxt >= 0)
        self._changed(open_at, self.nxt[open_at])
        few = np.array(self.found_few, np.int64).reshape(-1, 2)
        self.found.append((few[:, 0], few[:, 1]))
        return np.concatenate([p for p, _ in self.found]), np.concatenate([a for _, a in self.found])


def find_runs(texts: list[np.ndarray], min_exponent: int = 4, min_length: int = 6) -> list[np.ndarray]:
    """For each text (word numbers), an array of (start, length, period), by start, then period."""
    lengths = np.array([len(t) for t in texts], np.int64)
    offset = np.cumsum(lengths + 1) - (lengths + 1)
    symbols = np.concatenate([x for t in texts for x in (t, [-1])]) if texts else np.zeros(0, np.int64)
    text_of = np.repeat(np.arange(len(texts)), lengths + 1)
    refined = Refinement(symbols.astype(np.int64), text_of, max(min_exponent - 1, 2))
    period, at = refined.squares(int(lengths.max(initial=0)) // min_exponent)
    order = np.lexsort((at, period))
    period, at = period[order], at[order]
    head = np.flatnonzero(np.r_[True, (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, np.int64)
    squares = np.diff(np.r_[head, len(at)])
    period, at = period[head], at[head]
    length = squares - 1 + 2 * period
    runs = np.stack([text_of[at], at - offset[text_of[at]], length, period], axis=1)[length >= np.maximum(min_length, min_exponent * period)] if len(at) else np.zeros((0, 4), np.int64)
    runs = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
    bounds = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
    return [runs[a:b, 1:] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def kept_words(words: list[str], runs: np.ndarray) -> list[str]:
    """The words but for those that a run holds after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def _blocks(texts: Iterator[str | None]) -> Iterator[list[list[str]]]:
    block, n = [], 0
    for text in texts:
        words = _WORDS(text or "")
        if block and n + len(words) > BLOCK_WORDS:
            yield block
            block, n = [], 0
        block.append(words)
        n += len(words)
    if block:
        yield block


def periodic_runs(docs: DataFrame, text_col: str = "text", min_exponent: int = 4, min_length: int = 6) -> DataFrame:
    """``docs`` with n_words, runs (array of start, length, period; by start, then period) and collapsed.

    ``collapsed`` is the text's words, joined by single spaces, of which each run keeps
    its first period only (a word that any run drops is dropped).
    """
    taken, added = list(docs.columns), []
    for name, kind in (("n_words", T.LongType()), ("runs", T.ArrayType(RUN, False)), ("collapsed", T.StringType())):
        added.append(T.StructField(fresh(taken, name), kind))
        taken.append(added[-1].name)
    schema = T.StructType([*docs.schema.fields, *added])
    at, names = docs.columns.index(text_col), schema.fieldNames()
    run_type = pa.struct([pa.field(n, pa.int64()) for n in ("start", "length", "period")])

    def run(batches):
        for batch in batches:
            done = 0
            for block in _blocks(x.as_py() for x in batch.column(at)):
                numbers = pa.array([w for words in block for w in words], pa.string()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum([len(words) for words in block])
                runs = find_runs(np.split(numbers, ends[:-1]), min_exponent, min_length)
                collapsed = pa.array([" ".join(kept_words(words, r)) for words, r in zip(block, runs, strict=True)], pa.string())
                flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
                spans = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(run_type))
                offsets = pa.array(np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32))
                part = batch.slice(done, len(block))
                done += len(block)
                n_words = pa.array([len(words) for words in block], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, n_words, pa.ListArray.from_arrays(offsets, spans), collapsed], names=names)

    return docs.mapInArrow(run, schema)
