"""Quality rules under weak supervision.

Each rule looks at figures of a whole text and votes to keep (1), to reject
(-1) or abstains (0).  Expectation-maximisation estimates, from the votes alone,
how often each rule votes what on good and on bad texts, and how many texts are
good.  The posterior probability that a text is good replaces the usual demand
that all rules pass.  The model takes votes as independent given the class, so each
rule looks at evidence of its own: no figure decides two rules.

The estimates need only the number of texts that share each pattern of votes.
There are at most 3^9 = 19,683 patterns (``RULES`` is fixed), so this table's size
has a bound whatever the data: it is counted by a map-side combined aggregate,
fitted on the driver until it settles, and joined back by broadcast.

Null and empty texts have no words and fail the base rules; a very long text is
read whole like any other.  Rows are judged one
by one: repeated rows get the same verdict.  Extra columns are passed on by
``quality_rules`` and ignored by ``features``.  An empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociq.llm.common import fresh, materialize, tidy

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Marks that may stand around a word of letters.
AROUND = ".,;:!?\"'()[]{}\u00ab\u00bb\u201c\u201d\u2018\u2019\u201e\u2026\u00bf\u00a1\u3002\uff0c\u3001\uff01\uff1f"
_WORD = re.compile(r"[^\x20\x09-\x0D]+").findall
_OTHER = re.compile(r"[^\x00-\x7f]+").findall
_LETTERS, _UPPER = string.ascii_letters.encode(), [bytes([b]) for b in string.ascii_uppercase.encode()]
#: Figures of a text, in the order in which ``figures`` gives them.
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_letter_words")
#: Words in a repeated window.
WINDOW = 5


def figures(text: str | None) -> tuple[int, ...]:
    """The figures of one whole text, in the order of FIGURES."""
    if not text:
        return (0,) * len(FIGURES)
    raw = text.encode()
    words = _WORD(text)
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    dup = len(lines) - len(set(lines))
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
        if len(set(windows)) < len(windows):
            seen: dict[tuple, int] = {}
            for w in windows:
                seen[w] = seen.get(w, 0) + 1
            last = -1  # the last word covered so far
            for k, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += k + WINDOW - 1 - max(k - 1, last)
                    last = k + WINDOW - 1
    other = "".join(_OTHER(text)) if not text.isascii() else ""
    upper = sum(map(raw.count, _UPPER)) + sum(map(str.isupper, other))
    letters = len(raw) - len(raw.translate(None, _LETTERS)) + sum(map(str.isalpha, other))
    marks = raw.count(b"!") + raw.count(b"?")
    letter_words = sum(w.isalpha() or w.strip(AROUND).isalpha() for w in words)
    return n, chars, symbols, dup, repeated, len(lines), upper, letters, marks, letter_words


def features(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with a column ``prefix`` + name for each of FIGURES (long)."""
    schema = T.StructType([*docs.schema.fields, *(T.StructField(prefix + n, T.LongType()) for n in FIGURES)])
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            rows = [figures(t) for t in batch.column(at).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(FIGURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def _vote(reject: Column, accept: Column) -> Column:
    return F.when(reject, F.lit(-1)).when(accept, F.lit(1)).otherwise(F.lit(0))


def rules(prefix: str = "") -> dict[str, Column]:
    """Rule name -> vote.  Ratios are compared without division: no text divides by zero."""
    c = {n: F.col(f"`{prefix}{n}`") for n in FIGURES}
    words = c["n_words"]
    return {
        "length": _vote((words < 12) | (words > 200_000), words.between(20, 100_000)),
        "word_length": _vote((c["word_chars"] < 2 * words) | (c["word_chars"] > 14 * words), c["word_chars"].between(3 * words, 11 * words)),
        "symbols": _vote(10 * c["n_symbols"] > words, 50 * c["n_symbols"] <= words),
        "duplicate_lines": _vote(10 * c["n_dup_lines"] > 3 * c["n_lines"], 20 * c["n_dup_lines"] <= c["n_lines"]),
        "repeated_words": _vote(5 * c["n_repeat_words"] > words, 20 * c["n_repeat_words"] <= words),
        "capitals": _vote(2 * c["n_upper"] > c["n_letters"], 5 * c["n_upper"] <= c["n_letters"]),
        "marks": _vote(4 * c["n_marks"] > words, 20 * c["n_marks"] <= words),
        "letters": _vote(10 * c["n_letters"] < 8 * c["word_chars"], 10 * c["n_letters"] >= 9 * c["word_chars"]),
        "letter_words": _vote(10 * c["n_letter_words"] < 7 * words, 20 * c["n_letter_words"] >= 17 * words),
    }


#: Names of the rules; 3 ** len(RULES) patterns of votes at most.
RULES = ("length", "word_length", "symbols", "duplicate_lines", "repeated_words", "capitals", "marks", "letters", "letter_words")


def base_failed(prefix: str = "") -> Column:
    words, repeated = F.col(f"`{prefix}n_words`"), F.col(f"`{prefix}n_repeat_words`")
    return (words < 10) | (100 * repeated > 20 * words)


def fit(patterns: list[tuple[tuple[int, ...], int]], weight: float = 0.1, tolerance: float = 1e-9) -> dict[tuple[int, ...], float]:
    """Posterior probability of "good" for each pattern of votes, by expectation-maximisation.

    The start takes a vote to reject as strong evidence and one to keep as weak.
    ``weight`` of all texts, as pseudo-counts, holds each rule to rejecting good texts
    seldom and bad ones often, so that the classes keep their meaning.  Rounds go on until no
    posterior changes by ``tolerance``; each raises the penalised likelihood, which
    has a bound, so they end.
    """
    if not patterns:
        return {}
    votes = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], dtype=float)
    cast = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, rule, vote
    pseudo = weight * n.sum()
    prior = {1: pseudo * np.array([0.02, 0.18, 0.8]), 0: pseudo * np.array([0.3, 0.3, 0.4])}
    good = 1 / (1 + np.exp(-(2.0 + 0.2 * (votes > 0).sum(axis=1) - 2.5 * (votes < 0).sum(axis=1))))
    while True:
        share = ((n * good).sum() + 0.8 * pseudo) / (n.sum() + pseudo)
        rates = {}
        for c, mass in ((1, n * good), (0, n * (1 - good))):
            counted = np.einsum("p,prv->rv", mass, cast) + prior[c]
            rates[c] = counted / counted.sum(axis=1, keepdims=True)
        odds = math.log(share / (1 - share)) + np.einsum("prv,rv->p", cast, np.log(rates[1] / rates[0]))
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        settled = np.abs(new - good).max() < tolerance
        good = new
        if settled:
            return {p: float(g) for (p, _), g in zip(patterns, good, strict=True)}


@tidy
def quality_rules(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with the figures, base_failed, p_good and kept.

    A name that ``docs`` already has gets a number: kept_1 and so on; the added
    columns are the last ones, in a fixed order.
    """
    prefix = fresh(docs.columns, "__q")
    table = materialize(features(docs, text_col, prefix), "figures")
    return judged(table, docs.columns, prefix, threshold)


def judged(table: DataFrame, columns: list[str], prefix: str, threshold: float = 0.5) -> DataFrame:
    spark = table.sparkSession
    vote_columns = [F.coalesce(v, F.lit(0)).cast("int").alias(f"{prefix}v_{n}") for n, v in rules(prefix).items()]
    names = [f"{prefix}v_{n}" for n in RULES]
    voted = table.select("*", *vote_columns)
    patterns = [(tuple(row[n] for n in names), row["n"]) for row in voted.groupBy(*names).agg(F.count("*").alias("n")).collect()]  # 3 ** len(RULES) rows at most
    good = fit(sorted(patterns))
    schema = T.StructType([*(T.StructField(n, T.IntegerType()) for n in names), T.StructField(f"{prefix}p", T.DoubleType())])
    posterior = spark.createDataFrame([(*p, g) for p, g in good.items()], schema)
    found = voted.join(F.broadcast(posterior), names, "left")
    taken = list(columns)
    out = []
    failed = base_failed(prefix)
    for name, value in [*((n, F.col(f"`{prefix}{n}`")) for n in FIGURES), ("base_failed", failed), ("p_good", F.col(f"`{prefix}p`")), ("kept", ~failed & (F.col(f"`{prefix}p`") >= threshold))]:
        out.append(value.alias(name := fresh(taken, name)))
        taken.append(name)
    return found.select(*(F.col(f"`{c}`") for c in columns), *out)
