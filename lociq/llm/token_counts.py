"""Token counts of whole texts for a byte-level BPE tokenizer file (.json).

Whole-token shortcut.  Before any text is read, the driver proves which
vocabulary strings the merges turn into exactly one token when they stand
alone: each is run through the merges and kept only if one token comes out.
Workers then cut texts into pre-tokens; one found in the proven set counts 1
without being merged, and only the rest go through the merges.

A text may hold the string of an added token, or a character that the library
classes as another Unicode version does (``OTHER_CLASSES``, held to the library by
a test).  Such a text is cut before every single space between two characters
that are not white space: no pre-token goes across.  Runs with such a string or
character are counted by the library, all others of that text as above.

Nulls and empty texts have 0 bytes and 0 tokens.  Rows with equal or null ids
are counted row by row.  Extra columns are ignored; an empty table gives an
empty result.  No row depends on another, so nothing is shuffled.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lociq.llm.common import id_text, renamed

# Fixed value: the cutting pattern of byte-level BPE tokenizers of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Ranges whose letter, number or other class differs between this pattern's library and the tokenizer's.
OTHER_CLASSES = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Before a single space between characters that are not white space: there a text may be cut.
CUT = r"(?<=\S)(?= \S)"
#: Entries that a worker remembers of merged pre-tokens; beyond it the memory starts anew.
REMEMBERED = 400_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in such vocabularies."""
    keep = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


def prove_whole_tokens(tokenizer_json: str) -> list[str]:
    """Vocabulary strings that the merges, run on the string alone, give as one token."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(tokenizer_json).model
    added = {t["content"] for t in json.loads(tokenizer_json).get("added_tokens", [])}
    back = {c: b for b, c in enumerate(byte_letters())}
    proven = []
    for word in json.loads(tokenizer_json)["model"]["vocab"]:
        if word in added or any(c not in back for c in word):
            continue
        raw = bytes(back[c] for c in word)
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue  # part of a character: never a pre-token of a text
        if len(model.tokenize(word)) == 1:
            proven.append(text)
    return proven


class Counts(dict):
    """Tokens of each pre-token: 1 for the proven ones, merged on first sight for others."""

    def __init__(self, tokenizer_json: str, proven: list[str]):
        from tokenizers import Tokenizer

        super().__init__(dict.fromkeys(proven, 1))
        self.proven, self.tokenizer = proven, Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.letters = {b: c for b, c in enumerate(byte_letters())}

    def __missing__(self, word: str) -> int:
        n = len(self.model.tokenize(word.encode().decode("latin-1").translate(self.letters)))
        if len(word) <= 64:
            if len(self) > len(self.proven) + REMEMBERED:
                self.clear()
                self.update(dict.fromkeys(self.proven, 1))
            self[word] = n
        return n


class TokenCounter:
    def __init__(self, tokenizer_json: str, proven: list[str]):
        import regex

        self.counts = Counts(tokenizer_json, proven)
        self.pieces = regex.compile(PATTERN).findall
        added = [t["content"] for t in json.loads(tokenizer_json).get("added_tokens", [])]
        ranges = "".join(f"{chr(a)}-{chr(b)}" for a, b in OTHER_CLASSES)
        self.unsafe = regex.compile("|".join([f"[{ranges}]", *map(regex.escape, added)])).search
        self.runs = regex.compile(CUT).split

    def count(self, text: str) -> int:
        if not self.unsafe(text):
            return sum(map(self.counts.__getitem__, self.pieces(text)))
        encode = self.counts.tokenizer.encode
        runs = self.runs(text)
        odd = set(filter(self.unsafe, runs))
        return sum(len(encode(r, add_special_tokens=False).ids) if r in odd else sum(map(self.counts.__getitem__, self.pieces(r))) for r in runs)


@lru_cache(maxsize=2)
def _counter(key: str, shipped) -> TokenCounter:
    return TokenCounter(*shipped.value)


class _Shipped:
    """A broadcast value that caches by the broadcast's id."""

    def __init__(self, broadcast, key):
        self.broadcast, self.key = broadcast, key

    @property
    def value(self):
        return self.broadcast.value

    def __hash__(self):
        return hash(self.key)

    def __eq__(self, other):
        return self.key == other.key


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    The tokenizer's file and the proven strings are broadcast; the vocabulary
    bounds their size, whatever the data.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    proven = prove_whole_tokens(tokenizer_json)
    key = f"{os.path.basename(tokenizer_path)}:{len(tokenizer_json)}:{hash(tokenizer_json)}"
    shipped = _Shipped(docs.sparkSession.sparkContext.broadcast((tokenizer_json, proven)), key)

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = _counter(key, shipped)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [counter.count(t) for t in texts]
            size = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    schema = T.StructType([renamed(docs.schema[id_col], id_col), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return id_text(docs, id_col, text_col).mapInArrow(run, schema)
