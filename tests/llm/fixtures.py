"""Documents with every edge case: nulls, empties, ties, repeats, long texts, clashing columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("__fp", T.IntegerType())])


def texts(n=120, seed=3):
    rng = random.Random(seed)
    words = ["the", "of", "Étion", "naïve", "hello", "world's", "12345", "a", "schön", "foo_bar", "x" * 30, "!!", "—", "😀", "՘", "Ａ", "it's", "co-op", "ſ", "İstanbul", "J̌"]
    out = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randrange(0, 60)):
            t += rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", "\t ", "\r\n", " ", ""])
        out.append(t)
    out += ["", None, " ", "\n\n", "<|endoftext|>", "a<|endoftext|> b", "<|ENDOFTEXT|> <|startoftext|>", "word " * 6000, "ab" * 3000, "x", "A B C d", "a b c D"]
    base = [rng.choice(words[:10]) + str(rng.randrange(50)) for _ in range(80)]
    for k in range(12):  # near copies
        w = list(base)
        for j in range(k // 3):
            w[7 + 9 * j] = f"new{k}"
        out.append(" ".join(w))
    out += [" ".join(base).upper(), " ".join(base), out[0], out[1], out[1]]
    return out


def rows(n=120):
    t = texts(n)
    out = [(k, x, None if k % 5 == 0 else "en", f"src{k % 3}" if k % 7 else None, "clash", k, k) for k, x in enumerate(t)]
    out.append((3, t[3], "en", "src0", "clash", 1, 1))  # a repeated row
    out.append((None, t[4], None, None, None, None, None))
    out.append((None, None, None, None, None, None, None))
    return out


def frame(spark, n=120, partitions=3):
    return spark.createDataFrame(rows(n), SCHEMA).repartition(partitions, "n_tokens")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
