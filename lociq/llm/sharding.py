"""K-d tree sharding: split at weighted medians of the widest metadata dimension.

All rows begin as one node that must become ``shards`` leaves.  A node of k
leaves is cut where a k//2 / k share of its bytes lies on the lower side, along
the dimension in which it is widest, until every node is one leaf, which then
holds about total / shards bytes (the target).  Law: ``bytes``.

Points.  The tree is built over points, not rows: the rows of equal text (their
hash and size) are one point, so no cut separates them, however many tasks they
come from.  Only a group of more than ``WHOLE`` of the target would itself unbalance
the shards; its rows are dealt by a hash of their row number to pieces of about
1 / ``PIECES`` of the target, and each piece is a point.

Dimensions: the logarithm of the size, and each label (of a group the least one)
by its checksum.  Each is scaled by the range observed in the table, so widths
compare: a dimension in which a node spans half of what the table spans is half
as wide as one in which it spans all.

A weighted median is found without sorting a node.  Points are ordered by
(dimension, text hash, piece), three numbers of ``BITS`` bits.  Each pass adds up
bytes by node and by the next ``STEP`` bits of the current number, picks the bin in
which the wanted share is crossed, and narrows to it, until the bin is one point,
its bytes are too few to matter (``EXACT`` of a leaf) or the bits end.  What reaches
the driver is a row per node, at most ``shards``; sums by bin number 4096 a node
at most.

Rows then take their point's shard.  Points of many rows (more than a part of
1 / ``HOT``) and pieces are few by that definition and are broadcast; the others are
joined by a shuffle.  Slots are gapless without sorting a shard in one task: rows
are numbered inside 1024 hash buckets of their shard, and the sums of earlier
buckets (1024 rows a shard at most) are added.

Null text counts as no bytes (size 1), null metadata as an empty string.  Rows
with equal or null ids, and rows equal in all columns, are separate rows.  A very
long text is a point like any other; if it is larger than the target, so is its
shard.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociq.llm.common import HOT, materialize, tidy

#: Bits of a number that one pass looks at, and of a whole number.
STEP, BITS = 12, 36
#: A cut may miss its share by this part of a leaf.
EXACT = 0.0005
#: A group of equal texts stays whole up to this part of the target; a larger one is cut into pieces of 1 / PIECES of it.
WHOLE, PIECES = 0.125, 256
#: Buckets in which the rows of a shard are numbered.
BUCKETS = 1024
TOP = (1 << BITS) - 1
_GROUP = ["text_hash", "size"]


def _metadata(docs: DataFrame, id_col: str, text_col: str, label_cols: tuple[str, ...]) -> DataFrame:
    text = F.col(f"`{text_col}`")
    labels = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"label_{k}") for k, c in enumerate(label_cols) if c in docs.columns]
    whole = F.coalesce(text, F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"), F.xxhash64(whole).alias("text_hash"), *labels)


def _points(meta: DataFrame, shards: int, n_labels: int) -> tuple[DataFrame, DataFrame]:
    """Points (text_hash, size, piece, bytes, dimensions, ties), and the groups of many rows or bytes (text_hash, size, pieces)."""
    labels = [F.min(f"label_{k}").alias(f"label_{k}") for k in range(n_labels)]
    groups = materialize(meta.groupBy(*_GROUP).agg(F.count("*").alias("n"), *labels), "groups")
    total = groups.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("size")).alias("bytes"), F.min("size").alias("low"), F.max("size").alias("high"), *(x for k in range(n_labels) for x in (F.min(F.crc32(f"label_{k}")).alias(f"low_{k}"), F.max(F.crc32(f"label_{k}")).alias(f"high_{k}")))).first()
    target = (total["bytes"] or 0) / shards
    weight = F.col("n") * F.col("size")
    heavy = weight > F.lit(WHOLE * target)
    pieces = F.when(heavy & (F.col("n") > 1), F.least(F.col("n"), F.ceil(weight / F.lit(max(target, 1.0) / PIECES)))).otherwise(F.lit(1).cast("long"))
    # shards / WHOLE groups can be heavy, HOT can hold that many rows
    hot = materialize(groups.filter(heavy | (F.col("n") * HOT > F.lit(total["rows"] or 0))).withColumn("pieces", pieces), "hot_groups")
    dealt = F.pmod(F.xxhash64("row"), F.col("pieces"))
    cut = meta.select("row", *_GROUP).join(F.broadcast(hot), _GROUP).groupBy(*_GROUP, "pieces", dealt.alias("piece"), *(f"label_{k}" for k in range(n_labels))).agg(F.count("*").alias("n"))
    others = groups.join(F.broadcast(hot.select(*_GROUP)), _GROUP, "left_anti").withColumns({"pieces": F.lit(1).cast("long"), "piece": F.lit(0).cast("long")})

    def scaled(x: Column, low, high) -> Column:
        span = (high or 0) - (low or 0)
        return F.floor((x - F.lit(low)) / F.lit(float(span)) * F.lit(float(TOP))).cast("long") if span > 0 else F.lit(0).cast("long")

    low, high = (F.log2(F.lit(float(total[k] or 1))) for k in ("low", "high"))
    size = F.floor((F.log2(F.col("size").cast("double")) - low) / (high - low) * F.lit(float(TOP))).cast("long") if total["low"] != total["high"] else F.lit(0).cast("long")
    dims = [size.alias("dim_0"), *(scaled(F.crc32(f"label_{k}"), total[f"low_{k}"], total[f"high_{k}"]).alias(f"dim_{k + 1}") for k in range(n_labels))]
    ties = [F.shiftrightunsigned("text_hash", 64 - BITS).alias("tie_0"), F.floor(F.col("piece") / F.col("pieces") * F.lit(float(TOP))).cast("long").alias("tie_1")]
    points = cut.unionByName(others).select(*_GROUP, "piece", (F.col("n") * F.col("size")).alias("bytes"), *dims, *ties)
    return materialize(points, "points"), hot.select(*_GROUP, "pieces")


def _given(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A local relation of a row per node, at most ``shards``, for a broadcast join."""
    values = ", ".join("(" + ", ".join(f"{x}L" if isinstance(x, int) else f"{x!r}D" for x in r) + ")" for r in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})"))


def _number(level: int, n_dims: int) -> Column:
    """The level-th number of a point's order: its node's dimension (column dim), then the ties."""
    if level:
        return F.col(f"tie_{level - 1}")
    return F.element_at(F.array(*(F.col(f"dim_{d}") for d in range(n_dims))), F.col("dim").cast("int") + 1)


def _cuts(points: DataFrame, leaves: dict[int, int], n_dims: int) -> tuple[DataFrame, dict[int, int]]:
    """One level of the tree: every node of more than one leaf becomes 2 node and 2 node + 1."""
    spark = points.sparkSession
    open_nodes = _given(spark, [(n,) for n, k in leaves.items() if k > 1], "node")
    stats = points.join(open_nodes, "node").groupBy("node").agg(F.sum("bytes").alias("bytes"), *(x for d in range(n_dims) for x in (F.min(f"dim_{d}").alias(f"low_{d}"), F.max(f"dim_{d}").alias(f"high_{d}")))).collect()
    dims = {r["node"]: max(range(n_dims), key=lambda d: (r[f"high_{d}"] - r[f"low_{d}"], -d)) for r in stats}
    wanted = {r["node"]: r["bytes"] * (leaves[r["node"]] // 2) / leaves[r["node"]] for r in stats}
    leaf = {r["node"]: r["bytes"] / leaves[r["node"]] for r in stats}
    fixed: dict[int, list[int]] = {n: [] for n in dims}  # numbers narrowed to one value
    prefix, lower = dict.fromkeys(dims, 0), dict.fromkeys(dims, 0)
    cut: dict[int, tuple] = {}
    level = bits = 0
    while len(cut) < len(dims) and level < 3:
        active = [n for n in dims if n not in cut]
        take = min(STEP, BITS - bits)
        state = _given(spark, [(n, dims[n], prefix[n], float(lower[n]), float(wanted[n]), *(fixed[n] + [0, 0])[:2]) for n in active], "node, dim, prefix, lower, wanted, fixed_0, fixed_1")
        inside = points.join(state, "node")
        for past in range(level):
            inside = inside.filter(_number(past, n_dims) == F.col(f"fixed_{past}"))
        number = _number(level, n_dims)
        if bits:
            inside = inside.filter(F.shiftright(number, BITS - bits) == F.col("prefix"))
        bins = inside.groupBy("node", "lower", "wanted", F.shiftright(number, BITS - bits - take).alias("bin")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("points"))
        run = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        summed = bins.withColumn("upto", F.sum("bytes").over(run) + F.col("lower"))
        crossed = summed.filter(F.col("upto") >= F.col("wanted")).groupBy("node").agg(F.min(F.struct("bin", "bytes", "upto", "points")).alias("b")).collect()
        bits += take
        for r in crossed:
            n, b = r["node"], r["b"]
            prefix[n], lower[n] = b["bin"], b["upto"] - b["bytes"]
            last = bits == BITS and level == 2
            if b["bytes"] <= EXACT * leaf[n] or b["points"] == 1 or last:
                # up to and with the bin, or before it, whichever is nearer
                with_bin = b["upto"] - wanted[n] < wanted[n] - lower[n]
                cut[n] = (dims[n], level, *(fixed[n] + [0, 0])[:2], b["bin"] + (1 if with_bin else 0), BITS - bits)
        if bits == BITS:
            for n in dims:
                fixed[n].append(prefix[n])
                prefix[n] = 0
            level, bits = level + 1, 0
    grown: dict[int, int] = {}
    for n, k in leaves.items():
        if k > 1:
            grown[2 * n], grown[2 * n + 1] = k // 2, k - k // 2
        else:
            grown[n] = 1
    if not cut:
        return points, grown
    placed = points.join(_given(spark, [(n, *c) for n, c in cut.items()], "node, dim, depth, fixed_0, fixed_1, bound, shift"), "node", "left")
    first, tie, final = (_number(k, n_dims) for k in range(3))
    under = lambda x: F.call_function("shiftright", x, F.col("shift").cast("int")) < F.col("bound")
    after_tie = F.when(F.col("depth") == 1, under(tie)).otherwise((tie < F.col("fixed_1")) | ((tie == F.col("fixed_1")) & under(final)))
    below = F.when(F.col("depth") == 0, under(first)).otherwise((first < F.col("fixed_0")) | ((first == F.col("fixed_0")) & after_tie))
    node = F.when(F.col("dim").isNull(), F.col("node")).when(below, F.col("node") * 2).otherwise(F.col("node") * 2 + 1)
    return materialize(placed.withColumn("node", node).select(*points.columns), "nodes"), grown


@tidy
def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", label_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``bytes``)."""
    n_labels = sum(c in docs.columns for c in label_cols)
    meta = materialize(_metadata(docs, id_col, text_col, label_cols), "metadata")
    points, hot = _points(meta, shards, n_labels)
    points = points.withColumn("node", F.lit(1).cast("long"))
    leaves = {1: shards}
    while any(k > 1 for k in leaves.values()):
        points, leaves = _cuts(points, leaves, n_labels + 1)
    number = {n: k for k, n in enumerate(sorted(leaves, key=lambda n: format(n, "b")[1:]))}
    points = points.join(_given(docs.sparkSession, list(number.items()), "node, number"), "node").select(*_GROUP, "piece", F.col("number").cast("int").alias("shard"))
    rows = meta.select("row", "doc_id", "size", "text_crc32", "text_hash")
    # HOT + shards * (1 / WHOLE + PIECES) points at most
    many = F.broadcast(points.join(F.broadcast(hot), _GROUP))
    at_hot = rows.join(F.broadcast(hot), _GROUP).withColumn("piece", F.pmod(F.xxhash64("row"), F.col("pieces"))).join(many.drop("pieces"), [*_GROUP, "piece"])
    others = rows.join(F.broadcast(hot), _GROUP, "left_anti").join(points.filter("piece = 0"), _GROUP)
    bucket = F.pmod(F.xxhash64("row", F.lit(3)), F.lit(BUCKETS)).cast("int").alias("bucket")
    named = ["row", "doc_id", "size", "text_crc32", "shard", bucket]
    placed = materialize(at_hot.select(*named).unionByName(others.select(*named)), "placed")
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # shards * BUCKETS rows at most
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "row")
    return (
        placed.withColumn("at", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), ["shard", "bucket"])
        .select(F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
