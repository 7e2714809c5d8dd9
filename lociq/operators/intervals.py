"""Interval operators: bucketed range joins, nearest, interpolation, islands, neighbours.

Spark plans a plain inequality join as a nested loop.  Here intervals and points
meet by equality on a bucket number and the inequality is checked afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spans that agree in one row of an overlap join, and spans of a bucket's first side that one task takes.
BLOCK, SHARE = 512, 4096
#: Tasks of an overlap join for each shuffle partition: Parquet's dictionaries end at 1 MB (131,072 numbers), so a task should meet few buckets.
SPREAD = 4


def _bucket(x: Column, width: int) -> Column:
    return F.floor(x / F.lit(width)).cast("bigint")


def range_join(points: DataFrame, spans: DataFrame, pos: str, start: str, end: str, width: int, by: list[str] = (), bucket: str | None = None) -> DataFrame:
    """Points with the spans that hold them, both ends included.

    ``bucket`` names a column to keep the bucket in: the result lies by it, so a window or aggregate that has it
    among its keys moves no rows.
    """
    p = points.withColumn("__b", _bucket(F.col(pos), width))
    s = spans.withColumn("__b", F.explode(F.sequence(_bucket(F.col(start), width), _bucket(F.col(end), width))))
    held = p.join(s, ["__b", *by]).filter((F.col(pos) >= F.col(start)) & (F.col(pos) <= F.col(end)))
    return held.drop("__b") if bucket is None else held.withColumnRenamed("__b", bucket)


def _gathered(spans: DataFrame, span: tuple[str, str], by: list[str], out: str) -> DataFrame:
    """Spans that agree as one row for each ``BLOCK`` of them: by, span, __k, and their other columns in order as the array ``out``."""
    rest = [c for c in spans.columns if c not in (*by, *span)]
    place = Window.partitionBy(*by, *span).orderBy(*(rest or span))
    rows = spans.withColumn("__k", F.floor((F.row_number().over(place) - 1) / F.lit(BLOCK)))
    return rows.groupBy(*by, *span, "__k").agg(F.sort_array(F.collect_list(F.struct(*rest) if rest else F.struct(F.lit(0)))).alias(out))


def overlap_join(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], width: int, by: list[str] = ()) -> DataFrame:
    """Pairs of spans that share a position, each pair once: in the bucket where the later one starts.

    Spans that agree meet the other side once and are dealt out afterwards, so only rows of the result are made of
    copies, those of two places together.  A bucket with many spans of ``a`` is shared among tasks: they take its
    blocks in turns, and each has the bucket's spans of ``b``.  The merge join keeps a block of ``b`` while those of
    ``a`` pass, so what varies from row to row repeats the same few numbers and is written small.
    """
    bucket = lambda span: F.explode(F.sequence(_bucket(F.col(span[0]), width), _bucket(F.col(span[1]), width)))
    x, y = _gathered(a, a_span, by, "__a").withColumn("__b", bucket(a_span)), _gathered(b, b_span, by, "__c").drop("__k").withColumn("__b", bucket(b_span))
    shares = a.withColumn("__b", bucket(a_span)).groupBy(*by, "__b").agg(F.ceil(F.count("*") / F.lit(SHARE)).alias("__n"))
    key, n = [*by, "__b", "__t"], SPREAD * int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = x.join(shares, [*by, "__b"]).withColumn("__t", F.pmod(F.hash(*a_span, "__k"), F.col("__n"))).drop("__n", "__k")
    y = y.join(shares, [*by, "__b"]).withColumn("__t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))).drop("__n")
    later = F.greatest(F.col(a_span[0]), F.col(b_span[0]))
    # a stated number: small rows that meet to make many would be merged into few tasks
    met = y.repartition(n, *key).hint("merge").join(x.repartition(n, *key), key).filter((later <= F.least(F.col(a_span[1]), F.col(b_span[1]))) & (_bucket(later, width) == F.col("__b")))
    dealt = met.withColumn("__a", F.explode("__a")).withColumn("__c", F.explode("__c"))
    own = lambda side, span, at: [F.col(f"{at}.{c}") if c not in span else F.col(c) for c in side.columns if c not in by]
    return dealt.select(*by, *own(a, a_span, "__a"), *own(b, b_span, "__c"))


def _neighbours(both: DataFrame, by: list[str], width: int) -> DataFrame:
    """Rows (by, __x, __kind, __mark) with the mark at or before them and the one at or after them.

    Rows are ordered inside buckets of positions only; what the last bucket with
    a mark has, and the next one, is carried over from a table of buckets.  So a
    chromosome is spread over many tasks.
    """
    rows = both.withColumn("__b", _bucket(F.col("__x"), width))
    so_far = (Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by, "__b").orderBy("__x", "__kind").rowsBetween(*so_far)
    back = Window.partitionBy(*by, "__b").orderBy(F.desc("__x"), F.desc("__kind")).rowsBetween(*so_far)  # backwards: a frame that ends at the last row is read anew for every row
    here = F.when(F.col("__mark").isNotNull(), F.col("__x"))
    edges = rows.groupBy(*by, "__b").agg(F.max_by("__mark", here).alias("__last"), F.min_by("__mark", here).alias("__first"))
    earlier, later = (Window.partitionBy(*by).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("__b"), F.desc("__b")))
    carried = edges.select(*by, "__b", F.last("__last", ignorenulls=True).over(earlier).alias("__cl"), F.last("__first", ignorenulls=True).over(later).alias("__cr"))
    inside = rows.withColumn("__pl", F.last("__mark", ignorenulls=True).over(ahead)).withColumn("__pr", F.last("__mark", ignorenulls=True).over(back))
    return inside.join(carried, [*by, "__b"]).withColumn("__l", F.coalesce("__pl", "__cl")).withColumn("__r", F.coalesce("__pr", "__cr"))


def _with_marks(points: DataFrame, marks: DataFrame, pos: str, at: str, mark: Column, by: list[str], width: int) -> DataFrame:
    mks = marks.select(*by, F.col(at).cast("double").alias("__x"), F.lit(0).alias("__kind"), mark.alias("__mark"))
    row = F.struct(*points.columns)
    kind = points.select(row.alias("r")).schema["r"].dataType
    pts = points.select(*by, F.col(pos).cast("double").alias("__x"), F.lit(1).alias("__kind"), F.lit(None).cast(mks.schema["__mark"].dataType).alias("__mark"), row.alias("__row"))
    return _neighbours(pts.unionByName(mks.withColumn("__row", F.lit(None).cast(kind))), by, width).filter("__kind = 1")


def nearest(points: DataFrame, marks: DataFrame, pos: str, mark: str, payload: list[str], by: list[str], width: int = 1_000_000) -> DataFrame:
    """Each point with the nearest mark of its group; of two equally near, the lower."""
    found = _with_marks(points, marks, pos, mark, F.struct(F.col(mark).cast("double").alias("m"), *payload), by, width)
    gap_l, gap_r = F.abs(F.col("__x") - F.col("__l.m")), F.abs(F.col("__r.m") - F.col("__x"))
    take = F.when(F.col("__l").isNull(), F.col("__r")).when(F.col("__r").isNull(), F.col("__l")).when(gap_r < gap_l, F.col("__r")).otherwise(F.col("__l"))
    return found.withColumn("__m", take).select("__row.*", F.col("__m.m").alias("mark"), *(F.col(f"__m.{c}").alias(f"mark_{c}") for c in payload), F.abs(F.col("__x") - F.col("__m.m")).alias("distance"))


def interpolate(points: DataFrame, knots: DataFrame, pos: str, x: str, y: str, by: list[str], out: str, width: int = 1_000_000) -> DataFrame:
    """Linear interpolation through knots, extended by the end segments, not below 0."""
    w = Window.partitionBy(*by).orderBy(x)
    segments = knots.withColumn("__x2", F.lead(x).over(w)).withColumn("__y2", F.lead(y).over(w)).filter("__x2 is not null")
    segment = F.struct(F.col(x).cast("double").alias("x1"), F.col(y).cast("double").alias("y1"), F.col("__x2").cast("double").alias("x2"), F.col("__y2").cast("double").alias("y2"))
    found = _with_marks(points, segments, pos, x, segment, by, width).withColumn("__s", F.coalesce("__l", "__r"))
    value = F.col("__s.y1") + F.try_divide((F.col("__x") - F.col("__s.x1")) * (F.col("__s.y2") - F.col("__s.y1")), F.col("__s.x2") - F.col("__s.x1"))
    return found.select("__row.*", F.greatest(value, F.lit(0.0)).alias(out))


def step_value(points: DataFrame, knots: DataFrame, pos: str, x: str, y: str, by: list[str], out: str, width: int = 1_000_000) -> DataFrame:
    """Value of the last knot at or before the position (null before the first)."""
    found = _with_marks(points, knots, pos, x, F.struct(F.col(y).cast("double").alias("v")), by, width)
    return found.select("__row.*", F.col("__l.v").alias(out))


def _pieces(spans: DataFrame, start: str, end: str) -> DataFrame:
    """Spans cut at the edges of buckets no wider than they are: __w (width), __b (bucket), __x, __tail.

    A piece reaches from __x to the end of its bucket (__tail) or from the bucket's
    start to __x, so what meets it is a running value inside the bucket, not a join.  A span is at
    most four pieces; widths are powers of two, so there are few.  A span of one place has width 0
    and the place as its bucket.
    """
    lo, hi = F.col(start).cast("double"), F.col(end).cast("double")
    power = F.pow(F.lit(2.0), F.floor(F.log2(hi - lo)))
    rows = spans.filter(F.col(end) >= F.col(start)).withColumn("__w", F.when(hi == lo, 0.0).when(power > hi - lo, power / 2).otherwise(power))
    bucket = lambda x: F.floor(x / F.nullif(F.col("__w"), F.lit(0.0))).cast("double")
    piece = lambda b, x, tail: F.struct(b.alias("b"), x.alias("x"), F.lit(tail).alias("tail"))
    whole = F.transform(F.sequence(F.lit(1), (bucket(hi) - bucket(lo)).cast("int")), lambda k: piece(bucket(lo) + k, (bucket(lo) + k) * F.col("__w"), True))
    inner = F.slice(whole, F.lit(1), F.size(whole) - 1)  # the last bucket is a head
    cut = F.when(F.col("__w") == 0, F.array(piece(lo, lo, True))).otherwise(F.concat(F.array(piece(bucket(lo), lo, True), piece(bucket(hi), hi, False)), inner))
    return rows.withColumn("__p", F.explode(cut)).withColumns({"__b": F.col("__p.b"), "__x": F.col("__p.x"), "__tail": F.col("__p.tail")}).drop("__p")


def _places(points: DataFrame, pieces: DataFrame, pos: str) -> DataFrame:
    """Points once for each width of the pieces, with the bucket they lie in."""
    widths = pieces.select("__w").distinct()  # powers of two: a few dozen rows
    x = F.col(pos).cast("double")
    return points.crossJoin(F.broadcast(widths)).withColumn("__x", x).withColumn("__b", F.when(F.col("__w") == 0, x).otherwise(F.floor(x / F.nullif(F.col("__w"), F.lit(0.0))).cast("double")))


def _running(by: list[str], up: bool):
    return Window.partitionBy(*by, "__w", "__b").orderBy(F.asc("__x") if up else F.desc("__x")).rangeBetween(Window.unboundedPreceding, Window.currentRow)


def covering(points: DataFrame, spans: DataFrame, pos: str, start: str, end: str, by: list[str], sums: dict[str, Column], tops: dict[str, Column]) -> DataFrame:
    """Each place (by, pos) that a span holds, both ends included: sums and greatest values over the spans that hold it.

    Spans that agree are added up first; then each costs at most four rows and each place
    one for each width of spans, however many spans hold it.
    """
    spans = spans.groupBy(*by, start, end).agg(*(F.sum(c).alias(f"__s_{n}") for n, c in sums.items()), *(F.max(c).alias(f"__t_{n}") for n, c in tops.items()), F.count("*").alias("__n"))
    pieces = _pieces(spans, start, end).drop(start, end)
    rows = _places(points.select(*by, pos).distinct(), pieces, pos).unionByName(pieces, allowMissingColumns=True)
    tail, head = F.when(F.col("__tail"), True), F.when(~F.col("__tail"), True)
    up, down = _running(by, True), _running(by, False)
    total = lambda c: F.coalesce(F.sum(F.when(tail, F.col(c))).over(up), F.lit(0)) + F.coalesce(F.sum(F.when(head, F.col(c))).over(down), F.lit(0))
    top = lambda c: F.greatest(F.max(F.when(tail, F.col(c))).over(up), F.max(F.when(head, F.col(c))).over(down))
    held = rows.select(*by, pos, total("__n").alias("__n"), *(total(f"__s_{n}").alias(n) for n in sums), *(top(f"__t_{n}").alias(n) for n in tops)).filter(F.col(pos).isNotNull() & (F.col("__n") > 0))
    return held.groupBy(*by, pos).agg(*(F.sum(n).alias(n) for n in sums), *(F.max(n).alias(n) for n in tops))


def totals_within(points: DataFrame, spans: DataFrame, pos: str, start: str, end: str, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """``spans`` that hold points, both ends included, with the sums over those points.

    The counterpart of ``covering``: points of one place are added up first, spans that agree
    are asked for once, and no pair of a point and a span is made.
    """
    asked = spans.select(*by, start, end).distinct()
    pieces = _pieces(asked, start, end)
    added = points.groupBy(*by, pos).agg(*(F.sum(c).alias(f"__s_{n}") for n, c in sums.items()), F.count("*").alias("__n"))
    rows = _places(added, pieces, pos).drop(pos).unionByName(pieces, allowMissingColumns=True)
    up, down = _running(by, True), _running(by, False)
    total = lambda c: F.coalesce(F.when(F.col("__tail"), F.sum(c).over(down)).otherwise(F.sum(c).over(up)), F.lit(0))
    found = rows.select(*by, start, end, "__tail", total("__n").alias("__n"), *(total(f"__s_{n}").alias(n) for n in sums)).filter("__tail is not null")
    held = found.groupBy(*by, start, end).agg(F.sum("__n").alias("__n"), *(F.sum(n).alias(n) for n in sums)).filter("__n > 0").drop("__n")
    return spans.join(held, [*by, start, end])


def best_covering(points: DataFrame, spans: DataFrame, pos: str, start: str, end: str, value: str, by: list[str], highest: bool = True) -> DataFrame:
    """Per point the covering span of highest (lowest) value; ties go to the larger end."""
    key = F.struct((F.col(value) if highest else -F.col(value)).alias("k"), F.col(end).alias("end"), F.col(start).alias("start"), F.col(value).alias("value"))
    best = covering(points, spans, pos, start, end, by, {}, {"__k": key})
    return points.join(best.select(*by, pos, *(F.col(f"__k.{c}").alias(f"best_{c}") for c in ("value", "end", "start"))), [*by, pos], "left")


def numbered(rows: DataFrame, by: list[str], order: list[str], out: str, width: int = 1_000_000) -> DataFrame:
    """``rows`` with their number from 0 in the order of ``order`` (a position first) within ``by``.

    Rows are numbered inside buckets of positions; the sizes of earlier buckets are
    added from a table of buckets, so no group is sorted in one task.
    """
    r = rows.withColumn("__b", _bucket(F.col(order[0]), width))
    sizes = r.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(*order)) - 1
    return r.withColumn(out, inside).join(starts, [*by, "__b"]).withColumn(out, (F.col(out) + F.col("__start")).cast("long")).drop("__b", "__start")


def merge(spans: DataFrame, start: str, end: str, by: list[str], width: int = 1_000_000) -> DataFrame:
    """Islands of touching or overlapping spans: by, start, end, members.

    The reach of earlier spans and the number of islands so far are running values
    inside buckets of starts; what earlier buckets hold is carried over from a table
    of buckets.
    """
    rows = spans.withColumn("__b", _bucket(F.col(start), width))
    order = Window.partitionBy(*by, "__b").orderBy(start, end)
    buckets = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*by, "__b").agg(F.max(end).alias("__far"))
    carried = ends.select(*by, "__b", F.max("__far").over(buckets).alias("__far"))
    reach = F.greatest(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("__far"))
    opened = rows.join(carried, [*by, "__b"]).withColumn("__new", F.when(F.col(start) <= reach, 0).otherwise(1))
    counts = opened.groupBy(*by, "__b").agg(F.sum("__new").alias("__n"))
    before = counts.select(*by, "__b", F.coalesce(F.sum("__n").over(buckets), F.lit(0)).alias("__before"))
    island = opened.withColumn("__i", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(before, [*by, "__b"])
    groups = island.withColumn("__i", F.col("__i") + F.col("__before")).groupBy(*by, "__i")
    return groups.agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("members")).drop("__i")


def windows(length: int, width: int, step: int) -> Column:
    """Array of centres of a closed window grid over 1 .. length."""
    return F.sequence(F.lit(width // 2), F.lit(length), F.lit(step))
