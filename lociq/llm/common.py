"""What the operators of this subpackage share: scratch tables and column handling.

Scratch tables cut lineage.  They are written as Parquet below the shared folder
that the session names (``lociq.session.scratch_root``), so a lost executor never
loses an intermediate result.  An operator removes those that its result does
not read (``tidy``).
"""

from __future__ import annotations

import contextlib
import contextvars
import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociq.session import scratch_root

#: Lists that are told of every scratch table as this thread makes it: (path, catalog name or none).
_TOLD: contextvars.ContextVar[tuple] = contextvars.ContextVar("told", default=())
#: A key is hot if it holds more than a part of 1 / HOT of all rows, so there are at most HOT of them.
HOT = 4096


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/lociq/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, buckets: tuple[int, str] | None = None) -> DataFrame:
    """Write ``df`` to a scratch table and return a frame that reads it.

    ``buckets`` (count, column) keeps the layout that the writing tasks have, as
    bucket files, so that a later join on the column does not move this table.
    Each writing task should hold few values of that column.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    table = None if buckets is None else f"lociq_{name}_{uuid.uuid4().hex}"
    for told in _TOLD.get():
        told.append((path, table))
    if buckets is None:
        writer.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    writer.format("parquet").bucketBy(buckets[0], buckets[1]).option("path", path).saveAsTable(table)
    return spark.table(table)


@contextlib.contextmanager
def told_of_tables(into: list):
    """Within it, ``into`` gets (path, catalog name) of each scratch table made."""
    before = _TOLD.set((*_TOLD.get(), into))
    try:
        yield
    finally:
        _TOLD.reset(before)


def release(spark: SparkSession, tables: list, needed: DataFrame) -> None:
    """Remove the scratch tables listed, but for those that ``needed`` reads."""
    files = needed.inputFiles()
    for path, table in list(tables):
        if any(f"/{path.rsplit('/', 1)[-1]}/" in f for f in files):
            continue
        if table is not None:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        drop_path(spark, path)
        tables.remove((path, table))


def tidy(operator):
    """An operator (docs, ...) -> DataFrame that removes the scratch tables which its result does not read."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        made: list = []
        with told_of_tables(made):
            out = operator(docs, *args, **kwargs)
        release(docs.sparkSession, made, out)
        return out

    return run


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder through the file system that holds it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], hot: Column, how: str = "left") -> DataFrame:
    """``rows`` joined with ``table`` (one row a key), where one key may hold a large part of all rows.

    ``hot`` is a condition on ``table`` that at most ``HOT`` of its rows meet, by
    the definition of a hot key.  Those are broadcast, so the rows of a hot key
    stay where they are; only the others are shuffled.
    """
    few = table.filter(hot)
    at_hot = rows.join(F.broadcast(few), keys)  # HOT rows at most
    others = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(table.filter(~hot), keys, how)
    return at_hot.unionByName(others)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def renamed(field: T.StructField, name: str) -> T.StructField:
    return T.StructField(name, field.dataType, True)


def fresh(columns: list[str], wanted: str) -> str:
    """``wanted``, or the first of wanted_1, wanted_2 ... that no column has (case ignored)."""
    taken = {c.lower() for c in columns}
    name, k = wanted, 0
    while name.lower() in taken:
        k += 1
        name = f"{wanted}_{k}"
    return name


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns id and text alone; a null text counts as empty."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
