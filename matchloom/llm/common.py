"""Shared pieces of the text operators: lineage cuts, row keys, words, joins with hot keys."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, as a Java, DuckDB and Python pattern.
SPACE = r"[\x20\x09-\x0D]+"
#: A key is hot that holds more than this part of the rows, so there are at most so many hot keys.
HOT_PART = 1024


#: Rows that Python gets at a time in the pipeline: a batch is held by the JVM, as Arrow and as Python's own objects.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches to ``BATCH_ROWS`` rows; a smaller bound that it has stays. No result depends on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder the session names.

    On a cluster the session must name one that all nodes share; only a local session that names
    none, as in tests, gets a temporary folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="matchloom-"))
    return df.checkpoint()


def text_of(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def text_key(name: str = "text") -> Column:
    """With the id, this names a row even where ids repeat or are null."""
    return F.xxhash64(text_of(name))


def packed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, under names of their places, so that no name can clash."""
    return F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])


def words(text: Column) -> Column:
    """Runs of characters other than the six ASCII spaces."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of stored ``rows`` with ``counted``, which has one row a key and the key's number of rows.

    Keys that hold more than a ``HOT_PART``-th of the rows are at most ``HOT_PART``: those are
    broadcast, and their rows stay where they are. All other keys are shuffled.
    """
    most = max(total // HOT_PART, 64)
    more = [c for c in counted.columns if c not in keys]
    hot = counted.where(F.col(count) > most).select(*keys, F.struct(*more).alias("__hot"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    warm = marked.where("__hot is not null").select(*rows.columns, *[F.col("__hot")[c].alias(c) for c in more])
    cold = marked.where("__hot is null").drop("__hot").join(counted.where(F.col(count) <= most), keys).select(*rows.columns, *more)
    return warm.unionByName(cold)


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, or where ``docs`` has a column so called, the name with as many underscores before it as it takes."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
