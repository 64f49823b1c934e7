"""Candidates beside the accepted targets of their query, without a row for each of the three together.

Queries of one block tend to share their targets, so two targets are compared once for the block and
each query takes the greatest value among its own anchors. Any blocks give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Targets of a block that meet all anchors of the block in one task.
CHUNK = 256

#: Tables of candidates x anchors, one for each measure, from the fields of both.
Measure = Callable[[pd.DataFrame, pd.DataFrame], Sequence[np.ndarray]]


def _lists(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All items of a column of lists, and the row of each."""
    held = column.str.len().to_numpy(np.int64)
    return np.concatenate([np.asarray(x) for x in column]), np.repeat(np.arange(len(column)), held)


def _best(cand: pd.DataFrame, anchors: pd.DataFrame, measure: Measure, carry: list[str], names: list[str]) -> pd.DataFrame | None:
    """One block, some of its candidates and all of its anchors: a row for each candidate of a query with another anchor."""
    tables = [np.ascontiguousarray(m.T, np.float64) for m in measure(cand, anchors)]
    ids = cand["target_id"].to_numpy()
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))  # an id that several rows bear counts once, with its best
    tables, rows = [np.maximum.reduceat(m, first, axis=1) for m in tables], cand.iloc[first]
    place = {t: i for i, t in enumerate(rows["target_id"])}
    own = np.array([place.get(t, -1) for t in anchors["target_id"]], np.int64)
    flat = [m.min() == m.max() for m in tables]
    for m in tables:
        m[np.flatnonzero(own >= 0), own[own >= 0]] = -np.inf
    by, col = _lists(anchors["__n"])
    order = np.argsort(by, kind="stable")
    by, col = by[order], col[order]
    mine, row = _lists(rows["__n"])
    order = np.argsort(mine, kind="stable")
    mine, row = mine[order], row[order]
    known, start = np.unique(mine, return_index=True)
    end = np.append(start[1:], len(mine))
    left, right = np.searchsorted(by, known), np.searchsorted(by, known, "right")
    made, siblings = np.full((len(mine), len(tables)), -np.inf), np.zeros(len(mine), np.int64)
    for s, e, a, b in zip(start, end, left, right, strict=True):
        if a == b:
            continue
        at, cols = row[s:e], col[a:b]
        siblings[s:e] = b - a - np.bincount(own[cols][own[cols] >= 0], minlength=len(rows))[at]
        for k, m in enumerate(tables):
            if flat[k]:
                made[s:e, k] = m.max()
            elif len(at) * 2 > len(rows):
                made[s:e, k] = m[cols].max(0)[at]
            else:
                made[s:e, k] = m[cols[:, None], at].max(0)
    kept = np.flatnonzero(siblings > 0)
    if not len(kept):
        return None
    out = {"target_id": rows["target_id"].to_numpy()[row[kept]]}
    for c in ("s1_id", *carry):
        out[c] = np.concatenate([np.asarray(x) for x in rows[f"__{c}"]])[order[kept]]
    return pd.DataFrame(out | {"siblings": siblings[kept]} | {n: made[kept, k] for k, n in enumerate(names)})


def best_beside(candidates: DataFrame, anchors: DataFrame, fields: DataFrame, measure: Measure, names: list[str], blocks: DataFrame | None = None, carry: Sequence[str] = (), anchor_fields: DataFrame | None = None) -> DataFrame:
    """(s1_id, target_id, ``carry``, siblings, ``names``): candidates that have another accepted target beside them.

    ``candidates`` and ``anchors`` have s1_id and target_id, ``fields`` target_id and strings that
    ``measure`` reads, none of them null; ``anchor_fields`` are those of the anchors, if they are
    other rows. ``blocks`` has each s1_id once with a number ``block``; without it, each query is by itself.
    ``siblings`` counts the anchors, each of ``names`` is the greatest value to any of them.
    """
    spark, carry = candidates.sparkSession, list(carry)
    if blocks is None:
        blocks = candidates.select("s1_id").distinct().withColumn("block", F.xxhash64("s1_id"))
    numbered = blocks.withColumn("__n", F.row_number().over(Window.partitionBy("block").orderBy("s1_id")))
    lists = lambda df, *more: df.join(numbered, "s1_id").groupBy("block", "target_id").agg(F.collect_list(F.struct("__n", *more)).alias("__l")).select("block", "target_id", F.col("__l.__n").alias("__n"), *[F.col(f"__l.{c}").alias(f"__{c}") for c in more])
    mine, theirs = lists(candidates, "s1_id", *carry), lists(anchors.select("s1_id", "target_id"))
    chunks = mine.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("__of"))
    many = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cell = F.when(F.col("__of") == 1, F.pmod("block", F.lit(many))).otherwise(F.xxhash64("block", "__chunk")).alias("__cell")  # small blocks share a task
    mine = mine.join(chunks, "block").withColumn("__chunk", F.pmod(F.xxhash64("target_id"), F.col("__of"))).join(fields, "target_id").withColumn("__cell", cell)
    theirs = theirs.join(chunks, "block").join(fields if anchor_fields is None else anchor_fields, "target_id").withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__of") - 1))).withColumn("__cell", cell)
    kinds = {f.name: f.dataType for f in candidates.schema}
    schema = T.StructType([T.StructField("target_id", kinds["target_id"]), T.StructField("s1_id", kinds["s1_id"]), *[T.StructField(c, kinds[c]) for c in carry], T.StructField("siblings", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]])
    columns = schema.fieldNames()

    def found(a: pd.DataFrame, b: pd.DataFrame):
        made, groups = [], dict(tuple(b.groupby(["block", "__chunk"])))
        for key, part in a.groupby(["block", "__chunk"]):
            if key in groups:
                made.append(_best(part.sort_values("target_id", ignore_index=True), groups[key].reset_index(drop=True), measure, carry, names))
        made = [m for m in made if m is not None]
        return pd.concat(made, ignore_index=True)[columns] if made else pd.DataFrame(columns=columns).astype({n: "float64" for n in names} | {"siblings": "int64"})

    theirs = theirs.select(*[F.col(c).alias(c) for c in theirs.columns])  # columns of its own, not those of ``mine``
    met = mine.groupBy("__cell").cogroup(theirs.groupBy("__cell")).applyInPandas(found, schema)
    return met.select("s1_id", "target_id", *carry, "siblings", *names)


def asked(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(anchors, their fields): each query as its own only anchor, so that candidates meet the query itself. ``queries`` have s1_id and the fields."""
    own = F.concat(F.lit("query:"), "s1_id").alias("target_id")  # no target has such an id
    return queries.select("s1_id", own), queries.select(own, *[c for c in queries.columns if c != "s1_id"])
