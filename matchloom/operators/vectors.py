"""Nearest neighbours of dense vectors, exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.blocks import QUERIES, ROWS, best_rows, blocks, dot_products


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, other, rn): the ``k`` rows of greatest cosine for each query, itself apart; ties by key. Rows without a vector are left out."""
    side = lambda df, name: df.where(F.col(vector).isNotNull()).select(F.col(key).alias(name), F.col(vector).alias("v"))
    q, t = side(queries, "q_key"), side(rows, "t_key")
    found = best_rows(q, t, dot_products, k, blocks(q, QUERIES), blocks(t, ROWS), apart=True)
    return found.select(F.col("q_key").alias(key), F.col("t_key").alias("other"), F.col("rk").cast("long").alias("rn"))
