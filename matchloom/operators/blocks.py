"""Every query against every row in blocks of bounded size: each meeting keeps its best, and the best of all are merged."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and rows that meet in one task at a time.
QUERIES, ROWS = 1024, 32_768
#: Queries and rows where few of their terms are compared: rows are sent once for each block of queries, and many pairs come back from each block of rows.
FEW, LONG = 4096, 65_536
#: Rows whose scores are held at once, and products that are made at once.
STEP, PRODUCTS = 512, 4_000_000

Scorer = Callable[[pd.DataFrame, pd.DataFrame], "Callable[[int, int], np.ndarray]"]


def dot_products(q: pd.DataFrame, t: pd.DataFrame) -> Callable[[int, int], np.ndarray]:
    """Cosines of dense vectors ``v``."""
    unit = lambda c: (lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12))(np.stack(c).astype(np.float64))
    a, b = unit(q["v"]), unit(t["v"])
    return lambda i, j: a @ b[i:j].T


def sparse_products(q: pd.DataFrame, t: pd.DataFrame) -> Callable[[int, int], np.ndarray]:
    """Products of sparse vectors (``ids``, ``ws``); -1 for pairs without a common id."""
    mine = np.repeat(np.arange(len(q)), q["ids"].str.len())
    ids, ws = np.concatenate(q["ids"].tolist()), np.concatenate(q["ws"].tolist())
    order = np.argsort(ids, kind="stable")
    ids, ws, mine = ids[order], ws[order], mine[order]
    known, first = np.unique(ids, return_index=True)
    held = np.diff(np.append(first, len(ids)))

    def score(i: int, j: int) -> np.ndarray:
        part, width = t.iloc[i:j], j - i
        row = np.repeat(np.arange(width), part["ids"].str.len())
        term, w = np.concatenate(part["ids"].tolist()), np.concatenate(part["ws"].tolist())
        at = np.minimum(np.searchsorted(known, term), len(known) - 1)
        hit = known[at] == term
        row, w, at = row[hit], w[hit], at[hit]
        n = held[at]
        upto = np.cumsum(n)
        out = np.zeros(len(q) * width)
        a = 0
        while a < len(n):  # products are made a bounded number at a time
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PRODUCTS, "right")))
            m = n[a:b]
            flat = np.repeat(first[at[a:b]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            out += np.bincount(mine[flat] * width + np.repeat(row[a:b], m), weights=ws[flat] * np.repeat(w[a:b], m), minlength=len(out))
            a = b
        out[out == 0] = -1
        return out.reshape(len(q), width)

    return score


def sparse_pairs(q: pd.DataFrame, t: pd.DataFrame) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Products of chosen pairs of the whole vectors ``all_ids``, ``all_ws`` and ``ids``, ``ws``; a query's pairs stand together."""
    held = t["ids"].str.len().to_numpy(np.int64)
    first, ids, ws = np.cumsum(held) - held, np.concatenate(t["ids"].tolist()), np.concatenate(t["ws"].tolist())
    size = 1 + max(ids.max(), max(x.max() for x in q["all_ids"]))

    def score(row: np.ndarray, col: np.ndarray) -> np.ndarray:
        out, whole = np.zeros(len(row)), np.zeros(size)
        start = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else []
        for a, b in zip(start, [*start[1:], len(row)], strict=True):
            mine, n = q["all_ids"].iat[row[a]], held[col[a:b]]
            whole[mine] = q["all_ws"].iat[row[a]]
            flat = np.repeat(first[col[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out[a:b] = np.bincount(np.repeat(np.arange(b - a), n), weights=whole[ids[flat]] * ws[flat], minlength=b - a)
            whole[mine] = 0
        return np.round(out, 9)

    return score


def frame(q: np.ndarray, t: np.ndarray, score: np.ndarray) -> pd.DataFrame:
    plain = lambda a: pd.Series(a, dtype=a.dtype)  # noqa: E731  strings stay objects, which Arrow takes as one array
    return pd.DataFrame({"q_key": plain(q), "t_key": plain(t), "score": score})


def best_of(scorer: Scorer, k: int, floor: float, apart: bool, exact: Callable | None = None) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Of one meeting, each query's ``k`` best rows with a score over ``floor``; ties by key; ``apart``: a row isn't its own; ``exact`` scores these pairs anew."""

    def found(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            none = frame(np.array([], object), np.array([], object), np.array([], float))
            return none.assign(exact=none["score"]) if exact else none
        t = t.sort_values("t_key", ignore_index=True)  # so a place stands for a key in ties
        score, keys, mine = scorer(q, t), t["t_key"].to_numpy(), q["q_key"].to_numpy()
        top, at = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
        for i in range(0, len(t), STEP):
            j = min(i + STEP, len(t))
            made = np.round(score(i, j), 9)
            if apart:
                made[mine[:, None] == keys[None, i:j]] = -np.inf
            better = np.flatnonzero((made > top[:, -1:]).any(1))  # a tie with an earlier key changes nothing
            both = np.hstack([top[better], made[better]])
            place = np.hstack([at[better], np.broadcast_to(np.arange(i, j), (len(better), j - i))])
            order = np.argsort(-both, axis=1, kind="stable")[:, :k]
            top[better], at[better] = np.take_along_axis(both, order, 1), np.take_along_axis(place, order, 1)
        row, col = np.nonzero(top > floor)
        made = frame(mine[row], keys[at[row, col]], top[row, col])
        return made.assign(exact=exact(q, t)(row, at[row, col])) if exact else made

    return found


def listed(made: pd.DataFrame) -> pd.DataFrame:
    """A query's pairs, which stand together, in one row."""
    q = made["q_key"].to_numpy()
    cut = np.flatnonzero(q[1:] != q[:-1]) + 1
    billionths = {c: np.rint(made[c].to_numpy() * 1e9).astype(np.int32) for c in ("score", "exact")}
    parts = {"t_key": made["t_key"].to_numpy(), **billionths}
    column = lambda x: pd.Series(np.split(x, cut) if len(q) else [], dtype=object)
    return pd.DataFrame({"q_key": q[np.append(0, cut)] if len(q) else q} | {c: column(x) for c, x in parts.items()})


def blocks(df: DataFrame, size: int) -> int:
    return max(1, -(-df.count() // size))


def best_rows(queries: DataFrame, rows: DataFrame, scorer: Scorer, k: int, n_queries: int, n_rows: int, floor: float = -np.inf, apart: bool = False, exact: Callable | None = None) -> DataFrame:
    """(q_key, t_key, score, rk): the ``k`` best rows of each query; with ``exact``, also their other score of this name.

    ``queries`` have q_key, ``rows`` t_key, both unique, so hashes deal them in even blocks; each block of
    queries meets each block of rows in a task that holds both, and yields at most ``k`` rows a query.
    """
    key = rows.schema["t_key"].dataType.simpleString()
    deal = lambda df, c, n, other: df.withColumn(f"__{c}", F.pmod(F.xxhash64(f"{c}_key"), F.lit(n))).withColumn(f"__{'t' if c == 'q' else 'q'}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long"))))
    q, t = deal(queries, "q", n_queries, n_rows), deal(rows, "t", n_rows, n_queries)
    kept = best_of(scorer, k, floor, apart, exact)
    drop = lambda df: df.drop(columns=["__q", "__t"])
    cells, id_ = q.groupBy("__q", "__t").cogroup(t.groupBy("__q", "__t")), f"q_key {queries.schema['q_key'].dataType.simpleString()}"
    if exact:  # many pairs a query: they travel as lists, scores as billionths
        lists = cells.applyInPandas(lambda a, b: listed(kept(drop(a), drop(b))), f"{id_}, t_key array<{key}>, score array<int>, exact array<int>").repartition("q_key")
        met = lists.select("q_key", F.inline(F.arrays_zip("t_key", "score", "exact"))).select("q_key", "t_key", *[(F.col(c) / F.lit(1e9)).alias(c) for c in ("score", "exact")])
    else:
        met = cells.applyInPandas(lambda a, b: kept(drop(a), drop(b)), f"{id_}, t_key {key}, score double")
    at = Window.partitionBy("q_key").orderBy(F.desc("score"), "t_key")
    return met.withColumn("rk", F.row_number().over(at)).where(F.col("rk") <= k)
