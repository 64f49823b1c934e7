"""Rescue rules where all queries of a block have all its targets as pairs: no row is made for a pair.

A pair is a bit: of each target, those of the queries that accept it, and those that turned it down. A
rule's least resemblance is reached where any accepted target has it, so bits of such targets are joined.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions import tables as TB
from matchloom.functions.text import ascii_text

#: Targets of a block that are judged in one task.
CHUNK = 1024
#: Cells of a table of measures or scores that are held at once, and words of bits of accepted pairs.
CELLS, WORDS = 1 << 21, 1 << 23

#: Table of scores, queries x targets, from the rows of both.
Score = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]
#: Field and table of each measure.
MEASURES = {"name": ("name", TB.ratio), "name_set": ("name", TB.token_set), "latin_name": ("latin", TB.ratio), "address": ("address", TB.ratio), "address_set": ("address", TB.token_set)}


def _packed(table: np.ndarray) -> np.ndarray:
    """Rows of truth values as rows of bits, in whole words."""
    bits = np.packbits(table, axis=1)
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)


def _reached(left: list[str], right: list[str], measure: Callable, levels: list[float], held: np.ndarray, want: np.ndarray) -> dict[float, np.ndarray]:
    """Of each text of ``left``, bits of all texts of ``right`` that come up to a level; ``levels`` descend, ``want`` are all bits."""
    out = {x: np.zeros((len(left), len(want)), np.uint64) for x in levels}
    step = max(1, CELLS // len(right))
    for i in range(0, len(left), step):
        for j, row in enumerate(measure(left[i : i + step], right), i):
            got, above = np.zeros(len(want), np.uint64), np.inf
            for x in levels:
                at, a, n = np.flatnonzero((row >= x) & (row < above)), 0, 64
                while a < len(at) and not np.array_equal(got, want):
                    got |= np.bitwise_or.reduce(held[at[a : a + n]], axis=0)
                    a, n = a + n, n * 4
                out[x][j], above = got, x
    return out


def _gains(cand: pd.DataFrame, queries: pd.DataFrame, targets: pd.DataFrame, rules: dict[str, dict[str, float]], score: Score, accepted: float, least: float) -> np.ndarray:
    """One block, some of its candidates, all its queries and targets: rules x (true, false) that they add."""
    total = np.zeros((len(rules), 2), np.int64)
    levels = {m: sorted({r[m] for r in rules.values() if m in r}, reverse=True) for m in MEASURES if any(m in r for r in rules.values())}
    width = max(1, WORDS // len(targets)) * 64
    for s in range(0, len(queries), width):
        part = queries.iloc[s : s + width]
        step = max(1, CELLS // len(part))
        held = np.concatenate([_packed(score(part, targets.iloc[i : i + step]).T >= accepted) for i in range(0, len(targets), step)])
        want = np.bitwise_or.reduce(held, axis=0)
        if not want.any():
            continue
        reached, place = {}, {}
        for field in dict.fromkeys(MEASURES[m][0] for m in levels):
            texts, at = pd.factorize(targets[field])[::-1]
            mine, place[field] = pd.factorize(cand[field])[::-1]
            order = np.argsort(at, kind="stable")
            by = held if len(texts) == len(targets) else np.bitwise_or.reduceat(held[order], np.flatnonzero(np.diff(at[order], prepend=-1)), axis=0)
            for m in levels:
                if MEASURES[m][0] == field:
                    reached[m] = _reached(list(mine), list(texts), MEASURES[m][1], levels[m], by, want)
        ids = {x: i for i, x in enumerate(part["s1_id"])}
        own = np.array([ids.get(x, -1) for x in cand["owner"]], np.int64)
        for i in range(0, len(cand), step):
            prob, mine = score(part, cand.iloc[i : i + step]).T, own[i : i + step]
            there = np.flatnonzero(mine >= 0)
            floors = {p: _packed((prob < accepted) & (prob >= max(p, least))) & want for p in {r.get("prob", least) for r in rules.values()}}
            for k, rule in enumerate(rules.values()):
                ok = floors[rule.get("prob", least)]
                for m, x in rule.items():
                    if m != "prob":
                        ok = ok & reached[m][x][place[MEASURES[m][0]][i : i + step]]
                hit = int((np.ascontiguousarray(ok).view(np.uint8)[there, mine[there] >> 3] >> (7 - (mine[there] & 7)).astype(np.uint8) & 1).sum())
                total[k] += hit, int(np.bitwise_count(ok).sum()) - hit
    return total


def rule_counts(queries: DataFrame, targets: DataFrame, by: list[str], rules: dict[str, dict[str, float]], score: Score, accepted: float, least: float) -> DataFrame:
    """What each rule adds, as ``siblings.rule_counts`` gives it, in rows to be summed.

    ``queries`` have s1_id, ``targets`` target_id, name, address and ``owner`` (their true s1_id), both the
    columns ``by`` and what ``score`` reads. An id stands in one row. All queries and targets that are equal
    in ``by`` are pairs: accepted from the score ``accepted`` on, candidates below it from ``least`` on.
    """
    chunks = targets.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("__of"))
    many = 4 * int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = F.when(F.col("__of") == 1, F.pmod(F.xxhash64(*by), F.lit(many))).otherwise(F.xxhash64(*by, "__chunk")).alias("__cell")  # small blocks share a task
    dealt = targets.fillna("", ["name", "address"]).join(chunks, by)
    mine = dealt.withColumn("__chunk", F.pmod(F.xxhash64("target_id"), F.col("__of"))).withColumn("__cell", cell).drop("__of")
    each = lambda df: df.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__of") - 1))).withColumn("__cell", cell).drop("__of")
    theirs = each(dealt.drop("owner", "target_id")).unionByName(each(queries.join(chunks, by)), allowMissingColumns=True)
    names = [f"{k}_{hit}" for k in rules for hit in (True, False)]

    def found(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        total, parts = np.zeros((len(rules), 2), np.int64), b.groupby([*by, "__chunk"], sort=False).indices
        latin = {x: ascii_text(x) for x in set(a["name"]) | set(b["name"].dropna())}
        a, b = a.assign(latin=a["name"].map(latin)), b.assign(latin=b["name"].map(latin))
        asks = b["s1_id"].notna().to_numpy()
        for key, at in a.groupby([*by, "__chunk"], sort=False).indices.items():
            there = parts.get(key, np.array([], np.int64))
            q, t = b.iloc[there[asks[there]]], b.iloc[there[~asks[there]]]
            if len(q) and len(t):
                total += _gains(a.iloc[at], q, t, rules, score, accepted, least)
        return pd.DataFrame([total.ravel()], columns=names)

    theirs = theirs.select(*[F.col(c).alias(c) for c in theirs.columns])  # columns of its own, not those of ``mine``
    return mine.groupBy("__cell").cogroup(theirs.groupBy("__cell")).applyInPandas(found, ", ".join(f"`{n}` long" for n in names))
