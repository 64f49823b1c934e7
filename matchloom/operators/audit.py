"""Audits of results: scores that insist on the same queries on both sides, and what missed and false links had in common."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import similarity as S
from matchloom.functions import tables as TB
from matchloom.functions import text as X
from matchloom.operators.beside import asked, best_beside
from matchloom.operators.blocking import hydrate
from matchloom.operators.evaluate import error_budget
from matchloom.sources.records import decode_list, lockstep


def strict_macro(truth: DataFrame, predicted: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """Macro F0.5 over id lists; an error unless both have lists for the same queries, and for some."""
    faults = {r["in_left"]: r["count"] for r in lockstep(truth, predicted).groupBy("in_left").count().collect()}
    if faults:
        raise ValueError(f"queries differ: {faults.get(True, 0)} missing, {faults.get(False, 0)} extra")
    if truth.isEmpty():
        raise ValueError("there is no query to score")
    ids = lambda df, c: df.select("source1_entity_id", F.array_distinct(decode_list(F.col(name))).alias(c))
    both = ids(truth, "t").join(ids(predicted, "p"), "source1_entity_id").withColumn("tp", F.size(F.array_intersect("t", "p")))
    scores = both.select(S.f05(F.col("tp"), F.size("p") - F.col("tp"), F.size("t") - F.col("tp")).alias("f05"))
    return scores.agg(F.count(F.lit(1)).alias("queries"), F.avg("f05").alias("macro_f05"))


def missing_signals(truth: DataFrame, candidates: DataFrame, links: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Missed, rejected and false links by country and source, and which signals each kind had to show."""
    h = hydrate(error_budget(truth, candidates, links).where("kind <> 'found'"), queries, targets)
    h = h.select("kind", "country", "target_source", *[X.char_norm(c).alias(c) for c in ("q_name", "q_address", "t_name", "t_address")])
    h = h.withColumn("n", S.token_set_ratio("q_name", "t_name")).withColumn("a", S.token_set_ratio("q_address", "t_address"))
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    digits = lambda c: F.filter(F.split(c, " "), lambda w: w.rlike("^[0-9]{2,}$"))
    n, a = F.col("n") >= 80, F.col("a") >= 80
    signals = {
        "blank_target": F.col("t_address") == "", "shared_number": F.arrays_overlap(digits("q_address"), digits("t_address")), "shared_word": F.arrays_overlap(words("q_address"), words("t_address")),
        "name_alike": n, "address_alike": a, "either_alike": n | a, "both_unlike": (F.col("n") < 60) & (F.col("a") < 60),
    }
    return h.groupBy("kind", "country", "target_source").agg(F.count(F.lit(1)).alias("pairs"), *[F.count_if(s).alias(k) for k, s in signals.items()])


def _alike(c, a):
    return [TB.token_set(c[f], a[f]) / 100 for f in ("name", "address")]


def anchor_diagnostic(truth: DataFrame, candidates: DataFrame, links: DataFrame, queries: DataFrame, targets: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """How alike targets that weren't accepted are to their query and to its accepted targets, by status and source.

    Statuses: positives that were rejected or never retrieved, and negatives that were rejected, of
    queries with a link. All of them count, not a sample. ``blocks`` (s1_id, block): queries that tend to share targets.
    """
    key = ["s1_id", "target_id"]
    mark = lambda df, c: df.select(*key, F.lit(1).alias(c))
    open_ = mark(truth, "t").join(mark(candidates, "c"), key, "full_outer").join(links.select(*key), key, "left_anti")
    status = F.when(F.col("t").isNull(), "rejected_negative").when(F.col("c").isNull(), "absent_positive").otherwise("rejected_positive")
    open_ = open_.select(*key, status.alias("status")).distinct()
    clean = lambda df, id_, p: df.select(F.col(id_).alias(p), X.char_norm("business_name").alias("name"), X.char_norm("business_address").alias("address"))
    t, (own, mine) = clean(targets, "target_id", "target_id"), asked(clean(queries, "entity_id", "s1_id"))
    fields = [f"{who}_{f}" for who in ("query", "anchor") for f in ("name", "address")]
    near = best_beside(open_, links, t, _alike, fields[2:], blocks, ["status"])
    best = near.join(best_beside(open_.select(*key), own, t, _alike, fields[:2], blocks, anchor_fields=mine).drop("siblings"), key).join(targets.select("target_id", "source"), "target_id")
    numbers = [f(n) for n in fields for f in (lambda n: F.percentile(n, F.lit(0.5)).alias(f"{n}_median"), lambda n: F.percentile(n, F.lit(0.9)).alias(f"{n}_p90"))]
    stronger = [F.count_if(F.col(f"anchor_{f}") > F.col(f"query_{f}") + 0.15).alias(f"anchor_stronger_{f}_0p15") for f in ("name", "address")]
    high = [F.count_if((F.col(f"anchor_{f}") >= 0.9) & (F.col(f"query_{f}") < 0.75)).alias(f"anchor_{f}_high_query_low") for f in ("name", "address")]
    return best.groupBy("status", "source").agg(F.count(F.lit(1)).alias("n"), *numbers, *stronger, *high)


def profile_stages(spark: SparkSession, folder: str, stages: list[tuple[str, Callable[[DataFrame | None], DataFrame]]]) -> DataFrame:
    """(stage, rows, seconds): each stage gets the table that the one before wrote to ``folder``, so its time is its own."""
    table, seen = None, []
    for name, build in stages:
        start = time.perf_counter()
        build(table).write.mode("overwrite").parquet(f"{folder}/{name}")
        took = time.perf_counter() - start
        table = spark.read.parquet(f"{folder}/{name}")
        seen.append((name, table.count(), round(took, 3)))
    return spark.createDataFrame(seen, "stage string, rows long, seconds double")
