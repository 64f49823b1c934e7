"""Set metrics over pairs, with every query counted, and audits of labels and outputs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.similarity import f05


def per_query(queries: DataFrame, truth: DataFrame, links: DataFrame) -> DataFrame:
    """(s1_id, tp, fp, fn, f05) of every query."""
    key = ["s1_id", "target_id"]
    both = truth.select(*key, F.lit(1).alias("t")).join(links.select(*key, F.lit(1).alias("p")), key, "full_outer")
    n = both.groupBy("s1_id").agg(F.count_if(F.expr("t = 1 and p = 1")).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    all_ = queries.select("s1_id").join(n, "s1_id", "left").fillna(0, ["tp", "fp", "fn"])
    return all_.withColumn("f05", f05(F.col("tp"), F.col("fp"), F.col("fn")))


def macro(scores: DataFrame, *by: str) -> DataFrame:
    """Macro F0.5, pair precision and recall, complete sets among non-empty ones, accuracy of empty ones."""
    total = F.sum
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), F.avg("f05").alias("macro_f05"), (total("tp") / F.greatest(F.lit(1), total(F.col("tp") + F.col("fp")))).alias("pair_precision"), (total("tp") / F.greatest(F.lit(1), total(F.col("tp") + F.col("fn")))).alias("pair_recall"), F.avg(F.when(F.col("tp") + F.col("fn") > 0, (F.col("fn") == 0).cast("double"))).alias("complete_sets"), F.avg(F.when(F.col("tp") + F.col("fn") == 0, (F.col("fp") == 0).cast("double"))).alias("empty_accuracy"))


def ceiling(queries: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Macro F0.5 of a perfect matcher over the candidates."""
    key = ["s1_id", "target_id"]
    found = truth.join(candidates.select(*key).withColumn("c", F.lit(1)), key, "left").groupBy("s1_id").agg(F.count("c").alias("tp"), F.count_if(F.col("c").isNull()).alias("fn"))
    rows = queries.select("s1_id").join(found, "s1_id", "left").fillna(0, ["tp", "fn"])
    return rows.agg(F.avg(F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(1.25 * F.col("tp") / F.greatest(F.lit(1e-12), 1.25 * F.col("tp") + 0.25 * F.col("fn")))).alias("oracle_f05"))


def recall_at(ranked: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    hit = truth.join(ranked.select("s1_id", "target_id", "rn"), ["s1_id", "target_id"], "left")
    return hit.select("rn", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("rn") <= F.col("k")).alias("found"))


#: Ranges of values whose running sums are made apart.
RANGES = 256


def running(counted: DataFrame, column: str, sums: list[str], down: bool = False) -> DataFrame:
    """Adds ``upto_x``, the sum of x up to and with each row in the order of ``column``, and ``all_x``, the whole sum.

    Rows are dealt in ranges between approximate quantiles: one window sums within a range, another the
    totals of at most ``RANGES`` ranges, so no task takes the whole table. ``column`` holds no value twice.
    """
    ends = counted.agg(F.array_distinct(F.percentile_approx(column, F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]))).alias("__ends"))
    dealt = counted.join(F.broadcast(ends), F.lit(True)).withColumn("__r", F.size(F.filter("__ends", lambda e: e < F.col(column)))).drop("__ends")
    order = lambda c: F.desc(c) if down else F.asc(c)
    totals = dealt.groupBy("__r").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    before, whole = Window.orderBy(order("__r")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    totals = totals.select("__r", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__before_{c}") for c in sums], *[F.sum(f"__{c}").over(whole).alias(f"all_{c}") for c in sums])
    within = Window.partitionBy("__r").orderBy(order(column)).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.join(F.broadcast(totals), "__r")
    return summed.select(*counted.columns, *[(F.sum(c).over(within) + F.col(f"__before_{c}")).alias(f"upto_{c}") for c in sums], *[f"all_{c}" for c in sums])


def index_quantiles(values: DataFrame, column: str, ps: list[float]) -> DataFrame:
    """Sorted value at index floor(p * (n - 1)), by counts of values: ties never meet in one task."""
    upto = running(values.groupBy(column).agg(F.count(F.lit(1)).alias("held")), column, ["held"])
    reached = lambda p: F.col("upto_held") > F.floor(F.lit(float(p)) * (F.col("all_held") - 1))
    found = upto.agg(*[F.min(F.when(reached(p), F.col(column))).alias(f"__{i}") for i, p in enumerate(ps)])
    return found.select(F.inline(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(f"__{i}").alias("value")) for i, p in enumerate(ps)])))


def curve(scored: DataFrame) -> DataFrame:
    """ROC-AUC and average precision, from counts at each distinct score."""
    at = scored.groupBy("prob").agg(F.sum(F.col("is_match").cast("long")).alias("pos"), F.count_if(~F.col("is_match")).alias("neg"))
    at = running(at, "prob", ["pos", "neg"], down=True).withColumnsRenamed({"upto_pos": "tp", "upto_neg": "fp"})
    at = at.withColumn("area", F.col("neg") * (F.col("tp") - F.col("pos") / 2)).withColumn("gain", F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return at.agg((F.sum("area") / F.greatest(F.lit(1), F.max("tp") * F.max("fp"))).alias("auc"), (F.sum("gain") / F.greatest(F.lit(1), F.max("tp"))).alias("average_precision"))


def bootstrap(deltas: DataFrame, key: str, column: str, draws: int = 1000) -> DataFrame:
    """Mean difference with its 95 % interval, from Poisson-weighted resamples drawn by hash."""
    u = lambda s: (F.pmod(F.xxhash64(key, "b", F.lit(s)), F.lit(1_000_003)) + 0.5) / 1_000_003
    p = [sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) for i in range(8)]  # distribution of Poisson(1)
    weight = sum((u(0) > x).cast("int") for x in p)
    drawn = deltas.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws)))).groupBy("b").agg((F.sum(F.col(column) * weight) / F.greatest(F.lit(1), F.sum(weight))).alias("m"))
    ends = drawn.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return deltas.agg(F.avg(column).alias("mean")).join(ends)


def error_budget(truth: DataFrame, candidates: DataFrame, links: DataFrame) -> DataFrame:
    """Each true or claimed pair as found, missed by retrieval, rejected, or false."""
    key = ["s1_id", "target_id"]
    mark = lambda df, c: df.select(*key, F.lit(1).alias(c))
    all_ = mark(truth, "t").join(mark(links, "p"), key, "full_outer").join(mark(candidates, "c"), key, "left")
    kind = F.when(F.expr("t = 1 and p = 1"), "found").when(F.col("t").isNull(), "false").when(F.col("c").isNull(), "missed_retrieval").otherwise("rejected")
    return all_.select(*key, kind.alias("kind"))


def label_integrity(truth: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    t = truth.join(queries.select(F.col("entity_id").alias("s1_id"), F.col("country").alias("qc")), "s1_id", "left").join(targets.select("target_id", F.col("country").alias("tc")), "target_id", "left")
    return t.agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("qc").isNull()).alias("missing_s1"), F.count_if(F.col("tc").isNull()).alias("missing_target"), F.count_if(F.col("qc") != F.col("tc")).alias("cross_country"), (F.count("target_id") - F.count_distinct("target_id")).alias("reused_targets"))


def bins(c: Column, edges: list[int]) -> Column:
    out = F.when(c.isNull(), "missing").when(c < edges[0], f"<{edges[0]}")
    for a, b in zip(edges, edges[1:], strict=False):
        out = out.when(c < b, f"{a}-{b - 1}")
    return out.otherwise(f"{edges[-1]}+")


def threshold_sweep(scored: DataFrame, grid: list[float], *by: str) -> DataFrame:
    """True and claimed links at each threshold, from one pass, and the best by micro F0.5."""
    at = scored.select(*by, "prob", "is_match", F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("threshold"))
    hit = F.col("prob") >= F.col("threshold")
    out = at.groupBy(*by, "threshold").agg(F.count_if(hit & F.col("is_match")).alias("tp"), F.count_if(hit & ~F.col("is_match")).alias("fp"), F.count_if(~hit & F.col("is_match")).alias("fn"))
    return out.withColumn("f05", f05(F.col("tp"), F.col("fp"), F.col("fn")))
