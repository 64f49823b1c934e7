"""Decisions over scored pairs: thresholds, caps, ownership, vetoes, gates, merges, validation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.beside import best_beside
from matchloom.operators.blocking import best
from matchloom.operators.features import numbers


def threshold_of(by: Column, table: dict[str, float], default: float) -> Column:
    if not table:
        return F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), by), F.lit(default))


def parse_thresholds(items: list[str]) -> dict[str, float]:
    """``COUNTRY:VALUE`` items, or ``COUNTRY:SOURCE:VALUE``; the value is what follows the last colon."""
    return {k: float(v) for k, _, v in (x.rpartition(":") for x in items)}


def accept(scored: DataFrame, table: dict[str, float], default: float, blank: float | None = 0.8) -> DataFrame:
    """Pairs at or above the threshold of their country; blank target addresses have one of their own."""
    limit = threshold_of(F.col("country"), table, default)
    if blank is not None and "t_address" in scored.columns:
        limit = F.when(F.coalesce("t_address", F.lit("")) == "", blank).otherwise(limit)
    return scored.where(F.col("prob") >= limit)


def cap(scored: DataFrame, k: int = 11) -> DataFrame:
    return best(scored, "prob", k).drop("rn")


def exclusive(scored: DataFrame) -> DataFrame:
    """Each target stays with the query of its best score, ties with the least id."""
    at = Window.partitionBy("target_id").orderBy(F.desc("prob"), "s1_id")
    return scored.withColumn("__at", F.row_number().over(at)).where("__at = 1").drop("__at")


def nearby_number_veto(pairs: DataFrame, country: str = "US", reach: int = 10) -> DataFrame:
    """Where some link has exactly the query's number, links with another number within ``reach`` go. Reads q_num, t_num."""
    anchored = F.max((F.col("t_num") == F.col("q_num")) & (F.col("q_num") >= 0)).over(Window.partitionBy("s1_id"))
    near = (F.col("q_num") >= 0) & (F.col("t_num") >= 0) & F.abs(F.col("q_num") - F.col("t_num")).between(1, reach)
    return pairs.withColumn("__anchored", anchored).where(~((F.col("country") == country) & F.col("__anchored") & near)).drop("__anchored")


def low_coverage(queries: DataFrame, links: DataFrame, country: str, most: int) -> DataFrame:
    """Queries of a country with at most ``most`` links, none included: the gate of a further route."""
    n = links.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))
    return queries.where(F.col("country") == country).select(F.col("entity_id").alias("s1_id")).join(n, "s1_id", "left").select("s1_id", F.coalesce("n", F.lit(0)).alias("n_matches")).where(F.col("n_matches") <= most)


def gate(extra: DataFrame, gated: DataFrame) -> DataFrame:
    return extra.join(gated.select("s1_id"), "s1_id", "left_semi")


def new_pairs(extra: DataFrame, base: DataFrame) -> DataFrame:
    return extra.join(base, ["s1_id", "target_id"], "left_anti")


def merge_links(base: DataFrame, scored_extra: DataFrame, table: dict[str, float], default: float) -> DataFrame:
    """Base links and those of the new pairs that are accepted; base pairs aren't scored again."""
    fresh = accept(new_pairs(scored_extra, base), table, default)
    return base.select("s1_id", "target_id", "prob").unionByName(fresh.select("s1_id", "target_id", "prob"))


def replace_part(chosen: DataFrame, part: DataFrame, additions: DataFrame) -> DataFrame:
    key = ["s1_id", "target_id"]
    return chosen.select(key).join(part, key, "left_anti").unionByName(additions.select(key)).distinct()


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    key = ["s1_id", "target_id"]
    both = before.select(*key, F.lit(1).alias("b")).join(after.select(*key, F.lit(1).alias("a")), key, "full_outer")
    return both.where("a is null or b is null").select(*key, F.when(F.col("b").isNull(), "added").otherwise("removed").alias("change"))


def decide(scored: DataFrame, table: dict[str, float], default: float, k: int = 11) -> DataFrame:
    return exclusive(cap(accept(scored, table, default), k))


def validate(records: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """One row of counts: rows, links, empties, and each kind of fault (all zero in a valid result)."""
    c, m = F.col("c"), F.col("m")
    lists = records.select(F.col("entity_id").alias("id"), F.lit(1).alias("known")).join(candidates.select(F.col("source1_entity_id").alias("id"), F.col("candidate_entity_ids").alias("ct")), "id", "full_outer").join(matches.select(F.col("source1_entity_id").alias("id"), F.col("matched_entity_ids").alias("mt")), "id", "full_outer")
    split = lambda x: F.when(F.coalesce(x, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(x, ","))
    lists = lists.withColumn("c", split(F.col("ct"))).withColumn("m", split(F.col("mt")))
    count = lambda x, name: F.coalesce(F.sum(x.cast("long")), F.lit(0)).alias(name)
    return lists.agg(F.count(F.lit(1)).alias("n_rows"), count(F.size(c), "candidates"), count(F.size(m), "matches"), count(F.size(m) == 0, "empty"), count(F.col("known").isNull() | F.col("ct").isNull() | F.col("mt").isNull(), "row_faults"), count((F.size(c) != F.size(F.array_distinct(c))) | (F.size(m) != F.size(F.array_distinct(m))), "repeated"), count(F.exists(c, lambda x: ~x.rlike("^S[23]-")), "bad_prefix"), count(F.size(F.array_except(m, c)) > 0, "not_candidates"))


def caps_sweep(scored: DataFrame, truth: DataFrame, caps: list[int]) -> DataFrame:
    """Links and true links kept under each cap, from one ranking."""
    ranked = best(scored, "prob", max(caps)).join(truth.withColumn("hit", F.lit(1)), ["s1_id", "target_id"], "left")
    return ranked.select("rn", "hit", F.explode(F.array(*[F.lit(c) for c in caps])).alias("cap")).where("rn <= cap").groupBy("cap").agg(F.count(F.lit(1)).alias("links"), F.count("hit").alias("true_links"))


def rescue(rejected: DataFrame, name_least: float, address_least: float, prob_least: float) -> DataFrame:
    """Rejected cross-script pairs that transliterated fields and a fair score speak for."""
    return rejected.where((F.col("latin_name") >= name_least) & (F.col("latin_address") >= address_least) & (F.col("prob") >= prob_least))


def anchor_group_rule(candidates: DataFrame, anchors: DataFrame, fields: DataFrame, alike: Callable, name_least: float, address_least: float, shared_number: bool = False, blocks: DataFrame | None = None) -> DataFrame:
    """Candidates that resemble any accepted sibling enough, in name and in address, and share a number with it if asked to.

    ``fields`` have target_id, name and address; ``alike`` makes a table of two lists of texts.
    """

    def good(c, a):
        ok = (alike(c["name"], a["name"]) >= name_least) & (alike(c["address"], a["address"]) >= address_least)
        if shared_number:
            theirs = [numbers(x) for x in a["address"]]
            ok &= np.array([[bool(d & e) for e in theirs] for d in (numbers(x) for x in c["address"])])
        return [ok.astype(np.float64)]

    return best_beside(candidates, anchors, fields, good, ["ok"], blocks).where("ok > 0").select("s1_id", "target_id")


def rule_grid(pairs: DataFrame, axes: dict[str, list[float]], truth_col: str = "is_match") -> DataFrame:
    """Counts of pairs and matches for every combination of lower limits; the grid is a parameter, not data."""
    rows, exploded = [], pairs
    for name, values in axes.items():
        exploded = exploded.withColumn(f"least_{name}", F.explode(F.array(*[F.lit(float(v)) for v in values]))).where(F.col(name) >= F.col(f"least_{name}"))
        rows.append(f"least_{name}")
    return exploded.groupBy(*rows).agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col(truth_col).cast("long")).alias("matches"))
