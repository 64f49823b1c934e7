"""Rescue rules: candidates that were turned down, judged by how much they resemble their query's accepted targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import tables as TB
from matchloom.functions import text as X
from matchloom.operators.beside import best_beside

#: Least score and least resemblance to any accepted target, by rule.
SEED_RULES = {
    "strict_name_address": {"prob": 0.1, "name": 90, "address": 90},
    "name_focused": {"prob": 0.05, "name": 95, "address": 80},
    "address_focused": {"prob": 0.05, "name": 80, "address": 95},
    "higher_model_floor": {"prob": 0.2, "name": 80, "address": 90},
    "token_name_address": {"prob": 0.1, "name_set": 90, "address": 90},
}
#: Fixed values, as above.
SIBLING_RULES = {
    "strict_name_address": {"prob": 0.05, "name": 90, "address": 90},
    "strong_name_address": {"prob": 0.10, "name": 95, "address": 80},
    "strong_address_name": {"prob": 0.10, "name": 75, "address": 95},
    "translit_name_address": {"prob": 0.10, "latin_name": 90, "address": 80},
    "address_set_name": {"prob": 0.20, "name": 80, "address_set": 95},
}
MEASURES = ["name", "name_set", "latin_name", "address", "address_set"]


def _measured(c, a):
    yield from (TB.ratio(c["name"], a["name"]), TB.token_set(c["name"], a["name"]), TB.ratio(c["latin"], a["latin"]), TB.ratio(c["address"], a["address"]), TB.token_set(c["address"], a["address"]))


def resemblance(candidates: DataFrame, anchors: DataFrame, fields: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """``candidates`` that have another accepted target beside them, with their best measure to any of these.

    ``candidates`` and ``anchors`` have s1_id and target_id, ``fields`` target_id, name and address.
    ``blocks`` (s1_id, block): queries that tend to share targets, which are compared once for all of them.
    """
    texts = fields.fillna("", ["name", "address"]).select("target_id", "name", "address", X.to_ascii("name").alias("latin"))
    carry = [c for c in candidates.columns if c not in ("s1_id", "target_id")]
    return best_beside(candidates, anchors, texts, _measured, MEASURES, blocks, carry).drop("siblings")


def passes(rule: dict[str, float]) -> Column:
    ok = F.lit(True)
    for name, least in rule.items():
        ok = ok & (F.col(name) >= least)
    return ok


def rule_counts(judged: DataFrame, rules: dict[str, dict[str, float]]) -> DataFrame:
    """One row: what each rule would add, true and false, from one pass."""
    return judged.agg(*[F.count_if(passes(r) & (F.col("is_match") == hit)).alias(f"{k}_{hit}") for k, r in rules.items() for hit in (True, False)])


def summed(counts: DataFrame, rules: dict[str, dict[str, float]]) -> DataFrame:
    """Counts of parts as a row for each rule; rules that add nothing have a row too."""
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for k in rules for c in (f"{k}_True", f"{k}_False")])
    rows = [F.struct(F.lit(k).alias("rule"), (F.col(f"{k}_True") + F.col(f"{k}_False")).alias("added"), F.col(f"{k}_True").alias("added_true"), F.col(f"{k}_False").alias("added_false")) for k in rules]
    return total.select(F.inline(F.array(*rows)))


def rule_gains(judged: DataFrame, rules: dict[str, dict[str, float]]) -> DataFrame:
    """What each rule would add, true and false."""
    return summed(rule_counts(judged, rules), rules)


def rescued(judged: DataFrame, rule: dict[str, float]) -> DataFrame:
    """The pairs that a rule takes back."""
    return judged.where(passes(rule)).select("s1_id", "target_id")
