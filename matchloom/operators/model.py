"""Learning to match: splits, leakage guard, hard negatives, two-stage ranking, blank-address specialist."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import text as X
from matchloom.operators.blocking import best
from matchloom.operators.features import SETS, kind_of
from matchloom.operators.evaluate import macro, per_query
from matchloom.sources.records import sample_rows, sample_strata


def guard(pairs: DataFrame, owners: DataFrame) -> DataFrame:
    """Training pairs without negatives whose target belongs to a held-out query. ``owners``: target_id, split."""
    held = owners.where("split <> 'training'").select("target_id").distinct().withColumn("held", F.lit(True))
    return pairs.join(held, "target_id", "left").where("split <> 'training' or is_match or held is null").drop("held")


def hard_negatives(scored: DataFrame, hard: int = 20, random: int = 5) -> DataFrame:
    """All matches, each query's best-scored negatives, and some of its others by hash."""
    wrong = scored.where("not is_match")
    top = best(wrong, "prob", hard).drop("rn")
    rest = wrong.join(top.select("s1_id", "target_id"), ["s1_id", "target_id"], "left_anti")
    return scored.where("is_match").unionByName(top).unionByName(sample_strata(rest, ["s1_id"], "target_id", random))


#: Settings of the trainers. Depths stand for 31, 15 and 7 leaves; Spark's trees have no penalty on weights.
TRAINERS = {
    "base": {"trees": 500, "rate": 0.05, "depth": 5, "least": 50},
    "hard": {"trees": 1200, "rate": 0.04, "depth": 5, "least": 50},
    "blank": {"trees": 500, "rate": 0.05, "depth": 4, "least": 20},
    "siblings": {"trees": 180, "rate": 0.04, "depth": 3, "least": 50},
}
#: Queries that the trainer on hard negatives samples, its hard and its other negatives of a query.
SAMPLE, HARD, RANDOM = 200_000, 20, 5
#: Thresholds that the model of siblings is tried with.
SIBLING_GRID = (0.5, 0.65, 0.75, 0.85, 0.9, 0.95, 0.98, 0.99)


def fit(rows: DataFrame, trees: int = 20, depth: int = 5, rate: float = 0.1, least: int = 1, columns: float = 1.0, seed: int = 7) -> PipelineModel:
    """Boosted trees on ``vector`` and ``label``; rows with ``is_validation`` stop them early, where there are both kinds of rows."""
    learner = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=rate, minInstancesPerNode=least, featureSubsetStrategy=str(columns) if columns < 1 else "all", seed=seed)
    kinds = {r["is_validation"] for r in rows.select("is_validation").distinct().collect()}
    if kinds == {True, False}:
        learner = learner.setValidationIndicatorCol("is_validation")
    return Pipeline(stages=[learner]).fit(rows)


def train(pairs: DataFrame, kind: str = "latin", trees: int = 20, depth: int = 5, rate: float = 0.1, seed: int = 7, **settings) -> PipelineModel:
    """Boosted trees on the features of a contract."""
    rows = pairs.select(array_to_vector(F.slice("features", 1, len(SETS[kind])).cast("array<double>")).alias("vector"), F.col("is_match").cast("double").alias("label"), F.col("is_validation"))
    return fit(rows, trees, depth, rate, seed=seed, **settings)


def learning_rows(pairs: DataFrame, owners: DataFrame, seed: str = "7") -> DataFrame:
    """Pairs that a model may learn from: no held-out queries, no negatives that held-out queries own.

    ``is_validation`` marks the calibration fold of the training queries and all development queries.
    """
    split = pairs.withColumn("split", X.split_of(seed, F.col("s1_id"))).where("split <> 'validation'")
    return guard(split, owners).withColumn("is_validation", (F.col("split") == "development") | X.calibration_fold(F.col("s1_id")))


def train_base(pairs: DataFrame, owners: DataFrame, kind: str = "latin", **settings) -> PipelineModel:
    return train(learning_rows(pairs, owners), kind, **{**TRAINERS["base"], "columns": 0.9, **settings})


def train_hard(pairs: DataFrame, owners: DataFrame, seed_model: PipelineModel, sample: int = SAMPLE, **settings) -> PipelineModel:
    """On the matches, hardest negatives by the seed model and some others of ``sample`` training queries at most, a documented bound."""
    rows = learning_rows(pairs, owners).where("split = 'training'")
    asked = sample_rows(rows.select("s1_id").distinct(), "s1_id", sample)
    chosen = hard_negatives(predict(seed_model, rows.join(asked, "s1_id", "left_semi")), HARD, RANDOM)
    return train(chosen, "latin", **{**TRAINERS["hard"], "columns": 0.9, **settings})


def train_blank(pairs: DataFrame, owners: DataFrame, **settings) -> PipelineModel:
    """The specialist, on pairs whose target has no address; ``pairs`` have ``df``, the frequency of the target's core name."""
    rows = learning_rows(pairs.where(F.coalesce("t_address", F.lit("")) == ""), owners).where("split = 'training'")
    return train(rows.withColumn("features", F.concat("features", F.array(F.log1p("df").cast("float")))), "blank", **{**TRAINERS["blank"], "columns": 0.9, **settings})


def even_half(query: str = "s1_id"):
    return F.crc32(query) % 2 == 0


def train_siblings(judged: DataFrame, **settings) -> PipelineModel:
    """A second model over ``context`` of turned-down candidates, from one half of the queries by crc32."""
    rows = judged.where(even_half()).select(array_to_vector("context").alias("vector"), F.col("is_match").cast("double").alias("label"), F.lit(False).alias("is_validation"))
    return fit(rows, **{**TRAINERS["siblings"], **settings})


def predict_siblings(model: PipelineModel, judged: DataFrame) -> DataFrame:
    made = model.transform(judged.withColumn("vector", array_to_vector("context")))
    return made.withColumn("sibling_prob", F.get(vector_to_array("probability"), F.lit(1))).drop("vector", "rawPrediction", "probability", "prediction")


def sibling_sweep(queries: DataFrame, truth: DataFrame, accepted: DataFrame, judged: DataFrame, grid: tuple[float, ...] = SIBLING_GRID) -> DataFrame:
    """Scores on the other half of the queries where candidates from each threshold on are taken back, from one pass."""
    at = F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("threshold")
    tagged = lambda df, *more: df.where(~even_half()).select("*", at).select(F.struct("threshold", "s1_id").alias("s1_id"), *more)
    back = tagged(judged, "target_id", "sibling_prob").where("sibling_prob >= s1_id.threshold").select("s1_id", "target_id")
    links = tagged(accepted, "target_id").unionByName(back).distinct()
    scores = per_query(tagged(queries), tagged(truth, "target_id"), links)
    return macro(scores.withColumn("threshold", F.col("s1_id.threshold")), "threshold")


def predict(model: PipelineModel, pairs: DataFrame, kind: str = "latin", name: str = "prob") -> DataFrame:
    made = model.transform(pairs.withColumn("vector", array_to_vector(F.slice("features", 1, len(SETS[kind])).cast("array<double>"))))
    return made.withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).drop("vector", "rawPrediction", "probability", "prediction")


def save(model: PipelineModel, kind: str, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    SparkSession.getActiveSession().createDataFrame([(json.dumps(SETS[kind]),)], "names string").write.mode("overwrite").json(f"{path}/features")


def load(spark, path: str) -> tuple[PipelineModel, str]:
    names = json.loads(spark.read.schema("names string").json(f"{path}/features").first()["names"])
    return PipelineModel.load(f"{path}/model"), kind_of(names)


def two_stage(pairs: DataFrame, blocker: PipelineModel, matcher: PipelineModel, specialist: PipelineModel | None = None, k: int = 40) -> DataFrame:
    """The blocker ranks on the first features, the matcher scores what is left; a specialist takes blank addresses.

    ``select_prob`` is what thresholds see and ``rank_prob`` the matcher's own score, which caps and owners use.
    """
    kept = best(predict(blocker, pairs, "base", "blocker_prob"), "blocker_prob", k).drop("rn")
    scored = predict(matcher, kept, "latin", "rank_prob")
    if specialist is None:
        return scored.withColumn("select_prob", F.col("rank_prob"))
    blank = F.coalesce("t_address", F.lit("")) == ""
    with_df = scored.where(blank).withColumn("features", F.concat("features", F.array(F.log1p("df").cast("float"))))
    special = predict(specialist, with_df, "blank", "select_prob").withColumn("features", F.slice("features", 1, len(SETS["latin"])))
    return scored.where(~blank).withColumn("select_prob", F.col("rank_prob")).unionByName(special)


def blend(scored: DataFrame, first: str, second: str, weight: float) -> DataFrame:
    return scored.withColumn("prob", (1 - weight) * F.col(first) + weight * F.col(second))
