"""Boosted trees on the model table and their scores over folds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F

from colwright.operators import boosting, encode, metrics
from colwright.operators.parallel import side_by_side  # noqa: F401
from colwright.storage import cut_lineage


#: Boosting rounds of every model, unless a caller names another number.
ROUNDS = 20


def fit_regressor(train: DataFrame, features: Sequence[str], target: str, rounds: int = ROUNDS, seed: int = 42) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(features), outputCol="__features")
    trees = GBTRegressor(featuresCol="__features", labelCol=target, maxIter=rounds, seed=seed)
    return Pipeline(stages=[assembler, trees]).fit(train)


def fit_classifier(
    train: DataFrame, features: Sequence[str], label: str, classes: int, rounds: int = ROUNDS, seed: int = 42
) -> PipelineModel:
    """``label`` holds codes 0..classes-1. More than two classes are learned one against the rest."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="__features")
    trees = GBTClassifier(featuresCol="__features", labelCol=label, maxIter=rounds, seed=seed)
    if classes > 2:
        trees = OneVsRest(classifier=trees, featuresCol="__features", labelCol=label, parallelism=min(classes, 4))
    return Pipeline(stages=[assembler, trees]).fit(train)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).drop("__features", "rawPrediction", "probability")


def with_class_codes(df: DataFrame, target: str) -> tuple[DataFrame, int]:
    """``df`` with the target as codes 0..classes-1, and the number of classes."""
    coded = encode.label_encode(df, target, "__y").drop(target).withColumnRenamed("__y", target)
    return coded, coded.agg(F.count_distinct(target)).first()[0]


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def cross_validate(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    fold: str,
    folds: int,
    task: str,
    ordered: bool = False,
    rounds: int = ROUNDS,
    seed: int = 42,
    parallel: int = 4,
) -> DataFrame:
    """(fold, score, n, n_scored) of boosted trees; ``task`` is ``regression``, ``series`` (relative error) or ``classification``.

    The trees of all folds grow together (``boosting``); tables of folds are prepared side by side, ``parallel`` at a time.
    ``seed`` is taken for callers that name one: these trees draw nothing at random.
    """
    base, classes = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([target, fold, *features])]), None
    base = cut_lineage(base, "model")
    if task == "classification":
        base, classes = with_class_codes(base, target)
    tables = {j: base for j in range(folds)}
    scored = boosting.out_of_fold(tables, {"all": features}, target, fold, ordered, classes, rounds, parallel=parallel)
    metric = {"classification": "accuracy", "regression": "rmse", "series": "nrmse"}[task]
    spread = metrics.train_spread(base, target, fold, folds, ordered) if metric == "nrmse" else None
    return metrics.fold_scores(scored, metric, target, "prediction", [fold], spread)
