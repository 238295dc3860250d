"""Models trained and tested over folds of subjects, an identifiability probe and a projection.

Tables have `subject_id`, `seq`, `label` (0 or 1) and `features` (an array of doubles of one length, without nulls).
A fold is a filter on the table, not a copy of it. Loops run over folds, subjects or models, whose number doesn't grow
with the rows; every fit and every scoring is a distributed job.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from sigwarn.functions import hash_order, sigmoid
from sigwarn.operators.metrics import auc_ap
from sigwarn.sources.results import fresh_path, stored

#: Folds whose models are trained at the same time.
FOLDS_AT_ONCE = 4
#: The columns that the estimators read and write.
COLUMNS = dict(featuresCol="scaled", labelCol="label")


def logistic() -> Estimator:
    return LogisticRegression(weightCol="weight", maxIter=20, regParam=0.01, **COLUMNS)


def forest() -> Estimator:
    return RandomForestClassifier(weightCol="weight", numTrees=10, maxDepth=5, seed=7, **COLUMNS)


def boosted() -> Estimator:
    return GBTClassifier(weightCol="weight", maxIter=5, maxDepth=3, seed=7, **COLUMNS)


def margin(regularised: float = 0.01, rounds: int = 15) -> Estimator:
    """Linear margin."""
    return LinearSVC(weightCol="weight", maxIter=rounds, regParam=regularised, **COLUMNS)


def kernel_map(landmarks: np.ndarray, gamma: float, least: float = 1e-10) -> np.ndarray:
    """The matrix that takes kernel values with the landmarks to features whose inner products are the kernel between landmarks."""
    values, vectors_ = np.linalg.eigh(gaussian(landmarks, landmarks, gamma))
    kept = values > least * values[-1]
    return vectors_[:, kept] / np.sqrt(values[kept])


def gaussian(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))


class Landmarks(Estimator):
    """Features of a Gaussian kernel from at most `size` training rows, drawn by hash: exact with all rows, else the best that they span.

    What comes to the driver and goes to the executors is `size` rows and a size x size matrix. gamma None: 1 over the
    number of features times their variance.
    """

    def __init__(self, size: int = 256, gamma: float | None = None, inputCol: str = "scaled", outputCol: str = "mapped", seed: str = "landmarks") -> None:
        super().__init__()
        self.size, self.gamma, self.columns, self.seed = size, gamma, (inputCol, outputCol), seed

    def _fit(self, dataset: DataFrame) -> LandmarkModel:
        drawn = dataset.orderBy(hash_order(self.seed, F.col("subject_id"), F.col("seq")), "subject_id", "seq").limit(self.size)
        at = np.array([r[0] for r in drawn.select(vector_to_array(self.columns[0])).collect()])
        gamma = self.gamma if self.gamma is not None else 1 / max(at.shape[1] * at.var(), 1e-12)
        return LandmarkModel(at, gamma, self.columns)


class LandmarkModel(Model):
    """Adds the kernel features of Landmarks."""

    def __init__(self, landmarks: np.ndarray, gamma: float, columns: tuple[str, str]) -> None:
        super().__init__()
        self.landmarks, self.gamma, self.columns = landmarks, gamma, columns

    def _transform(self, dataset: DataFrame) -> DataFrame:
        landmarks, gamma, to = self.landmarks, self.gamma, kernel_map(self.landmarks, self.gamma)

        @F.pandas_udf("array<double>")
        def mapped(column: pd.Series) -> pd.Series:
            x = np.stack(column.to_list()) if len(column) else np.zeros((0, landmarks.shape[1]))
            return pd.Series(list(gaussian(x, landmarks, gamma) @ to))

        return dataset.withColumn(self.columns[1], array_to_vector(mapped(vector_to_array(self.columns[0]))))


def kernel_margin(size: int = 256, gamma: float | None = None, regularised: float = 0.01, rounds: int = 30, offset: bool = True) -> Estimator:
    """Margin with a Gaussian kernel, on the features that landmarks span."""
    plain = LinearSVC(weightCol="weight", maxIter=rounds, regParam=regularised, standardization=False, fitIntercept=offset, featuresCol="mapped", labelCol="label")
    return Pipeline(stages=[Landmarks(size, gamma), plain])


def dense(width: int) -> Estimator:
    return MultilayerPerceptronClassifier(layers=[width, 16, 2], maxIter=20, seed=7, **COLUMNS)


def vectors(df: DataFrame) -> DataFrame:
    """df with `vector`, and the label as a double."""
    return df.withColumns({"vector": array_to_vector("features"), "label": F.col("label").cast("double")})


def weighted(df: DataFrame, label: str = "label") -> DataFrame:
    """df with `weight` n / (classes * rows of the class)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_c"))
    sizes = sizes.crossJoin(F.broadcast(total)).select(label, (F.col("_all") / (F.col("_c") * F.col("_n"))).alias("weight"))  # one row
    return df.join(F.broadcast(sizes), label)  # a row per class


def scaler(center: bool = True) -> StandardScaler:
    """Standardises with the training rows' mean and deviation."""
    return StandardScaler(inputCol="vector", outputCol="scaled", withMean=center, withStd=True)


def scores(scored: DataFrame) -> DataFrame:
    """scored with `prob`, from the probability or, where a model has none, from its squashed margin."""
    if "probability" in scored.columns:
        return scored.withColumn("prob", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.withColumn("prob", sigmoid(F.get(vector_to_array("rawPrediction"), F.lit(1))))


def fit_and_score(train: DataFrame, test: DataFrame, estimator: Estimator) -> DataFrame:
    """(subject_id, seq, label, prob) of test; scaling and class weights come from train alone. Both have `vector`."""
    model = Pipeline(stages=[scaler(), estimator]).fit(weighted(train))
    return scores(model.transform(test)).select("subject_id", "seq", F.col("label").cast("int").alias("label"), "prob")


def subjects_of(df: DataFrame) -> list:
    """Subjects with both classes among the other subjects' rows, in order: one fold each."""
    sizes = df.groupBy("subject_id").agg(F.sum((F.col("label") == 1).cast("long")).alias("p"), F.sum((F.col("label") == 0).cast("long")).alias("n")).collect()
    p, n = sum(r["p"] for r in sizes), sum(r["n"] for r in sizes)
    return sorted(r["subject_id"] for r in sizes if p > r["p"] and n > r["n"])


def _gathered(df: DataFrame, parts: list[Callable[[], DataFrame]]) -> DataFrame:
    """(subject_id, seq, label, prob) of all parts, some of them worked out at the same time.

    Each is written as soon as its model is there, so that plans stay short whatever the number of folds.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, "scores")
    schema = f"subject_id {df.schema['subject_id'].dataType.simpleString()}, seq long, label int, prob double"

    def write(k: int) -> None:
        parts[k]().withColumn("seq", F.col("seq").cast("long")).write.parquet(f"{path}/{k}")

    if not parts:
        return spark.createDataFrame([], schema)
    with ThreadPool(min(FOLDS_AT_ONCE, len(parts))) as pool:
        pool.map(inheritable_thread_target(spark)(write), range(len(parts)), chunksize=1)
    return spark.read.schema(schema).parquet(*[f"{path}/{k}" for k in range(len(parts))])


def leave_one_out(df: DataFrame, estimator: Estimator) -> DataFrame:
    """(subject_id, seq, label, prob): each subject scored by a model of all the others; empty if there is no fold."""
    rows = stored(vectors(df), "features")
    other, own = (lambda s: rows.where(F.col("subject_id") != s)), (lambda s: rows.where(F.col("subject_id") == s))
    return _gathered(df, [partial(lambda s: fit_and_score(other(s), own(s), estimator), s) for s in subjects_of(rows)])


class AveragePrecision(Evaluator):
    """Exact average precision of all rows; 0 where a class is missing."""

    def _evaluate(self, dataset: DataFrame) -> float:
        rows = scores(dataset).select(F.lit(1).alias("g"), F.col("label").cast("int").alias("label"), "prob")
        found = auc_ap(rows, ["g"]).first()
        return float(found["ap"] or 0.0) if found else 0.0

    def isLargerBetter(self) -> bool:
        return True


def grid_search(df: DataFrame, strengths: list[float], folds: int) -> DataFrame:
    """(reg_param, mean_ap, best): inner validation over groups of subjects; a subject's rows stay in one fold."""
    place = {s: i % folds for i, s in enumerate(sorted(r[0] for r in df.select("subject_id").distinct().collect()))}
    dealt = df.sparkSession.createDataFrame(list(place.items()), df.select("subject_id").schema.add("fold", IntegerType()))
    rows = weighted(vectors(df)).join(F.broadcast(dealt), "subject_id")  # a row per subject
    estimator = logistic()
    search = CrossValidator(estimator=Pipeline(stages=[scaler(), estimator]), estimatorParamMaps=ParamGridBuilder().addGrid(estimator.regParam, strengths).build(), evaluator=AveragePrecision(), numFolds=folds, foldCol="fold", parallelism=2)
    means = [float(v) for v in search.fit(rows).avgMetrics]
    best = means.index(max(means))
    return df.sparkSession.createDataFrame([(s, v, k == best) for k, (s, v) in enumerate(zip(strengths, means, strict=True))], "reg_param double, mean_ap double, best boolean")


def principal_components(df: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(subject_id, seq, label, projected) of all rows and (component, explained), the share of variance from 1 on."""
    rows = vectors(df)
    model = Pipeline(stages=[scaler(), PCA(k=k, inputCol="scaled", outputCol="components")]).fit(rows)
    shares = [(i + 1, float(v)) for i, v in enumerate(model.stages[-1].explainedVariance)]
    projected = model.transform(rows).select("subject_id", "seq", F.col("label").cast("int").alias("label"), vector_to_array("components").alias("projected"))
    return projected, df.sparkSession.createDataFrame(shares, "component int, explained double")
