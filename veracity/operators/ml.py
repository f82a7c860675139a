"""Weighted, class-balanced logistic regression with calibration, and choice between feature subsets."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics

#: Feature subsets: the risk h alone, the audit features, all, and all with isotonic calibration.
VARIANTS = {"v1": ((0,), "none"), "v2": (tuple(range(10)), "none"), "v3": (tuple(range(17)), "none"), "v4": (tuple(range(17)), "isotonic")}


@dataclass
class Classifier:
    """A fitted model: standardised subset of ``features``, logistic weights, calibrator."""

    indices: tuple[int, ...]
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    model: LogisticRegressionModel | None = None
    calibration: str = "none"
    calibrator: IsotonicRegressionModel | LogisticRegressionModel | None = None

    def scaled(self, features: Column) -> Column:
        return array_to_vector(F.array(*((F.get(features, F.lit(i)).cast("double") - m) / s for i, m, s in zip(self.indices, self.mean, self.scale, strict=True))))

    def margin(self, df: DataFrame, features: str = "features") -> DataFrame:
        out = self.model.transform(df.withColumn("_x", self.scaled(F.col(features))))
        return out.withColumn("margin", vector_to_array("rawPrediction")[1]).withColumn("proba", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")

    def predict(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds ``margin`` and ``proba``, calibrated if there is a calibrator, in [0, 1]."""
        out = self.margin(df, features)
        if self.calibration == "isotonic":
            out = self.calibrator.transform(out.withColumn("features_", F.col("margin"))).withColumn("proba", F.col("prediction")).drop("prediction", "features_")
        elif self.calibration == "sigmoid":
            out = self.calibrator.transform(out.withColumn("_m", array_to_vector(F.array("margin")))).withColumn("proba", vector_to_array("probability")[1]).drop("_m", "rawPrediction", "probability", "prediction")
        return out.withColumn("proba", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "proba")))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        if self.calibrator is not None:
            self.calibrator.write().overwrite().save(f"{path}/calibrator")
        spark = SparkSession.active()
        meta = json.dumps({"indices": self.indices, "mean": self.mean, "scale": self.scale, "calibration": self.calibration})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str) -> Classifier:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        out = cls(tuple(meta["indices"]), meta["mean"], meta["scale"], LogisticRegressionModel.load(f"{path}/model"), meta["calibration"])
        kinds = {"isotonic": IsotonicRegressionModel, "sigmoid": LogisticRegressionModel}
        if out.calibration in kinds:
            out.calibrator = kinds[out.calibration].load(f"{path}/calibrator")
        return out


def _balanced(df: DataFrame, label: str, weight: str | None) -> DataFrame:
    table = {r[label]: r["class_weight"] for r in metrics.class_weights(df, label).collect()}  # a row a class
    by_class = F.lit(1.0)
    for k, w in table.items():
        by_class = F.when(F.col(label) == k, w).otherwise(by_class)
    return df.withColumn("_weight", by_class * (F.col(weight) if weight else F.lit(1.0)))


def fit(train: DataFrame, validation: DataFrame | None = None, *, indices: tuple[int, ...] = tuple(range(17)), label: str = "label", weight: str | None = None, calibration: str = "isotonic", c: float = 1.0, max_iter: int = 3000) -> Classifier:
    """Fits scaler and regression on ``train`` and a calibrator on ``validation``, if that has two classes.

    The penalty of strength 1/c on the summed loss is 1/(c * sum of weights) on Spark's mean loss.
    """
    columns = {f"f{i}": F.get("features", F.lit(i)).cast("double") for i in indices}
    moments = metrics.moments(train.select(*(v.alias(k) for k, v in columns.items())), list(columns))
    out = Classifier(indices, [moments[k][0] for k in columns], [moments[k][1] for k in columns])
    rows = _balanced(train, label, weight).select(out.scaled(F.col("features")).alias("_x"), F.col(label).cast("double").alias("label"), "_weight")
    total = rows.agg(F.sum("_weight")).first()[0] or 1.0
    out.model = LogisticRegression(featuresCol="_x", weightCol="_weight", regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-8).fit(rows)
    if validation is None or calibration == "none" or validation.select(label).distinct().count() < 2:
        return out
    scored = out.margin(_balanced(validation, label, weight) if calibration == "sigmoid" else validation.withColumn("_weight", F.col(weight) if weight else F.lit(1.0)))
    if calibration == "isotonic":
        rows = scored.select(F.col("margin").alias("features_"), F.col(label).cast("double").alias("label"), "_weight")
        out.calibrator = IsotonicRegression(featuresCol="features_", weightCol="_weight").fit(rows)
    else:
        rows = scored.select(array_to_vector(F.array("margin")).alias("_m"), F.col(label).cast("double").alias("label"), "_weight")
        total = rows.agg(F.sum("_weight")).first()[0] or 1.0
        out.calibrator = LogisticRegression(featuresCol="_m", weightCol="_weight", regParam=1.0 / total, standardization=False, maxIter=1000).fit(rows)
    out.calibration = calibration
    return out


def select_variant(train: DataFrame, validation: DataFrame, *, label: str = "label", weight: str | None = None) -> tuple[str, Classifier, dict[str, float]]:
    """Fits every variant and takes the best average precision on the validation rows; the earliest wins a tie."""
    found: dict[str, float] = {}
    best: tuple[str, Classifier] | None = None
    for name, (indices, calibration) in VARIANTS.items():
        model = fit(train, validation, indices=indices, label=label, weight=weight, calibration=calibration)
        found[name] = metrics.average_precision(model.predict(validation), "proba", label).first()[0]
        if best is None or found[name] > found[best[0]]:
            best = name, model
    return best[0], best[1], found


def centred_pca(df: DataFrame, values: str, k: int, out: str = "pca") -> DataFrame:
    """Principal components of an array column, centred first, which Spark's PCA leaves to the caller."""
    size = df.agg(F.max(F.size(values))).first()[0] or 0
    means = df.select(*(F.get(values, F.lit(i)).cast("double").alias(f"m{i}") for i in range(size)))
    means = means.agg(*(F.avg(c).alias(c) for c in means.columns)).first()
    centred = df.withColumn("_v", array_to_vector(F.array(*(F.get(values, F.lit(i)).cast("double") - means[i] for i in range(size)))))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(centred).transform(centred).withColumn(out, vector_to_array("_p")).drop("_v", "_p")


def probe_features(df: DataFrame, vector: str, parts: list[str], k: int = 64, out: str = "features") -> DataFrame:
    """The first ``k`` centred components of a vector (as many as it has, if fewer) and the arrays ``parts`` in one array, which
    ``fit`` scales and weighs by class."""
    size = df.agg(F.max(F.size(vector))).first()[0] or 0
    both = centred_pca(df, vector, min(k, size), "_pca")
    return both.withColumn(out, F.concat("_pca", *(F.transform(p, lambda x: x.cast("double")) for p in parts))).drop("_pca")


def split_report(scored: DataFrame, label: str = "label", proba: str = "proba", seconds: str | None = None, most: float = 1.0) -> dict[str, float]:
    """Rows, positives, average precision and accuracy at a half; with ``seconds`` also the 99th percentile of that overhead and
    whether it is below ``most``."""
    n, positive, right = scored.agg(F.count("*"), F.sum((F.col(label) == 1).cast("int")), F.avg(((F.col(proba) >= 0.5) == (F.col(label) == 1)).cast("double"))).first()
    out = {"rows": n, "positives": positive or 0, "average_precision": metrics.average_precision(scored, proba, label).first()[0], "accuracy": right or 0.0}
    if seconds:
        p99 = metrics.latency_summary(scored, seconds).first()["p99"]
        out |= {"p99": p99, "in_time": p99 < most}
    return out
