"""Trained classifiers on Spark MLlib."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.classify import LAYOUT_FEATURES, TEXT_FEATURES, feature_columns


def feature_frame(df: DataFrame, keep: list[str], with_layout: bool = False) -> tuple[DataFrame, list[str]]:
    """The feature columns as doubles, with their names in vector order."""
    names = [*(LAYOUT_FEATURES if with_layout else []), *TEXT_FEATURES]
    return df.select(*keep, *feature_columns(df, with_layout)), names


#: Classifiers that go through their rows many times and for which a row with a weight says the same as that many rows alike. A random
#: forest draws rows, so its rows stay single.
WEIGHTED = ("gradient_boost", "svm")
WEIGHT = "__weight"


def classifier(kind: str = "random_forest", trees: int = 100, depth: int | None = None, iterations: int = 1000):
    """random_forest, gradient_boost and svm (one against the rest, over rows with a weight), or logistic."""
    base = {"featuresCol": "features", "labelCol": "label_index"}
    if kind == "gradient_boost":
        return OneVsRest(classifier=GBTClassifier(maxIter=trees, maxDepth=depth or 6, seed=42, weightCol=WEIGHT, **base), weightCol=WEIGHT, **base)
    if kind == "svm":
        return OneVsRest(classifier=LinearSVC(maxIter=100, weightCol=WEIGHT, **base), weightCol=WEIGHT, **base)
    if kind == "logistic":
        return LogisticRegression(maxIter=iterations, **base)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth or 10, seed=42, **base)


def train_classifier(df: DataFrame, inputs: list[str], label: str = "label", kind: str = "random_forest", **options) -> PipelineModel:
    """Label index, scaled features and classifier; rows with missing values are left out of the fit only.

    Labels and scale are those of all rows. Where the classifier takes weights, rows with equal features and label then become
    one row with their number, so that its many passes go over what differs.
    """
    rows = df.dropna(subset=[*inputs, label]).persist()
    try:
        model = Pipeline(stages=[
            StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="skip"),
            VectorAssembler(inputCols=inputs, outputCol="raw_features", handleInvalid="error"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        ]).fit(rows)
        fitted = counted(rows, [*inputs, label], WEIGHT) if kind in WEIGHTED else rows
        return PipelineModel([*model.stages, classifier(kind, **options).fit(model.transform(fitted))])
    finally:
        rows.unpersist()


def counted(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Each combination of values once, with the number of its rows."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))


def predict_class(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds document_type, confidence and probabilities; classifiers without probabilities leave the last two NULL.

    Every row is kept: a feature that is NULL or not a number counts as its mean in the training rows, which the scaler holds.
    """
    indexer, *rest = model.stages
    labels = list(indexer.labels)
    assembler, scaler = rest[0], rest[1]
    means = dict(zip(assembler.getInputCols(), scaler.mean.toArray().tolist()))
    names_in = {c: f"__in_{c}" for c in means}
    filled = {names_in[c]: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(m)), F.lit(m)) for c, m in means.items()}
    out = df.withColumns(filled)
    rest = [assembler.copy().setInputCols(list(names_in.values())), *rest[1:]]
    for stage in rest:
        out = stage.transform(out)
    names = F.array(*[F.lit(x) for x in labels])
    picked = F.get(names, F.col("prediction").cast("int"))
    drop = ["raw_features", "features", "rawPrediction", "prediction", "probability"]
    if "probability" in out.columns:
        p = vector_to_array("probability")
        out = out.withColumns({"document_type": picked, "confidence": F.array_max(p), "probabilities": F.map_from_arrays(names, p)})
    else:
        out = out.withColumns({"document_type": picked, "confidence": F.lit(None).cast("double"), "probabilities": F.lit(None).cast("map<string,double>")})
    return out.drop(*drop, *names_in.values())


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
