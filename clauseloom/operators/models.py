"""Learned alignment scores with Spark ML. Both classes must be present; nothing is guessed without a model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _both_classes(df: DataFrame, label: str) -> None:
    if df.select(label).distinct().count() < 2:
        raise ValueError("training needs rows of both classes")


def train_alignment(pairs: DataFrame, features=("similarity", "closeness"), label: str = "label", trees: int = 100) -> PipelineModel:
    """A random forest over scaled pair features."""
    _both_classes(pairs, label)
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), RandomForestClassifier(labelCol=label, numTrees=trees, seed=42)]
    return Pipeline(stages=stages).fit(pairs)


def infer(model: PipelineModel, pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose probability reaches the threshold, with similarity x confidence."""
    p = vector_to_array("probability")[1]
    return model.transform(pairs).withColumn("confidence", p).where(F.col("confidence") >= threshold).withColumn("similarity_x_confidence", F.col("similarity") * F.col("confidence")).select(*pairs.columns, "confidence", "similarity_x_confidence")


def train_text(texts: DataFrame, text: str = "text", label: str = "label", features: int = 10_000) -> PipelineModel:
    """Logistic regression on TF-IDF of one- and two-word terms, rows of unit length, classes weighted evenly."""
    _both_classes(texts, label)
    n = {r[label]: r["count"] for r in texts.groupBy(label).count().collect()}
    total = sum(n.values())
    weight = " ".join(f"WHEN {label} = {k} THEN {total / (len(n) * c)}" for k, c in n.items())
    stages = [
        RegexTokenizer(inputCol=text, outputCol="one", pattern="[\\p{L}\\p{N}_]{2,}", gaps=False), NGram(n=2, inputCol="one", outputCol="two"),
        SQLTransformer(statement=f"SELECT *, concat(one, two) AS terms, CASE {weight} ELSE 1.0 END AS class_weight FROM __THIS__"),
        CountVectorizer(inputCol="terms", outputCol="counts", vocabSize=features), IDF(inputCol="counts", outputCol="weighted"), Normalizer(inputCol="weighted", outputCol="features"),
        LogisticRegression(labelCol=label, weightCol="class_weight", maxIter=30, regParam=0.01),
    ]
    with_label = texts.withColumn(label, F.col(label).cast("int"))
    model = Pipeline(stages=stages).fit(with_label)
    return model


def predict_text(model: PipelineModel, texts: DataFrame, label: str = "label", threshold: float = 0.7) -> DataFrame:
    """Texts whose probability exceeds the threshold."""
    rows = texts if label in texts.columns else texts.withColumn(label, F.lit(0))
    return model.transform(rows).withColumn("probability_1", vector_to_array("probability")[1]).where(F.col("probability_1") > threshold).select(*texts.columns, "probability_1")


def predict_pairs(model: PipelineModel, pairs: DataFrame, left: str = "a_text", right: str = "b_text", threshold: float = 0.7) -> DataFrame:
    """Pairs whose texts, one after the other, have a probability above the threshold."""
    both = pairs.withColumn("text", F.concat_ws(" ", left, right))
    return predict_text(model, both, threshold=threshold).drop("text")


def save_model(model: PipelineModel, path: str) -> None:
    """K08."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
