"""Credit-limit rule and fraud score over card transactions."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capledger.functions.scalars import alert_label

FEATURES = ["transaction_amount", "credit_limit"]
LABEL = "is_fraud_label"


def is_breach() -> Column:
    """Strictly above the limit; an unknown limit is no breach."""
    return F.col("transaction_amount") > F.col("credit_limit")


def breaches(transactions: DataFrame, breached_at: Column) -> DataFrame:
    return transactions.where(is_breach()).select(
        "transaction_id", "cardholder_id", "transaction_amount", "credit_limit", breached_at.alias("breached_at")
    )


def breach_by_cardholder(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("cardholder_id").agg(
        F.count("*").alias("n"), F.count_if(is_breach()).alias("breaches")
    )


def transaction_feed(transactions: DataFrame, limit: int = 30) -> DataFrame:
    return (
        transactions.orderBy(F.desc("transaction_time"), F.desc("transaction_id"))
        .limit(limit)
        .select("transaction_id", "cardholder_id", "transaction_amount", "credit_limit", "transaction_time")
    )


def feed_metrics(transactions: DataFrame, flagged: Column, flagged_name: str) -> DataFrame:
    """Count, average amount (exact sum, then one division) and flagged count."""
    return transactions.agg(
        F.count("*").alias("total_count"),
        (F.sum("transaction_amount").cast("double") / F.count("transaction_amount")).alias("avg_amount"),
        F.count_if(flagged).alias(flagged_name),
    )


def train(transactions: DataFrame) -> PipelineModel:
    """Logistic regression on amount and limit.

    Rows with equal features and label enter the loss alike, so they are counted
    first and weighted by that count: the passes over the data run on distinct
    (amount, limit, label) combinations instead of every transaction.
    """
    combinations = (
        transactions.dropna(subset=[*FEATURES, LABEL])
        .groupBy(*FEATURES, LABEL)
        .agg(F.count("*").cast("double").alias("weight"))
    )
    stages = [
        VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep"),
        LogisticRegression(labelCol=LABEL, weightCol="weight", tol=1e-12, maxIter=500),
    ]
    return Pipeline(stages=stages).fit(combinations)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(model: PipelineModel, transactions: DataFrame) -> DataFrame:
    """Input columns, the predicted label, and the fraud probability where it is 1.

    Every input row stays; one without amount or limit has a NULL label and score and the
    alert of an ordinary transaction.
    """
    known = F.col(FEATURES[0]).isNotNull() & F.col(FEATURES[1]).isNotNull()
    likely = F.when(F.col("prediction") == 1, vector_to_array("probability")[1]).otherwise(F.lit(0.0))
    return model.transform(transactions).select(
        *transactions.columns,
        F.when(known, F.col("prediction").cast("int")).alias("predicted_label"),
        F.when(known, likely).alias("fraud_score"),
        alert_label(F.when(known, likely)).alias("alert"),
    )


def class_probabilities(model: PipelineModel, transactions: DataFrame) -> DataFrame:
    """``transaction_id, ordinary, fraud``: the probability of either class; NULL without amount or limit."""
    known = F.col(FEATURES[0]).isNotNull() & F.col(FEATURES[1]).isNotNull()
    both = vector_to_array("probability")
    return model.transform(transactions).select(
        "transaction_id", F.when(known, both[0]).alias("ordinary"), F.when(known, both[1]).alias("fraud")
    )


def scored_feed(model: PipelineModel, transactions: DataFrame, limit: int = 30) -> DataFrame:
    """Latest transactions with their score; only those are scored."""
    newest = transactions.orderBy(F.desc("transaction_time"), F.desc("transaction_id")).limit(limit)
    return score(model, newest)


def feed_or_fallback(model: PipelineModel | None, transactions: DataFrame) -> DataFrame:
    """Scored feed, or the ten newest raw rows while there is no model."""
    return transaction_feed(transactions, 10) if model is None else scored_feed(model, transactions)
