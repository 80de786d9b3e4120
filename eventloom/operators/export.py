"""Fitted models as plain expressions: a score that any SQL engine can compute, and how far a fit is from its optimum."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.contracts import LABEL
from eventloom.operators.model import feature_names
from eventloom.operators.prepare import PREPARED, weight_column


def coefficients(model: PipelineModel) -> tuple[float, dict[str, float]]:
    """(intercept, coefficient of each prepared input) of a fitted logistic regression."""
    fitted = model.stages[-1]
    if not isinstance(fitted, LogisticRegressionModel):
        raise TypeError(f"{type(fitted).__name__} has no coefficients")
    return float(fitted.intercept), dict(zip(feature_names(model), map(float, fitted.coefficients.toArray())))


def margin(model: PipelineModel) -> Column:
    """The linear score over `prepared_` columns, summed in the order of the inputs."""
    intercept, weights = coefficients(model)
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(weight) * F.col(f"{PREPARED}{name}")
    return total + F.lit(intercept)


def probability(model: PipelineModel) -> Column:
    return 1 / (1 + F.exp(-margin(model)))


def prepared_rows(df: DataFrame, model: PipelineModel) -> DataFrame:
    """`df` with the `prepared_` inputs of the model, as its first stage makes them."""
    return model.stages[0].transform(df)


def score_sql(model: PipelineModel, table: str) -> str:
    """A query for the probability of each row of `table`, without this library: medians, scales, weights and all."""
    intercept, weights = coefficients(model)
    terms = " + ".join(f"CAST('{w!r}' AS DOUBLE) * `{PREPARED}{c}`" for c, w in weights.items())
    prepared = model.stages[0].getStatement().replace("__THIS__", table)
    return f"SELECT *, 1 / (1 + exp(-({terms} + CAST('{intercept!r}' AS DOUBLE)))) AS probability FROM ({prepared})"


def gradient(train: DataFrame, model: PipelineModel, label: str = LABEL) -> DataFrame:
    """(input, gradient, rows) of the penalised, class-weighted loss per row at the fitted weights; the intercept comes last.

    All components are sums over the rows in a single aggregate. At the optimum each is zero.
    """
    intercept, weights = coefficients(model)
    rows = prepared_rows(train.withColumn("weight", weight_column(train, label)), model)
    miss = F.col("weight") * (probability(model) - F.col(label).cast("double"))
    sums = [F.sum(miss * F.col(f"{PREPARED}{c}")).alias(f"g_{i}") for i, c in enumerate(weights)]
    row = rows.agg(*sums, F.sum(miss).alias("g_intercept"), F.count("*").alias("rows"))
    cells = [
        F.struct(F.lit(c).alias("input"), ((F.col(f"g_{i}") + F.lit(w)) / F.col("rows")).alias("gradient"), "rows")
        for i, (c, w) in enumerate(weights.items())
    ]
    cells.append(F.struct(F.lit("(intercept)").alias("input"), (F.col("g_intercept") / F.col("rows")).alias("gradient"), "rows"))
    return row.select(F.inline(F.array(*cells)))
