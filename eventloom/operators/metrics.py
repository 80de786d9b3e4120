"""Classifier metrics from label, prediction and score columns, all as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.ranks import running_totals
from eventloom.sources.tables import stage


def _over(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _f1(hits: Column, predicted: Column, actual: Column) -> Column:
    return _over(2 * hits, predicted + actual)


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall and F1 of class 1."""
    actual, predicted = F.col(label) == 1, F.col(prediction) == 1
    counts = df.agg(
        F.count_if(actual & predicted).alias("hits"),
        F.count_if(predicted).alias("predicted"),
        F.count_if(actual).alias("actual"),
    )
    hits, predicted, actual = F.col("hits"), F.col("predicted"), F.col("actual")
    return counts.select(
        _over(hits, predicted).alias("precision"),
        _over(hits, actual).alias("recall"),
        _f1(hits, predicted, actual).alias("f1"),
    )


def ranking_metrics(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve and average precision; null where a class is missing.

    Rows with equal scores are one step of either curve. The steps are written once to the shared folder.
    """
    steps = stage(
        df.filter(F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives")),
        "score-steps",
    )
    curve = running_totals(steps, "score", ["positives", "negatives"])
    higher = F.col("positives_upto") - F.col("positives") + F.col("positives") / 2
    precision = F.col("positives_upto") / (F.col("positives_upto") + F.col("negatives_upto"))
    sums = curve.agg(
        F.sum(F.col("negatives") * higher).alias("pairs_won"),
        F.sum(F.col("positives") * precision).alias("precision_sum"),
        F.sum("positives").cast("double").alias("p"),
        F.sum("negatives").cast("double").alias("n"),
    )
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return sums.select(
        F.when(both, F.col("pairs_won") / (F.col("p") * F.col("n"))).alias("roc_auc"),
        F.when(both, F.col("precision_sum") / F.col("p")).alias("average_precision"),
    )


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return ranking_metrics(df, label, score).select("roc_auc")


def average_precision(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Step sum over the recall steps, not the area under the interpolated curve."""
    return ranking_metrics(df, label, score).select("average_precision")


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class, precision, recall, f1, support) per class, then accuracy, macro and weighted averages."""
    confusion = df.groupBy(F.col(label).cast("int").alias("l"), F.col(prediction).cast("int").alias("p")).agg(
        F.count("*").alias("n")
    )
    zero = F.lit(0).cast("bigint")

    def side(column: str, hits: Column, actual: Column, predicted: Column) -> Column:
        return F.struct(
            F.col(column).cast("string").alias("class"),
            hits.alias("hits"), actual.alias("actual"), predicted.alias("predicted"),
        )

    hit = F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(zero)
    sides = confusion.select(F.inline(F.array(side("l", hit, F.col("n"), zero), side("p", zero, zero, F.col("n")))))
    hits, actual, predicted = F.col("hits"), F.col("actual"), F.col("predicted")
    classes = (
        sides.groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("hits", "actual", "predicted")])
        .select(
            "class",
            _over(hits, predicted).alias("precision"),
            _over(hits, actual).alias("recall"),
            _f1(hits, predicted, actual).alias("f1"),
            actual.alias("support"),
            "hits",
        )
    )
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    averages = classes.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in names],
        *[_over(F.sum(F.col(m) * F.col("support")), total).alias(f"weighted_{m}") for m in names],
        _over(F.sum("hits"), total).alias("accuracy"),
        F.coalesce(total, zero).alias("support"),
    )

    def average(name: str, *values: Column) -> Column:
        cells = [v.cast("double").alias(m) for m, v in zip(names, values)]
        return F.struct(F.lit(name).alias("class"), *cells, F.col("support").alias("support"))

    rows = [
        average("accuracy", F.lit(None), F.lit(None), F.col("accuracy")),
        average("macro avg", *[F.col(f"macro_{m}") for m in names]),
        average("weighted avg", *[F.col(f"weighted_{m}") for m in names]),
    ]
    return classes.drop("hits").unionByName(averages.select(F.inline(F.array(*rows))))
