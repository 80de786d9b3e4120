"""What is learned from the training rows before a model: medians, scales and class weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.contracts import LABEL
from eventloom.functions.ranks import column_groups, exact_quantiles, sketch_quantiles, union_all

PREPARED = "prepared_"


@dataclass(frozen=True)
class Preparation:
    """Per column: the median that replaces nulls, then mean and deviation to scale by.

    Three numbers per column, so they travel with the plan as constants.
    """

    medians: dict[str, float]
    means: dict[str, float]
    deviations: dict[str, float]

    @property
    def columns(self) -> list[str]:
        return list(self.medians)

    def transformer(self) -> SQLTransformer:
        """As a pipeline stage; adds a `prepared_` column per input."""
        cells = [
            f"(coalesce(CAST(`{c}` AS DOUBLE), {_number(self.medians[c])}) - {_number(self.means[c])})"
            f" / {_number(self.deviations[c])} AS `{PREPARED}{c}`"
            for c in self.columns
        ]
        return SQLTransformer(statement=f"SELECT *, {', '.join(cells)} FROM __THIS__")


def _number(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def medians(df: DataFrame, columns: list[str], exact: bool = True) -> dict[str, float]:
    """Medians, exact or from a sketch in one pass; a column without any value has none and is left out."""
    find = exact_quantiles if exact else sketch_quantiles
    found = {r.column_name: r.quantile for r in find(df, columns, [0.5]).collect()}  # a row per column
    return {c: found[c] for c in columns if c in found}


def impute_median(df: DataFrame, columns: list[str], fitted: dict[str, float] | None = None) -> DataFrame:
    """Replace nulls by the column's median, and leave out columns that have none."""
    fitted = medians(df, columns) if fitted is None else fitted
    gone = [c for c in columns if c not in fitted]
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in fitted.items()}
    return df.withColumns(filled).drop(*gone)


def scales(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation; a constant column gets deviation 1, so it scales to 0."""
    if not columns:
        return {}
    found = []
    for group in column_groups(columns):
        row = df.agg(*[m for i, c in enumerate(group) for m in (F.avg(c).alias(f"mean_{i}"), F.stddev_pop(c).alias(f"std_{i}"))])
        cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"mean_{i}").alias("mean"), F.col(f"std_{i}").alias("std")) for i, c in enumerate(group)]
        found.append(row.select(F.inline(F.array(*cells))))
    measured = {r.column_name: (r["mean"], r["std"] or 1.0) for r in union_all(found).collect()}  # a row per column
    return {c: measured[c] for c in columns}


def standardise(df: DataFrame, columns: list[str], fitted: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Zero mean and unit population deviation."""
    fitted = scales(df, columns) if fitted is None else fitted
    return df.withColumns({c: (F.col(c) - F.lit(mean)) / F.lit(std) for c, (mean, std) in fitted.items()})


def fit_preparation(train: DataFrame, columns: list[str], exact: bool = True) -> Preparation:
    middle = medians(train, columns, exact)
    spread = scales(impute_median(train, columns, middle).select(*middle), list(middle))
    return Preparation(middle, {c: m for c, (m, _) in spread.items()}, {c: s for c, (_, s) in spread.items()})


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """(label, count, weight): n / (classes * count), so all classes weigh the same in sum."""
    counts = df.groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("count"))
    every = Window.partitionBy()  # a row per class
    weight = F.sum("count").over(every) / (F.count("*").over(every) * F.col("count"))
    return counts.withColumn("weight", weight)


def weight_column(df: DataFrame, label: str = LABEL) -> Column:
    """The weight of each row of a 0/1 label as an expression over two constants."""
    found = {r.label: r.weight for r in class_weights(df, label).filter("label IN (0, 1)").collect()}  # two rows
    return F.when(F.col(label) == 1, F.lit(found.get(1, 1.0))).otherwise(F.lit(found.get(0, 1.0)))
