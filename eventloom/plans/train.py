"""From the feature table to evaluated, stored models and a chosen one; and scoring with it."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from eventloom.contracts import FEATURE_KEY, LABEL, REDTEAM_NOW, feature_columns
from eventloom.functions.ranks import union_all
from eventloom.operators.metrics import classification_report
from eventloom.operators.model import (
    FOREST,
    FOREST_DEPTH,
    LOGISTIC,
    TREES,
    evaluate,
    even_parts,
    fit,
    logistic_regression,
    predict,
    random_forest,
    score,
    select_best,
)
from eventloom.operators.prepare import fit_preparation
from eventloom.operators.quality import distribution
from eventloom.operators.split import SPLITS, TimeCuts, read_part, time_cuts, time_split
from eventloom.sources.tables import DEFAULT_FORMAT, read_table, write_report, write_table


def model_inputs(table: DataFrame) -> tuple[list[str], list[str]]:
    """The numeric inputs of a model, and those that are left out for not being numbers."""
    columns = feature_columns(table.columns)
    numeric = [c for c in columns if isinstance(table.schema[c].dataType, NumericType)]
    return numeric, [c for c in columns if c not in numeric]


def labelled_splits(table: DataFrame) -> tuple[DataFrame, TimeCuts, dict[str, dict[int, int]]]:
    """The table with its `split`, the cuts, and the label counts of each part; an empty part is an error."""
    cuts = time_cuts(table)
    parts = time_split(table, cuts=cuts)
    counts = parts.filter("split IS NOT NULL").groupBy("split", F.col(LABEL).cast("int").alias("label")).count()
    found: dict[str, dict[int, int]] = {s: {} for s in SPLITS}
    for row in counts.collect():  # a row per part and class
        found[row["split"]][row["label"]] = row["count"]
    empty = [s for s, labels in found.items() if not labels]
    if empty:
        raise ValueError(f"no rows in the {' and '.join(empty)} part: too few time windows")
    return parts, cuts, found


def train_models(
    spark: SparkSession,
    features: str,
    output: str,
    *,
    run: str | None = None,
    fmt: str = DEFAULT_FORMAT,
    trees: int = TREES,
    depth: int = FOREST_DEPTH,
    exact_medians: bool = True,
) -> DataFrame:
    """Fit both models on the first 60 % of the windows, measure them on the next two parts, keep the better one.

    Written below `output`/run=<run>: models/<name> (fitted pipelines), predictions, reports, metrics, parameters; so
    runs do not mix. `output`/best names the chosen model of the latest run.
    """
    run = run or uuid.uuid4().hex
    table = read_table(spark, features, fmt)
    columns, left_out = model_inputs(table)
    parts, cuts, labels = labelled_splits(table)
    output, top = f"{output}/run={run}", output
    part_labels = parts.filter("split IS NOT NULL").select(F.concat_ws("/", "split", LABEL).alias("part_label"))
    write_report(distribution(part_labels, "part_label"), f"{output}/label_distribution")
    train, valid, test = (read_part(spark, features, cuts, name, fmt) for name in SPLITS)
    prepared = fit_preparation(train, columns, exact_medians)
    estimators = {
        LOGISTIC: logistic_regression(sum(labels["train"].values())),
        FOREST: random_forest(trees, depth),
    }
    later = even_parts(valid.unionByName(test))

    def fit_and_predict(name: str) -> None:
        fitted = fit(train, prepared, estimators[name], path=f"{output}/models/{name}")
        write_table(predict(later, fitted, [*FEATURE_KEY, "split", LABEL]), f"{output}/predictions/{name}", fmt)

    with ThreadPoolExecutor(len(estimators)) as pool:  # the passes of the regression are short, the trees take long
        list(pool.map(fit_and_predict, estimators))
    for position, name in enumerate(estimators):
        stored = read_table(spark, f"{output}/predictions/{name}", fmt)
        measured, reports = [], []
        for split in ("valid", "test"):
            part = stored.filter(F.col("split") == split)
            tags = {"run": run, "model": name, "position": position, "split": split}
            labelled = [F.lit(v).alias(k) for k, v in tags.items()]
            measured.append(evaluate(part).select(*labelled, "metric", "value"))
            reports.append(classification_report(part, LABEL).select(*labelled, "*"))
        write_table(union_all(measured), f"{output}/metrics", fmt, mode="append" if position else "overwrite")
        write_table(union_all(reports), f"{output}/reports/{name}", fmt)
        write_table(_parameters(spark, run, name, columns, left_out), f"{output}/parameters", fmt, mode="append" if position else "overwrite")

    best = select_best(read_table(spark, f"{output}/metrics", fmt))
    path = F.concat(F.lit(f"{output}/models/"), "model")
    write_table(best.select("run", "model", "metric", "value", path.alias("model_path")).coalesce(1), f"{top}/best", fmt)
    return read_table(spark, f"{top}/best", fmt)


def _parameters(spark: SparkSession, run: str, name: str, columns: list[str], left_out: list[str]) -> DataFrame:
    """Run settings as (run, model, name, value) rows."""
    # Names of the settings, and how the split is called.
    settings = {
        "model_name": name,
        "target_column": LABEL,
        "feature_count": str(len(columns)),
        "split_strategy": "time_aware_60_20_20",
        "leakage_columns_removed": ",".join(REDTEAM_NOW),
        "non_numeric_columns_removed": ",".join(left_out),
    }
    rows = [F.struct(F.lit(k).alias("name"), F.lit(v).alias("value")) for k, v in settings.items()]
    return spark.range(1).select(F.lit(run).alias("run"), F.lit(name).alias("model"), F.inline(F.array(*rows)))


def score_table(df: DataFrame, output: str, fmt: str = DEFAULT_FORMAT, keep: list[str] | None = None) -> DataFrame:
    """Score rows with the model `train_models` kept below `output`."""
    best = read_table(df.sparkSession, f"{output}/best", fmt).first()
    return score(df, PipelineModel.load(best["model_path"]), best["model"], keep)
