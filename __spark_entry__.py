
from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.checks import oracles
from eventloom.contracts import CONTRACTS, LABEL, SCHEMAS, SOURCES, feature_columns
from eventloom.functions.columns import coerce_numeric
from eventloom.functions.ranks import union_all
from eventloom.operators import export, features, inspect, label, merge, metrics, model, prepare, quality, sketches, split
from eventloom.operators.clean import clean, ensure_success_flag, trim_strings
from eventloom.plans.features import ORDER, feature_table, merged_features
from eventloom.plans.runs import FeatureRuns
from eventloom.plans.train import train_models
from eventloom.sources import layout, raw, refused, tables
from eventloom.sources.retail import labelled_scores, log_columns, read_log

Query = Callable[[SparkSession, str], DataFrame]


def _log(spark: SparkSession, directory: str, source: str) -> DataFrame:
    return clean(read_log(spark, directory, source), source)


def _logs(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    return {s: _log(spark, directory, s) for s in SOURCES}


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles computed in another order differ in the last bits, so both sides are rounded."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _tagged(frames: dict[str, DataFrame], name: str = "table_name") -> DataFrame:
    return union_all([df.select(F.lit(t).alias(name), "*") for t, df in frames.items()])


def _per_log(check: Callable[[DataFrame, str], DataFrame], digits: int = 9) -> Query:
    """The check on each of the five cleaned logs."""
    return lambda spark, d: _rounded(_tagged({s: check(df, s) for s, df in _logs(spark, d).items()}), digits)


def _on_features(use: Callable[[DataFrame], DataFrame], digits: int = 9) -> Query:
    return lambda spark, d: _rounded(use(_rounded(feature_table(_logs(spark, d)))), digits)


def _on_scores(metric: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: _rounded(
        _tagged({n: metric(labelled_scores(spark, d, n)) for n in ("toxic", "quality")}, "label_name")
    )


def _role(name: str) -> Query:
    source = features.ROLES[name].source
    return lambda spark, d: _rounded(features.role_features(_log(spark, d, source), name))


def _merged(**options) -> Query:
    return lambda spark, d: _rounded(merged_features(_logs(spark, d), **options))


def _cleaned(source: str) -> Query:
    return lambda spark, d: _log(spark, d, source)


# --- scans and sinks -----------------------------------------------------------------------------------------------


def raw_scan(spark: SparkSession, directory: str) -> DataFrame:
    path = tables.scratch_path(spark, "raw-auth")
    read_log(spark, directory, "auth").write.option("compression", "gzip").csv(path)
    return clean(raw.read_raw(spark, "auth", path), "auth")


def refused_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Flows as text with planted bad lines: how many rows are kept and refused, and why."""
    key = F.col("l_orderkey") % 50
    source = spark.read.parquet(f"{directory}/lineitem.parquet")
    fields = [F.coalesce(F.expr(text).cast("string"), F.lit("")) for text in log_columns("flows").values()]
    fields[0] = F.when(key == 2, F.concat(F.lit("x"), fields[0])).otherwise(fields[0])
    line = F.concat_ws(",", *fields)
    cut = F.when(key == 0, F.concat(line, F.lit(",more"))).when(key == 1, F.regexp_replace(line, ",[^,]*$", "")).otherwise(line)
    path, split_path = (tables.scratch_path(spark, n) for n in ("flows-text", "flows-split"))
    source.select(cut.alias("value")).write.text(path)
    refused.write_split(refused.parsed_or_refused(spark, "flows", path), split_path)
    kept = refused.read_kept(spark, split_path, "flows").agg(
        F.lit("kept").alias("verdict"), F.lit(None).cast("string").alias("reason"), F.count("*").alias("lines"), F.sum("byte_count").alias("bytes")
    )
    bad = refused.read_refused(spark, split_path).groupBy("reason").agg(F.count("*").alias("lines"))
    return kept.unionByName(bad.withColumn("verdict", F.lit("refused")), allowMissingColumns=True)


def io_roundtrip(spark: SparkSession, directory: str) -> DataFrame:
    table = feature_table(_logs(spark, directory))
    path = tables.scratch_path(spark, "features")
    tables.write_table(table, path)
    return _rounded(tables.read_back(table, path))


def csv_export(spark: SparkSession, directory: str) -> DataFrame:
    path = tables.scratch_path(spark, "flows-csv")
    tables.export_csv(_log(spark, directory, "flows"), path)
    return tables.read_csv_export(spark, path, SCHEMAS["flows"])


def json_report(spark: SparkSession, directory: str) -> DataFrame:
    path = tables.scratch_path(spark, "report")
    tables.write_report(quality.log_report(_log(spark, directory, "flows"), "flows", exact_quantile=True), path)
    return _rounded(spark.read.schema("table_name STRING, check STRING, column_name STRING, metric STRING, value DOUBLE, text STRING").json(path), 6)


def sample_profile(spark: SparkSession, directory: str) -> DataFrame:
    """What does not depend on which rows come first."""
    found = union_all([inspect.sample_profile(df, s) for s, df in _logs(spark, directory).items()])
    return found.select("table_name", "column_name", "data_type", "sampled_rows")


def random_sample(spark: SparkSession, directory: str) -> DataFrame:
    """The size of each sample, and whether it is within five deviations of the expected one."""
    share = raw.SAMPLE_FRACTION
    found = {}
    for s, df in _logs(spark, directory).items():
        sampled = raw.random_rows(df).agg(F.count("*")).scalar()
        spread = 5 * F.sqrt(F.col("total_rows") * share * (1 - share))
        near = (F.abs(sampled - share * F.col("total_rows")) <= spread).alias("as_expected")
        found[s] = df.agg(F.count("*").alias("total_rows")).select("total_rows", near)
    return _tagged(found)


# --- columns -------------------------------------------------------------------------------------------------------


def time_window(spark: SparkSession, directory: str) -> DataFrame:
    return _tagged(
        {s: features.add_time_window(df).select("time", "time_window") for s, df in _logs(spark, directory).items()}, "source"
    )


def success_flag_if_missing(spark: SparkSession, directory: str) -> DataFrame:
    return features.with_event_flags(ensure_success_flag(trim_strings(read_log(spark, directory, "auth"))), "auth")


def coerced(spark: SparkSession, directory: str) -> DataFrame:
    ports = ["src_port", "dst_port", "byte_count"]
    return coerce_numeric(_log(spark, directory, "flows").select("time", *ports), ports)


def _role_frames(spark: SparkSession, directory: str) -> list[DataFrame]:
    return merge.role_frames(_logs(spark, directory))


def join_null_safe(spark: SparkSession, directory: str) -> DataFrame:
    joined = merge.join_features(_role_frames(spark, directory), null_keys="matched")
    return _rounded(features.fill_counts(joined, means=True))


def _derived(epsilon: float | None, columns: list[str]) -> Query:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        table = features.add_derived(merged_features(_logs(spark, directory)), epsilon)
        chosen = table.select("computer", "time_window", *columns)
        return chosen if epsilon else _rounded(chosen)  # shifted ratios end in a 5 where rounding would cut them

    return run


RATIOS = ["auth_failure_ratio", "flows_bytes_per_event", "flows_packets_per_event"]
DERIVED = ["auth_total_events", "auth_total_failures", "auth_total_successes", "flows_total_events", "flows_total_bytes",
           "flows_total_packets", "redteam_event_count", "redteam_current_flag"]


def _labelled(**options) -> Query:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        table = features.add_derived(merged_features(_logs(spark, directory)))
        labelled = label.add_label(table.select("computer", "time_window", "redteam_current_flag"), **options)
        return labelled.select("computer", "time_window", "redteam_current_flag", LABEL)

    return run


# --- tables that grow, and tables laid out by time ---------------------------------------------------------------------


def feature_runs_mixed(spark: SparkSession, directory: str) -> DataFrame:
    """The feature table of two runs whose events are in the same windows."""
    runs, half = FeatureRuns(spark, tables.scratch_path(spark, "runs")), F.pmod(F.xxhash64("time"), F.lit(2))
    for n in (0, 1):
        runs.add(f"half-{n}", {s: df.filter(half == n) for s, df in _logs(spark, directory).items()})
    return _rounded(runs.table())


def label_runs_in_order(spark: SparkSession, directory: str) -> DataFrame:
    """Labels after a later run, which is added twice."""
    runs, logs = FeatureRuns(spark, tables.scratch_path(spark, "runs")), _logs(spark, directory)
    cut = 15 * 24 * 3600 + 1800  # in the middle of a window
    runs.add("early", {s: df.filter(F.col("time") < cut) for s, df in logs.items()})
    for _ in range(2):
        runs.add("late", {s: df.filter(F.col("time") >= cut) for s, df in logs.items()})
    return runs.table().select("computer", "time_window", "redteam_current_flag", LABEL)


def clustered_parts(spark: SparkSession, directory: str) -> DataFrame:
    """Each part of the split from the files that can hold it, and whether others were left closed."""
    path = tables.scratch_path(spark, "clustered")
    layout.write_clustered(feature_table(_logs(spark, directory)), path, ORDER, files=12)
    cuts = split.time_cuts(spark.read.parquet(path))
    found = []
    for name in split.SPLITS:
        part = split.read_part(spark, path, cuts, name)
        opened = F.lit(len(part.inputFiles()) < layout.read_layout(spark, path).count()).alias("files_skipped")
        sums = [F.sum(c).alias(c) for c in ("auth_total_events", "flows_total_bytes", LABEL)]
        found.append(part.groupBy("split").agg(F.count("*").alias("count"), *sums).select("*", opened))
    return union_all(found)


# --- quality -------------------------------------------------------------------------------------------------------


def dq_overview(spark: SparkSession, directory: str) -> DataFrame:
    shapes = union_all([quality.overview(df, s) for s, df in _logs(spark, directory).items()])
    return shapes.withColumn("columns", F.concat_ws(",", "columns"))


def _coverage(spark: SparkSession, directory: str) -> DataFrame:
    logs = {s: features.add_time_window(df).select("time_window") for s, df in _logs(spark, directory).items()}
    return quality.window_coverage(logs)


def _repeated_pairs(spark: SparkSession, directory: str) -> DataFrame:
    return _tagged({t: quality.key_duplicates(_log(spark, directory, t), k) for t, k in oracles.REPEATED.items()})


def _value_counts(spark: SparkSession, directory: str) -> DataFrame:
    return _tagged({t: quality.top_values(_log(spark, directory, t), list(cs)) for t, cs in oracles.VALUE_COUNTS.items()})


def _distinct_counts(spark: SparkSession, directory: str) -> DataFrame:
    return quality.distinct_counts(_logs(spark, directory), oracles.DISTINCT_COLUMNS)


def _approximate_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Exact counts, and whether the approximate ones are within three of their deviations (5 % each)."""
    logs, key = _logs(spark, directory), ["table_name", "column_name"]
    near = quality.distinct_counts(logs, oracles.DISTINCT_COLUMNS, approx=True).withColumnRenamed("distinct_count", "near")
    both = quality.distinct_counts(logs, oracles.DISTINCT_COLUMNS).join(near, key)
    off = F.abs(F.col("near") - F.col("distinct_count"))
    return both.select(*key, "distinct_count", (off <= 0.15 * F.col("distinct_count")).alias("within_error"))


def _approximate_quantiles(df: DataFrame, source: str) -> DataFrame:
    """Whether the rank of each sketched quantile is within 0.2 % of the rows of the one asked for."""
    found = quality.quantiles(df, exact=False).unpivot(["column_name"], list(quality.QUANTILES), "metric", "value").collect()  # five a column
    cells = []
    for r in found:
        p, value = quality.QUANTILES[r.metric], F.col(r.column_name)
        below, upto, n = F.count_if(value < r.value), F.count_if(value <= r.value), F.count(value)
        within = (below <= (p + 0.002) * n) & (upto >= (p - 0.002) * n)
        cells.append(F.struct(F.lit(r.column_name).alias("column_name"), F.lit(r.metric).alias("metric"), within.alias("within_error")))
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def _summary(spark: SparkSession, directory: str) -> DataFrame:
    columns = ["time", "duration", "packet_count", "byte_count"]
    return _rounded(quality.summarise(_log(spark, directory, "flows"), columns), 6)


def sketch_ranges(spark: SparkSession, directory: str) -> DataFrame:
    """Stored sketches merged over all days and over ten of them, held against the logs of the same time."""
    found = []
    for source, distinct in oracles.DISTINCT_COLUMNS.items():
        log = _log(spark, directory, source)
        path = tables.scratch_path(spark, "sketches")
        sketches.write_sketches(sketches.window_sketches(log, distinct), path)
        for name, first, last in (("all", None, None), ("ten_days", 240, 479)):
            window = features.time_window("time")
            rows = log if first is None else log.filter(window.between(first, last))
            held = sketches.held_against(sketches.profile_range(spark, path, first, last), rows, distinct)
            found.append(held.select(F.lit(source).alias("table_name"), F.lit(name).alias("range_name"), "*"))
    return union_all(found)


def _log_reports(spark: SparkSession, directory: str) -> DataFrame:
    reports = [quality.log_report(df, s, exact_quantile=True) for s, df in _logs(spark, directory).items()]
    return _rounded(union_all(reports), 6)


def measured_reports(spark: SparkSession, directory: str) -> DataFrame:
    """What is measured of each log while it is written, but for the quantiles, which are sketched."""
    found = []
    for s, df in _logs(spark, directory).items():
        rows, report = quality.write_measured(df, tables.scratch_path(spark, "measured"), s)
        found.append(report.filter(~F.col("metric").isin(*quality.QUANTILES)).withColumn("rows", F.lit(rows).cast("bigint")))
    return _rounded(union_all(found), 6)


def feature_report(spark: SparkSession, directory: str) -> DataFrame:
    table = tables.stage(_rounded(feature_table(_logs(spark, directory))), "features")
    return _rounded(quality.feature_report(table), 6)


# --- splits and models ---------------------------------------------------------------------------------------------


def _staged(spark: SparkSession, directory: str) -> DataFrame:
    """The feature table, written once: everything from here on reads it many times."""
    return tables.stage(feature_table(_logs(spark, directory)), "features")


def _split_summary(spark: SparkSession, directory: str) -> DataFrame:
    parts = split.time_split(_staged(spark, directory))
    window = F.col("time_window")
    return parts.groupBy("split").agg(
        F.count("*").alias("count"), F.min(window).alias("first_window"), F.max(window).alias("last_window")
    )


def _split_labels(spark: SparkSession, directory: str) -> DataFrame:
    return split.time_split(_staged(spark, directory)).groupBy("split", LABEL).count()


def _prepared(operator: Callable[[DataFrame, list[str]], DataFrame], columns: list[str]) -> Query:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        return _rounded(operator(_staged(spark, directory).select("computer", "time_window", *columns), columns), 6)

    return run


def _trained(spark: SparkSession, directory: str, estimator) -> tuple[DataFrame, object]:
    table = _staged(spark, directory)
    cuts = split.time_cuts(table)
    parts = split.time_split(table, cuts=cuts)
    train = cuts.part(table, "train")
    prepared = prepare.fit_preparation(train, feature_columns(table.columns))
    return parts, model.fit(train, prepared, estimator(train))


def _evaluated(parts: DataFrame, fitted: object) -> DataFrame:
    rows = model.even_parts(parts.filter("split IN ('valid', 'test')"))
    predictions = model.predict(rows, fitted, ["split", LABEL])
    stored = tables.stage(predictions, "predictions")
    return union_all([
        model.evaluate(stored.filter(F.col("split") == s)).select(F.lit(s).alias("split"), "metric", "value")
        for s in ("valid", "test")
    ])


def _logistic(train: DataFrame):
    return model.logistic_regression(train.count())


#: The largest component of the gradient of the loss per row that a fit may end with.
GRADIENT_BOUND = 1e-4


def train_logistic(spark: SparkSession, directory: str) -> DataFrame:
    """The inputs of the fitted regression, and whether the penalised loss is at its optimum in each."""
    parts, fitted = _trained(spark, directory, _logistic)
    train = parts.filter("split = 'train'")
    found = export.gradient(train, fitted).withColumn("at_optimum", F.abs("gradient") <= GRADIENT_BOUND)
    return found.select("input", F.col("rows").alias("train_rows"), "at_optimum")


def logistic_metrics(spark: SparkSession, directory: str) -> DataFrame:
    return _evaluated(*_trained(spark, directory, _logistic))


def train_forest(spark: SparkSession, directory: str) -> DataFrame:
    return _evaluated(*_trained(spark, directory, lambda train: model.random_forest()))


def forest_splits(spark: SparkSession, directory: str) -> DataFrame:
    """The trees of a forest, splits of nodes with too few rows, and rows that it scores."""
    parts, fitted = _trained(spark, directory, lambda train: model.random_forest(trees=8, depth=12))
    path = tables.scratch_path(spark, "forest")
    fitted.write().save(path)
    nodes = model.forest_nodes(spark, path)
    small = (F.col("left") >= 0) & (F.col("rows") < model.SPLIT_ROWS)
    counts = nodes.agg(F.countDistinct("tree").alias("trees"), F.count_if(small).alias("small_splits"))
    scored = model.predict(parts.filter("split = 'test'"), fitted, []).agg(F.count_if(F.col("score").between(0, 1)).alias("scored_rows"))
    return counts.join(F.broadcast(scored))  # a row each


def select_best(spark: SparkSession, directory: str) -> DataFrame:
    """Both models trained, measured, stored and compared; the better one with its score."""
    path = tables.scratch_path(spark, "features")
    tables.write_table(feature_table(_logs(spark, directory)), path)
    return train_models(spark, path, tables.scratch_path(spark, "training")).select("model", "metric", "value")


def batch_score(spark: SparkSession, directory: str) -> DataFrame:
    """Scored rows, and whether each probability is what the exported SQL of the model says."""
    parts, fitted = _trained(spark, directory, _logistic)
    rows = parts.filter("split = 'test'").drop("split", LABEL, "dns_lookup_count")  # an absent input counts as 0
    key = ["computer", "time_window"]
    scored = tables.stage(model.score(rows, fitted, model.LOGISTIC, key), "scored")
    tables.stage(rows.withColumn("dns_lookup_count", F.lit(0.0)), "to-score").createOrReplaceTempView("rows_to_score")
    exported = spark.sql(export.score_sql(fitted, "rows_to_score")).select(*[F.col(k).alias(f"x_{k}") for k in key], "probability")
    same = [F.col(k).eqNullSafe(F.col(f"x_{k}")) for k in key]
    agrees = F.abs(F.col(model.PROBABILITY) - F.col("probability")) <= 1e-9
    predicted = F.col("prediction") == F.when(F.col("probability") > 0.5, 1).otherwise(0)
    return scored.join(exported, same).select(*key, "model_name", (agrees & predicted).alias("as_exported"))


# --- registry ------------------------------------------------------------------------------------------------------

QUERIES: dict[str, Query] = {
    "raw_scan": raw_scan,
    "refused_lines": refused_lines,
    "trim_strings": lambda spark, d: trim_strings(read_log(spark, d, "proc")),
    **{f"clean_{s}": _cleaned(s) for s in SOURCES},
    "success_flag_if_missing": success_flag_if_missing,
    "coerce_numeric": coerced,
    "time_window": time_window,
    "auth_src_features": _role("auth_src"),
    "auth_dst_features": _role("auth_dst"),
    "flows_out_features": _role("flows_out"),
    "flows_in_features": _role("flows_in"),
    "dns_features": _role("dns"),
    "proc_features": _role("proc"),
    "redteam_src": _role("redteam_src"),
    "redteam_dst": _role("redteam_dst"),
    "keyspace": lambda spark, d: features.keyspace(_role_frames(spark, d)),
    "feature_join": _merged(merge="buckets"),
    "feature_join_shuffled": _merged(merge="join"),
    "feature_union_merge": _merged(merge="roles"),
    "feature_source_merge": _merged(merge="sources"),
    "feature_join_null_safe": _merged(merge="buckets", null_keys="matched", fill_means=True),
    "feature_join_null_safe_shuffled": join_null_safe,
    "derived_features": _derived(None, DERIVED + RATIOS),
    "epsilon_ratios": _derived(1e-9, RATIOS),
    "label_next_row": _labelled(),
    "label_adjacent": _labelled(mode="adjacent"),
    "label_uncensored": _labelled(drop_censored=True),
    "feature_table": _on_features(lambda table: table),
    "feature_table_known_computers": lambda spark, d: _rounded(feature_table(_logs(spark, d), drop_null_keys=True)),
    "feature_table_draft": lambda spark, d: feature_table(
        _logs(spark, d), null_times="keep", null_keys="matched", fill_means=True, epsilon=1e-9
    ).select("computer", "time_window", *[F.round(m, 9).alias(m) for m in oracles.MEANS], *DERIVED, *RATIOS, LABEL),
    "feature_selection": _on_features(lambda table: table.select(*feature_columns(table.columns))),
    "feature_runs_mixed": feature_runs_mixed,
    "label_runs_in_order": label_runs_in_order,
    "clustered_parts": clustered_parts,
    "io_roundtrip": io_roundtrip,
    "csv_export": csv_export,
    "json_report": json_report,
    "sample_profile": sample_profile,
    "random_sample": random_sample,
    "dq_overview": dq_overview,
    "dq_missing": _per_log(lambda df, s: quality.missing_values(df)),
    "dq_full_row_duplicates": _per_log(lambda df, s: quality.row_duplicates(df, CONTRACTS[s].computed)),
    "dq_key_duplicates": _per_log(lambda df, s: quality.key_duplicates(df, list(CONTRACTS[s].key))),
    "dq_repeated_pairs": _repeated_pairs,
    "dq_key_duplicate_samples": lambda spark, d: quality.key_duplicate_samples(_log(spark, d, "flows"), oracles.REPEATED["flows"]),
    "dq_time_horizon": _per_log(lambda df, s: quality.time_horizon(df)),
    "dq_numeric": _per_log(lambda df, s: quality.numeric_moments(df), 6),
    "dq_quantiles_exact": _per_log(lambda df, s: quality.quantiles(df), 6),
    "dq_quantiles_approx": _per_log(_approximate_quantiles),
    "dq_skew": _per_log(lambda df, s: quality.skewness(df), 6),
    "dq_source_overlap": _coverage,
    "dq_feature_horizon": _on_features(lambda table: quality.window_coverage({"features": table})),
    "dq_label_distribution": _on_features(quality.distribution),
    "dq_flag_distribution": _on_features(lambda table: quality.distribution(table, "redteam_current_flag")),
    "dq_value_counts": _value_counts,
    "dq_event_types": lambda spark, d: quality.distribution(_log(spark, d, "proc"), "event_type"),
    "dq_distinct_counts": _distinct_counts,
    "dq_distinct_counts_approx": _approximate_counts,
    "dq_summary": _summary,
    "dq_sketch_ranges": sketch_ranges,
    "dq_log_reports": _log_reports,
    "dq_measured_reports": measured_reports,
    "dq_feature_report": feature_report,
    "time_split": _split_summary,
    "split_label_distribution": _split_labels,
    "impute_median": _prepared(prepare.impute_median, oracles.IMPUTED),
    "standardise": _prepared(prepare.standardise, oracles.SCALED),
    "class_weights": _on_features(prepare.class_weights),
    "binary_metrics": _on_scores(metrics.binary_metrics),
    "roc_auc": _on_scores(metrics.roc_auc),
    "average_precision": _on_scores(metrics.average_precision),
    "classification_report": _on_scores(metrics.classification_report),
    "train_logistic": train_logistic,
    "logistic_metrics": logistic_metrics,
    "train_forest": train_forest,
    "forest_splits": forest_splits,
    "select_best": select_best,
    "batch_score": batch_score,
}


ORACLES = oracles.oracle_sql()

try:
    import corpus_pipeline
    from eventloom.llm import queries as corpus
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "eventloom.llm"):
        raise
else:
    QUERIES |= corpus.QUERIES | {"pipeline": corpus_pipeline.run}
    ORACLES |= corpus.ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})


def entry(spark: SparkSession) -> DataFrame:
    """The labelled feature table."""
    return QUERIES["feature_table"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
