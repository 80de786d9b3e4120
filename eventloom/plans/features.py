"""From cleaned logs to the labelled feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.contracts import SOURCES, WINDOW_SECONDS
from eventloom.operators.copartition import bucket_join, stored_frames
from eventloom.operators.features import add_derived, add_time_window, fill_counts
from eventloom.operators.label import add_label
from eventloom.operators.merge import join_features, role_frames, source_frames, union_features
from eventloom.operators.quality import coverage_report, feature_report
from eventloom.sources.layout import write_clustered
from eventloom.sources.tables import DEFAULT_FORMAT, read_back, read_table, write_report, write_table

MERGES = ("sources", "roles", "join", "buckets")
#: How the feature table lies on disk: by time, as it is split, then by computer.
ORDER = ["time_window", "computer"]


def merged_features(
    logs: dict[str, DataFrame],
    *,
    merge: str = "sources",
    seconds: int = WINDOW_SECONDS,
    null_times: str = "drop",
    null_keys: str = "unmatched",
    fill_means: bool = False,
) -> DataFrame:
    """One row per computer and window, absent counts zero.

    merge       "sources" folds one table per log, "roles" one per role, "join" left-joins the roles to a key list,
                "buckets" does so bucket by bucket from stored tables, without a shuffle
    null_times  "drop" leaves out events without a time, which the quality report of the log counts;
                "zero" keeps them as a row of zeros in window 0, which then has two rows for such a computer;
                "keep" keeps them with an unknown window
    null_keys   "matched" gives an unknown computer or window its features instead of zeros
    fill_means  absent means are zero too
    """
    if merge not in MERGES:
        raise ValueError(f"merge is one of {MERGES}, not {merge!r}")
    keep = {"drop": False, "zero": True, "keep": True}[null_times]
    if merge == "buckets":
        keys, stored = stored_frames(logs, seconds=seconds, null_times=keep, null_keys=null_keys)
        return fill_counts(bucket_join(keys, stored, null_keys), means=fill_means, null_window_as_zero=null_times == "zero")
    if merge == "sources":
        frames = source_frames(logs, seconds=seconds, null_times=keep, null_keys=null_keys)
    else:
        frames = role_frames(logs, seconds=seconds, null_times=keep)
    table = join_features(frames, null_keys) if merge == "join" else union_features(frames, null_keys)
    return fill_counts(table, means=fill_means, null_window_as_zero=null_times == "zero")


def feature_table(
    logs: dict[str, DataFrame],
    *,
    label: str = "next_row",
    drop_null_keys: bool = False,
    drop_censored: bool = False,
    epsilon: float | None = None,
    **options,
) -> DataFrame:
    """The 50 columns: key, features of all roles, totals and ratios, label."""
    if drop_null_keys:
        options = {**options, "null_times": "drop"}
    table = merged_features(logs, **options)
    if drop_null_keys:
        table = table.filter(F.col("computer").isNotNull())
    return add_label(add_derived(table, epsilon), label, drop_censored=drop_censored)


def build_features(
    spark: SparkSession,
    tables: str,
    output: str,
    reports: str,
    *,
    fmt: str = DEFAULT_FORMAT,
    seconds: int = WINDOW_SECONDS,
    **options,
) -> None:
    """Read the cleaned tables, write the feature table in order of time, and report on what was written."""
    logs = {s: read_table(spark, f"{tables}/{s}", fmt) for s in SOURCES}
    windows = {s: add_time_window(log, seconds=seconds).select("time_window") for s, log in logs.items()}
    write_report(coverage_report(windows), f"{reports}/window_coverage")
    table = feature_table(logs, seconds=seconds, **options)
    if fmt == DEFAULT_FORMAT:
        write_clustered(table, output, ORDER)
    else:
        write_table(table.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER), output, fmt)
    write_report(feature_report(read_back(table, output, fmt)), f"{reports}/features")
